"""The record graph: the main path of a session and the branches that it left.

A session is thousands of records deep, so a join per level won't do. The parent pointers of a session of usual size (ids only, about
100 bytes a record) are walked in one Arrow group; a longer session is spread over all tasks and its chains are halved by joins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import keep

#: Records of a session up to which it is one group: about 100 MB.
MOST_IN_GROUP = 1_000_000
WALKED = "session_id string, uuid string, record_index int, on_main boolean, abandoned boolean"


def walk(uuids: list, parents: list, sidechain: list) -> tuple[list[bool], list[bool]]:
    """For records in order: whether each is on the main path, and whether it is on a branch that hangs off it.

    Of equal uuids the last record counts; cycles end a walk.
    """
    at = {u: k for k, u in enumerate(uuids) if u is not None}
    main: set[str] = set()
    tip = next((k for k in range(len(uuids) - 1, -1, -1) if uuids[k] is not None and not sidechain[k]), None)
    while tip is not None and uuids[tip] not in main:
        main.add(uuids[tip])
        tip = at.get(parents[tip])
    known: dict[str, bool] = dict.fromkeys(main, False)
    for start in at:
        path, here, found = [], start, False
        seen: set[str] = set()
        while here is not None and here not in seen:
            if here in known:
                found = known[here]
                break
            seen.add(here)
            path.append(here)
            parent = parents[at[here]] if here in at else None
            if parent in main:
                found = True
                break
            here = parent if parent in at else None
        known.update(dict.fromkeys(path, found))
    return [u in main for u in uuids], [bool(main) and u is not None and known.get(u, False) for u in uuids]


def _in_groups(narrow: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("record_index")
        main, left = walk(*(table.column(c).to_pylist() for c in ("uuid", "parent", "is_sidechain")))
        return pa.table({"session_id": table.column("session_id"), "uuid": table.column("uuid"), "record_index": table.column("record_index"), "on_main": pa.array(main), "abandoned": pa.array(left)})

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return narrow.groupBy("session_id").applyInArrow(run, WALKED)


def by_doubling(narrow: DataFrame) -> DataFrame:
    """The same by pointers that reach twice as far each round, each round two joins on (session, node); no session is ever in one task.

    A node is the last record of its uuid. The main path is the tip and its ancestors: after k rounds the first 2^k of them are known, as
    each known one names the one 2^k further up. Off it, each node's pointer is replaced by its pointer's until it is on the path or ends.
    A chain of n nodes takes log2(n) rounds; what still points somewhere after as many rounds as all nodes need goes round a cycle.
    """
    key = F.coalesce(F.concat(F.lit("s"), "session_id"), F.lit("n"))
    recs = keep(narrow.withColumn("s", key), "graph-records")
    last = recs.where("uuid IS NOT NULL").groupBy("s", "uuid").agg(F.max(F.struct("record_index", "parent")).alias("r")).select("s", "uuid", F.col("r.record_index").alias("node"), "r.parent")
    names = last.select("s", F.col("uuid").alias("parent"), F.col("node").alias("up"))
    nodes = keep(last.join(names, ["s", "parent"], "left").select("s", "uuid", "node", "up"), "graph-nodes")
    tip = recs.where("uuid IS NOT NULL AND NOT is_sidechain").groupBy("s").agg(F.max(F.struct("record_index", "uuid", "parent")).alias("r"))
    tip = tip.select("s", F.col("r.uuid").alias("uuid"), F.col("r.parent").alias("parent")).join(names, ["s", "parent"], "left")
    tip = keep(tip.join(nodes.select("s", "uuid", "node"), ["s", "uuid"]).select("s", "node", "up"), "graph-tips")
    # A walk that comes back to the tip ends there.
    jump = nodes.where("up IS NOT NULL").select("s", "node", "up").join(tip.select("s", "node"), ["s", "node"], "left_anti")
    main = tip.where("up IS NOT NULL").select("s", F.col("up").alias("node"))
    fresh = main
    while True:
        reached = main.join(jump, ["s", "node"]).select("s", F.col("up").alias("node")).distinct()
        fresh = keep(reached.join(main, ["s", "node"], "left_anti"), "graph-main")
        if fresh.isEmpty():
            break
        main = keep(main.union(fresh), "graph-main")
        further = jump.select("s", F.col("node").alias("up"), F.col("up").alias("_up"))
        jump = keep(jump.join(further, ["s", "up"]).select("s", "node", F.col("_up").alias("up")), "graph-jumps")
    main = keep(main.union(tip.select("s", "node")).distinct(), "graph-main").withColumn("_main", F.lit(True))
    off = nodes.join(main, ["s", "node"], "left_anti").where("up IS NOT NULL").select("s", "node", "up")
    off = off.join(main.withColumnRenamed("node", "up"), ["s", "up"], "left").select("s", "node", "up", F.coalesce("_main", F.lit(False)).alias("hit"))
    off = keep(off, "graph-off")
    rounds = max(1, off.count()).bit_length() + 1
    for _ in range(rounds):
        if off.where("NOT hit AND up IS NOT NULL").isEmpty():
            break
        told = off.select("s", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("hit").alias("_hit"))
        joined = off.join(told, ["s", "up"], "left")
        off = keep(joined.select("s", "node", F.when(F.col("hit"), F.col("up")).otherwise(F.col("_up")).alias("up"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")), "graph-off")
    flags = nodes.join(main, ["s", "node"], "left").join(off.where("hit").select("s", "node", "hit"), ["s", "node"], "left")
    flags = flags.select("s", "uuid", F.coalesce("_main", F.lit(False)).alias("on_main"), F.coalesce("hit", F.lit(False)).alias("abandoned"))
    out = recs.join(flags, ["s", "uuid"], "left")
    return out.select("session_id", "uuid", "record_index", F.coalesce("on_main", F.lit(False)).alias("on_main"), F.coalesce("abandoned", F.lit(False)).alias("abandoned"))


def graph(recs: DataFrame, most: int = MOST_IN_GROUP) -> DataFrame:
    """session_id, uuid, record_index, on_main and abandoned of records (session_id, record_index, uuid, parent, is_sidechain).

    Sessions of up to ``most`` records are walked in a group each, longer ones by doubling; both give the same.
    """
    narrow = recs.select(F.col("session_id").cast("string"), F.col("record_index").cast("int"), "uuid", "parent", "is_sidechain")
    # Written with its session's length, for what records are read from may cost much more than to read these again.
    narrow = keep(narrow.withColumn("_n", F.count("*").over(Window.partitionBy("session_id"))), "graph-narrow")
    short, long = narrow.where(F.col("_n") <= most).drop("_n"), narrow.where(F.col("_n") > most).drop("_n")
    return _in_groups(short) if long.isEmpty() else _in_groups(short).unionByName(by_doubling(long))
