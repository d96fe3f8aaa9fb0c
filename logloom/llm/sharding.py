"""Sharding over fixed virtual slots, with DataFrame functions only.

The hash of a record's text picks one of ``slots`` virtual slots, so equal texts share a shard. Only a text that no shard can
hold is split: one of several rows with more than a shard's even share of all bytes or rows, and more than ``FLOOR_BYTES`` or ``FLOOR_ROWS``, so
that a small table's copies stay together. Its parts are slots of their own, named by a hash of text and part; other texts of its slot
stay where they are. There are at most eight parts a shard and law, so slots stay few whatever the table. Where a text has many rows but
one shard, only the numbering of its rows is dealt out, which its shard doesn't show.

Bytes are added up per slot, and the largest slot first goes to the shard with the fewest bytes so far.
That map is a table with a row per slot, stored by version at a named place. ``rebalance`` edits a stored
map after growth or for another number of shards: the next version moves only the slots that it has to. Slots larger than an even share
have a shard to themselves, and the others share what shards are left. An edit that moves nothing makes no version; of two editors at
once one makes the next version and the other edits that one (``logloom.versions``).
Nothing but the map and the list of hot texts is ever broadcast.

Cases: null text has no bytes (size 1) and the empty text's slot; null and repeated doc_ids make no
difference; places inside a part of a hot text go by the row's number in the stored records, so that
rows that are equal in all else spread too; an empty table gives an empty table and map; further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.versions import Versions

from . import shared

SLOTS = 4096
#: By how much a shard may exceed the even share before an edit moves slots away from it.
SLACK = 0.0005
#: A text of fewer bytes and rows is never split, nor the numbering of its rows.
FLOOR_BYTES, FLOOR_ROWS = 1 << 20, 1000


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, row and virtual_slot of each row: what is left of a text after one reading. Write it before use: ``row`` is a number in this reading."""
    octets = shared.text_or_empty().cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(octets) + F.lit(1)).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
        F.xxhash64(octets).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
        F.pmod(F.xxhash64(octets), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def split_hot(recs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """``rank_part``, by which the rows of a slot are numbered, and for the parts of hot texts virtual slots of their own, from ``slots`` on."""
    whole = recs.agg((F.sum("size") / shards).alias("most_bytes"), (F.count("*") / shards).alias("most_rows"))
    per_text = recs.groupBy("text_hash", "text_crc32").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # A text of a single row can't be split.
    heavy = per_text.where("n > 1").crossJoin(F.broadcast(whole))
    many = (F.col("bytes") > F.greatest(F.col("most_bytes") / 8, F.lit(FLOOR_BYTES))) | (F.col("n") > F.greatest(F.col("most_rows") / 8, F.lit(FLOOR_ROWS)))
    hot = (F.col("bytes") > F.greatest(F.col("most_bytes"), F.lit(FLOOR_BYTES))) | (F.col("n") > F.greatest(F.col("most_rows"), F.lit(FLOOR_ROWS)))
    parts = F.least(F.col("n"), F.ceil(8 * F.greatest(F.col("bytes") / F.col("most_bytes"), F.col("n") / F.col("most_rows")))).cast("int")
    # At most 16 texts a shard.
    heavy = heavy.where(many).select("text_hash", "text_crc32", parts.alias("parts"), hot.alias("hot"))
    dealt = recs.join(F.broadcast(heavy), ["text_hash", "text_crc32"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(0))
    dealt = dealt.withColumn("rank_part", F.when(F.col("parts").isNull(), 0).otherwise(1 + part))
    own = slots + F.pmod(F.xxhash64("text_hash", "text_crc32", "rank_part"), F.lit((1 << 31) - 1 - slots)).cast("int")
    return dealt.withColumn("virtual_slot", F.when(F.col("hot"), own).otherwise(F.col("virtual_slot"))).select(*recs.columns, "rank_part")


def _least_loaded(sized: Column, loads: Column) -> Column:
    """Fold slots (bytes, rows, virtual_slot), in the array's order, each to the shard with the least load."""
    step = lambda acc, x: F.struct(
        F.transform(acc["loads"], lambda load, i: F.when(i == F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1, load + x["bytes"]).otherwise(load)).alias("loads"),
        F.concat(acc["shards"], F.array((F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int"))).alias("shards"),
    )
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))
    return F.aggregate(sized, start, step)["shards"]


def _heaviest_first() -> Column:
    """All slots as one array; there are ``slots`` of them and the parts of hot texts."""
    entry = F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot"), F.col("bytes"), F.col("n_rows"))
    return F.sort_array(F.collect_list(entry))


def _even_share(shards: int, slack: float) -> Column:
    """What a shard should hold, over all slots: those above it are taken out, each with a shard, until the others fit."""
    step = lambda acc, x: F.when((acc["left"] > 1) & (-x * acc["left"] > acc["rest"]), F.struct((acc["rest"] + x).alias("rest"), (acc["left"] - 1).alias("left"))).otherwise(acc)
    start = F.struct(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("rest"), F.lit(shards).cast("long").alias("left"))
    # Negated sizes sort as the largest first.
    return F.aggregate(F.sort_array(F.collect_list(-F.col("bytes"))), start, step, lambda acc: acc["rest"] * (1 + slack) / acc["left"])


def per_slot(recs: DataFrame) -> DataFrame:
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the slot-to-shard map over the slots in use (virtual_slot, bytes, n_rows)."""
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    one = sizes.agg(_heaviest_first().alias("sized")).select("sized", _least_loaded(F.col("sized"), loads).alias("shards"))
    rows = one.select(F.explode(F.arrays_zip("sized", "shards")).alias("x"))
    return rows.select(F.lit(1).alias("version"), F.col("x.sized.virtual_slot").alias("virtual_slot"), F.col("x.shards").alias("shard"), F.col("x.sized.bytes").alias("bytes"), F.col("x.sized.n_rows").alias("n_rows"))


def rebalance(old: DataFrame, sizes: DataFrame, shards: int, slack: float = SLACK) -> DataFrame:
    """The next version of ``old`` for present ``sizes`` and ``shards``.

    A shard keeps its slots, largest first, while they fit into its even share and a little ``slack``;
    those above it, slots of shards that are gone and new slots go to the least loaded shard, largest first.
    """
    known = old.select("virtual_slot", F.col("shard").alias("held"), "version")
    now = sizes.join(F.broadcast(known), "virtual_slot", "left")
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    share = sizes.agg(_even_share(shards, slack).alias("share"))
    largest_first = Window.partitionBy("held").orderBy(F.desc("bytes"), "virtual_slot")
    # A slot above the share stays where it is the largest.
    fits = (F.sum("bytes").over(largest_first) <= F.col("share")) | ((F.row_number().over(largest_first) == 1) & (F.col("bytes") > F.col("share")))
    marked = now.crossJoin(F.broadcast(share)).withColumn("stays", F.coalesce((F.col("held") < shards) & fits, F.lit(False)))
    entry = F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot"), F.col("bytes"), F.col("n_rows"))
    kept = F.struct(F.col("held").alias("shard"), F.col("virtual_slot"), F.col("bytes"), F.col("n_rows"))
    one = marked.agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), entry))).alias("moved"),
        F.collect_list(F.when(F.col("stays"), kept)).alias("kept"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == s, x["bytes"]).otherwise(F.lit(0).cast("long"))),
    )
    one = one.withColumn("to", _least_loaded(F.col("moved"), loads))
    moved = F.transform(F.arrays_zip("moved", "to"), lambda x: F.struct(x["to"].alias("shard"), x["moved"]["virtual_slot"].alias("virtual_slot"), x["moved"]["bytes"].alias("bytes"), x["moved"]["n_rows"].alias("n_rows")))
    rows = one.select(F.explode(F.concat("kept", moved)).alias("x"))
    return rows.crossJoin(F.broadcast(version)).select("version", "x.virtual_slot", "x.shard", "x.bytes", "x.n_rows")


class Maps(Versions):
    """Versions of one map at ``place``."""

    def edit(self, sizes: DataFrame, shards: int) -> DataFrame:
        """The map for present sizes and shards: the first version where there is none, the last where nothing changes, else the next."""

        def change(held: DataFrame | None) -> DataFrame | None:
            if held is None:
                return first_map(sizes, shards).withColumn("shards", F.lit(shards))
            new = shared.materialize(rebalance(held, sizes, shards).withColumn("shards", F.lit(shards)), "slot-map")
            kept = held.drop("version").exceptAll(new.drop("version")).isEmpty() and new.count() == held.count()
            return None if kept else new

        return self.commit(change).withColumn("version", F.lit(self.latest()[0]))


def assign(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and place in the shard (gapless from 0) of each record under one version of the map.

    Places are a prefix sum over the parts of the map's slots and a rank inside each part, so the work is split
    over thousands of parts and never over shards.
    """
    parts = recs.groupBy("virtual_slot", "rank_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "rank_part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    based = based.select("virtual_slot", "rank_part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "rank_part").orderBy("doc_id", "text_crc32", "size", "row"))
    return recs.withColumn("rank", rank).join(F.broadcast(based), ["virtual_slot", "rank_part"]).withColumn("slot", F.col("base") + F.col("rank") - 1)


def op6_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 under the law ``bytes``: a map for 15 shards, grown to 16 by an edit.

    The map is this run's own, so the result follows from the table alone; ``Maps`` at a place of your choice keeps one over runs.
    """
    recs = shared.materialize(records(shared.documents(spark, sf_dir)), "records")
    recs = shared.materialize(split_hot(recs, 16), "dealt")
    sizes = shared.materialize(per_slot(recs), "slot-sizes")
    maps = Maps(spark, shared.new_path(spark, "slot-map"))
    maps.edit(sizes, 15)
    placed = assign(recs, maps.edit(sizes, 16))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
