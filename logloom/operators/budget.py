"""Budgets that hold over a session, spent in the order of its rows.

A row is paid for if what is left covers it, and refused otherwise; a refused row costs nothing, so a cheaper one after it may still be paid for.
Almost no session comes near a budget, and a sum by session, formed in each task first, tells which could. Only the rows of those are
walked in order, a session a group, with nothing but their place and cost: 16 bytes a row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import keep

#: What the objects, arrays, keys and items of a session may come to: an object or array counts as three keys, an item as a third of one.
STRUCTURES = 16_000_000


def refused(rows: DataFrame, by: str, place: str, cost: str, budget: int) -> DataFrame:
    """(by, place) of the rows that ``budget`` doesn't cover. Places of a group differ; a null group is a group; a null cost is nothing."""
    narrow = rows.select(by, place, F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("cost"))
    over = keep(narrow.groupBy(F.col(by).alias("_over")).agg(F.sum("cost").alias("whole")).where(F.col("whole") > budget).select("_over"), "over-budget")
    kinds = dict(narrow.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(place)
        left, out = budget, []
        for k, amount in enumerate(table["cost"].to_pylist()):
            if amount > left:
                out.append(k)
            else:
                left -= amount
        return table.take(pa.array(out, pa.int64())).select([by, place])

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return narrow.join(F.broadcast(over) if over.count() <= 200_000 else over, F.col(by).eqNullSafe(F.col("_over")), "left_semi").groupBy(by).applyInArrow(run, f"`{by}` {kinds[by]}, `{place}` {kinds[place]}")


def structures(line: Column) -> Column:
    """What a line's JSON may come to once parsed, told from its signs."""
    size = F.length(line)
    opened = size - F.length(F.translate(line, "{[", ""))
    items = size - F.length(F.replace(line, F.lit(","), F.lit("")))
    return (3 * opened + F.regexp_count(line, F.lit('"[ \t\r]*:')) + F.floor(items / 3)).cast("long")


def parseable(lines: DataFrame, budget: int = STRUCTURES) -> DataFrame:
    """Lines (session_id, line_no, line) with ``refused``, whether the session's budget of structures leaves them unparsed.

    No sign costs more than three, so only sessions with more than a third of the budget in characters are looked at. ``lines`` is read several times.
    """
    long = lines.groupBy(F.col("session_id").alias("_s")).agg(F.sum(F.length("line")).alias("chars")).where(3 * F.col("chars") > budget)
    long = keep(long.select("_s"), "long-sessions")
    if long.isEmpty():
        return lines.withColumn("refused", F.lit(False))
    asked = lines.join(long, F.col("session_id").eqNullSafe(F.col("_s")), "left_semi").withColumn("_cost", structures(F.trim("line")))
    gone = keep(refused(asked, "session_id", "line_no", "_cost", budget).select(F.col("session_id").alias("_s"), F.col("line_no").alias("_l"), F.lit(True).alias("_refused")), "refused")
    marked = lines.join(gone, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("line_no") == F.col("_l")), "left")
    return marked.withColumn("refused", F.coalesce("_refused", F.lit(False))).drop("_s", "_l", "_refused")
