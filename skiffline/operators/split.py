"""Windows over hot keys, split into blocks of the order.

A window of a key that holds a third of all rows would be one task.  Here a window holds one
block of a key; what goes from block to block (the last value, the greatest so far, a
running count) is taken from one row per block in a second, short window and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 65_536  #: ids that make a block
PERIOD = 7 * 86_400_000_000  #: microseconds that make a block
LIMIT = 5_000_000  #: rows of a key in a block of time beyond which the block is cut into parts
PARTS = 200  #: parts of such a block


def id_block(of: Column) -> Column:
    return F.floor(of / F.lit(WIDTH))


def time_block(of: Column) -> Column:
    return F.floor(of / F.lit(PERIOD))


def _same(keys: list[str], theirs: str) -> Column:
    """Keys and block equal to those of a renamed table; NULL keys are a key."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col(theirs).eqNullSafe(F.col("_kb")))


def cut_by_count(df: DataFrame, keys: list[str], at: str, block: Column, limit: int = LIMIT) -> DataFrame:
    """``_b``: the block, and within one of more than ``limit`` rows of a key the part of it, cut at quantiles of ``at``.

    Blocks that are too large number at most rows / limit, a row each, which bounds what is
    broadcast; quantiles are taken of their rows only.  Rows at one and the same instant
    stay together whatever their number.
    """
    rows = df.withColumn("_w", block)
    names = [*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_w").alias("_kb")]
    large = F.broadcast(rows.groupBy(*keys, "_w").count().where(F.col("count") > limit).select(*names))
    cuts = rows.join(large, _same(keys, "_w"), "left_semi").groupBy(*keys, "_w").agg(F.array_distinct(F.percentile_approx(at, [i / PARTS for i in range(1, PARTS)], 10_000)).alias("_cuts"))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(at))), F.lit(0))
    cut = rows.join(F.broadcast(cuts.select(*names, "_cuts")), _same(keys, "_w"), "left")
    return cut.withColumn("_b", F.struct("_w", F.greatest(part, F.lit(0)).alias("part"))).drop("_w", "_kb", "_cuts", *(f"_k_{k}" for k in keys))


def _joined(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Joins one row per (keys, _b) to the rows of its block; NULL keys are a key."""
    renamed = edges.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_b": "_kb"})
    return rows.join(renamed, _same(keys, "_b")).drop("_kb", *(f"_k_{k}" for k in keys))


def neighbour(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, out: str, after: bool = False, by_count: bool = False) -> DataFrame:
    """``out``: the value of the row before (or after) in a key's order, NULL at the end; ``block`` must rise with the order.

    ``by_count``: for blocks that don't bound the rows in them, as those of time.
    """
    step, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    rows = (cut_by_count(df, keys, order[0], block) if by_count else df.withColumn("_b", block)).withColumn("_v", F.struct(F.col(value).alias("x")))
    rows = rows.withColumn("_in", step("_v").over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    edges = rows.groupBy(*keys, "_b").agg(edge("_v", F.struct(*order)).alias("_e"))
    edges = edges.withColumn("_p", step("_e").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_e")
    return _joined(rows, edges, keys).withColumn(out, F.coalesce("_in", "_p")["x"]).drop("_b", "_v", "_in", "_p")


def greatest_before(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, out: str) -> DataFrame:
    """``out``: the greatest value among the rows before, NULL for the first."""
    rows = df.withColumn("_b", block)
    rows = rows.withColumn("_in", F.max(value).over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    edges = rows.groupBy(*keys, "_b").agg(F.max(value).alias("_e"))
    edges = edges.withColumn("_p", F.max("_e").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_e")
    return _joined(rows, edges, keys).withColumn(out, F.greatest("_in", "_p")).drop("_b", "_in", "_p")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, out: str) -> DataFrame:
    """``out``: the sum of the values up to and with each row."""
    rows = df.withColumn("_b", block)
    rows = rows.withColumn("_in", F.sum(value).over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    edges = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_e"))
    edges = edges.withColumn("_p", F.coalesce(F.sum("_e").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_e")
    return _joined(rows, edges, keys).withColumn(out, F.col("_in") + F.col("_p")).drop("_b", "_in", "_p")
