"""History of changing attributes by Merkle comparison of snapshots (problem 6).

Observations (key, instant, id, attributes) are laid into snapshot periods.  Keys hash into
leaf buckets and these into groups.  For each attribute and period a leaf bucket's digest is
that of the set of (key, value) pairs seen in it, a group's that of its buckets; both come
from partial aggregates of hashes, no row is sorted or windowed for them.

A node stands still if each of its keys shows one value in the period and in the one before
(in which it was seen), and both digests are the same.  Then nothing in it has changed.
Comparison descends from the groups that don't stand still to their buckets; only rows of
buckets that differ are read again and diffed, and their new versions appended.  The value
that a key carries into a differing period is that of its last row in one: in between
it stood still.

Hot keys: what compares neighbours runs in blocks of the order (``split``), the period and,
where that holds too many rows of a key, parts of it.

Defined cases: a NULL value says nothing about its attribute; rows with a NULL key,
id or unreadable instant are left out; equal instants are put in order by id; repeated
rows are one; a value that comes back is a new version; an empty table gives an empty
history; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skiffline.operators import split
from skiffline.session import Scratch

DAY = 86_400_000_000
FANOUT = 256  #: leaf buckets in a group
BUCKETS = 65_536


def observations(rows: DataFrame, key: Column, instant: Column, row_id: Column, attributes: list[str], period: int = 28 * DAY) -> DataFrame:
    """Long form: k, bucket, attribute, period, at, id, value (as text)."""
    slim = rows.select(key.alias("k"), instant.cast("bigint").alias("at"), row_id.cast("bigint").alias("id"), *[F.col(a).cast("string").alias(f"a{i}") for i, a in enumerate(attributes)]).where("k is not null and at is not null and id is not null")
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"a{i}").alias("value")) for i, a in enumerate(attributes)])
    long = slim.select("k", "at", "id", F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("x")).select("k", "at", "id", "x.*")
    return long.withColumn("period", F.floor(F.col("at") / F.lit(period))).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(BUCKETS)).cast("int"))


def leaf_nodes(obs: DataFrame) -> DataFrame:
    """attribute, period, grp, bucket, digest, moved: the leaf buckets of each snapshot; ``moved``: a key shows more than one value."""
    seen = obs.select("attribute", "period", "bucket", "k", F.xxhash64("k", "value").alias("h"))
    keys = seen.groupBy("attribute", "period", "bucket", "k").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    nodes = keys.groupBy("attribute", "period", "bucket").agg(F.bit_xor("low").alias("digest"), F.bool_or(F.col("low") != F.col("high")).alias("moved"))
    return nodes.withColumn("grp", F.floor(F.col("bucket") / F.lit(FANOUT)).cast("int"))


def group_nodes(leaves: DataFrame) -> DataFrame:
    """The level above: attribute, period, grp, digest, moved."""
    return leaves.groupBy("attribute", "period", "grp").agg(F.bit_xor(F.xxhash64("bucket", "digest")).alias("digest"), F.bool_or("moved").alias("moved"))


def differing(nodes: DataFrame, node: str) -> DataFrame:
    """The nodes that don't stand still.  The first of a node differs from nothing, and one after a node that moved differs from that."""
    settled = F.when(~F.col("moved"), F.col("digest"))
    before = F.lag(settled).over(Window.partitionBy("attribute", node).orderBy("period"))
    return nodes.withColumn("_before", before).where(F.col("moved") | ~F.col("digest").eqNullSafe(F.col("_before"))).drop("_before")


def differing_buckets(leaves: DataFrame) -> DataFrame:
    """attribute, period, bucket that differ, found by descending from the groups that do.

    A bucket is compared with its node in the last differing period of its group: in the
    periods between, the whole group stood still.
    """
    groups = differing(group_nodes(leaves), "grp").select("attribute", "period", "grp")
    return differing(leaves.join(groups, ["attribute", "period", "grp"], "left_semi"), "bucket").select("attribute", "period", "bucket")


def differing_rows(obs: DataFrame, scratch: Scratch) -> DataFrame:
    """The observations in differing buckets: all that the diff has to read."""
    leaves, _ = scratch.write(leaf_nodes(obs))
    return obs.join(differing_buckets(leaves), ["attribute", "period", "bucket"], "left_semi")


def versions(obs: DataFrame) -> DataFrame:
    """k, attribute, value, from_id, from_at, next_id (0 for the last), next_at (NULL for the last)."""
    scratch = Scratch(obs.sparkSession, "history")
    keys = ["attribute", "k"]
    rows, _ = scratch.write(differing_rows(obs, scratch).select("k", "attribute", "period", "at", "id", "value"))
    rows = split.cut_by_count(rows, keys, "at", F.col("period")).withColumnRenamed("_b", "part").drop("period")
    rows = split.neighbour(rows, keys, ["at", "id"], "value", F.col("part"), "prior")
    new, _ = scratch.write(rows.where(~F.col("value").eqNullSafe(F.col("prior"))).drop("prior").withColumn("begin", F.struct("at", "id")))
    done = split.neighbour(new, keys, ["at", "id"], "begin", F.col("part"), "next", after=True)
    return done.select("k", "attribute", "value", F.col("id").alias("from_id"), F.col("at").alias("from_at"), F.coalesce("next.id", F.lit(0).cast("bigint")).alias("next_id"), F.col("next.at").alias("next_at"))


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """The versions valid at an instant (microseconds)."""
    return history.where((F.col("from_at") <= at) & (F.col("next_at").isNull() | (F.col("next_at") > at)))
