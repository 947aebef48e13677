"""Commit-ordered replay of a change feed (problem 5).

A feed is a set of change rows; a row belongs to a transaction of a stream and each
transaction has a commit number in its stream.

1. Transactions are assembled: one of several rows counts only when all its parts
   have arrived.  A transaction of one row is complete as it stands and is not
   shuffled for that.
2. Each stream's watermark is its greatest commit number up to which no number is
   missing.  Later commits are held.  A sealed stream is one whose log has ended: its
   missing numbers are void (they will never come), so nothing is held.
3. Changes to different keys don't conflict, so keys are replayed in parallel: the
   state of a key is its greatest change in (instant, tie-breakers) order, found by a
   partial maximum before the shuffle.  Order of arrival and repeats play no part, and
   a key that holds most rows reaches the shuffle as one row a task.

Defined cases: a change with a NULL key, commit number or unreadable instant changes
nothing; at one instant a delete comes after an upsert; repeated rows count once; an
empty feed gives an empty state; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skiffline.functions.instants import instant_micros

UPSERT, DELETE, NOTHING = 0, 1, -1
BLOCK = 65_536  #: commit numbers counted together when looking for gaps


def change_rows(
    rows: DataFrame,
    stream: str,
    commit: Column,
    keys: dict[str, Column],
    op: Column,
    instant: Column,
    ties: list[Column],
    values: dict[str, Column],
    txn: Column | None = None,
    parts: Column | None = None,
) -> DataFrame:
    """A table as change rows of one stream.  ``txn``/``parts``: the transaction's id and number of rows, if it has several."""
    return rows.select(
        F.lit(stream).alias("_stream"),
        commit.cast("bigint").alias("_commit"),
        (F.lit(None).cast("string") if txn is None else txn.cast("string")).alias("_txn"),
        (F.lit(1) if parts is None else parts).cast("int").alias("_parts"),
        op.cast("int").alias("_op"),
        instant.cast("bigint").alias("_instant"),
        F.array(*[t.cast("bigint") for t in ties]).alias("_ties"),
        *[c.alias(k) for k, c in keys.items()],
        *[c.alias(k) for k, c in values.items()],
    )


def complete_transactions(feed: DataFrame) -> DataFrame:
    """The rows of transactions all of whose parts are there."""
    single = F.coalesce("_parts", F.lit(1)) <= 1
    many = feed.where(~single)
    whole = many.groupBy(F.col("_stream").alias("_s"), F.col("_txn").alias("_t")).agg(F.countDistinct("_commit").alias("_have"), F.max("_parts").alias("_want")).where("_have >= _want").drop("_have", "_want")
    return feed.where(single).unionByName(many.join(whole, (F.col("_stream") == F.col("_s")) & (F.col("_txn") == F.col("_t")), "left_semi"))


def watermarks(feed: DataFrame, first: int = 1) -> DataFrame:
    """One row per stream: the last commit number of the unbroken run that starts at ``first`` (``first - 1`` if that is missing).

    Numbers are counted by blocks of 65,536; only the first block that isn't full is
    looked at one by one.  So no window is longer than a block, or than the list of blocks.
    """
    numbers = feed.where(F.col("_commit") >= first).select("_stream", "_commit").distinct().withColumn("_block", F.floor((F.col("_commit") - first) / BLOCK))
    blocks = numbers.groupBy("_stream", "_block").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("_stream").orderBy("_block")
    blocks = blocks.withColumn("_rank", F.row_number().over(run) - 1).withColumn("_full", (F.col("_n") == BLOCK).cast("int"))
    prefix = blocks.withColumn("_ok", F.min("_full").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    full = prefix.where("_ok = 1 and _rank = _block").groupBy("_stream").agg(F.count("*").alias("_blocks"))
    streams = feed.select("_stream").distinct().join(full, "_stream", "left").select(F.col("_stream").alias("_s"), F.coalesce("_blocks", F.lit(0)).alias("_blocks"))
    tail = numbers.join(F.broadcast(streams), (F.col("_stream") == F.col("_s")) & (F.col("_block") == F.col("_blocks")))
    inside = Window.partitionBy("_stream", "_block").orderBy("_commit")
    reached = tail.withColumn("_at", F.row_number().over(inside)).where(F.col("_commit") == F.col("_block") * BLOCK + F.col("_at") + first - 1).groupBy(F.col("_stream").alias("_r")).agg(F.max("_commit").alias("_reach"))
    return streams.join(reached, F.col("_s") == F.col("_r"), "left").select(F.col("_s").alias("_stream"), F.coalesce("_reach", F.col("_blocks") * BLOCK + first - 1).alias("watermark"))


def replay(feeds: list[DataFrame], keys: list[str], values: list[str], sealed: bool = False) -> DataFrame:
    """The state after the committed changes: one row per key alive, with its values, ``_instant`` and ``_commit``.

    Only commits up to each stream's watermark show.  ``sealed``: the logs have ended, so
    gaps are void and every commit shows.  (Streams number a handful, one row each, which
    bounds the broadcast.)
    """
    feed = complete_transactions(reduce(DataFrame.unionByName, feeds))
    if sealed:  # with its gaps void a log is unbroken up to its last commit
        feed = feed.where(F.col("_commit").isNotNull())
    else:
        marks = watermarks(feed).select(F.col("_stream").alias("_m"), "watermark")
        feed = feed.join(F.broadcast(marks), (F.col("_stream") == F.col("_m")) & (F.col("_commit") <= F.col("watermark")), "left_semi")
    live = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], (F.col("_op") != NOTHING) & F.col("_instant").isNotNull())
    last = feed.where(live).groupBy(*keys).agg(F.max(F.struct("_instant", "_op", "_ties", "_commit", *values)).alias("_last"))
    return last.where(F.col("_last._op") == UPSERT).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values], F.col("_last._instant").alias("_instant"), F.col("_last._commit").alias("_commit"))


def message_feeds(messages: DataFrame, tombstones: DataFrame) -> list[DataFrame]:
    """Messages as upserts and tombstones as deletes.  (Evidence ``gap`` changes nothing.)"""
    upserts = change_rows(
        messages,
        "messages",
        F.col("seq"),
        {"channel_id": F.col("channel_id"), "msg_id": F.col("msg_id")},
        F.lit(UPSERT),
        instant_micros(F.coalesce("edit_date", "date")),
        [instant_micros(F.col("last_seen")), F.col("seq")],
        {"content_hash": F.col("content_hash")},
    )
    ids = F.regexp_extract("message_uri", r"^tg:msg:(\d+)/(\d+)$", 1), F.regexp_extract("message_uri", r"^tg:msg:(\d+)/(\d+)$", 2)
    none = F.lit(None).cast("bigint")
    deletes = change_rows(
        tombstones,
        "tombstones",
        F.col("id"),
        {"channel_id": ids[0].try_cast("bigint"), "msg_id": ids[1].try_cast("bigint")},
        F.when(F.lower("evidence").isin("update", "empty"), DELETE).otherwise(NOTHING),
        instant_micros(F.col("observed_at")),
        [none, none],
        {"content_hash": F.lit(None).cast("string")},
    )
    return [upserts, deletes]
