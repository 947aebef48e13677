"""Current state and history from observations: keyed reductions, revisions, ranges, gaps.

Reductions are partial aggregates (``max_by``/``min_by`` over structs), so a key that holds
most rows reaches the shuffle as one row a task.  What compares neighbours runs in blocks of
the order (``split``).  ``order`` is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiffline.operators import split

EXPANDED = 10_000  #: ids of a range expanded together

def last_state(obs: DataFrame, keys: list[str], order: list[str], first: list[str] | None = None) -> DataFrame:
    """One row per key: every column of the last observation, the columns in ``first`` of the first one."""
    first = first or []
    rest = [c for c in obs.columns if c not in keys and c not in first]
    by = F.struct(*order)
    rows = obs.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_l"), *[F.min_by(c, by).alias(c) for c in first])
    return rows.select(*keys, "_l.*", *first)


def merged_peers(obs: DataFrame, order: list[str]) -> DataFrame:
    """One row per peer uri: the profile of the last full observation if there is one, else of the last; where it was
    seen and its source from the last observation of any kind; first seen from the first."""
    profile = F.struct(*[c for c in ("kind", "id", "access_hash", "is_min", "username", "first_name", "last_name", "title") if c in obs.columns])
    seen = F.struct(*[c for c in ("seen_in_chat", "seen_in_msg", "raw_id", "observed_at") if c in obs.columns])
    by = F.struct(*order)
    full = F.max_by(profile, F.when(F.col("is_min") == 0, by))  # rows without an order don't take part
    rows = obs.groupBy("uri").agg(F.coalesce(full, F.max_by(profile, by)).alias("_p"), F.max_by(seen, by).alias("_s"), F.min_by("observed_at", by).alias("first_seen"))
    return rows.select("uri", "_p.*", "_s.*", "first_seen").withColumnRenamed("observed_at", "last_seen")


def deleted_at(messages: DataFrame, tombstones: DataFrame) -> DataFrame:
    """uri and deleted_at of messages with deleting evidence of a time at which they were known: of these the first that arrived (by id)."""
    dead = tombstones.where(F.col("evidence").isin("update", "empty")).select(F.col("message_uri").alias("uri"), "at", "id", "observed_at")
    first = messages.groupBy("uri").agg(F.min("seen").alias("seen"))
    rows = dead.join(first, "uri").where(F.col("at") >= F.col("seen"))
    return rows.groupBy("uri").agg(F.min_by("observed_at", "id").alias("deleted_at"))


def latest_values(state: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return state.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_owner(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key owns it."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def dispositions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each media row's fate: ``skipped_kind`` without a content key, ``downloaded`` for the first of its key, else ``duplicates``."""
    keyed, bare = rows.where(F.col(keys[-1]).isNotNull()), rows.where(F.col(keys[-1]).isNull())
    first = keyed.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    marked = keyed.join(first, keys).withColumn("disposition", F.when(F.struct(*order) == F.col("_first"), "downloaded").otherwise("duplicates")).drop("_first")
    return marked.unionByName(bare.withColumn("disposition", F.lit("skipped_kind")))


def stored_media(rows: DataFrame, files: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each media row's fate, with what is stored for it: disposition, sha256 (NULL if nothing is).

    rows: keys (the last of them NULL: a kind that isn't stored), order and others; files:
    keys, sha256 - the bytes that a content brings, a row a content.  ``unavailable`` without
    bytes; of rows with the same bytes the first is ``downloaded``, all others are
    ``duplicates``, whether content or bytes are known.
    """
    key = keys[-1]
    have = files.select(*keys, "sha256").dropDuplicates(keys)
    keyed = rows.where(F.col(key).isNotNull()).join(have, keys, "left")
    first = keyed.where("sha256 is not null").groupBy(F.col("sha256").alias("_sha")).agg(F.min(F.struct(*order)).alias("_first"))
    marked = keyed.join(first, F.col("sha256") == F.col("_sha"), "left")
    fate = F.when(F.col("sha256").isNull(), "unavailable").when(F.struct(*order) == F.col("_first"), "downloaded").otherwise("duplicates")
    bare = rows.where(F.col(key).isNull()).withColumns({"sha256": F.lit(None).cast("string"), "disposition": F.lit("skipped_kind")})
    return marked.withColumn("disposition", fate).drop("_sha", "_first").unionByName(bare)


def custody(stored: DataFrame) -> DataFrame:
    """A row for each message that bytes are kept for: sha256, the path they lie under, the message."""
    return stored.where("disposition in ('downloaded', 'duplicates')").select("sha256", F.concat_ws("/", F.substring("sha256", 1, 2), "sha256").alias("path"), F.col("uri").alias("source_message_uri"), "disposition")


def revisions(obs: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """Observations whose digest differs from the one before; the first of a key is one too.  ``order``: the number of arrival."""
    rows = split.neighbour(obs, [key], [order], digest, split.id_block(F.col(order)), "_before")
    return rows.where(~F.col("_before").eqNullSafe(F.col(digest))).drop("_before")


def deltas(series: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """Each observation's change against the one before (at: microseconds)."""
    rows = split.neighbour(series, [key], [at, tie], value, split.time_block(F.col(at)), "_before", by_count=True)
    return rows.withColumn(f"{value}_delta", F.col(value) - F.col("_before")).drop("_before")


def coalesced_ranges(ranges: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Inclusive ranges of a key merged where they overlap or touch."""
    block = split.id_block(F.col(lo))
    rows = ranges.where(F.col(lo) <= F.col(hi)).select(key, lo, hi).distinct()
    rows = split.greatest_before(rows, [key], [lo, hi], hi, block, "_reach")
    rows = rows.withColumn("_new", (F.col("_reach").isNull() | (F.col(lo) > F.col("_reach") + 1)).cast("int"))
    rows = split.running_sum(rows, [key], [lo, hi], "_new", block, "_island")
    return rows.groupBy(key, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def gaps(ids: DataFrame, key: str, value: str) -> DataFrame:
    """The ranges between consecutive ids of a key that no row has: key, lo, hi.  No id is generated for that."""
    rows = split.neighbour(ids.select(key, value).distinct(), [key], [value], value, split.id_block(F.col(value)), "_next", after=True)
    return rows.where(F.col("_next") > F.col(value) + 1).select(key, (F.col(value) + 1).alias("lo"), (F.col("_next") - 1).alias("hi"))


def chunks(ids: DataFrame, key: str, value: str, size: int = 200) -> DataFrame:
    """Distinct ids of a key numbered into chunks of a size."""
    rows = ids.select(key, value).distinct().withColumn("_one", F.lit(1))
    rows = split.running_sum(rows, [key], [value], "_one", split.id_block(F.col(value)), "_rank")
    return rows.withColumn("chunk", F.floor((F.col("_rank") - 1) / F.lit(size))).drop("_one", "_rank")


def uncovered(spans: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """The parts of each key's span (lo, hi; one a key) that its ranges leave open: the gaps between the merged ranges, and what lies before and after them."""
    merged = coalesced_ranges(ranges, key)
    span = spans.select(F.col(key).alias("_k"), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"))
    clipped = merged.join(span, F.col(key) == F.col("_k")).where("hi >= s_lo and lo <= s_hi").select(key, F.greatest("lo", "s_lo").alias("lo"), F.least("hi", "s_hi").alias("hi"))
    walls = span.select(F.col("_k").alias(key), F.explode(F.array(F.struct((F.col("s_lo") - 1).alias("lo"), (F.col("s_lo") - 1).alias("hi")), F.struct((F.col("s_hi") + 1).alias("lo"), (F.col("s_hi") + 1).alias("hi")))).alias("w")).select(key, "w.*")
    rows = split.neighbour(clipped.unionByName(walls), [key], ["lo"], "lo", split.id_block(F.col("lo")), "_next", after=True)
    return rows.where(F.col("_next") > F.col("hi") + 1).select(key, (F.col("hi") + 1).alias("lo"), (F.col("_next") - 1).alias("hi"))


def expanded(ranges: DataFrame, key: str, value: str) -> DataFrame:
    """One row per id of inclusive ranges; an empty range has none.  Wide ranges are cut first, so no array is longer than a block."""
    cut = ranges.where("lo <= hi").select(key, "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("hi") - F.col("lo")) / EXPANDED / EXPANDED))).alias("far"))
    cut = cut.select(key, "hi", (F.col("lo") + F.col("far") * EXPANDED * EXPANDED).alias("lo")).where("lo <= hi")
    near = cut.select(key, "hi", "lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.floor((F.col("hi") - F.col("lo")) / EXPANDED), F.lit(EXPANDED - 1)))).alias("near"))
    near = near.select(key, "hi", (F.col("lo") + F.col("near") * EXPANDED).alias("lo"))
    return near.select(key, F.explode(F.sequence("lo", F.least(F.col("hi"), F.col("lo") + EXPANDED - 1))).alias(value))


def collapsed(captures: DataFrame, keys: list[str], digest: str, at: str, tie: str, ok: Column | None = None) -> DataFrame:
    """Captures whose digest differs from the capture before of the same keys (at: microseconds)."""
    rows = captures if ok is None else captures.where(ok)
    rows = split.neighbour(rows, keys, [at, tie], digest, split.time_block(F.col(at)), "_before", by_count=True)
    return rows.where(F.col("_before").isNull() | (F.col("_before") != F.col(digest))).drop("_before")


def nested_revisions(messages: DataFrame, revisions_: DataFrame, own_uri: str | None = None) -> DataFrame:
    """Messages with their revisions as one ordered array; those of the collecting account left out, unknown authors kept."""
    fields = F.struct("observed_at", "id", "content_hash", "text")
    lists = revisions_.groupBy(F.col("message_uri").alias("uri")).agg(F.sort_array(F.collect_list(fields)).alias("revisions"))
    rows = messages if own_uri is None else messages.where(~F.col("from_uri").eqNullSafe(F.lit(own_uri)))
    return rows.join(lists, "uri", "left").withColumn("revisions", F.coalesce("revisions", F.array().cast(lists.schema["revisions"].dataType)))


def edges_of_channel(edges: DataFrame, channel: int, own_uri: str | None = None) -> DataFrame:
    """Edges that start at a channel or one of its messages or end at it, without the collecting account's."""
    uri = f"tg:channel:{channel}"
    rows = edges.where((F.col("subject_uri") == uri) | F.col("subject_uri").startswith(f"tg:msg:{channel}/") | (F.col("object_uri") == uri))
    return rows if own_uri is None else rows.where(~F.col("subject_uri").eqNullSafe(F.lit(own_uri)) & ~F.col("object_uri").eqNullSafe(F.lit(own_uri)))
