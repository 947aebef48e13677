"""Schemas, views and checks of the archive's tables, and its landed sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the archive's tables.
SCHEMAS = {
    "raw_records": "id bigint, kind string, observed_at string, tier string, context_json string, payload_json string",
    "channels": "id bigint, uri string, username string, title string, about string, kind string, created_at string, linked_chat_id bigint, participants_count bigint, flags_json string, restriction_json string, source_raw_id bigint, first_seen string, last_seen string",
    "peers": "uri string, kind string, id bigint, access_hash bigint, is_min int, seen_in_chat bigint, seen_in_msg bigint, username string, first_name string, last_name string, title string, flags_json string, source_raw_id bigint, first_seen string, last_seen string",
    "messages": "uri string, channel_id bigint, msg_id bigint, date string, edit_date string, from_uri string, post_author string, text string, entities_json string, media_kind string, media_json string, fwd_json string, reply_to_msg_id bigint, reply_to_top_id bigint, grouped_id bigint, via_bot_id bigint, is_service int, action_json string, content_hash string, deleted_at string, source_raw_id bigint, first_seen string, last_seen string",
    "media": "sha256 string, message_uri string, kind string, mime_type string, size bigint, file_name string, attributes_json string, path string, downloaded_at string, exif_json string",
    "channel_snapshots": "id bigint, channel_id bigint, observed_at string, participants_count bigint, online_count bigint, title string, username string, about_hash string, source_raw_id bigint",
    "message_revisions": "id bigint, message_uri string, observed_at string, edit_date string, content_hash string, text string, entities_json string, media_json string, source_raw_id bigint",
    "message_metrics": "id bigint, message_uri string, observed_at string, views bigint, forwards bigint, replies bigint, reactions_json string",
    "message_tombstones": "id bigint, message_uri string, observed_at string, evidence string",
    "edges": "id bigint, subject_uri string, predicate string, object_uri string, observed_at string, tier string, source_raw_id bigint, evidence_json string",
    "sync_state": "scope string, key string, value_json string",
    "sync_ranges": "id bigint, channel_id bigint, lo bigint, hi bigint",
    "flood_log": "id bigint, method string, until string, seconds bigint, recorded_at string",
    "run_events": "id bigint, observed_at string, channel_id bigint, phase string, kind string, detail_json string",
    "custody_log": "id bigint, path string, sha256 string, recorded_at string, source_message_uri string",
    "web_snapshots": "id bigint, source string, url string, fetched_at string, channel_username string, msg_id bigint, timestamp string, content_hash string, raw string, meta_json string",
}
EVIDENCE = ["update", "gap", "empty"]
CAPTURES = ["tme", "wayback"]


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every table of a folder as a temporary view, for SQL text; tables that are missing become empty views."""
    names = []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{name}").createOrReplaceTempView(name.removesuffix(".parquet"))
            names.append(name.removesuffix(".parquet"))
    for name, schema in SCHEMAS.items():
        if name not in names:
            spark.createDataFrame([], schema).createOrReplaceTempView(name)
            names.append(name)
    return sorted(names)


def checked(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Fails the job on a value outside the set, as a CHECK would."""
    ok = F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} out of range: "), F.coalesce(column, F.lit("NULL"))))))


def append_raw(records: DataFrame, path: str) -> None:
    """Appends landed objects to the raw log, partitioned by kind (compared without case)."""
    records.withColumn("kind_key", F.lower("kind")).write.mode("append").partitionBy("kind_key").parquet(path)


def opened(payload: Column) -> Column:
    """The JSON text of a payload, a quoted one opened; NULL if it isn't valid JSON."""
    inner = F.when(payload.rlike(r'^\s*"'), F.get_json_object(payload, "$")).otherwise(payload)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def history_page(messages: DataFrame, channel: int | Column, before: int, size: int = 100) -> DataFrame:
    """One page of a channel's history, newest first, below a message id (0: from the top)."""
    rows = messages.where(F.col("channel_id") == channel)
    if before:
        rows = rows.where(F.col("msg_id") < before)
    return rows.orderBy(F.col("msg_id").desc(), F.col("seq").desc()).limit(size)


def lookup(wanted: DataFrame, messages: DataFrame) -> DataFrame:
    """Point lookup: the rows wanted (channel_id, msg_id), those without a message marked empty."""
    have = messages.select(F.col("channel_id").alias("h_c"), F.col("msg_id").alias("h_m")).distinct()
    return wanted.join(have, (F.col("channel_id") == F.col("h_c")) & (F.col("msg_id") == F.col("h_m")), "left").select("channel_id", "msg_id", F.col("h_m").isNull().alias("is_empty"))


def differences_since(raw: DataFrame, cursors: DataFrame) -> DataFrame:
    """Change batches past each channel's cursor (channel_id, pts)."""
    return raw.join(cursors.withColumnsRenamed({"pts": "seen_pts"}), "channel_id").where(F.col("pts") > F.col("seen_pts")).drop("seen_pts")


def write_json_lines(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Lines of JSON with sorted members, NULLs kept, everything overwritten."""
    out = df.select(*sorted(df.columns))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_channel(channels: DataFrame, messages: DataFrame, edges: DataFrame, uri: str, out: str, own_uri: str | None = None) -> None:
    """One channel as three files of sorted JSON lines: ``channel``, ``messages`` (by id) and ``edges`` (in their order).

    messages: with their revisions nested; ``edges``: with a column ``id`` that gives their order.
    What the collecting account wrote or is part of is left out.  Fails on a URI of anything but a channel.
    """
    if (m := re.fullmatch(r"tg:channel:(-?\d+)", uri)) is None:
        raise ValueError(f"not a channel: {uri}")
    number = int(m.group(1))
    written = messages.where(F.col("channel_id") == number)
    of = edges.where((F.col("subject_uri") == uri) | F.col("subject_uri").startswith(f"tg:msg:{number}/") | (F.col("object_uri") == uri))
    if own_uri is not None:
        written = written.where(~F.col("from_uri").eqNullSafe(F.lit(own_uri)))
        of = of.where(~F.col("subject_uri").eqNullSafe(F.lit(own_uri)) & ~F.col("object_uri").eqNullSafe(F.lit(own_uri)))
    write_json_lines(channels.where(F.col("id") == number), f"{out}/channel")
    write_json_lines(written.orderBy("msg_id"), f"{out}/messages")
    write_json_lines(of.orderBy("id"), f"{out}/edges")


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed media with their content address: sha256, size, and the path they belong under."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sha = F.sha2("content", 256)
    suffix = F.regexp_extract("path", r"(\.[^./\\]+)$", 1)
    return files.select(F.col("path").alias("landed_path"), sha.alias("sha256"), F.col("length").alias("size"), F.concat_ws("/", F.substring(sha, 1, 2), F.concat(sha, suffix)).alias("path"))
