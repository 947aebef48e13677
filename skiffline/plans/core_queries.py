"""Queries of the general pipeline problems (1, 2, 5, 6) over their whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiffline.functions.instants import instant_micros, instant_sql
from skiffline.operators import changefeed, hierarchy, history, nested
from skiffline.session import scratch_folder, table

ATTRIBUTES = ["title", "username", "participants_count"]


def emission(spark: SparkSession, sf_dir: str, payload: bool) -> DataFrame:
    """Every text column of problem 1 through one visitor."""
    raw, messages = table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "messages")
    parts = [raw.select(F.lit("raw_records.payload").alias("f"), F.col("id").alias("i"), F.col("payload").alias("x"))]
    cells = F.array(F.struct(F.lit("messages.media_json").alias("f"), F.col("media_json").alias("x")), F.struct(F.lit("messages.entities_json").alias("f"), F.col("entities_json").alias("x")))
    parts.append(messages.select(F.col("seq").alias("i"), F.inline(F.filter(cells, lambda c: c["x"].isNotNull()))).select("f", "i", "x"))
    return nested.tagged_emission(parts[0].unionByName(parts[1]), F.col("f"), F.col("i"), F.col("x"), payload)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emission(spark, sf_dir, payload=False).select("field", "row_id", "path", "parent_path")


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct records of each flat child table."""
    return emission(spark, sf_dir, payload=False).groupBy("field", "tag").agg(F.count("*").alias("n_rows"), F.countDistinct("row_id").alias("n_records"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of messages as a flat table with a schema."""
    rows = emission(spark, sf_dir, payload=True).where("field = 'messages.entities_json'")
    return nested.flat_table(rows, "[]", "_ string, offset bigint, length bigint, url string, user_id bigint").select("row_id", "path", F.col("_").alias("entity"), "offset", "length", "url", "user_id")


def p1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole emission written partitioned by tag, every tag's table read back under its own schema: values of each column.

    Tables of different fields (``raw_records.payload``, ``messages.media_json``...) with the same tag stay apart.
    """
    rows = emission(spark, sf_dir, payload=True).withColumn("tag", F.concat_ws(":", "field", "tag"))
    path = scratch_folder(spark, "flat-tables")
    nested.write_tables(rows, path)
    store = spark.read.parquet(path)
    counts = []
    for tag, names in nested.columns_of(store).items():
        flat = nested.flat_table(store, tag, T.StructType([T.StructField(n, T.StringType()) for n in names]))
        scalar = [F.struct(F.lit(n).alias("column_name"), F.count(F.when(~F.col(f"fields.`{n}`").rlike(r"^[\[{]"), 1)).alias("n_values")) for n in names]
        wide = flat.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("fields")).agg(F.array(*scalar).alias("c"))
        counts.append(wide.select(F.lit(tag).alias("table_name"), F.inline("c")))
    return reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "table_name string, column_name string, n_values bigint")


def message_trees(spark: SparkSession, sf_dir: str, bare: bool) -> DataFrame:
    """The reply trees; ``bare`` adds the messages that reply to none."""
    return hierarchy.hierarchy(table(spark, sf_dir, "messages"), F.col("channel_id"), F.col("msg_id"), F.col("reply_to_msg_id"), bare)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_trees(spark, sf_dir, bare=False).select(F.col("t").alias("channel_id"), F.col("v").alias("msg_id"), F.col("root").alias("root_msg_id"), "depth")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each message, roots included, as an interval of positions under its root."""
    return hierarchy.preorder(message_trees(spark, sf_dir, bare=True)).select(F.col("t").alias("channel_id"), F.col("v").alias("msg_id"), F.col("root").alias("root_msg_id"), F.col("pos"), (F.col("size") - 1).alias("n_descendants"))


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages hang below each reply to a message in the table, from the subtree sizes; ``p2_descendants`` has the roots too."""
    return message_trees(spark, sf_dir, bare=False).where("depth > 0").select(F.col("t").alias("channel_id"), F.col("v").alias("msg_id"), (F.col("size") - 1).alias("n_descendants"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root paths of all messages as chain segments: the depths covered add up to the whole path."""
    return hierarchy.segments(message_trees(spark, sf_dir, bare=True)).select(F.col("t").alias("channel_id"), F.col("v").alias("msg_id"), F.col("chain").alias("chain_msg_id"), "from_depth", "to_depth")


def feeds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return changefeed.message_feeds(table(spark, sf_dir, "messages"), table(spark, sf_dir, "message_tombstones"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all landed changes: the tables are ended logs whose numbers may have gaps (``p5_watermarks`` tells how far they have none)."""
    return changefeed.replay(feeds(spark, sf_dir), ["channel_id", "msg_id"], ["content_hash"], sealed=True).select("channel_id", "msg_id", "content_hash")


def p5_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each landing log is unbroken."""
    a, b = feeds(spark, sf_dir)
    return changefeed.watermarks(a.unionByName(b)).select(F.col("_stream").alias("stream"), "watermark")


def channel_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions(history.observations(table(spark, sf_dir, "channel_snapshots"), F.col("channel_id"), instant_micros(F.col("observed_at")), F.col("id"), ATTRIBUTES))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel_versions(spark, sf_dir).select(F.col("k").alias("channel_id"), "attribute", "from_id", "next_id")


def p6_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its value and the period in which it was valid (microseconds; NULL while it lasts)."""
    return channel_versions(spark, sf_dir).select(F.col("k").alias("channel_id"), "attribute", "value", F.col("from_at").alias("valid_from"), F.col("next_at").alias("valid_to"))


def p6_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each channel's attributes were at the begin of 2025."""
    return history.as_of(channel_versions(spark, sf_dir), F.lit(1_735_689_600_000_000)).select(F.col("k").alias("channel_id"), "attribute", "value")


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_entities, p1_columns, p2_found, p2_sizes, p2_descendants, p2_paths, p5_found, p5_watermarks, p6_found, p6_periods, p6_as_of)}

_OPENED = "case when json_valid(x) then case when json_type(x) = 'VARCHAR' then case when json_valid(json_extract_string(x, '$')) then json_extract_string(x, '$') end else x end end"
_OBJECTS = f"""with cells as (
  select 'raw_records.payload' as field, id as row_id, payload as x from raw_records
  union all select 'messages.media_json', seq, media_json from messages
  union all select 'messages.entities_json', seq, entities_json from messages),
opened as (select field, row_id, {_OPENED} as j from cells where x is not null),
objects as (select field, row_id, replace(replace(substr(t.fullkey, 2), '"', ''), '$', '') as full_path, t.value as node
  from opened, json_tree(opened.j) t where j is not null and t.type = 'OBJECT' and t.fullkey like '%]'),
found as (select field, row_id, ltrim(full_path, '.') as path, node from objects)
"""
_PARENT = r"coalesce(nullif(regexp_extract(path, '^(.*\])\.[^\[\]]+(\[[0-9]+\])+$', 1), ''), '$')"
_TAG = r"coalesce(nullif(regexp_replace(path, '\[[0-9]+\]', '', 'g'), ''), '[]')"
_URI = r"cast(regexp_extract(message_uri, '^tg:msg:([0-9]+)/([0-9]+)$', 1) as bigint) as channel_id, cast(regexp_extract(message_uri, '^tg:msg:([0-9]+)/([0-9]+)$', 2) as bigint) as msg_id"
_TREE = """with recursive m as (select channel_id c, msg_id v, max(reply_to_msg_id) p from messages group by 1, 2),
walk as (
  select m.c, m.v, m.p, m.v as root, cast(0 as bigint) as depth from m left join m u on u.c = m.c and u.v = m.p where u.v is null
  union all select m.c, m.v, m.p, walk.root, walk.depth + 1 from m join walk on m.c = walk.c and m.p = walk.v)
"""
_PREORDER = (
    _TREE
    + """, up as (select w.c, w.v, w.p as a from walk w where w.depth > 0 union all select up.c, up.v, w.p from up join walk w on w.c = up.c and w.v = up.a where w.depth > 0),
below as (select c, a, count(*) as n from up group by 1, 2),
sized as (select w.c, w.v, case when w.depth > 0 then w.p end as p, 1 + coalesce(b.n, 0) as size from walk w left join below b on b.c = w.c and b.a = w.v),
ranked as (select *, row_number() over (partition by c, p order by size desc, v) as rn from sized where p is not null),
light as (select *, case when rn > 1 then coalesce(sum(case when rn > 1 then size end) over (partition by c, p order by v rows between unbounded preceding and 1 preceding), 0) end as earlier, max(case when rn = 1 then size end) over (partition by c, p) as heavy from ranked),
placed as (select c, v, cast(0 as hugeint) as pos, v as chain from sized where p is null
  union all select l.c, l.v, o.pos + 1 + case when l.rn = 1 then 0 else l.heavy + l.earlier end, case when l.rn = 1 then o.chain else l.v end from placed o join light l on l.c = o.c and l.p = o.v)
"""
)
_VERSIONS = f"""with long as ({" union all ".join(f"select channel_id, '{a}' as attribute, id, {instant_sql('observed_at')} as at_us, cast({a} as varchar) as value from channel_snapshots where {a} is not null" for a in ATTRIBUTES)}),
marked as (select *, lag(value) over (partition by channel_id, attribute order by at_us, id) as prior from long),
kept as (select * from marked where prior is null or prior <> value)
"""

SQL = {
    "p1_found": _OBJECTS + f"select field, row_id, path, {_PARENT} as parent_path from found",
    "p1_tables": _OBJECTS + f"select field, {_TAG} as tag, count(*) as n_rows, count(distinct row_id) as n_records from found group by 1, 2",
    "p1_entities": _OBJECTS
    + """select row_id, path, json_extract_string(node, '$._') as entity, cast(json_extract_string(node, '$.offset') as bigint) as "offset", cast(json_extract_string(node, '$.length') as bigint) as length,
json_extract_string(node, '$.url') as url, cast(json_extract_string(node, '$.user_id') as bigint) as user_id from found where field = 'messages.entities_json' and regexp_matches(path, '^(\\[[0-9]+\\])+$')""",
    "p1_columns": _OBJECTS
    + f""", cols as (select field || ':' || {_TAG} as table_name, unnest(json_keys(node)) as column_name, node from found),
vals as (select table_name, column_name, json_extract_string(node, '$."' || column_name || '"') as v, json_type(node, '$."' || column_name || '"') as t from cols)
select table_name, column_name, count(*) as n_values from vals where t not in ('NULL', 'OBJECT', 'ARRAY') and not regexp_matches(v, '^[\\[{{]') group by 1, 2""",
    "p2_found": _TREE + "select m.c as channel_id, m.v as msg_id, coalesce(walk.root, 0) as root_msg_id, coalesce(walk.depth, -1) as depth from m left join walk on m.c = walk.c and m.v = walk.v where m.p is not null",
    "p2_sizes": _TREE
    + """, up as (select w.c, w.v, w.p as a from walk w where w.depth > 0 union all select up.c, up.v, w.p from up join walk w on w.c = up.c and w.v = up.a where w.depth > 0),
below as (select c, a, count(*) as n from up group by 1, 2)
select w.c as channel_id, w.v as msg_id, coalesce(b.n, 0) as n_descendants from walk w left join below b on b.c = w.c and b.a = w.v where w.depth > 0""",
    "p2_descendants": _PREORDER + "select w.c as channel_id, w.v as msg_id, w.root as root_msg_id, cast(o.pos as bigint) as pos, cast(s.size - 1 as bigint) as n_descendants from walk w join sized s on s.c = w.c and s.v = w.v join placed o on o.c = w.c and o.v = w.v",
    "p2_paths": _PREORDER
    + """, above as (select c, v, v as a from walk union all select above.c, above.v, w.p from above join walk w on w.c = above.c and w.v = above.a where w.depth > 0)
select above.c as channel_id, above.v as msg_id, o.chain as chain_msg_id, min(w.depth) as from_depth, max(w.depth) as to_depth from above join placed o on o.c = above.c and o.v = above.a join walk w on w.c = above.c and w.v = above.a group by 1, 2, 3""",
    "p5_found": f"""with changes as (
  select channel_id, msg_id, {instant_sql("coalesce(edit_date, date)")} as at_us, 0 as op, {instant_sql("last_seen")} as ls, seq, content_hash from messages
  union all select {_URI}, {instant_sql("observed_at")}, 1, 0, 0, null from message_tombstones where evidence in ('update', 'empty')),
ranked as (select *, row_number() over (partition by channel_id, msg_id order by at_us desc, op desc, ls desc, seq desc) as rn from changes)
select channel_id, msg_id, content_hash from ranked where rn = 1 and op = 0""",
    "p5_watermarks": """with n as (select 'messages' as stream, seq as commit_no from messages union select 'tombstones', id from message_tombstones),
r as (select stream, commit_no, row_number() over (partition by stream order by commit_no) as rn from n where commit_no >= 1)
select s.stream, coalesce(max(r.commit_no), 0) as watermark from (select distinct stream from n) s left join r on r.stream = s.stream and r.commit_no = r.rn group by 1""",
    "p6_found": _VERSIONS + "select channel_id, attribute, id as from_id, coalesce(lead(id) over (partition by channel_id, attribute order by at_us, id), 0) as next_id from kept",
    "p6_as_of": _VERSIONS
    + """, spans as (select channel_id, attribute, value, at_us, lead(at_us) over (partition by channel_id, attribute order by at_us, id) as until from kept)
select channel_id, attribute, value from spans where at_us <= 1735689600000000 and (until is null or until > 1735689600000000)""",
    "p6_periods": _VERSIONS + "select channel_id, attribute, value, at_us as valid_from, lead(at_us) over (partition by channel_id, attribute order by at_us, id) as valid_to from kept",
}
