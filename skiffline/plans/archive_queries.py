"""Queries of the archive's own operators over whole tables, and their SQL.

Keys follow the operators: projections of the raw log, current states and histories,
ranges and gaps, joins, aggregates, graph edges, web captures, text search, scalar
functions, exports and the change stream.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiffline.functions import archive as fn
from skiffline.functions.instants import instant_micros, instant_sql
from skiffline.operators import merge, operations, projections, search, split, web
from skiffline.session import built_once, scratch_folder, table
from skiffline.sources import tables
from skiffline.streaming import feed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# DuckDB pieces shared by several queries.
_OPEN = """opened as (select id as raw_id, lower(kind) as tag, observed_at, tier, case when json_type(payload) = 'VARCHAR' then json_extract_string(payload, '$') else payload end as j
  from raw_records where json_valid(payload) and (json_type(payload) <> 'VARCHAR' or json_valid(json_extract_string(payload, '$'))))"""
_OBSERVED = f"""with {_OPEN},
listed as (select raw_id, observed_at, tier, 0 as pos, cast(j as json) as m from opened where tag in ('message', 'messageservice')
  union all select raw_id, observed_at, tier, pos - 1, ms[pos] as m from (
    select raw_id, observed_at, tier, ms, unnest(range(1, len(ms) + 1)) as pos from (
      select raw_id, observed_at, tier, list_concat(coalesce(cast(json_extract(j, '$.messages') as json[]), []), coalesce(cast(json_extract(j, '$.new_messages') as json[]), []),
        list_transform(list_filter(coalesce(cast(json_extract(j, '$.other_updates') as json[]), []), lambda u: json_type(u, '$.message') = 'OBJECT' and lower(json_extract_string(u, '$._')) = 'updateeditchannelmessage'), lambda u: json_extract(u, '$.message'))) as ms
      from opened where tag not in ('message', 'messageservice', 'messageempty')))),
observed as (select * from listed where json_extract(m, '$.id') is not null and json_type(m, '$.id') <> 'NULL' and lower(json_extract_string(m, '$._')) in ('message', 'messageservice'))
"""
_CHANNEL = "cast(json_extract_string(m, '$.peer_id.channel_id') as bigint)"
_MSG = "cast(json_extract_string(m, '$.id') as bigint)"


def _flags(names: list[str], *objects: str) -> str:
    """The members named of the first JSON object that has each, as JSON text."""
    has = " || ".join(f"""case {" ".join(f"when json_exists({o}, '$.{n}') then ', \"{n}\": ' || cast(json_extract({o}, '$.{n}') as varchar)" for o in objects)} else '' end""" for n in sorted(names))
    return f"nullif('{{' || substr({has}, 3) || '}}', '{{}}')"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_records")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.observed_messages(raw(spark, sf_dir))


# --- scans and sources -------------------------------------------------------------


@query("select lower(kind) as kind, tier, count(*) as n from raw_records group by 1, 2")
def raw_kind_counts(spark, sf_dir):
    """The raw log by kind (without case) and tier."""
    return raw(spark, sf_dir).groupBy(F.lower("kind").alias("kind"), "tier").agg(F.count("*").alias("n"))


@query("select seq, media_json as canonical from messages where media_json is not null")
def canonical_media(spark, sf_dir):
    """Canonical JSON of canonical JSON is itself."""
    return messages(spark, sf_dir).where("media_json is not null").select("seq", fn.canonical_json("media_json").alias("canonical"))


@query("select channel_id, msg_id, seq from messages where channel_id = (select min(channel_id) from messages) and msg_id < 200 order by msg_id desc, seq desc limit 100")
def history_page(spark, sf_dir):
    """One page of the first channel's history below an id (the page size is the feature)."""
    m = messages(spark, sf_dir)
    return tables.history_page(m, m.agg(F.min("channel_id")).scalar(), 200).select("channel_id", "msg_id", "seq")


@query("""with w as (select distinct channel_id, msg_id + 1 as msg_id from messages)
select w.channel_id, w.msg_id, h.msg_id is null as is_empty from w left join (select distinct channel_id, msg_id from messages) h on h.channel_id = w.channel_id and h.msg_id = w.msg_id""")
def point_lookup(spark, sf_dir):
    """The successor of every message id, looked up; missing ones are empty."""
    m = messages(spark, sf_dir)
    return tables.lookup(m.select("channel_id", (F.col("msg_id") + 1).alias("msg_id")).distinct(), m)


@query(f"""with {_OPEN}, d as (select raw_id, cast(json_extract_string(j, '$.pts') as bigint) as pts from opened where tag like '%channeldifference%')
select raw_id, pts from d where pts > (select floor(avg(pts)) from d)""")
def difference_since(spark, sf_dir):
    """Change batches past a cursor (the mean cursor of all)."""
    d = projections.parsed(raw(spark, sf_dir)).where("tag like '%channeldifference%'").select("raw_id", F.col("p.pts").alias("pts"))
    return d.where(F.col("pts") > d.agg(F.floor(F.avg("pts"))).scalar())


# --- projections ---------------------------------------------------------------------


@query(
    _OBSERVED
    + f"""select raw_id as source_raw_id, cast(pos as int) as pos, {_CHANNEL} as channel_id, {_MSG} as msg_id, coalesce(json_extract_string(m, '$.message'), '') as text,
case when regexp_matches(json_extract_string(m, '$.date'), '^[0-9]{{1,12}}$') then strftime(make_timestamp(cast(json_extract_string(m, '$.date') as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') else json_extract_string(m, '$.date') end as date,
json_extract_string(m, '$.media._') as media_kind, cast(json_extract_string(m, '$.reply_to.reply_to_msg_id') as bigint) as reply_to_msg_id,
case when lower(json_extract_string(m, '$.from_id._')) = 'peeruser' then 'tg:user:' || json_extract_string(m, '$.from_id.user_id') when lower(json_extract_string(m, '$.from_id._')) = 'peerchannel' then 'tg:channel:' || json_extract_string(m, '$.from_id.channel_id') end as from_uri,
cast(lower(json_extract_string(m, '$._')) = 'messageservice' as int) as is_service, json_extract_string(m, '$.post_author') as post_author, cast(json_extract_string(m, '$.grouped_id') as bigint) as grouped_id, cast(json_extract_string(m, '$.via_bot_id') as bigint) as via_bot_id,
cast(json_extract_string(m, '$.reply_to.reply_to_top_id') as bigint) as reply_to_top_id from observed"""
)
def message_projection(spark, sf_dir):
    """Message objects of the raw log as rows."""
    return projections.message_rows(observed(spark, sf_dir)).select("source_raw_id", "pos", "channel_id", "msg_id", "text", "date", "media_kind", "reply_to_msg_id", "from_uri", "is_service", "post_author", "grouped_id", "via_bot_id", "reply_to_top_id")


@query("select seq, sha256(text || chr(0) || coalesce(media_json, '')) as computed, sha256(text || chr(0) || coalesce(media_json, '')) = content_hash as same from messages")
def content_hash(spark, sf_dir):
    """The hash of text and media, against the delivered one."""
    h = fn.content_hash(F.col("text"), F.col("media_json"))
    return messages(spark, sf_dir).select("seq", h.alias("computed"), (h == F.col("content_hash")).alias("same"))


@query(f"with {_OPEN} select distinct source_raw_id, uri, content_hash from messages where source_raw_id in (select raw_id from opened)")
def projected_hashes(spark, sf_dir):
    """Delivered hashes (of text and canonical media) that come out of the raw record they name, if that is valid JSON."""
    found = projections.message_rows(observed(spark, sf_dir)).select("source_raw_id", "uri", "content_hash").distinct()
    return messages(spark, sf_dir).where("source_raw_id is not null").select("source_raw_id", "uri", "content_hash").distinct().join(found, ["source_raw_id", "uri", "content_hash"], "left_semi")


@query(
    f"""with {_OPEN}, f as (select raw_id, j, json_extract(j, '$.full_chat') as c, list_filter(coalesce(cast(json_extract(j, '$.chats') as json[]), []), lambda x: json_extract_string(x, '$.id') = json_extract_string(j, '$.full_chat.id'))[1] as own from opened where json_extract_string(j, '$.full_chat.id') is not null)
select raw_id, cast(json_extract_string(c, '$.id') as bigint) as id, json_extract_string(own, '$.title') as title, json_extract_string(c, '$.about') as about,
case when json_extract_string(own, '$.broadcast') = 'true' then 'broadcast' when json_extract_string(own, '$.gigagroup') = 'true' then 'gigagroup' when json_extract_string(own, '$.megagroup') = 'true' and json_extract_string(own, '$.forum') = 'true' then 'forum' when json_extract_string(own, '$.megagroup') = 'true' then 'megagroup' end as kind,
nullif(cast(json_extract_string(c, '$.linked_chat_id') as bigint), 0) as linked_chat_id, cast(json_extract_string(c, '$.participants_count') as bigint) as participants_count,
case when length(json_extract_string(c, '$.about')) > 0 then sha256(json_extract_string(c, '$.about')) end as about_hash, cast(json_extract_string(c, '$.online_count') as bigint) as online_count, {_flags(projections.CHANNEL_FLAGS, "own", "c")} as flags_json,
case when json_array_length(own, '$.restriction_reason') > 0 then cast(json_extract(own, '$.restriction_reason') as varchar) end as restriction_json from f"""
)
def channel_projection(spark, sf_dir):
    """Full channel objects as rows."""
    return projections.channel_rows(raw(spark, sf_dir)).select("raw_id", "id", "title", "about", "kind", "linked_chat_id", "participants_count", "about_hash", "online_count", "flags_json", "restriction_json")


_PEERS = f"""with {_OPEN}, o as (select raw_id, observed_at, os[pos] as o, pos - 1 as pos from (select raw_id, observed_at, os, unnest(range(1, len(os) + 1)) as pos from (
  select raw_id, observed_at, list_concat(coalesce(cast(json_extract(j, '$.chats') as json[]), []), coalesce(cast(json_extract(j, '$.users') as json[]), [])) as os from opened))),
named as (select *, lower(json_extract_string(o, '$._')) as t, list_filter(coalesce(cast(json_extract(o, '$.usernames') as json[]), []), lambda x: json_extract_string(x, '$.editable') = 'true') as ed, list_filter(coalesce(cast(json_extract(o, '$.usernames') as json[]), []), lambda x: json_extract_string(x, '$.active') = 'true') as ac from o where json_extract_string(o, '$.id') is not null),
peers as (select raw_id, pos, observed_at, case when t like 'user%' then 'user' when t like 'channel%' then 'channel' when t like 'chat%' then 'chat' end as kind, cast(json_extract_string(o, '$.id') as bigint) as id,
  cast(json_extract_string(o, '$.access_hash') as bigint) as access_hash, cast(coalesce(json_extract_string(o, '$.min') = 'true', false) as int) as is_min,
  case when length(json_extract_string(o, '$.username')) > 0 then json_extract_string(o, '$.username') when len(ed) > 0 then json_extract_string(ed[1], '$.username') else json_extract_string(ac[1], '$.username') end as username,
  json_extract_string(o, '$.first_name') as first_name, json_extract_string(o, '$.last_name') as last_name, json_extract_string(o, '$.title') as title, {_flags(projections.PEER_FLAGS, "o")} as flags_json from named),
p as (select 'tg:' || kind || ':' || id as uri, * from peers where kind is not null)
"""


@query(_PEERS + "select uri, kind, id, is_min, access_hash, username, first_name, last_name, title, flags_json, raw_id, cast(pos as int) as pos from p")
def peer_projection(spark, sf_dir):
    """Chats and users of every payload as peers."""
    return projections.peer_rows(raw(spark, sf_dir)).select("uri", "kind", "id", "is_min", "access_hash", "username", "first_name", "last_name", "title", "flags_json", "raw_id", "pos")


@query(
    _OBSERVED
    + f"""select 'tg:user:' || json_extract_string(m, '$.from_id.user_id') as uri, {_CHANNEL} as seen_in_chat, {_MSG} as seen_in_msg, raw_id, cast(pos as int) as pos from observed
where lower(json_extract_string(m, '$.from_id._')) = 'peeruser' and json_extract_string(m, '$.from_id.user_id') is not null"""
)
def author_stubs(spark, sf_dir):
    """Partial peers from the authors of messages."""
    return projections.author_stubs(observed(spark, sf_dir)).select("uri", "seen_in_chat", "seen_in_msg", "raw_id", "pos")


_METRICS = f"""metrics as (select raw_id, pos, observed_at, 'tg:msg:' || {_CHANNEL} || '/' || {_MSG} as message_uri, cast(json_extract_string(m, '$.views') as bigint) as views, cast(json_extract_string(m, '$.forwards') as bigint) as forwards,
  cast(json_extract_string(m, '$.replies.replies') as bigint) as replies from observed)"""


@query(_OBSERVED + f", {_METRICS} select message_uri, views, forwards, replies, raw_id, cast(pos as int) as pos from metrics where coalesce(views, forwards, replies) is not null")
def metric_rows(spark, sf_dir):
    """Counters where one is given."""
    return projections.metric_rows(observed(spark, sf_dir)).select("message_uri", "views", "forwards", "replies", "raw_id", "pos")


@query("select 'web' as origin, id, source, channel_username, msg_id, url from web_snapshots where source in ('tme', 'wayback')")
def capture_rows(spark, sf_dir):
    """Captures of both origins, their origin checked."""
    w = tables.checked(table(spark, sf_dir, "web_snapshots"), "source", tables.CAPTURES)
    both = w.where("source = 'tme'").unionByName(w.where("source = 'wayback'"))
    return both.select(F.lit("web").alias("origin"), "id", "source", "channel_username", "msg_id", "url")


_MEDIA = """media as (select cast(json_extract(media_json, '$.document.attributes') as varchar) as attributes, seq, uri, channel_id, msg_id, case when json_extract_string(media_json, '$.photo.id') is not null then 'photo' when json_extract_string(media_json, '$.document.id') is not null then 'document' end as kind,
  cast(coalesce(json_extract_string(media_json, '$.photo.id'), json_extract_string(media_json, '$.document.id')) as bigint) as content_id, json_extract_string(media_json, '$.document.mime_type') as mime,
  json_extract_string(list_filter(coalesce(cast(json_extract(media_json, '$.document.attributes') as json[]), []), lambda a: lower(json_extract_string(a, '$._')) = 'documentattributefilename')[1], '$.file_name') as fname
  from messages where media_kind is not null and deleted_at is null)"""


@query(
    f"""with {_MEDIA} select seq, uri, kind, content_id, case when kind = 'photo' then 'image/jpeg' else mime end as mime_type, case when kind = 'document' then fname end as file_name, case when kind = 'document' then attributes end as attributes_json,
case when kind = 'photo' then '.jpg' when regexp_extract(fname, '[^/.](\\.[^./]+)$', 1) <> '' then regexp_extract(fname, '[^/.](\\.[^./]+)$', 1) else coalesce(case mime {" ".join(f"when '{k}' then '{v}'" for k, v in fn.MIME_SUFFIXES.items())} end, '') end as suffix from media"""
)
def media_attributes(spark, sf_dir):
    """What the media of living messages hold."""
    return projections.media_rows(messages(spark, sf_dir)).select("seq", "uri", "kind", "content_id", "mime_type", "file_name", "attributes_json", "suffix")


# --- predicates ----------------------------------------------------------------------


@query("select url, coalesce(regexp_matches(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^(t\\.me|www\\.t\\.me|web\\.archive\\.org)$'), false) as allowed, text <> '' as has_text from web_snapshots")
def allowed_captures(spark, sf_dir):
    """The host allow-list, and the test for text."""
    return table(spark, sf_dir, "web_snapshots").select("url", fn.allowed_host(F.col("url")).alias("allowed"), (F.col("text") != "").alias("has_text"))


# --- current state and history ---------------------------------------------------------


@query("""with r as (select *, row_number() over (partition by channel_id, msg_id order by seq desc) as rn, min_by(first_seen, seq) over (partition by channel_id, msg_id) as first_obs from messages)
select channel_id, msg_id, seq, text, content_hash, last_seen, first_obs as first_seen from r where rn = 1""")
def current_messages(spark, sf_dir):
    """The last observation of each message, first seen from the first."""
    cols = ["channel_id", "msg_id", "seq", "text", "content_hash", "last_seen", "first_seen"]
    obs = messages(spark, sf_dir).select(*cols).withColumn("arrival", F.col("seq"))
    return merge.last_state(obs, ["channel_id", "msg_id"], ["arrival"], first=["first_seen"]).select(*cols)


@query(
    f"""with {_OPEN}, f as (select raw_id, observed_at, json_extract(j, '$.full_chat') as c, list_filter(coalesce(cast(json_extract(j, '$.chats') as json[]), []), lambda x: json_extract_string(x, '$.id') = json_extract_string(j, '$.full_chat.id'))[1] as own from opened where json_extract_string(j, '$.full_chat.id') is not null),
r as (select cast(json_extract_string(c, '$.id') as bigint) as id, raw_id, observed_at, json_extract_string(own, '$.title') as title, json_extract_string(c, '$.about') as about, cast(json_extract_string(c, '$.participants_count') as bigint) as participants_count, row_number() over (partition by json_extract_string(c, '$.id') order by raw_id desc) as rn,
  first_value(observed_at) over (partition by json_extract_string(c, '$.id') order by raw_id) as first_seen, count(*) over (partition by json_extract_string(c, '$.id')) as n_snapshots from f)
select id, title, about, participants_count, raw_id as source_raw_id, first_seen, observed_at as last_seen, n_snapshots from r where rn = 1"""
)
def projected_channels(spark, sf_dir):
    """Channels from full objects: all columns of the last observation, first seen from the first, a snapshot for each."""
    rows = projections.channel_rows(raw(spark, sf_dir)).withColumn("arrival", F.col("raw_id")).withColumn("first_seen", F.col("observed_at"))
    last = merge.last_state(rows, ["id"], ["arrival"], first=["first_seen"])
    snapshots = rows.groupBy("id").agg(F.count("*").alias("n_snapshots"))
    return last.join(snapshots, "id").select("id", "title", "about", "participants_count", F.col("raw_id").alias("source_raw_id"), "first_seen", F.col("observed_at").alias("last_seen"), "n_snapshots")


@query("select channel_id, max(id) as id, arg_max(coalesce(title, ''), id) as title, arg_max(coalesce(participants_count, -1), id) as participants_count from channel_snapshots group by 1")
def current_channels(spark, sf_dir):
    """The last landed snapshot of each channel."""
    obs = table(spark, sf_dir, "channel_snapshots").select("channel_id", "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("participants_count", F.lit(-1)).alias("participants_count"))
    return merge.last_state(obs.withColumn("arrival", F.col("id")), ["channel_id"], ["arrival"]).select("channel_id", "id", "title", "participants_count")


@query(
    _PEERS
    + """, k as (select uri, max(raw_id * 100000 + pos) filter (is_min = 0) as f, max(raw_id * 100000 + pos) as l, min(raw_id * 100000 + pos) as s from p group by 1)
select k.uri, a.is_min, a.username, a.first_name, a.title, b.raw_id, b.observed_at as last_seen, c.observed_at as first_seen from k join p a on a.uri = k.uri and a.raw_id * 100000 + a.pos = coalesce(k.f, k.l) join p b on b.uri = k.uri and b.raw_id * 100000 + b.pos = k.l join p c on c.uri = k.uri and c.raw_id * 100000 + c.pos = k.s"""
)
def merged_peers(spark, sf_dir):
    """Partial peers never overwrite full ones."""
    return merge.merged_peers(projections.peer_rows(raw(spark, sf_dir)), ["raw_id", "pos"]).select("uri", "is_min", "username", "first_name", "title", "raw_id", "last_seen", "first_seen")


@query(f"""with f as (select uri, min({instant_sql("first_seen")}) as seen from messages group by 1)
select t.message_uri as uri, arg_min(t.observed_at, t.id) as deleted_at from message_tombstones t join f on f.uri = t.message_uri where t.evidence in ('update', 'empty') and {instant_sql("t.observed_at")} >= f.seen group by 1""")
def deleted_messages(spark, sf_dir):
    """When messages were first known to be deleted."""
    m = messages(spark, sf_dir).select("uri", instant_micros(F.col("first_seen")).alias("seen"))
    t = tables.checked(table(spark, sf_dir, "message_tombstones"), "evidence", tables.EVIDENCE)
    return merge.deleted_at(m, t.withColumn("at", instant_micros(F.col("observed_at"))))


@query(f"""with {_OPEN} select coalesce(json_extract_string(j, '$.full_chat.id'), json_extract_string(j, '$.chats[0].id')) as channel, arg_max(cast(json_extract_string(j, '$.pts') as bigint), raw_id) as pts from opened where json_extract_string(j, '$.pts') is not null group by 1""")
def latest_cursors(spark, sf_dir):
    """The last value of each channel's change cursor."""
    rows = projections.parsed(raw(spark, sf_dir)).select(F.coalesce("p.full_chat.id", F.get("p.chats", 0)["id"]).cast("string").alias("channel"), F.col("p.pts").alias("pts"), "raw_id").where("pts is not null")
    return merge.latest_values(rows, ["channel"], "pts", ["raw_id"])


@query(f"with {_MEDIA} select kind, content_id, arg_min(uri, (msg_id, seq)) as uri, count(*) as n from media where content_id is not null group by 1, 2")
def media_owners(spark, sf_dir):
    """The first message that brought each content, and how many did."""
    rows = projections.media_rows(messages(spark, sf_dir)).where("content_id is not null")
    own = merge.first_owner(rows.select("kind", "content_id", "uri", "msg_id", "seq"), ["kind", "content_id"], ["msg_id", "seq"]).select("kind", "content_id", "uri")
    return own.join(rows.groupBy("kind", "content_id").agg(F.count("*").alias("n")), ["kind", "content_id"])


@query(f"""with {_MEDIA}, r as (select content_id, row_number() over (partition by kind, content_id order by msg_id, seq) as rn from media)
select case when content_id is null then 'skipped_kind' when rn = 1 then 'downloaded' else 'duplicates' end as disposition, count(*) as n from r group by 1""")
def media_dispositions(spark, sf_dir):
    """What happens to each message's media, counted."""
    rows = projections.media_rows(messages(spark, sf_dir)).select("kind", "content_id", "msg_id", "seq")
    return merge.dispositions(rows, ["kind", "content_id"], ["msg_id", "seq"]).groupBy("disposition").agg(F.count("*").alias("n"))


@query("""with r as (select seq, uri, content_hash, lag(content_hash) over (partition by uri order by seq) as b from messages) select seq, uri, content_hash from r where b is null or b <> content_hash""")
def revision_log(spark, sf_dir):
    """Observations that changed a message."""
    return merge.revisions(messages(spark, sf_dir).select("seq", "uri", "content_hash"), "uri", "content_hash", "seq")


@query("""with r as (select uri, content_hash, lag(content_hash) over (partition by uri order by seq) as b from messages) select uri, count(*) as n_revisions from r where b is null or b <> content_hash group by 1""")
def revision_counts(spark, sf_dir):
    """Revisions per message."""
    return merge.revisions(messages(spark, sf_dir).select("seq", "uri", "content_hash"), "uri", "content_hash", "seq").groupBy("uri").agg(F.count("*").alias("n_revisions"))


@query(f"""with s as (select id, channel_id, participants_count, {instant_sql("observed_at")} as at_us from channel_snapshots)
select id, channel_id, participants_count, participants_count - lag(participants_count) over (partition by channel_id order by at_us, id) as participants_count_delta from s""")
def snapshot_deltas(spark, sf_dir):
    """Change of each snapshot against the one before."""
    s = table(spark, sf_dir, "channel_snapshots").select("id", "channel_id", "participants_count", instant_micros(F.col("observed_at")).alias("at"))
    return merge.deltas(s, "channel_id", "at", "id", "participants_count").drop("at")


# --- ranges and gaps -------------------------------------------------------------------

_RANGES = "select channel_id, floor(msg_id / 10) as page, min(msg_id) as lo, max(msg_id) as hi from messages group by 1, 2"


def _ranges(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("channel_id", F.floor(F.col("msg_id") / 10).alias("page")).agg(F.min("msg_id").alias("lo"), F.max("msg_id").alias("hi")).drop("page")


@query(f"""with r as ({_RANGES}), m as (select *, max(hi) over (partition by channel_id order by lo, hi rows between unbounded preceding and 1 preceding) as reach from r),
i as (select *, sum(case when reach is null or lo > reach + 1 then 1 else 0 end) over (partition by channel_id order by lo, hi) as island from m) select channel_id, min(lo) as lo, max(hi) as hi from i group by channel_id, island""")
def range_coalesce(spark, sf_dir):
    """The ranges seen in pages of ten ids, merged where they touch."""
    return merge.coalesced_ranges(_ranges(spark, sf_dir), "channel_id")


@query("""with n as (select channel_id, msg_id, lead(msg_id) over (partition by channel_id order by msg_id) as nx from (select distinct channel_id, msg_id from messages))
select channel_id, unnest(range(msg_id + 1, nx)) as msg_id from n where nx > msg_id + 1""")
def gap_ids(spark, sf_dir):
    """Ids that no message has, inside each channel's span."""
    return merge.expanded(merge.gaps(messages(spark, sf_dir), "channel_id", "msg_id"), "channel_id", "msg_id")


@query(f"""with r as ({_RANGES}), s as (select channel_id, min(msg_id) as a, max(msg_id) as b from messages group by 1), ids as (select channel_id, unnest(range(a, b + 1)) as msg_id from s)
select ids.channel_id, ids.msg_id from ids anti join (select channel_id, unnest(range(lo, hi + 1)) as msg_id from r) c on c.channel_id = ids.channel_id and c.msg_id = ids.msg_id""")
def missing_ids(spark, sf_dir):
    """Ids of each channel's span outside its ranges, by interval arithmetic."""
    spans = messages(spark, sf_dir).groupBy("channel_id").agg(F.min("msg_id").alias("lo"), F.max("msg_id").alias("hi"))
    return merge.expanded(merge.uncovered(spans, _ranges(spark, sf_dir), "channel_id"), "channel_id", "msg_id")


@query("select channel_id, min(msg_id) as min_id, max(msg_id) as max_id, count(distinct msg_id) as n_ids from messages group by 1")
def sweep_bounds(spark, sf_dir):
    """A5: bounds of each channel's ids."""
    return messages(spark, sf_dir).groupBy("channel_id").agg(F.min("msg_id").alias("min_id"), F.max("msg_id").alias("max_id"), F.countDistinct("msg_id").alias("n_ids"))


@query("""with g as (select distinct channel_id, msg_id from messages), r as (select *, row_number() over (partition by channel_id order by msg_id) as rn from g) select channel_id, cast(floor((rn - 1) / 200) as bigint) as chunk, count(*) as n, min(msg_id) as first_id from r group by 1, 2""")
def id_chunks(spark, sf_dir):
    """Ids dealt into chunks of 200."""
    return merge.chunks(messages(spark, sf_dir), "channel_id", "msg_id").groupBy("channel_id", "chunk").agg(F.count("*").alias("n"), F.min("msg_id").alias("first_id"))


# --- joins -----------------------------------------------------------------------------


@query(f"with {_MEDIA}, own as (select kind, content_id, arg_min(uri, (msg_id, seq)) as uri from media where content_id is not null group by 1, 2) select o.kind, o.content_id, m.channel_id, count(*) as n_rows from own o join messages m on m.uri = o.uri group by 1, 2, 3")
def content_index(spark, sf_dir):
    """K1: owners of contents joined to their messages."""
    rows = projections.media_rows(messages(spark, sf_dir)).where("content_id is not null").select("kind", "content_id", "uri", "msg_id", "seq")
    own = merge.first_owner(rows, ["kind", "content_id"], ["msg_id", "seq"]).select("kind", "content_id", "uri")
    return own.join(messages(spark, sf_dir).select("uri", "channel_id"), "uri").groupBy("kind", "content_id", "channel_id").agg(F.count("*").alias("n_rows"))


_OWN = "tg:user:700000004"


@query(f"""with cur as (select channel_id, msg_id, uri, from_uri, seq, row_number() over (partition by channel_id, msg_id order by seq desc) as rn from messages),
r as (select message_uri, string_agg(content_hash, ',' order by observed_at, id) as hashes, count(*) as n from message_revisions group by 1)
select c.uri, c.from_uri, coalesce(r.n, 0) as n_revisions, coalesce(r.hashes, '') as hashes from cur c left join r on r.message_uri = c.uri where c.rn = 1 and c.from_uri is distinct from '{_OWN}'""")
def export_messages(spark, sf_dir):
    """Messages with their revisions as a nested array, the collecting account's own left out."""
    cur = merge.last_state(messages(spark, sf_dir).select("uri", "from_uri", "seq").withColumn("arrival", F.col("seq")), ["uri"], ["arrival"])
    rows = merge.nested_revisions(cur, table(spark, sf_dir, "message_revisions"), _OWN)
    return rows.select("uri", "from_uri", F.size("revisions").cast("bigint").alias("n_revisions"), F.array_join("revisions.content_hash", ",").alias("hashes"))


@query("""with p as (select w.id, w.url, 'tg:msg:' || c.id || '/' || w.msg_id as uri from web_snapshots w join channels c on c.username = w.channel_username where w.msg_id is not null), d as (select distinct message_uri from message_tombstones)
select p.id, p.uri, d.message_uri is not null as is_deleted from p left join d on d.message_uri = p.uri""")
def recovered_posts(spark, sf_dir):
    """Captured posts whose messages are known to be deleted."""
    w, c = table(spark, sf_dir, "web_snapshots").where("msg_id is not null"), table(spark, sf_dir, "channels").select(F.col("id").alias("channel_id"), F.col("username").alias("channel_username"))
    rows = w.join(c, "channel_username").select("id", fn.entity_uri("msg", F.col("channel_id"), F.col("msg_id")).alias("uri"))
    return web.recovered(rows, table(spark, sf_dir, "message_tombstones")).select("id", "uri", "is_deleted")


@query(_OBSERVED + f", {_METRICS}, v as (select message_uri, max(views) as views from metrics where coalesce(views, forwards, replies) is not null group by 1) select m.uri, m.date, m.seq, v.views from messages m left join v on v.message_uri = m.uri where m.text <> '' order by m.date desc, m.seq desc limit 20")
def recent_posts(spark, sf_dir):
    """The twenty most recent posts with their views (a top-k report)."""
    v = projections.metric_rows(observed(spark, sf_dir)).groupBy(F.col("message_uri").alias("uri")).agg(F.max("views").alias("views"))
    top = messages(spark, sf_dir).where("text <> ''").select("uri", "date", "seq").orderBy(F.col("date").desc(), F.col("seq").desc()).limit(20)
    return top.join(v, "uri", "left").select("uri", "date", "seq", "views")


@query(f"""with {_OPEN}, k as (select raw_id, case when tag like '%difference%' then 'changes' when tag like '%chatfull%' then 'channel' when tag like '%messages%' then 'page' else 'single' end as route, coalesce(json_array_length(j, '$.other_updates'), 0) as updates from opened)
select route, count(*) as n, cast(sum(updates) as bigint) as updates from k group by 1""")
def routed_payloads(spark, sf_dir):
    """Payloads routed by their tag, with the changes they hold."""
    tag = F.col("tag")
    route = F.when(tag.contains("difference"), "changes").when(tag.contains("chatfull"), "channel").when(tag.contains("messages"), "page").otherwise("single")
    n = F.coalesce(F.size("p.other_updates"), F.lit(0))
    return projections.parsed(raw(spark, sf_dir)).groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.sum(F.greatest(n, F.lit(0))).alias("updates"))


# --- aggregates --------------------------------------------------------------------------


@query("select (select count(*) from channels) as channels, (select count(*) from messages) as messages, (select count(*) from message_revisions) as revisions, (select count(*) from message_tombstones) as tombstones")
def status_counts(spark, sf_dir):
    """A1: rows of each table."""
    names = ["channels", "messages", "message_revisions", "message_tombstones"]
    counts = {n if n == "messages" else n.removeprefix("message_"): table(spark, sf_dir, n).agg(F.count("*")).scalar() for n in names}
    return spark.range(1).select(*[c.alias(n) for n, c in counts.items()])


@query(r"""with a as (select channel_id, 1 as m, 0 as r, 0 as t from messages union all select cast(regexp_extract(message_uri, '^tg:msg:([0-9]+)/', 1) as bigint), 0, 1, 0 from message_revisions union all select cast(regexp_extract(message_uri, '^tg:msg:([0-9]+)/', 1) as bigint), 0, 0, 1 from message_tombstones)
select channel_id, cast(sum(m) as bigint) as messages, cast(sum(r) as bigint) as revisions, cast(sum(t) as bigint) as tombstones from a group by 1""")
def status_by_channel(spark, sf_dir):
    """Messages, revisions and tombstones per channel, in one aggregate."""
    of = fn.parsed_uri(F.col("message_uri"))["id"]
    parts = [messages(spark, sf_dir).select("channel_id", F.lit("m").alias("k")), *[table(spark, sf_dir, t).select(of.alias("channel_id"), F.lit(k).alias("k")) for t, k in (("message_revisions", "r"), ("message_tombstones", "t"))]]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("channel_id").agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("m", "messages"), ("r", "revisions"), ("t", "tombstones"))])


@query("with c as (select 'm:' || lower(coalesce(media_kind, 'none')) as name, count(*) as n from messages group by 1 union all select 'm:' || lower('none'), count(*) from message_revisions where media_json is null) select name, cast(sum(n) as bigint) as n from c group by 1")
def merged_counters(spark, sf_dir):
    """A4: counters of two phases merged by name."""
    a = messages(spark, sf_dir).groupBy(F.concat(F.lit("m:"), F.lower(F.coalesce("media_kind", F.lit("none")))).alias("name")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "message_revisions").where("media_json is null").agg(F.count("*").alias("n")).select(F.lit("m:none").alias("name"), "n")
    return operations.merged_counts(a.unionByName(b))


@query(_PEERS + "select kind, count(distinct uri) as peers, count(*) as n from p group by 1")
def distinct_peers(spark, sf_dir):
    """Distinct peers touched, by kind."""
    return projections.peer_rows(raw(spark, sf_dir)).groupBy("kind").agg(F.countDistinct("uri").alias("peers"), F.count("*").alias("n"))


@query(f"with {_OPEN} select raw_id, coalesce(cast(json_extract_string(j, '$.count') as bigint), json_array_length(j, '$.chats')) as total from opened where json_type(j, '$.chats') = 'ARRAY'")
def true_totals(spark, sf_dir):
    """The announced count, else the length of the list."""
    rows = projections.parsed(raw(spark, sf_dir)).where("p.chats is not null")
    return rows.select("raw_id", F.coalesce("p.count", F.size("p.chats").cast("bigint")).alias("total"))


@query("with l as (select event_type as method, cast(floor(epoch(ts)) as bigint) + cast(json_extract_string(props, '$.k') as bigint) as until from events) select method, max(until) as until, greatest(0, max(until) - 1704100000) as remaining from l group by 1")
def latest_cooldowns(spark, sf_dir):
    """The wait that each method still has, from the log of waits (events as its stand-in)."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_type").alias("method"), (F.unix_seconds(F.col("ts").cast("timestamp")) + F.get_json_object("props", "$.k").try_cast("bigint")).alias("until"))
    return operations.cooldowns(log, F.lit(1_704_100_000))


@query(f"""with w as (select id, url, content_hash, {instant_sql("fetched_at")} as at_us, lag(content_hash) over (partition by channel_username, msg_id order by {instant_sql("fetched_at")}, id) as b from web_snapshots where content_hash is not null)
select id, url, content_hash from w where b is null or b <> content_hash""")
def archive_collapse(spark, sf_dir):
    """Captures that differ from the capture before of the same post."""
    w = table(spark, sf_dir, "web_snapshots").withColumn("at", instant_micros(F.col("fetched_at")))
    return merge.collapsed(w, ["channel_username", "msg_id"], "content_hash", "at", "id", F.col("content_hash").isNotNull()).select("id", "url", "content_hash")


@query("""with e as (select uri, seq, cast(unnest(range(cast(json_array_length(entities_json) as bigint))) as int) as pos, unnest(cast(entities_json as json[])) as e from messages where entities_json is not null), u as (select uri, seq, pos, json_extract_string(e, '$.url') as url from e where lower(json_extract_string(e, '$._')) = 'messageentitytexturl')
select url, uri, row_number() over (partition by url order by seq, pos) as place, count(*) over (partition by url) as n from u""")
def link_groups(spark, sf_dir):
    """A10, K8: messages of each hidden link, numbered in their order; a row each, so no group is gathered in one."""
    links = F.from_json("entities_json", "array<struct<_:string,url:string>>")
    rows = messages(spark, sf_dir).where("entities_json is not null").select("uri", "seq", F.posexplode(links).alias("pos", "e")).where(fn.tag_is(F.col("e._"), "messageentitytexturl")).select(F.col("e.url").alias("url"), "uri", "seq", "pos", F.lit(1).alias("one"))
    numbered = split.running_sum(rows, ["url"], ["seq", "pos"], "one", split.id_block(F.col("seq")), "place")
    return numbered.join(rows.groupBy("url").agg(F.count("*").alias("n")), "url").select("url", "uri", "place", "n")


@query("select user_id as profile, bool_or(event_type = 'error' and value > 50) as blocked from events group by 1")
def preflight(spark, sf_dir):
    """Whether a failing check blocks a profile (events as stand-in of checks)."""
    e = table(spark, sf_dir, "events")
    checks = e.select(F.col("user_id").alias("profile"), F.when(F.col("event_type") == "error", "fail").otherwise("warn").alias("severity"), (F.col("value") <= 50).alias("ok"))
    return operations.blocked(checks)


@query("""with a as (select c_custkey as profile, c_custkey % 2 = 0 as need, case when c_custkey % 3 = 0 then 'socks' end as proxy, c_acctbal as age, c_mktsegment = 'BUILDING' as pw, c_nationkey as n, c_name as name from customer),
c as (select profile, 'proxy' as name, not need or proxy is not null as ok, 'fail' as severity from a union all select profile, 'session_age', coalesce(age >= 30, false), 'fail' from a union all select profile, 'two_factor_auth', coalesce(pw, false), 'fail' from a
  union all select profile, 'privacy_phone', coalesce(n % 4 in (1, 2), false), 'fail' from a union all select profile, 'privacy_lastseen', coalesce(n % 4 = 1, false), 'fail' from a union all select profile, 'privacy_photo', coalesce(n % 4 = 2, false), 'fail' from a union all select profile, 'minimal_profile', coalesce(profile % 5 <> 0, false), 'warn' from a)
select profile, name, ok, severity, bool_or(severity = 'fail' and not ok) over (partition by profile) as blocks from c""")
def preflight_checks(spark, sf_dir):
    """Seven checks of each account, and whether one blocks it (customers as stand-in of accounts)."""
    c = table(spark, sf_dir, "customer")
    now, n = F.lit(1_767_225_600_000_000), F.col("c_nationkey") % 4
    closed, all_, none = F.lit('{"rules":[{"_":"PrivacyValueDisallowAll"}]}'), F.lit('{"rules":[{"_":"PrivacyValueAllowAll"}]}'), F.lit('{"rules":[]}')
    accounts = c.select(
        F.col("c_custkey").alias("profile"),
        (F.col("c_custkey") % 2 == 0).alias("require_proxy"),
        F.when(F.col("c_custkey") % 3 == 0, "socks").alias("proxy"),
        (now - F.col("c_acctbal") * 86_400_000_000).alias("session_created"),
        (F.col("c_mktsegment") == "BUILDING").alias("has_password"),
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("username"),
        F.lit("").alias("photo"),
        F.lit(None).cast("string").alias("about"),
        F.when(n.isin(1, 2), closed).otherwise(all_).alias("phone_rules"),
        F.when(n == 1, closed).otherwise(none).alias("lastseen_rules"),
        F.when(n == 2, closed).alias("photo_rules"),
    )
    checks = operations.preflight(accounts, now, 30)
    blocked = operations.blocked(checks)
    return checks.join(blocked.select("profile", F.col("blocked").alias("blocks")), "profile")


# --- graph ---------------------------------------------------------------------------------


@query("select 'tg:channel:' || id as subject_uri, 'tg:channel:' || linked_chat_id as object_uri from channels where coalesce(linked_chat_id, 0) <> 0")
def linked_edges(spark, sf_dir):
    """G1: channels and their groups."""
    c = table(spark, sf_dir, "channels").select("uri", "linked_chat_id", F.col("last_seen").alias("observed_at"), "source_raw_id")
    return projections.linked_edges(c).select("subject_uri", "object_uri")


_FORWARD = """select seq, uri as subject_uri, case lower(json_extract_string(fwd_json, '$.from_id._')) when 'peeruser' then 'tg:user:' || json_extract_string(fwd_json, '$.from_id.user_id') when 'peerchannel' then 'tg:channel:' || json_extract_string(fwd_json, '$.from_id.channel_id') when 'peerchat' then 'tg:chat:' || json_extract_string(fwd_json, '$.from_id.chat_id') end as object_uri from messages where fwd_json is not null"""


@query(f"with f as ({_FORWARD}) select subject_uri, object_uri from f where object_uri is not null")
def forward_edges(spark, sf_dir):
    """Messages and the peers they were forwarded from."""
    return projections.forward_edges(messages(spark, sf_dir)).select("subject_uri", "object_uri")


@query(f"with f as ({_FORWARD}) select distinct subject_uri, 'forwarded_from' as predicate, object_uri from f where object_uri is not null")
def edges_distinct(spark, sf_dir):
    """Each triple once."""
    return projections.forward_edges(messages(spark, sf_dir)).select("subject_uri", "predicate", "object_uri").distinct()


@query(f"""with f as ({_FORWARD}), e as (select distinct subject_uri, object_uri from f where object_uri like 'tg:channel:%'), own as (select distinct regexp_extract(subject_uri, '^tg:msg:([0-9]+)/', 1) as a, regexp_extract(object_uri, '([0-9]+)$', 1) as b from e)
select x.a as a, y.b as c, count(*) as n from own x join own y on y.a = x.b group by 1, 2""")
def two_hop(spark, sf_dir):
    """Channels two forwards apart: the graph joined to itself after reduction to channel pairs."""
    e = projections.forward_edges(messages(spark, sf_dir)).where(F.col("object_uri").startswith("tg:channel:"))
    own = e.select(F.regexp_extract("subject_uri", r"^tg:msg:([0-9]+)/", 1).alias("a"), F.regexp_extract("object_uri", r"([0-9]+)$", 1).alias("b")).distinct()
    return own.join(own.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").groupBy("a", "c").agg(F.count("*").alias("n"))


@query(f"with f as ({_FORWARD}) select subject_uri, object_uri, count(*) as n from f where object_uri is not null and (subject_uri like 'tg:msg:1700000001/%' or object_uri = 'tg:channel:1700000001') and object_uri <> '{_OWN}' group by 1, 2")
def export_edges(spark, sf_dir):
    """The edges of one channel, the collecting account's left out."""
    rows = merge.edges_of_channel(projections.forward_edges(messages(spark, sf_dir)), 1700000001, _OWN)
    return rows.groupBy("subject_uri", "object_uri").agg(F.count("*").alias("n"))


@query("""with e as (select seq, uri, text, cast(unnest(range(cast(json_array_length(entities_json) as bigint))) as int) as pos, unnest(cast(entities_json as json[])) as e from messages where entities_json is not null),
named as (select seq, uri, text, pos, json_extract_string(e, '$._') as entity, lower(json_extract_string(e, '$._')) as t, json_extract_string(e, '$.url') as url, cast(json_extract_string(e, '$.user_id') as bigint) as user_id, cast(json_extract_string(e, '$.offset') as bigint) as a, cast(json_extract_string(e, '$.length') as bigint) as n from e),
signs as (select seq, pos, a, n, unnest(range(len(cs))) as i, unnest(cs) as c from (select seq, pos, a, n, regexp_extract_all(text, '(?s).') as cs from named where t = 'messageentityurl')),
placed as (select *, case when unicode(c) > 65535 then 2 else 1 end as w, sum(case when unicode(c) > 65535 then 2 else 1 end) over (partition by seq, pos order by i) as upto from signs),
cut as (select seq, pos, coalesce(string_agg(c, '' order by i) filter (upto - w >= a and upto <= a + n), '') as url from placed group by 1, 2)
select x.uri, x.pos, x.entity, case when x.t = 'messageentitytexturl' then x.url when x.t = 'messageentityurl' then c.url end as url, case when x.t in ('messageentitymentionname', 'inputmessageentitymentionname') then x.user_id end as user_id
from named x left join cut c on c.seq = x.seq and c.pos = x.pos where (x.t = 'messageentitytexturl' and x.url is not null) or x.t = 'messageentityurl' or (x.t in ('messageentitymentionname', 'inputmessageentitymentionname') and x.user_id is not null)""")
def entity_links(spark, sf_dir):
    """The users and URLs that entities name, bare ones cut from the text by UTF-16 offsets."""
    return projections.entity_links(messages(spark, sf_dir)).select("uri", "pos", "entity", "url", "user_id")


@query("select url, null::varchar as kind, null::varchar as value from (select distinct url from web_snapshots) where not regexp_matches(url, '^https?://(t\\.me|telegram\\.me|telegram\\.dog)(/|$)')")
def link_targets(spark, sf_dir):
    """What captured URLs point to; none of them is the platform's."""
    w = table(spark, sf_dir, "web_snapshots").select("url").distinct()
    t = fn.link_target(F.col("url"))
    return w.select("url", t["kind"].alias("kind"), t["value"].alias("value"))


# --- web -----------------------------------------------------------------------------------


@query("select id, text from web_snapshots where raw is not null")
def capture_texts(spark, sf_dir):
    """The text of captured HTML, against the text that was delivered with it."""
    return web.capture_texts(table(spark, sf_dir, "web_snapshots"), F.col("id"), F.col("raw"), "post_text")


@query(r"""with w as (select id, url, regexp_replace(timestamp, '[^0-9]', '', 'g') as d, content_hash from web_snapshots where source = 'wayback' and timestamp is not null and length(regexp_replace(timestamp, '[^0-9]', '', 'g')) = 14)
select id as index_id, url, strftime(strptime(d, '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%S+00:00') as timestamp from w""")
def index_captures(spark, sf_dir):
    """Archive indexes (built from the captures) parsed back to rows."""
    w = table(spark, sf_dir, "web_snapshots").where("source = 'wayback' and timestamp is not null").withColumn("d", F.regexp_replace("timestamp", r"[^0-9]", "")).where(F.length("d") == 14)
    head = F.array(*[F.lit(x) for x in ("urlkey", "timestamp", "original", "statuscode", "digest")])
    body = F.to_json(F.array(head, F.array(F.lit("k"), "d", "url", F.lit("200"), F.coalesce("content_hash", F.lit("-"))), F.array(F.lit("short"))))
    return web.index_captures(web.index_rows(w.select("id", body.alias("body")), F.col("id"), F.col("body"))).select("index_id", "url", "timestamp")


# --- search ----------------------------------------------------------------------------------

_WORDS = "with t as (select doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' as w from documents where text is not null)"


def _index(spark, sf_dir):
    """The documents' token table, written once in an application."""
    return built_once(spark, sf_dir, ["documents"], "document-tokens", lambda: search.by_token(search.tokens(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))))


def _message_index(spark, sf_dir):
    return built_once(spark, sf_dir, ["messages"], "message-tokens", lambda: search.by_token(search.tokens(messages(spark, sf_dir), F.col("seq"), F.col("text"))))


_TOKENS = f"""words as (select seq as id, unnest(list_filter(regexp_split_to_array(translate(lower(text), '{search.ACCENTED}', '{search.PLAIN[: len(search.ACCENTED)]}'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')) as token, unnest(range(len(list_filter(regexp_split_to_array(translate(lower(text), '{search.ACCENTED}', '{search.PLAIN[: len(search.ACCENTED)]}'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')))) as pos from messages)"""


@query(f"with {_TOKENS} select distinct a.id as seq from words a join words b on b.id = a.id and b.token = 'poll' and abs(a.pos - b.pos) <= 4 where a.token = 'harbour'")
def search_near(spark, sf_dir):
    """Messages with two words near each other."""
    return search.near(_message_index(spark, sf_dir), "harbour", "poll", between=3).select(F.col("id").alias("seq"))


@query(f"""with {_TOKENS}, lens as (select id, count(*) as n from words group by 1), hits as (select id, token, count(*) as tf from words where token in ('ferry', 'midnight') group by 1, 2), dfs as (select token, count(*) as df from hits group by 1), w as (select count(*) as total, avg(n) as mean from lens)
select h.id as seq, round(sum(greatest(ln((w.total - d.df + 0.5) / (d.df + 0.5)), 1e-6) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * l.n / w.mean))), 6) as score from hits h join dfs d on d.token = h.token join lens l on l.id = h.id cross join w group by 1""")
def search_ranked(spark, sf_dir):
    """Messages with either word, with their rank."""
    return search.ranked(_message_index(spark, sf_dir), ["ferry", "midnight"]).select(F.col("id").alias("seq"), F.round("score", 6).alias("score"))


@query(_WORDS + " select doc_id from t where w like '% harbour %' and w like '% poll %' and w not like '% storm %'")
def search_boolean(spark, sf_dir):
    """All of, none of."""
    return search.search(_index(spark, sf_dir), all_of=["harbour", "poll"], none_of=["storm"]).select(F.col("id").alias("doc_id"))


@query(_WORDS + " select doc_id from t where w like '% tide table %' and (w like '% midnight %' or w like '% storm %')")
def search_phrase(spark, sf_dir):
    """A phrase and any of."""
    return search.search(_index(spark, sf_dir), phrases=[["tide", "table"]], any_of=["midnight", "storm"]).select(F.col("id").alias("doc_id"))


@query(_WORDS + " select doc_id from t where w like '% transl%' and w like '% relay %'")
def search_prefix(spark, sf_dir):
    """A prefix beside a word."""
    return search.search(_index(spark, sf_dir), prefixes=["transl"], all_of=["relay"]).select(F.col("id").alias("doc_id"))


# --- scalar functions -------------------------------------------------------------------------


@query(r"select id, message_uri, 'msg' as kind, cast(regexp_extract(message_uri, '^tg:msg:([0-9]+)/([0-9]+)$', 1) as bigint) as entity_id, cast(regexp_extract(message_uri, '^tg:msg:([0-9]+)/([0-9]+)$', 2) as bigint) as sub_id, true as same from message_tombstones")
def uri_round_trip(spark, sf_dir):
    """URIs taken apart and built again."""
    u = fn.strict_uri(F.col("message_uri"))
    return table(spark, sf_dir, "message_tombstones").select("id", "message_uri", u["kind"].alias("kind"), u["id"].alias("entity_id"), u["sub_id"].alias("sub_id"), (fn.entity_uri("msg", u["id"], u["sub_id"]) == F.col("message_uri")).alias("same"))


@query(f"select seq, strftime(make_timestamp({instant_sql('date')}), '%Y-%m-%dT%H:%M:%S') || case when {instant_sql('date')} % 1000000 = 0 then '' else '.' || lpad(cast({instant_sql('date')} % 1000000 as varchar), 6, '0') end || '+00:00' as iso from messages")
def iso_times(spark, sf_dir):
    """every notation of an instant as one."""
    return messages(spark, sf_dir).select("seq", fn.iso_text(F.timestamp_micros(instant_micros(F.col("date")))).alias("iso"))


@query(r"""with named as (select id, 'https://t.me/' || username as x, 'username' as kind, username as value, null::bigint as msg_id from channels where username is not null
union all select id, 't.me/' || username || '/' || id, 'msg_link', username, id from channels where username is not null
union all select id, '-100' || id, 'peer_id', '-100' || id, null from channels union all select id, '+' || id, 'phone', '+' || id, null from channels)
select id, x, kind, value, msg_id, kind <> 'phone' as leads_to_chat from named""")
def targets(spark, sf_dir):
    """What a user may name, by shape: every channel's name, message link, peer id and a number like a phone's."""
    c = table(spark, sf_dir, "channels").select("id", "username")
    name, number = F.col("username"), F.col("id").cast("string")
    texts = F.array(F.concat(F.lit("https://t.me/"), name), F.concat(F.lit("t.me/"), name, F.lit("/"), number), F.concat(F.lit("-100"), number), F.concat(F.lit("+"), number))
    t = fn.target(F.col("x"))
    return c.select("id", F.explode(texts).alias("x")).where("x is not null").select("id", "x", t["kind"].alias("kind"), t["value"].alias("value"), t["msg_id"].alias("msg_id"), fn.is_channel_like(t["kind"]).alias("leads_to_chat"))


@query(r"select id, regexp_extract(url, '/s/([^/]+)/([0-9]+)$', 1) as username, cast(nullif(regexp_extract(url, '/s/([^/]+)/([0-9]+)$', 2), '') as bigint) as msg_id from web_snapshots where source = 'tme'")
def post_ids(spark, sf_dir):
    """ids of posts split at the last slash."""
    p = fn.post_id(F.regexp_extract("url", r"/s/(.*)$", 1))
    return table(spark, sf_dir, "web_snapshots").where("source = 'tme'").select("id", p["username"].alias("username"), p["msg_id"].alias("msg_id"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, base64(encode(props)) as b64 from events")
def json_props(spark, sf_dir):
    """a path read from JSON, and base64."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.regexp_replace(F.base64("props"), r"\s", "").alias("b64"))


@query("select doc_id, sha256(replace(replace(text, 'harbour desk', '***'), 'harbour', '***')) as masked_hash from documents where text is not null")
def masked_texts(spark, sf_dir):
    """secrets masked, the longest first."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(fn.masked(F.col("text"), ["harbour", "harbour desk"]), 256).alias("masked_hash"))


@query(f"select id, cast(floor((1767225600000000 - {instant_sql('first_seen')}) / 86400000000) as bigint) as age_days from channels")
def session_ages(spark, sf_dir):
    """whole days since an instant."""
    age = operations.session_age_days(instant_micros(F.col("first_seen")), F.lit(1_767_225_600_000_000))
    return table(spark, sf_dir, "channels").select("id", age.alias("age_days"))


@query("""with e as (select event_id, case event_type when 'error' then 'FloodWaitError' when 'click' then 'ChannelPrivateError' when 'view' then 'PeerFloodError' else 'TimeoutError' end as err, cast(json_extract_string(props, '$.k') as bigint) as k from events)
select event_id, case err when 'FloodWaitError' then case when k <= 60 then 'retry' else 'phase_stop' end when 'ChannelPrivateError' then 'skip' when 'PeerFloodError' then 'hard_stop' else 'retry' end as disposition from e""")
def error_dispositions(spark, sf_dir):
    """what to do about each error (events as stand-in)."""
    kind = F.when(F.col("event_type") == "error", "FloodWaitError").when(F.col("event_type") == "click", "ChannelPrivateError").when(F.col("event_type") == "view", "PeerFloodError").otherwise("TimeoutError")
    return table(spark, sf_dir, "events").select("event_id", fn.disposition(kind, F.get_json_object("props", "$.k").try_cast("bigint")).alias("disposition"))


@query("""with e as (select event_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by event_type order by ts, event_id) as b from events) select event_id, round(greatest(0.0, 300.0 - coalesce((us - b) / 1000000.0, 300.0)), 3) as wait from e""")
def pacing(spark, sf_dir):
    """F16: seconds to wait before each call, by the call before of the same kind."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = split.neighbour(e, ["event_type"], ["us", "event_id"], "us", split.time_block(F.col("us")), "before", by_count=True)
    since = (F.col("us") - F.col("before")) / F.lit(1_000_000.0)
    return rows.select("event_id", F.round(fn.pause(F.lit(300.0), since), 3).alias("wait"))


# --- streaming ----------------------------------------------------------------------------------


@query("""with r as (select uri as key, seq, content_hash, lag(content_hash) over (partition by uri order by seq) as b, row_number() over (partition by uri order by seq) as rn from messages)
select key, seq as "order", case when rn = 1 then 'insert' when b = content_hash then 'repeat' else 'edit' end as kind from r""")
def change_stream(spark, sf_dir):
    """Landed observations as a stream; insert, edit or repeat by keyed state."""
    schema = messages(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, sf_dir))
    root = scratch_folder(spark, "stream")
    feed.run_once(stream.select(F.col("uri").alias("key"), F.col("content_hash").alias("digest"), F.col("seq").alias("order")), f"{root}/checkpoint", feed.change_sink(root))
    return feed.changes_of(spark, root)


def _stream_folder(spark: SparkSession, sf_dir: str) -> str:
    """A stream reads a folder: the table's own if it is one, else the folder that holds its file, by name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/messages.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{sf_dir}/messages.parquet" if fs.getFileStatus(path).isDirectory() else f"{sf_dir}/messages.parquet*"
