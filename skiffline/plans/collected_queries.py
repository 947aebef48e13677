"""Queries of what is collected over time: change batches, exports, link edges, feed pages, streams of cursors; and their SQL.

Invites, sponsored posts, links of the platform and feed pages don't occur in the delivered
tables; their operators run on stand-ins that the queries build from channels and captures
(one for each row), as said in each docstring.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiffline.functions import archive as fn
from skiffline.operators import changes, merge, projections, web
from skiffline.plans.archive_queries import _FORWARD, _OPEN, _OWN
from skiffline.session import scratch_folder, table
from skiffline.sources import tables
from skiffline.streaming import feed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


# --- change batches ---------------------------------------------------------------------

_CHANGES = f"""with {_OPEN},
lists as (select raw_id, observed_at, tag, cast(json_extract_string(j, '$.chats[0].id') as bigint) as own, coalesce(cast(json_extract(j, '$.messages') as json[]), []) as a, coalesce(cast(json_extract(j, '$.new_messages') as json[]), []) as b, coalesce(cast(json_extract(j, '$.other_updates') as json[]), []) as c
  from opened where tag not in ('message', 'messageservice', 'messageempty') and tag not like '%toolong%'),
flat as (select raw_id, observed_at, own, unnest(range(len(a) + len(b) + len(c))) as pos, len(a) + len(b) as plain, list_concat(a, b, c) as l from lists),
items as (select raw_id, observed_at, own, pos, pos < plain as is_message, l[pos + 1] as x from flat),
ups as (select raw_id, observed_at, 0 as pos, cast(j as json) as m from opened where tag in ('message', 'messageservice')
  union all select raw_id, observed_at, pos, case when is_message then x else json_extract(x, '$.message') end from items where is_message or lower(json_extract_string(x, '$._')) = 'updateeditchannelmessage'),
seen as (select raw_id, pos, 0 as item, observed_at, cast(json_extract_string(m, '$.peer_id.channel_id') as bigint) as channel_id, cast(json_extract_string(m, '$.id') as bigint) as msg_id, coalesce(json_extract_string(m, '$.message'), '') as text,
    case when json_type(m, '$.media') = 'OBJECT' and json_extract_string(m, '$.media') <> '{{}}' then json_extract_string(m, '$.media') end as media
  from ups where lower(json_extract_string(m, '$._')) in ('message', 'messageservice')),
known as (select *, sha256(text || chr(0) || coalesce(media, '')) as content_hash from seen where channel_id is not null and msg_id is not null),
listed as (select raw_id, pos, observed_at, coalesce(cast(json_extract_string(x, '$.channel_id') as bigint), own) as channel_id, cast(json_extract(x, '$.messages') as bigint[]) as ids from items where not is_message and lower(json_extract_string(x, '$._')) = 'updatedeletechannelmessages'),
gone as (select raw_id, pos, observed_at, channel_id, unnest(range(len(ids))) as item, unnest(ids) as msg_id from listed where channel_id is not null),
dels as (select * from gone where msg_id is not null)
"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changes(table(spark, sf_dir, "raw_records"))


@query(
    _CHANGES
    + """, ranked as (select *, lag(content_hash) over w as b, row_number() over w as rn from known window w as (partition by channel_id, msg_id order by raw_id, pos, item)),
state as (select channel_id, msg_id, arg_max(text, rn) as text, arg_max(content_hash, rn) as content_hash, arg_min(observed_at, rn) as first_seen, arg_max(observed_at, rn) as last_seen, count(*) filter (rn = 1 or b <> content_hash) as n_revisions, min((raw_id, pos, item)) as born from ranked group by 1, 2),
dead as (select s.channel_id, s.msg_id, arg_min(d.observed_at, (d.raw_id, d.pos, d.item)) as deleted_at from dels d join state s on s.channel_id = d.channel_id and s.msg_id = d.msg_id where (d.raw_id, d.pos, d.item) > s.born group by 1, 2)
select s.channel_id, s.msg_id, sha256(s.text) as text_hash, s.content_hash, s.first_seen, s.last_seen, d.deleted_at, s.n_revisions from state s left join dead d on d.channel_id = s.channel_id and d.msg_id = s.msg_id"""
)
def collected_messages(spark, sf_dir):
    """The state after backfilled pages and change batches, applied in the order of their arrival."""
    rows = changes.collected_messages(_changes(spark, sf_dir))
    return rows.select("channel_id", "msg_id", F.sha2("text", 256).alias("text_hash"), "content_hash", "first_seen", "last_seen", "deleted_at", "n_revisions")


@query(_CHANGES + "select 'tg:msg:' || channel_id || '/' || msg_id as message_uri, observed_at, 'update' as evidence, raw_id, cast(pos as int) as pos, cast(item as int) as item from dels")
def change_tombstones(spark, sf_dir):
    """The evidence that change batches give of deletions, messages never seen included."""
    return changes.tombstones(_changes(spark, sf_dir))


_BATCHES = f"""with {_OPEN}, d as (select raw_id, cast(json_extract_string(j, '$.chats[0].id') as bigint) as channel_id, tag like '%toolong%' as too_long, case when tag like '%toolong%' then cast(json_extract_string(j, '$.dialog.pts') as bigint) else cast(json_extract_string(j, '$.pts') as bigint) end as cur,
  coalesce(json_array_length(j, '$.new_messages'), 0) > 0 or len(list_filter(coalesce(cast(json_extract(j, '$.other_updates') as json[]), []), lambda u: lower(json_extract_string(u, '$._')) in ('updateeditchannelmessage', 'updatedeletechannelmessages'))) > 0 as has_any from opened where tag like '%channeldifference%'),
o as (select raw_id, channel_id, cur, case when too_long then 'resynced' when has_any then 'applied' else 'empty' end as outcome from d)
"""


@query(_BATCHES + 'select channel_id, arg_max(cur, raw_id) filter (cur is not null) as "cursor", arg_max(outcome, raw_id) as outcome, count(*) as n_batches from o where channel_id is not null group by 1')
def change_cursors(spark, sf_dir):
    """Where each channel's changes have got to, and how its last batch ended."""
    return changes.cursors(changes.batches(table(spark, sf_dir, "raw_records")))


@query(_BATCHES + ", m as (select channel_id, avg(cur) as mean from o where channel_id is not null group by 1) select o.raw_id, o.channel_id, o.cur as pts from o join m on m.channel_id = o.channel_id where o.cur > floor(m.mean)")
def differences_by_channel(spark, sf_dir):
    """Change batches past each channel's own cursor (the mean of its cursors)."""
    rows = changes.batches(table(spark, sf_dir, "raw_records")).where("channel_id is not null").select("raw_id", "channel_id", F.col("cursor").alias("pts"))
    at = rows.groupBy("channel_id").agg(F.floor(F.avg("pts")).alias("pts"))
    return tables.differences_since(rows, at).select("raw_id", "channel_id", "pts")


@query(_BATCHES + "select channel_id, max(cur) as pts from o where channel_id is not null group by 1")
def cursor_stream(spark, sf_dir):
    """The highest cursor of each channel as a stream's state, read from landed batches."""
    root = scratch_folder(spark, "cursors")
    changes.batches(table(spark, sf_dir, "raw_records")).where("channel_id is not null").select("raw_id", "channel_id", F.col("cursor").alias("pts")).write.parquet(f"{root}/landed")
    stream = feed.landed(spark, f"{root}/landed", "raw_id bigint, channel_id bigint, pts bigint")
    feed.run_once(feed.cursors(stream), f"{root}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out"), mode="complete")
    return spark.read.schema("channel_id bigint, pts bigint").parquet(f"{root}/out")


@query("""select distinct case when json_extract_string(media_json, '$.photo.id') is not null then 'photo' else 'document' end as kind, cast(coalesce(json_extract_string(media_json, '$.photo.id'), json_extract_string(media_json, '$.document.id')) as bigint) as content_id
from messages where media_kind is not null and deleted_at is null and coalesce(json_extract_string(media_json, '$.photo.id'), json_extract_string(media_json, '$.document.id')) is not null""")
def media_stream(spark, sf_dir):
    """Contents a stream of media rows had not seen before."""
    root = scratch_folder(spark, "media")
    projections.media_rows(table(spark, sf_dir, "messages")).where("content_id is not null").select("kind", "content_id").write.parquet(f"{root}/landed")
    stream = feed.landed(spark, f"{root}/landed", "kind string, content_id bigint")
    feed.run_once(feed.unseen(stream, ["kind", "content_id"]), f"{root}/checkpoint", feed.batch_writer(f"{root}/out"))
    return spark.read.schema("kind string, content_id bigint").parquet(f"{root}/out").select("kind", "content_id")


_FATES = """with media as (select seq, uri, msg_id, case when json_extract_string(media_json, '$.photo.id') is not null then 'photo' when json_extract_string(media_json, '$.document.id') is not null then 'document' end as kind,
  cast(coalesce(json_extract_string(media_json, '$.photo.id'), json_extract_string(media_json, '$.document.id')) as bigint) as content_id from messages where media_kind is not null and deleted_at is null),
filed as (select *, case when content_id % 10 <> 0 then sha256(cast(content_id % 500 as varchar)) end as sha from media),
fated as (select *, case when content_id is null then 'skipped_kind' when sha is null then 'unavailable' when row_number() over (partition by sha order by msg_id, seq) = 1 then 'downloaded' else 'duplicates' end as disposition from filed)
"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media rows and their bytes (stand-in: a content's bytes are its id modulo 500, those of every tenth can't be had)."""
    rows = projections.media_rows(table(spark, sf_dir, "messages")).select("kind", "content_id", "uri", "msg_id", "seq")
    files = rows.where("content_id % 10 <> 0").select("kind", "content_id", F.sha2((F.col("content_id") % 500).cast("string"), 256).alias("sha256")).distinct()
    return merge.stored_media(rows, files, ["kind", "content_id"], ["msg_id", "seq"])


@query(_FATES + "select disposition, count(*) as n, count(distinct sha) as n_files from fated group by 1")
def stored_dispositions(spark, sf_dir):
    """What becomes of each message's media by content and by sha256 (bytes are stand-ins)."""
    return _stored(spark, sf_dir).groupBy("disposition").agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("n_files"))


@query(_FATES + "select sha as sha256, substr(sha, 1, 2) || '/' || sha as path, uri as source_message_uri, disposition from fated where disposition in ('downloaded', 'duplicates')")
def custody_rows(spark, sf_dir):
    """The custody log: every message that bytes are kept for, and where they lie (bytes are stand-ins)."""
    return merge.custody(_stored(spark, sf_dir)).select("sha256", "path", "source_message_uri", "disposition")


# --- exports ---------------------------------------------------------------------------

_CHANNEL = 1700000001


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "channels").select("uri", "linked_chat_id", F.col("last_seen").alias("observed_at"), "source_raw_id")
    forward = projections.forward_edges(table(spark, sf_dir, "messages").withColumn("order", F.col("seq")))
    return forward.unionByName(projections.linked_edges(c)).withColumn("id", F.xxhash64("subject_uri", "predicate", "object_uri"))


@query(f"""with cur as (select *, row_number() over (partition by channel_id, msg_id order by seq desc) as rn from messages), f as ({_FORWARD}),
e as (select subject_uri, 'forwarded_from' as predicate, object_uri from f where object_uri is not null union all select uri, 'linked_group', 'tg:channel:' || linked_chat_id from channels where coalesce(linked_chat_id, 0) <> 0)
select 'channel' as file, uri as key, count(*) as n_rows, cast(0 as bigint) as n_nested from channels where id = {_CHANNEL} group by 2
union all select 'messages', c.uri, 1, coalesce((select count(*) from message_revisions r where r.message_uri = c.uri), 0) from cur c where c.rn = 1 and c.channel_id = {_CHANNEL} and c.from_uri is distinct from '{_OWN}'
union all select 'edges', subject_uri || ' ' || predicate || ' ' || object_uri, count(*), 0 from e where (subject_uri = 'tg:channel:{_CHANNEL}' or subject_uri like 'tg:msg:{_CHANNEL}/%' or object_uri = 'tg:channel:{_CHANNEL}') and subject_uri <> '{_OWN}' and object_uri <> '{_OWN}' group by 2""")
def channel_export(spark, sf_dir):
    """One channel exported to three sorted files, the collecting account left out, and read back."""
    m = table(spark, sf_dir, "messages")
    cur = merge.last_state(m.withColumn("arrival", F.col("seq")), ["channel_id", "msg_id"], ["arrival"])
    out = scratch_folder(spark, "export")
    tables.export_channel(table(spark, sf_dir, "channels"), merge.nested_revisions(cur.where(F.col("channel_id") == _CHANNEL), table(spark, sf_dir, "message_revisions")), _edges(spark, sf_dir), f"tg:channel:{_CHANNEL}", out, _OWN)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    channel = spark.read.schema("uri string").json(f"{out}/channel").groupBy(F.col("uri").alias("key")).agg(F.count("*").alias("n_rows")).select(F.lit("channel").alias("file"), "key", "n_rows", zero.alias("n_nested"))
    written = spark.read.schema("uri string, revisions array<struct<content_hash:string>>").json(f"{out}/messages").select(F.lit("messages").alias("file"), F.col("uri").alias("key"), one.alias("n_rows"), F.size("revisions").cast("bigint").alias("n_nested"))
    edges = spark.read.schema("subject_uri string, predicate string, object_uri string").json(f"{out}/edges").groupBy(F.concat_ws(" ", "subject_uri", "predicate", "object_uri").alias("key")).agg(F.count("*").alias("n_rows"))
    return channel.unionByName(written).unionByName(edges.select(F.lit("edges").alias("file"), "key", "n_rows", zero.alias("n_nested")))


# --- edges -----------------------------------------------------------------------------


@query(f"with f as ({_FORWARD}) select f.subject_uri, f.object_uri, r.tier, m.fwd_json from f join messages m on m.seq = f.seq left join raw_records r on r.id = m.source_raw_id where f.object_uri is not null")
def forward_evidence(spark, sf_dir):
    """Forwards with the tier they were landed in and their header as evidence."""
    rows = projections.with_tier(projections.forward_edges(table(spark, sf_dir, "messages")), table(spark, sf_dir, "raw_records"))
    return rows.select("subject_uri", "object_uri", "tier", F.regexp_extract("evidence_json", r'^\{"fwd_from": (.*)\}$', 1).alias("fwd_json"))


def _linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each channel that names it three ways (stand-in: delivered messages have no links of the platform)."""
    c = table(spark, sf_dir, "channels").where("username is not null")
    name, number = F.col("username"), F.col("id").cast("string")
    at = F.lit(',"offset":8,"length":')
    entities = F.concat(F.lit('[{"_":"MessageEntityUrl"'), at, (F.length(name) + 5).cast("string"), F.lit('},{"_":"MessageEntityTextUrl","offset":0,"length":2,"url":"https://t.me/+h'), number, F.lit('"},{"_":"MessageEntityMentionName","offset":0,"length":2,"user_id":'), number, F.lit('},{"_":"MessageEntityMention","offset":0,"length":2}]'))
    return c.select(fn.entity_uri("msg", F.col("id"), F.lit(1)).alias("uri"), F.concat(F.lit("\U0001f30a\U0001f30a at "), F.lit("t.me/"), name, F.lit(" \U0001f30a")).alias("text"), entities.alias("entities_json"), "first_seen", "source_raw_id")


@query("""select 'tg:msg:' || id || '/1' as subject_uri, 'tg:username:' || username as object_uri, 'MessageEntityUrl' as entity from channels where username is not null
union all select 'tg:msg:' || id || '/1', 'tg:invite:h' || id, 'MessageEntityTextUrl' from channels where username is not null
union all select 'tg:msg:' || id || '/1', 'tg:user:' || id, 'MessageEntityMentionName' from channels where username is not null""")
def mention_edges(spark, sf_dir):
    """Messages and the users, names and invites that they link to (on a message for each channel as stand-in)."""
    edges = projections.mention_edges(projections.entity_links(_linking(spark, sf_dir)))
    return edges.select("subject_uri", "object_uri", F.get_json_object("evidence_json", "$.entity").alias("entity"))


@query("""select 'tg:msg:' || id || '/1' as subject_uri, case when id % 2 = 0 then 'tg:channel:' || id else 'tg:invite:h' || id end as object_uri, cast(id % 2 = 0 as varchar) as resolved, case when id % 2 = 1 then title end as title from channels where username is not null""")
def invite_edges(spark, sf_dir):
    """Invites that messages link to, joined to their previews; every other one is of a chat already known (stand-ins)."""
    links = projections.mention_edges(projections.entity_links(_linking(spark, sf_dir))).where(F.col("object_uri").startswith("tg:invite:"))
    invites = links.select("subject_uri", F.regexp_replace("object_uri", "^tg:invite:", "").alias("hash"))
    c = table(spark, sf_dir, "channels").where("username is not null")
    chat = F.to_json(F.struct(F.lit("chatInviteAlready").alias("_"), F.struct(F.lit("channel").alias("_"), "id").alias("chat")))
    preview = F.to_json(F.struct(F.lit("chatInvite").alias("_"), "title", "participants_count"))
    previews = c.select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"), F.when(F.col("id") % 2 == 0, chat).otherwise(preview).alias("json"))
    edges = projections.invite_edges(invites, previews)
    return edges.select("subject_uri", "object_uri", F.get_json_object("evidence_json", "$.resolved").alias("resolved"), F.get_json_object("evidence_json", "$.title").alias("title"))


@query(f"""with {_OPEN}, l as (select raw_id, cast(json_extract_string(j, '$.full_chat.id') as bigint) as channel_id, cast(json_extract(j, '$.chats') as json[]) as cs from opened where tag like '%chatfull%'),
e as (select raw_id, channel_id, len(cs) as total, unnest(cs) as c from l)
select raw_id, 'tg:channel:' || channel_id as subject_uri, 'tg:' || case when lower(json_extract_string(c, '$._')) like 'user%' then 'user' when lower(json_extract_string(c, '$._')) like 'channel%' then 'channel' else 'chat' end || ':' || json_extract_string(c, '$.id') as object_uri, cast(total as bigint) as total_count
from e where json_extract_string(c, '$.id') <> cast(channel_id as varchar)""")
def recommended_edges(spark, sf_dir):
    """A channel and the other chats of its list, with the true total (lists of full channels as stand-in of recommendations)."""
    full = projections.parsed(table(spark, sf_dir, "raw_records")).where("tag like '%chatfull%'")
    edges = projections.recommended_edges(full.select(F.col("p.full_chat.id").alias("channel_id"), "raw_id", "observed_at", "json"))
    return edges.select(F.col("source_raw_id").alias("raw_id"), "subject_uri", "object_uri", F.get_json_object("evidence_json", "$.total_count").try_cast("bigint").alias("total_count"))


@query("""select 'tg:channel:' || id as subject_uri, 'tg:username:' || username as object_uri, title from channels where username is not null""")
def sponsored_edges(spark, sf_dir):
    """A channel and what its sponsored posts advertise, links of other hosts left out (a post for each channel and one elsewhere as stand-ins)."""
    c = table(spark, sf_dir, "channels").where("username is not null")
    ad, other = F.struct(F.concat(F.lit("https://t.me/"), F.col("username")).alias("url"), "title"), F.struct(F.lit("https://shop.example/x").alias("url"), "title")
    edges = projections.sponsored_edges(c.select(F.col("id").alias("channel_id"), F.to_json(F.struct(F.array(ad, other).alias("messages"))).alias("json")))
    return edges.select("subject_uri", "object_uri", F.get_json_object("evidence_json", "$.title").alias("title"))


# --- feed pages ------------------------------------------------------------------------

_POSTS = "select channel_username as name, msg_id, text, timestamp as taken, json_extract_string(meta_json, '$.views') as views from (select *, row_number() over (partition by channel_username, msg_id order by id) as rn from web_snapshots where source = 'tme' and msg_id is not null and channel_username is not null and text is not null) where rn = 1"


def _feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed pages of 50 ids each, newest first, in the platform's markup (stand-in: captures are of single posts in another one)."""
    w = table(spark, sf_dir, "web_snapshots").where("source = 'tme' and msg_id is not null and channel_username is not null and text is not null")
    one = w.groupBy(F.col("channel_username").alias("name"), "msg_id").agg(F.min_by(F.struct("text", "timestamp", F.get_json_object("meta_json", "$.views").alias("views")), "id").alias("x"))
    safe = F.replace(F.replace(F.replace(F.col("x.text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br/>"))
    post = F.concat(F.lit('<div class="tgme_widget_message" data-post="'), "name", F.lit("/"), F.col("msg_id").cast("string"), F.lit('"><div class="tgme_widget_message_text">'), safe, F.lit("</div>"), F.coalesce(F.concat(F.lit('<time datetime="'), F.col("x.timestamp"), F.lit('"></time>')), F.lit("")), F.coalesce(F.concat(F.lit('<span class="tgme_widget_message_views">'), F.col("x.views"), F.lit("</span>")), F.lit("")), F.lit("</div>"))
    pages = one.withColumn("page_no", -F.floor(F.col("msg_id") / 50)).groupBy("name", "page_no").agg(F.sort_array(F.collect_list(F.struct((-F.col("msg_id")).alias("o"), post.alias("p")))).alias("ps"))
    return pages.select("name", "page_no", F.concat(F.lit("<html><body>"), F.array_join("ps.p", "\n"), F.lit("</body></html>")).alias("html"))


@query(f"with p as ({_POSTS}) select name as channel_username, msg_id, trim(replace(text, chr(13), ''), ' ' || chr(10) || chr(9)) as text, taken as datetime, views from p")
def feed_posts(spark, sf_dir):
    """Posts of feed pages (built from captures, one post each and at most 50 a page)."""
    pages = _feed_pages(spark, sf_dir).withColumn("id", F.xxhash64("name", "page_no"))
    return web.feed_posts(pages, F.col("id"), F.col("html")).select("channel_username", "msg_id", "text", "datetime", "views")


@query(f"""with p as ({_POSTS}), g as (select name, -floor(msg_id / 50) as page_no, min(msg_id) as next_before, max(msg_id) as newest, count(*) as n_posts from p group by 1, 2),
l as (select *, lag(next_before) over (partition by name order by page_no) as b from g)
select name, cast(page_no as bigint) as page_no, next_before, newest, n_posts, next_before is not null and (b is null or next_before < b) and page_no < 50 as goes_on from l""")
def feed_cursors(spark, sf_dir):
    """The cursor of each feed page's next one, and whether paging goes on."""
    pages = _feed_pages(spark, sf_dir).withColumn("id", F.xxhash64("name", "page_no"))
    posts = web.feed_posts(pages, F.col("id"), F.col("html"))
    rows = posts.join(pages.select("id", F.col("name"), "page_no"), posts["page_id"] == F.col("id")).select("name", "page_no", "msg_id")
    return web.page_cursors(rows, "name", "page_no")
