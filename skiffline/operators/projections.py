"""Raw objects to rows: messages, channels, peers, metrics, web captures, media, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiffline.functions import archive as fn
from skiffline.sources.tables import opened

MESSAGE = (
    "struct<_:string,id:bigint,date:string,edit_date:string,message:string,entities:string,media:string,from_id:struct<_:string,user_id:bigint,channel_id:bigint,chat_id:bigint>,"
    "peer_id:struct<channel_id:bigint>,post_author:string,fwd_from:string,reply_to:struct<reply_to_msg_id:bigint,reply_to_top_id:bigint>,grouped_id:bigint,via_bot_id:bigint,action:string,"
    "views:bigint,forwards:bigint,replies:struct<replies:bigint>,reactions:string>"
)
PEER = "struct<_:string,id:bigint,access_hash:bigint,username:string,usernames:array<struct<username:string,editable:boolean,active:boolean>>,title:string,first_name:string,last_name:string,min:boolean,broadcast:boolean,megagroup:boolean,gigagroup:boolean,forum:boolean>"
FULL = "struct<id:bigint,about:string,participants_count:bigint,online_count:bigint,linked_chat_id:bigint,pts:bigint>"
PAYLOAD = f"struct<_:string,messages:array<{MESSAGE}>,new_messages:array<{MESSAGE}>,other_updates:array<struct<_:string,message:{MESSAGE},messages:array<bigint>,channel_id:bigint>>,chats:array<{PEER}>,users:array<{PEER}>,full_chat:{FULL},count:bigint,pts:bigint,dialog:struct<pts:bigint>>"


def parsed(raw: DataFrame) -> DataFrame:
    """raw_id, tag, observed_at, tier, p (the payload's struct), text (its JSON)."""
    base = raw.select(F.col("id").alias("raw_id"), F.lower("kind").alias("tag"), "observed_at", "tier", opened(F.col("payload")).alias("json")).where("json is not null")
    return base.withColumn("p", F.from_json("json", PAYLOAD))


def observed_messages(raw: DataFrame) -> DataFrame:
    """Every message object of the raw log with the place it came from: single objects, pages, change batches (new and edited)."""
    base = parsed(raw)
    single = base.where(F.col("tag").isin("message", "messageservice")).select("raw_id", "observed_at", "tier", F.lit(0).alias("pos"), F.from_json("json", MESSAGE).alias("m"))
    edits = F.transform(F.filter("p.other_updates", lambda u: u["message"].isNotNull() & fn.tag_is(u["_"], "updateEditChannelMessage")), lambda u: u["message"])
    listed = F.concat(*[F.coalesce(x, F.array().cast(f"array<{MESSAGE}>")) for x in (F.col("p.messages"), F.col("p.new_messages"), edits)])
    pages = base.where(~F.col("tag").isin("message", "messageservice", "messageempty")).select("raw_id", "observed_at", "tier", F.posexplode(listed).alias("pos", "m"))
    return single.unionByName(pages).where(F.col("m.id").isNotNull() & fn.tag_is(F.col("m._"), "message", "messageservice"))


def iso_or_text(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{1,12}$"), fn.epoch_iso(x.try_cast("bigint"))).otherwise(x)


def _some(x: Column) -> Column:
    """JSON text that holds something: not null, false, zero or empty."""
    return F.when(~F.trim(x).isin("null", "false", "0", '""', "[]", "{}"), x)


def message_rows(observed: DataFrame) -> DataFrame:
    """Message objects as rows.  Media, forward and action only if they hold something; entities also if they are empty."""
    m = F.col("m")
    rows = observed.select(
        fn.entity_uri("msg", m["peer_id"]["channel_id"], m["id"]).alias("uri"),
        m["peer_id"]["channel_id"].alias("channel_id"),
        m["id"].alias("msg_id"),
        iso_or_text(m["date"]).alias("date"),
        iso_or_text(m["edit_date"]).alias("edit_date"),
        fn.peer_uri(m["from_id"]["_"], m["from_id"]["user_id"], m["from_id"]["channel_id"], m["from_id"]["chat_id"]).alias("from_uri"),
        m["post_author"].alias("post_author"),
        F.coalesce(m["message"], F.lit("")).alias("text"),
        m["entities"].alias("entities_json"),
        F.get_json_object(_some(m["media"]), "$._").alias("media_kind"),
        _some(m["media"]).alias("media_json"),
        _some(m["fwd_from"]).alias("fwd_json"),
        m["reply_to"]["reply_to_msg_id"].alias("reply_to_msg_id"),
        m["reply_to"]["reply_to_top_id"].alias("reply_to_top_id"),
        m["grouped_id"].alias("grouped_id"),
        m["via_bot_id"].alias("via_bot_id"),
        fn.tag_is(m["_"], "messageservice").cast("int").alias("is_service"),
        _some(m["action"]).alias("action_json"),
        F.col("raw_id").alias("source_raw_id"),
        "pos",
        "observed_at",
    )
    held = ["entities_json", "media_json", "fwd_json", "action_json"]
    rows = rows.withColumns({c: fn.canonical_json(c) for c in held})
    return rows.withColumn("content_hash", fn.content_hash(F.col("text"), F.col("media_json")))


def metric_rows(observed: DataFrame) -> DataFrame:
    """Counters, where views, forwards or replies are given; reactions alone make no row."""
    m = F.col("m")
    rows = observed.select(fn.entity_uri("msg", m["peer_id"]["channel_id"], m["id"]).alias("message_uri"), "observed_at", m["views"].alias("views"), m["forwards"].alias("forwards"), m["replies"]["replies"].alias("replies"), _some(m["reactions"]).alias("reactions_json"), "raw_id", "pos")
    return rows.where(F.coalesce("views", "forwards", "replies").isNotNull())


def author_stubs(observed: DataFrame) -> DataFrame:
    """Authors known only from their messages: partial users with the message they were seen in."""
    m = F.col("m")
    rows = observed.where(fn.tag_is(m["from_id"]["_"], "peeruser") & m["from_id"]["user_id"].isNotNull())
    return rows.select(fn.entity_uri("user", m["from_id"]["user_id"]).alias("uri"), m["from_id"]["user_id"].alias("id"), F.lit(1).alias("is_min"), m["peer_id"]["channel_id"].alias("seen_in_chat"), m["id"].alias("seen_in_msg"), "raw_id", "pos", "observed_at")


def peer_class(tag: Column) -> Column:
    t = F.lower(tag)
    return F.when(t.startswith("user"), "user").when(t.startswith("channel"), "channel").when(t.startswith("chat"), "chat")


def peer_rows(raw: DataFrame, strict: bool = False) -> DataFrame:
    """The chats and users of every payload as peer rows; objects of another kind are left out, or fail the job if ``strict``."""
    both = F.concat(*[F.coalesce(F.col(c), F.array().cast(f"array<{PEER}>")) for c in ("p.chats", "p.users")])
    texts = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("t.chats", "t.users")])
    rows = parsed(raw).withColumn("t", F.from_json("json", "struct<chats:array<string>,users:array<string>>"))
    rows = rows.select("raw_id", "observed_at", F.posexplode(F.arrays_zip(both.alias("o"), texts.alias("t"))).alias("pos", "z")).select("raw_id", "observed_at", "pos", "z.*").where(F.col("o.id").isNotNull())
    o, kind = F.col("o"), peer_class(F.col("o._"))
    if strict:  # an object that is no peer fails the job
        kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("no peer: "), F.coalesce(o["_"], F.lit("NULL")))).cast("string"))
    return rows.where(kind.isNotNull()).select(
        F.concat(F.lit("tg:"), kind, F.lit(":"), o["id"].cast("string")).alias("uri"),
        kind.alias("kind"),
        o["id"].alias("id"),
        o["access_hash"].alias("access_hash"),
        F.coalesce(o["min"], F.lit(False)).cast("int").alias("is_min"),
        fn.primary_username(o["username"], o["usernames"]).alias("username"),
        o["first_name"].alias("first_name"),
        o["last_name"].alias("last_name"),
        o["title"].alias("title"),
        flags_json(PEER_FLAGS, F.col("t")).alias("flags_json"),
        "raw_id",
        "pos",
        "observed_at",
    )


def channel_rows(raw: DataFrame) -> DataFrame:
    """Full channel objects as rows: kind by its flags, a linked id of 0 as none, the hash of what it says about itself."""
    rows = parsed(raw).where(F.col("p.full_chat.id").isNotNull()).withColumn("t", F.from_json("json", "struct<chats:array<string>,full_chat:string>"))
    own_text = F.get(F.filter("t.chats", lambda c: F.get_json_object(c, "$.id") == F.col("p.full_chat.id").cast("string")), 0)
    full = F.col("p.full_chat")
    own = F.get(F.filter("p.chats", lambda c: c["id"] == full["id"]), 0)
    kind = F.when(own["broadcast"], "broadcast").when(own["gigagroup"], "gigagroup").when(own["megagroup"] & own["forum"], "forum").when(own["megagroup"], "megagroup")
    return rows.select(
        full["id"].alias("id"),
        fn.entity_uri("channel", full["id"]).alias("uri"),
        fn.primary_username(own["username"], own["usernames"]).alias("username"),
        own["title"].alias("title"),
        full["about"].alias("about"),
        kind.alias("kind"),
        F.when(full["linked_chat_id"] != 0, full["linked_chat_id"]).alias("linked_chat_id"),
        full["participants_count"].alias("participants_count"),
        full["online_count"].alias("online_count"),
        F.when(F.length(full["about"]) > 0, F.sha2(full["about"], 256)).alias("about_hash"),
        full["pts"].alias("pts"),
        flags_json(CHANNEL_FLAGS, own_text, F.col("t.full_chat")).alias("flags_json"),
        _some(F.get_json_object(own_text, "$.restriction_reason")).alias("restriction_json"),
        F.lit(None).cast("string").alias("created_at"),
        "raw_id",
        "observed_at",
        "tier",
    )


def media_rows(messages: DataFrame) -> DataFrame:
    """What the media of messages hold: kind, content key, MIME type, file name, suffix.  Deleted messages have none."""
    j = F.col("media_json")

    def at(path: str) -> Column:
        return F.get_json_object(j, path)

    photo, document = at("$.photo.id").try_cast("bigint"), at("$.document.id").try_cast("bigint")
    kind = F.when(photo.isNotNull(), "photo").when(document.isNotNull(), "document")
    names = F.from_json(at("$.document.attributes"), "array<struct<_:string,file_name:string>>")
    name = F.get(F.filter(names, lambda a: fn.tag_is(a["_"], "documentattributefilename")), 0)["file_name"]
    mime = F.when(kind == "photo", "image/jpeg").otherwise(at("$.document.mime_type"))
    rows = messages.where("media_kind is not null and deleted_at is null")
    return rows.select("uri", "channel_id", "msg_id", "seq", kind.alias("kind"), F.coalesce(photo, document).alias("content_id"), mime.alias("mime_type"), F.when(kind == "document", name).alias("file_name"), F.when(kind == "document", at("$.document.attributes")).alias("attributes_json"), fn.file_suffix(kind, name, mime).alias("suffix"))


# The flags kept of peers and of channels.
PEER_FLAGS = ["bot", "broadcast", "deleted", "fake", "forum", "gigagroup", "megagroup", "premium", "restricted", "scam", "verified"]
CHANNEL_FLAGS = ["can_view_participants", "fake", "has_geo", "has_link", "participants_hidden", "restricted", "scam", "signatures", "slowmode_enabled", "verified"]


def flags_json(flags: list[str], *objects: Column) -> Column:
    """The members named of the first object that has each, as JSON with sorted names; NULL if there is none."""
    keys = [F.coalesce(F.json_object_keys(o), F.array().cast("array<string>")) for o in objects]
    parts = []
    for name in sorted(flags):
        value = F.lit(None).cast("string")
        for has, o in reversed(list(zip(keys, objects))):
            value = F.when(F.array_contains(has, name), F.coalesce(F.get_json_object(o, f"$.{name}"), F.lit("null"))).otherwise(value)
        parts.append(F.concat(F.lit(f'"{name}": '), value))
    inside = F.concat_ws(", ", *parts)
    return F.when(F.length(inside) > 0, F.concat(F.lit("{"), inside, F.lit("}")))


TRIPLE = ["subject_uri", "predicate", "object_uri", "observed_at", "source_raw_id"]


def linked_edges(channels: DataFrame) -> DataFrame:
    evidence = F.to_json(F.struct(F.lit("linked_chat_id").alias("field")))
    return channels.where("coalesce(linked_chat_id, 0) <> 0").select(F.col("uri").alias("subject_uri"), F.lit("linked_group").alias("predicate"), fn.entity_uri("channel", F.col("linked_chat_id")).alias("object_uri"), F.col("observed_at"), F.col("source_raw_id"), evidence.alias("evidence_json"))


def forward_edges(messages: DataFrame) -> DataFrame:
    """Message to the peer it was forwarded from; forwards that give a name only have none."""
    f = F.from_json("fwd_json", "struct<from_id:struct<_:string,user_id:bigint,channel_id:bigint,chat_id:bigint>>")["from_id"]
    rows = messages.withColumn("object_uri", fn.peer_uri(f["_"], f["user_id"], f["channel_id"], f["chat_id"])).where("object_uri is not null")
    return rows.select(F.col("uri").alias("subject_uri"), F.lit("forwarded_from").alias("predicate"), "object_uri", F.col("first_seen").alias("observed_at"), "source_raw_id", F.concat(F.lit('{"fwd_from": '), F.col("fwd_json"), F.lit("}")).alias("evidence_json"))


def with_tier(edges: DataFrame, raw: DataFrame) -> DataFrame:
    """Edges with the tier in which their source was landed; NULL where that was pruned."""
    tiers = raw.select(F.col("id").alias("_raw"), "tier")
    return edges.join(tiers, F.col("source_raw_id") == F.col("_raw"), "left").drop("_raw")


def recommended_edges(recommendations: DataFrame) -> DataFrame:
    """recommendations: channel_id, raw_id, observed_at, json.  Channel to each other chat of the list, with the true total."""
    rows = recommendations.withColumn("p", F.from_json("json", f"struct<count:bigint,chats:array<{PEER}>>"))
    total = F.coalesce(F.col("p.count"), F.size("p.chats").cast("bigint"))
    each = rows.select("channel_id", "raw_id", "observed_at", total.alias("total"), F.explode("p.chats").alias("c")).where(F.col("c.id") != F.col("channel_id"))
    return each.select(fn.entity_uri("channel", F.col("channel_id")).alias("subject_uri"), F.lit("recommended_with").alias("predicate"), F.concat(F.lit("tg:"), peer_class(F.col("c._")), F.lit(":"), F.col("c.id").cast("string")).alias("object_uri"), "observed_at", F.col("raw_id").alias("source_raw_id"), F.to_json(F.struct(F.col("total").alias("total_count"))).alias("evidence_json"))


def entity_links(messages: DataFrame) -> DataFrame:
    """What the entities of messages name: users by id, and URLs (hidden, or bare in the text).  Plain @names are left out."""
    items = F.from_json("entities_json", "array<struct<_:string,offset:bigint,length:bigint,url:string,user_id:bigint>>")
    rows = messages.where("entities_json is not null").select("uri", "text", "first_seen", "source_raw_id", F.posexplode(items).alias("pos", "e"))
    tag = F.lower("e._")
    url = F.when(tag == "messageentitytexturl", F.col("e.url")).when(tag == "messageentityurl", fn.utf16_slice(F.col("text"), F.col("e.offset"), F.col("e.length")))
    user = F.when(tag.isin("messageentitymentionname", "inputmessageentitymentionname"), F.col("e.user_id"))
    return rows.select("uri", "pos", F.col("e._").alias("entity"), url.alias("url"), user.alias("user_id"), "first_seen", "source_raw_id").where("url is not null or user_id is not null")


def mention_edges(links: DataFrame) -> DataFrame:
    """Message to user, username or invite."""
    where = fn.link_target(F.col("url"))
    to = F.coalesce(fn.entity_uri("user", F.col("user_id")), F.concat(F.lit("tg:"), where["kind"], F.lit(":"), where["value"]))
    return links.withColumn("object_uri", to).where("object_uri is not null").select(F.col("uri").alias("subject_uri"), F.lit("mentions").alias("predicate"), "object_uri", F.col("first_seen").alias("observed_at"), "source_raw_id", F.to_json(F.struct("entity", "url")).alias("evidence_json"))


def invite_edges(invites: DataFrame, previews: DataFrame) -> DataFrame:
    """invites: subject_uri, hash; previews: hash, json.  Fans each preview out to every message with its hash."""
    p = previews.select("hash", F.from_json("json", "struct<_:string,chat:struct<_:string,id:bigint>,title:string,participants_count:bigint,photo:string>").alias("p")).dropDuplicates(["hash"])
    both = invites.join(p, "hash")
    chat = F.col("p.chat")
    known = fn.tag_is(F.col("p._"), "chatinvitealready", "chatinvitepeek") & chat["id"].isNotNull()
    to = F.when(known, F.concat(F.lit("tg:"), peer_class(chat["_"]), F.lit(":"), chat["id"].cast("string"))).otherwise(F.concat(F.lit("tg:invite:"), F.col("hash")))
    shown = F.struct(F.lit(False).alias("resolved"), F.col("p.title").alias("title"), F.col("p.participants_count").alias("participants_count"), F.col("p.photo").isNotNull().alias("has_photo"))
    evidence = F.when(known, F.to_json(F.struct(F.lit(True).alias("resolved"), chat["id"].alias("chat_id")))).otherwise(F.to_json(shown, {"ignoreNullFields": "false"}))
    return both.select("subject_uri", F.lit("invited_via").alias("predicate"), to.alias("object_uri"), evidence.alias("evidence_json"))


def sponsored_edges(sponsored: DataFrame) -> DataFrame:
    """sponsored: channel_id, json.  Channel to the username or invite of each advertised link that is one."""
    ads = sponsored.select("channel_id", F.explode(F.from_json("json", "struct<messages:array<struct<url:string,title:string,sponsor_info:string>>>")["messages"]).alias("a"))
    where = fn.link_target(F.col("a.url"))
    return ads.where(where.isNotNull()).select(fn.entity_uri("channel", F.col("channel_id")).alias("subject_uri"), F.lit("mentions").alias("predicate"), F.concat(F.lit("tg:"), where["kind"], F.lit(":"), where["value"]).alias("object_uri"), F.to_json(F.struct(F.lit("sponsored").alias("source"), "a.url", "a.sponsor_info", "a.title"), {"ignoreNullFields": "false"}).alias("evidence_json"))
