"""Change batches of the raw log applied in the order of their arrival.

A payload is a flat list of changes: the messages of a page, the new messages of a change
batch, then its updates in order.  Only an edit's message is an upsert and only a deletion's
ids are deletes; any other update, whatever it holds, changes nothing.  A batch that is too
long carries nothing to apply, only the cursor to go on from.

Backfilled pages and change batches are one stream of changes, so the state after both is
that of one reduction per message: its last upsert, and the first deletion that arrived when
the message was known (an upsert later on doesn't undo it).  Reductions are partial
aggregates; what compares neighbours runs in blocks of the order of arrival.

Defined cases: payloads that aren't JSON change nothing; objects without an id or channel
are no messages; repeated payloads add no revision; an empty log gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiffline.functions import archive as fn
from skiffline.operators import split
from skiffline.operators.projections import MESSAGE, _some, parsed

EDIT, DELETE = "updateEditChannelMessage", "updateDeleteChannelMessages"
ARRIVAL = ["raw_id", "pos", "item"]


def is_too_long(tag: Column) -> Column:
    return F.lower(tag).contains("toolong")


def changes(raw: DataFrame) -> DataFrame:
    """raw_id, pos, item (the order of arrival), observed_at, tier, op (`upsert`, `delete`), channel_id, msg_id, m (an upsert's message)."""
    base = parsed(raw).withColumn("own", F.get("p.chats", 0)["id"])
    single = base.where(fn.tag_is(F.col("tag"), "message", "messageservice")).select("raw_id", "observed_at", "tier", "own", F.lit(0).alias("pos"), F.struct(F.lit("upsert").alias("op"), F.from_json("json", MESSAGE).alias("m"), F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("bigint").alias("channel")).alias("c"))

    def upsert(m: Column) -> Column:
        return F.struct(F.lit("upsert").alias("op"), m.alias("m"), F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("bigint").alias("channel"))

    def update(u: Column) -> Column:
        op = F.when(fn.tag_is(u["_"], EDIT), "upsert").when(fn.tag_is(u["_"], DELETE), "delete")
        return F.struct(op.alias("op"), u["message"].alias("m"), u["messages"].alias("ids"), u["channel_id"].alias("channel"))

    none = F.array().cast(f"array<struct<op:string,m:{MESSAGE},ids:array<bigint>,channel:bigint>>")
    lists = [F.transform("p.messages", upsert), F.transform("p.new_messages", upsert), F.transform("p.other_updates", update)]
    listed = F.concat(*[F.coalesce(x, none) for x in lists])
    many = base.where(~fn.tag_is(F.col("tag"), "message", "messageservice", "messageempty") & ~is_too_long(F.col("tag")) & ~is_too_long(F.coalesce("p._", F.lit("")))).select("raw_id", "observed_at", "tier", "own", F.posexplode(listed).alias("pos", "c"))
    rows = single.unionByName(many)
    ups = rows.where((F.col("c.op") == "upsert") & fn.tag_is(F.col("c.m._"), "message", "messageservice")).select("raw_id", "pos", F.lit(0).alias("item"), "observed_at", "tier", F.lit("upsert").alias("op"), F.col("c.m.peer_id.channel_id").alias("channel_id"), F.col("c.m.id").alias("msg_id"), F.col("c.m").alias("m"))
    dels = rows.where("c.op = 'delete'").select("raw_id", "pos", "observed_at", "tier", F.coalesce("c.channel", "own").alias("channel_id"), F.posexplode("c.ids").alias("item", "msg_id"))
    dels = dels.select("raw_id", "pos", "item", "observed_at", "tier", F.lit("delete").alias("op"), "channel_id", "msg_id", F.lit(None).cast(MESSAGE).alias("m"))
    return ups.unionByName(dels).where("channel_id is not null and msg_id is not null")


def tombstones(changed: DataFrame) -> DataFrame:
    """A row of evidence for every deletion, of messages never seen too."""
    return changed.where("op = 'delete'").select(fn.entity_uri("msg", F.col("channel_id"), F.col("msg_id")).alias("message_uri"), "observed_at", F.lit("update").alias("evidence"), *ARRIVAL)


def collected_messages(changed: DataFrame) -> DataFrame:
    """One row per message: its last text and digest, when it was first and last seen, the first deletion that found it, its revisions."""
    keys, order = ["channel_id", "msg_id"], F.struct(*ARRIVAL)
    digest = fn.content_hash(F.coalesce("m.message", F.lit("")), _some(F.col("m.media")))
    ups = changed.where("op = 'upsert'").select(*keys, *ARRIVAL, "observed_at", F.coalesce("m.message", F.lit("")).alias("text"), digest.alias("content_hash"))
    state = ups.groupBy(*keys).agg(F.max_by(F.struct("text", "content_hash", "observed_at"), order).alias("l"), F.min_by("observed_at", order).alias("first_seen"), F.min(order).alias("born"))
    moved = split.neighbour(ups, keys, ARRIVAL, "content_hash", split.id_block(F.col("raw_id")), "before")
    revisions = moved.where(~F.col("before").eqNullSafe(F.col("content_hash"))).groupBy(*keys).agg(F.count("*").alias("n_revisions"))
    gone = changed.where("op = 'delete'").select(*keys, order.alias("at"), "observed_at").join(state.select(*keys, "born"), keys).where("at > born").groupBy(*keys).agg(F.min_by("observed_at", "at").alias("deleted_at"))
    return state.join(revisions, keys).join(gone, keys, "left").select(*keys, "l.text", "l.content_hash", "first_seen", F.col("l.observed_at").alias("last_seen"), "deleted_at", "n_revisions")


def batches(raw: DataFrame) -> DataFrame:
    """raw_id, channel_id, cursor, outcome of each change batch: `resynced` if it was too long, `empty` or `applied`."""
    rows = parsed(raw).where("tag like '%channeldifference%'")
    long = is_too_long(F.col("tag")) | is_too_long(F.coalesce("p._", F.lit("")))
    some = (F.coalesce(F.size("p.new_messages"), F.lit(0)) > 0) | F.exists(F.coalesce("p.other_updates", F.array().cast(rows.schema["p"].dataType["other_updates"].dataType)), lambda u: fn.tag_is(u["_"], EDIT, DELETE))
    return rows.select("raw_id", F.get("p.chats", 0)["id"].alias("channel_id"), F.when(long, F.col("p.dialog.pts")).otherwise(F.col("p.pts")).alias("cursor"), F.when(long, "resynced").when(some, "applied").otherwise("empty").alias("outcome"))


def cursors(batched: DataFrame) -> DataFrame:
    """Where each channel's changes have got to: the cursor of its last batch that has one, and how its last batch ended."""
    by = F.col("raw_id")
    return batched.where("channel_id is not null").groupBy("channel_id").agg(F.max_by("cursor", F.when(F.col("cursor").isNotNull(), by)).alias("cursor"), F.max_by("outcome", by).alias("outcome"), F.count("*").alias("n_batches"))
