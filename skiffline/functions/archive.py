"""Scalar functions of the archive's data model, as JVM expressions.

Each takes and returns columns, so Catalyst sees through them; the two that Spark can't
express (canonical JSON, and nothing else) are Arrow-batched.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model: kinds of entities, hosts, tags.
SCHEME = "tg"
ENTITY_KINDS = ["channel", "chat", "user", "msg"]
LINK_HOSTS = ["t.me", "telegram.me", "telegram.dog"]
CAPTURE_HOSTS = ["t.me", "www.t.me", "web.archive.org"]
PEER_TAGS = {"peeruser": ("user", "user_id"), "peerchannel": ("channel", "channel_id"), "peerchat": ("chat", "chat_id"), "inputpeeruser": ("user", "user_id"), "inputpeerchannel": ("channel", "channel_id"), "inputpeerchat": ("chat", "chat_id")}
MIME_SUFFIXES = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "video/mp4": ".mp4", "audio/mpeg": ".mp3", "audio/ogg": ".oga", "application/pdf": ".pdf", "application/zip": ".zip", "text/plain": ".txt"}


def tag_is(tag: Column, *names: str) -> Column:
    """Tags are compared without case."""
    return F.lower(tag).isin(*[n.lower() for n in names])


def entity_uri(kind: str, *ids: Column) -> Column:
    """``tg:<kind>:<id>``, NULL without an id."""
    parts = [p for i in ids for p in (F.lit("/"), i.cast("string"))][1:]
    return F.concat(F.lit(f"{SCHEME}:{kind}:"), *parts)


def parsed_uri(uri: Column) -> Column:
    """struct(kind, id, sub_id) of an entity URI, NULL if it is none."""
    m = F.regexp_extract
    shape = rf"^{SCHEME}:(channel|chat|user):(-?\d+)$"
    message = rf"^{SCHEME}:msg:(-?\d+)/(-?\d+)$"
    none = F.lit(None).cast("bigint")
    return F.when(uri.rlike(message), F.struct(F.lit("msg").alias("kind"), m(uri, message, 1).try_cast("bigint").alias("id"), m(uri, message, 2).try_cast("bigint").alias("sub_id"))).when(uri.rlike(shape), F.struct(m(uri, shape, 1).alias("kind"), m(uri, shape, 2).try_cast("bigint").alias("id"), none.alias("sub_id")))


def strict_uri(uri: Column) -> Column:
    """``parsed_uri`` that fails on a bad URI."""
    parsed = parsed_uri(uri)
    return F.when(parsed.isNull() & uri.isNotNull(), F.raise_error(F.concat(F.lit("no entity URI: "), uri))).otherwise(parsed)


def peer_uri(tag: Column, user_id: Column, channel_id: Column, chat_id: Column) -> Column:
    """The URI of a peer reference; NULL for other tags."""
    out, ids = F.lit(None).cast("string"), {"user": user_id, "channel": channel_id, "chat": chat_id}
    for kind, of in ids.items():
        out = F.when(tag_is(tag, *[t for t, (k, _) in PEER_TAGS.items() if k == kind]) & of.isNotNull(), entity_uri(kind, of)).otherwise(out)
    return out


def primary_username(username: Column, usernames: Column) -> Column:
    """The plain name, else the first editable, else the first active one (whose own NULL name stays NULL)."""
    first_editable, first_active = F.get(F.filter(usernames, lambda x: x["editable"]), 0), F.get(F.filter(usernames, lambda x: x["active"]), 0)
    return F.when(F.length(username) > 0, username).when(first_editable.isNotNull(), first_editable["username"]).otherwise(first_active["username"])


def utf16_slice(text: Column, offset: Column, length: Column) -> Column:
    """The part of a text at an offset and length in UTF-16 units; half a surrogate pair at either end is left out."""
    start, size = F.greatest(offset, F.lit(0)).cast("int"), F.greatest(length, F.lit(0)).cast("int")
    part = F.hex(F.encode(text, "UTF-16BE").substr(start * 2 + 1, size * 2))
    part = F.regexp_replace(part, r"^D[C-F][0-9A-F]{2}", "")
    n = F.length(part)
    part = F.when((n >= 4) & part.substr(n - 3, F.lit(4)).rlike(r"^D[89AB]"), part.substr(F.lit(1), n - 4)).otherwise(part)
    return F.when(offset < 0, F.lit("")).otherwise(F.decode(F.unhex(part), "UTF-16BE"))


def link_target(url: Column) -> Column:
    """struct(kind, value): what a link points to - ``username`` or ``invite`` - NULL if its host isn't the platform's."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"^[^:/?#]*://(.*)$", 1)).otherwise(url)
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    steps = F.filter(F.split(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    head, second = F.get(steps, 0), F.get(steps, 1)

    def pair(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    name = F.when((head == "s") & second.isNotNull(), second).otherwise(head)
    target = F.when(head.startswith("+") & (F.length(head) > 1), pair("invite", F.substring(head, 2, 1 << 20))).when((head == "joinchat") & second.isNotNull(), pair("invite", second)).when(name.isNotNull() & ~name.startswith("+"), pair("username", name))
    return F.when(host.isin(*LINK_HOSTS), target)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"


def _only(x: Column, signs: str) -> Column:
    """Whether a text has signs, and no others than these."""
    return (F.length(x) > 0) & (F.translate(x, signs, "") == "")


def _is_name(x: Column) -> Column:
    """A name: a letter, then letters, digits and underscores, 32 signs at most."""
    return (F.length(x) <= 32) & _only(F.substring(x, 1, 1), LETTERS) & _only(x, LETTERS + DIGITS + "_")


def _without_host(text: Column) -> Column:
    """What follows the platform's host, with or without ``http(s)://`` and ``www.``; the whole text if it has another or none."""
    low = F.lower(text)
    skip = F.when(low.startswith("https://"), 8).when(low.startswith("http://"), 7).otherwise(0)
    skip = skip + F.when(low.substr(skip + 1, F.lit(4)) == "www.", 4).otherwise(0)
    host = LINK_HOSTS[0] + "/"
    return F.when(low.substr(skip + 1, F.lit(len(host))) == host, text.substr(skip + 1 + len(host), F.length(text))).otherwise(text)


def target(text: Column) -> Column:
    """struct(kind, value, msg_id) of what a user named; NULL if it is nothing known.

    The first sign tells most kinds apart (``+``, ``#``, ``-``); the rest are one or two
    steps of a path.  Digits are ASCII digits.
    """
    body = _without_host(F.regexp_replace(text, r"^\s+|\s+$", ""))
    sign, tail = F.substring(body, 1, 1), F.substring(body, 2, 1 << 20)
    steps = F.split(body, "/", 3)
    first, second = F.get(steps, 0), F.get(steps, 1)
    hashed = LETTERS + DIGITS + "_-"

    def found(kind: str, value: Column, msg_id: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), (F.lit(None).cast("bigint") if msg_id is None else msg_id).alias("msg_id"))

    numbered = F.when(F.length(tail).between(7, 15), found("phone", body))
    plus = F.when(_only(tail, DIGITS), numbered).when(_only(tail, hashed), found("invite", tail))
    path = F.when((first == "joinchat") & _only(second, hashed), found("invite", second)).when(_is_name(first) & _only(second, DIGITS), found("msg_link", first, second.try_cast("bigint")))
    name = F.when(sign == "@", tail).otherwise(body)
    word = F.when(_is_name(name), found("username", name)).when(_only(F.when(sign == "-", tail).otherwise(body), DIGITS), found("peer_id", body))
    tagged = F.when(tail.rlike(r"^[\p{L}\p{N}_]+$"), found("hashtag", tail))
    return F.when(sign == "+", plus).when(sign == "#", tagged).when(F.size(steps) == 2, path).when(F.size(steps) == 1, word)


def is_channel_like(kind: Column) -> Column:
    """Whether a kind of target leads to a channel or chat."""
    return F.coalesce(kind.isin("username", "invite", "msg_link", "peer_id"), F.lit(False))


def iso_text(at: Column) -> Column:
    """UTC text of a timestamp, with a fraction only if there is one."""
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))


def epoch_iso(seconds: Column) -> Column:
    return iso_text(F.timestamp_seconds(seconds))


def archive_iso(stamp: Column) -> Column:
    """14 digits of an archive as ISO text; NULL if they are no time."""
    return F.when(stamp.rlike(r"^\d{14}$"), iso_text(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))))


def post_id(text: Column) -> Column:
    """struct(username, msg_id) of ``name/523``; both NULL if it is something else."""
    shape = r"^(.+)/([0-9]+)$"
    ok = text.rlike(shape)
    return F.struct(F.when(ok, F.regexp_extract(text, shape, 1)).alias("username"), F.when(ok, F.regexp_extract(text, shape, 2).try_cast("bigint")).alias("msg_id"))


def allowed_host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*CAPTURE_HOSTS), F.lit(False))


def masked(text: Column, secrets: list[str]) -> Column:
    """Every secret replaced by three stars, the longest first."""
    for s in sorted({s for s in secrets if s}, key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("***"))
    return text


def content_hash(text: Column, media_json: Column) -> Column:
    return F.sha2(F.concat(text, F.char(F.lit(0)), F.coalesce(media_json, F.lit(""))), 256)


def file_suffix(kind: Column, file_name: Column, mime: Column) -> Column:
    """``.jpg`` for photos, else the name's suffix, else one that fits the MIME type, else nothing."""
    by_name = F.regexp_extract(file_name, r"[^/.](\.[^./\\]+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in MIME_SUFFIXES.items() for x in kv])
    return F.when(kind == "photo", ".jpg").when(F.length(by_name) > 0, by_name).otherwise(F.coalesce(F.try_element_at(known, mime), F.lit("")))


# What to do about an error, by its class; waits also depend on their length.
DISPOSITIONS = {
    "skip": ["ChatAdminRequiredError", "ChannelPrivateError", "MsgIdInvalidError", "BroadcastForbiddenError", "PremiumAccountRequiredError", "ChatNotModifiedError"],
    "hard_stop": ["PeerFloodError", "FrozenMethodInvalidError", "AuthKeyDuplicatedError", "SessionRevokedError"],
    "retry": ["ConnectionError", "TimeoutError", "OSError"],
}
LONGEST_WAIT = 60


def disposition(error: Column, seconds: Column, threshold: int = LONGEST_WAIT) -> Column:
    """retry, skip, phase_stop or hard_stop; NULL for an error of no known class."""
    out = F.lit(None).cast("string")
    for what, names in DISPOSITIONS.items():
        out = F.when(error.isin(*names), what).otherwise(out)
    return F.when(error == "FloodWaitError", F.when(seconds <= threshold, "retry").otherwise("phase_stop")).otherwise(out)


def pause(interval: Column, since_last: Column) -> Column:
    """Seconds still to wait before the next call."""
    return F.greatest(F.lit(0.0), interval - F.coalesce(since_last, interval))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted members and one kind of spacing, other letters kept; NULL for what is no JSON."""

    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)


def register(spark: SparkSession) -> None:
    """Makes some of the functions usable from SQL text: canonical_json as an Arrow-batched one, the others as SQL functions that stay in the JVM."""
    spark.udf.register("canonical_json", canonical_json)
    for head, body in {
        "entity_uri(kind string, id bigint) returns string": f"concat('{SCHEME}:', kind, ':', id)",
        "message_uri(channel_id bigint, msg_id bigint) returns string": f"concat('{SCHEME}:msg:', channel_id, '/', msg_id)",
        "message_hash(text string, media_json string) returns string": "sha2(concat(text, char(0), coalesce(media_json, '')), 256)",
        "iso_time(at timestamp) returns string": "concat(date_format(at, \"yyyy-MM-dd'T'HH:mm:ss\"), case when pmod(unix_micros(at), 1000000) = 0 then '' else concat('.', lpad(pmod(unix_micros(at), 1000000), 6, '0')) end, '+00:00')",
    }.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
