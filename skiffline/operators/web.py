"""Captured pages and archive indexes to rows.

Feed pages are HTML.  A page is cut into a flat table of tags and texts; posts are balanced
spans of it, and what a post holds is looked up in its span by class.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skiffline.functions.archive import archive_iso, post_id

MAX_PAGES = 50  #: pages of a feed in one run


@dataclass(frozen=True)
class PageMarkup:
    """Class names of a feed page's parts."""

    post: str = "tgme_widget_message"
    text: str = "tgme_widget_message_text"
    fields: dict = field(default_factory=lambda: {"tgme_widget_message_views": "views", "tgme_widget_message_author_signature": "signature", "tgme_widget_message_forwarded_from_name": "forwarded_from"})
    id_attribute: str = "data-post"


_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Event(NamedTuple):
    """A tag or a piece of text of a page, in document order."""

    kind: str  #: ``open``, ``close`` or ``text``
    name: str = ""
    attributes: dict = {}
    text: str = ""

    def has_class(self, name: str) -> bool:
        return name in self.attributes.get("class", "").split()


def events(page: str) -> list[Event]:
    """A page as a flat table of tags and texts, entities decoded."""
    out, at = [], 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            out.append(Event("text", text=html.unescape(page[at : m.start()])))
        at = m.end()
        if m.group(2):
            pairs = ((a.group(1).lower(), next((v for v in a.groups()[1:] if v is not None), "")) for a in _ATTRIBUTE.finditer(m.group(3)))
            out.append(Event("close" if m.group(1) else "open", m.group(2).lower(), {k: html.unescape(v) for k, v in pairs}))
    if at < len(page):
        out.append(Event("text", text=html.unescape(page[at:])))
    return out


def balanced(table: list[Event], name: str) -> dict[int, int]:
    """Where each element of a name that is closed begins and ends, other elements disregarded."""
    opened, spans = [], {}
    for i, e in enumerate(table):
        if e.name == name:
            if e.kind == "open":
                opened.append(i)
            elif opened:
                spans[opened.pop()] = i
    return spans


def _until(table: list[Event], start: int, *names: str) -> int:
    """The first end tag of one of the names after a place, else the end of the table."""
    return next((j for j in range(start + 1, len(table)) if table[j].kind == "close" and table[j].name in names), len(table))


def _text(table: list[Event]) -> str:
    return "".join("\n" if e.name == "br" else e.text for e in table if e.name == "br" or e.kind == "text")


def post_fields(table: list[Event], markup: PageMarkup) -> dict:
    """The fields of one post's events: the last time and text block, every piece of the short fields."""
    blocks = [(i, _until(table, i, "div")) for i, e in enumerate(table) if i and e.kind == "open" and e.name == "div" and e.has_class(markup.text)]
    short: dict[str, list[str]] = {}
    for i, e in enumerate(table):
        if e.kind == "open" and e.name in ("span", "a") and not any(a < i < b for a, b in blocks):
            for of, column in markup.fields.items():
                if e.has_class(of):
                    short.setdefault(column, []).append("".join(x.text for x in table[i : _until(table, i, "span", "a")]))
    times = [e.attributes["datetime"] for e in table if e.kind == "open" and e.name == "time" and "datetime" in e.attributes]
    texts = [_text(table[a:b]).strip() for a, b in blocks if b < len(table)]
    return {"datetime": times[-1] if times else None, **{c: "".join(short[c]).strip() if c in short else None for c in markup.fields.values()}, "text": texts[-1] if texts else None}


def posts(page: str, markup: PageMarkup = PageMarkup()) -> list[dict]:
    """The posts of a page in document order; a post that isn't closed, or that holds another one, is left out."""
    table = events(page)
    heads = [i for i, e in enumerate(table) if e.kind == "open" and e.name == "div" and e.has_class(markup.post) and e.attributes.get(markup.id_attribute)]
    if not heads:
        return []
    ends = balanced(table, "div")
    out = []
    for i, following in zip(heads, [*heads[1:], len(table)]):
        if i in ends and ends[i] < following:
            out.append({"post_id": table[i].attributes[markup.id_attribute], **post_fields(table[i : ends[i] + 1], markup)})
    return out


def block_text(page: str | None, class_name: str) -> str | None:
    """The text of a capture's single block with a class; line breaks kept."""
    if page is None:
        return None
    inner = re.search(rf'<div[^>]*class="[^"]*\b{re.escape(class_name)}\b[^"]*"[^>]*>(.*?)</div>', page, re.S)
    if inner is None:
        return None
    return html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", "\n", inner.group(1)))).strip()


_POSTS = "page_id bigint, pos int, post_id string, datetime string, views string, signature string, forwarded_from string, text string"


def feed_posts(pages: DataFrame, page_id: Column, page: Column, markup: PageMarkup = PageMarkup()) -> DataFrame:
    """One row per post of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), *[(c, pa.string()) for c in ("post_id", "datetime", "views", "signature", "forwarded_from", "text")]])

    def run(batches):
        for batch in batches:
            rows = [(i, n, *(p[c] for c in schema.names[2:])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for n, p in enumerate(posts(t, markup))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    parsed = pages.select(page_id.cast("bigint").alias("page_id"), page.alias("page")).where("page is not null").mapInArrow(run, _POSTS)
    ids = post_id(F.col("post_id"))
    return parsed.withColumns({"channel_username": ids["username"], "msg_id": ids["msg_id"]})


def page_cursors(posts_: DataFrame, feed: str, page_no: str) -> DataFrame:
    """Each page of a feed with its least and greatest message id, the cursor of the next page, and whether paging goes on.

    It ends at a page without an id and at one whose least id isn't below that of the page before.
    """
    pages = posts_.groupBy(feed, page_no).agg(F.min("msg_id").alias("next_before"), F.max("msg_id").alias("newest"), F.count("*").alias("n_posts"))
    before = F.lag("next_before").over(Window.partitionBy(feed).orderBy(page_no))  # at most MAX_PAGES pages of a feed are fetched in a run
    goes_on = F.col("next_before").isNotNull() & (before.isNull() | (F.col("next_before") < before)) & (F.col(page_no) < MAX_PAGES)
    return pages.withColumn("goes_on", goes_on)


def high_water_marks(pages: DataFrame, feed: str) -> DataFrame:
    """The newest message id seen of each feed."""
    return pages.groupBy(feed).agg(F.max("newest").alias("newest_seen"))


def capture_texts(pages: DataFrame, page_id: Column, page: Column, class_name: str) -> DataFrame:
    """id and text of captures that hold one post each."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([block_text(t, class_name) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return pages.select(page_id.cast("bigint").alias("id"), page.alias("page")).where("page is not null").mapInArrow(run, "id bigint, text string")


def index_rows(indexes: DataFrame, index_id: Column, body: Column) -> DataFrame:
    """An archive index (an array whose first row names the columns) as rows of maps; rows of another length are left out."""
    table = F.from_json(body, "array<array<string>>")
    head = F.get(table, 0)
    rows = indexes.select(index_id.alias("index_id"), head.alias("head"), F.posexplode(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))).alias("pos", "row"))
    return rows.where(F.size("row") == F.size("head")).select("index_id", "pos", F.map_from_arrays("head", "row").alias("r"))


def index_captures(rows: DataFrame) -> DataFrame:
    """The captures of an index with their time as ISO text (its digits if they are none)."""
    r = F.col("r")
    return rows.select("index_id", "pos", r["original"].alias("url"), F.coalesce(archive_iso(r["timestamp"]), r["timestamp"]).alias("timestamp"), r["statuscode"].alias("status"), r["digest"].alias("digest"))


def recovered(captures: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Captured posts, each with whether any evidence says that its message was deleted."""
    dead = tombstones.select(F.col("message_uri").alias("d")).distinct()
    return captures.join(dead, F.col("uri") == F.col("d"), "left").withColumn("is_deleted", F.col("d").isNotNull()).drop("d")
