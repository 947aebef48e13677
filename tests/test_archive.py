"""Operators of the archive on literal rows, and merge rules against a fold over random events."""

import random

import pytest
from pyspark.sql import functions as F

from skiffline.functions import archive as fn
from skiffline.operators import changes, merge, operations, projections, search, split, web
from skiffline.sources import tables
from skiffline.streaming import feed


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def units(text):
    """Where each character of a text begins, in UTF-16 units, and where the text ends."""
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode("utf-16-le")) // 2)
    return at


@pytest.mark.parametrize("text", ["pier nine", "\U0001f30a\U0001f30a pier \u00e9\U0001d11e", "\u6f6e\U0002000b", ""])
def test_utf16_slice(spark, text):
    at = units(text)
    wanted = [(text[i:j], at[i], at[j] - at[i]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)]
    rows = spark.createDataFrame([(w, text, o, n) for w, o, n in wanted], "w string, t string, o int, n int")
    assert rows.where(fn.utf16_slice(F.col("t"), F.col("o"), F.col("n")) != F.col("w")).count() == 0


@pytest.mark.parametrize(("offset", "length", "want"), [(1, 2, "q"), (0, 1, ""), (2, 50, "q"), (-2, 3, ""), (2, -1, ""), (9, 1, "")])
def test_utf16_slice_at_odd_places(spark, offset, length, want):
    """Half a pair is left out, what lies beyond the end is nothing."""
    assert one(spark, fn.utf16_slice(F.col("t"), F.col("o"), F.col("n")), t="\U0001f6a2q", o=offset, n=length) == want


def test_link_target(spark):
    wanted = {
        "http://t.me/kelp_mirror": ("username", "kelp_mirror"),
        "telegram.dog/Gull9": ("username", "Gull9"),
        "https://T.ME/s/gull_relay/": ("username", "gull_relay"),
        "telegram.me/gull_relay/77?single#top": ("username", "gull_relay"),
        "t.me/+q-R_7": ("invite", "q-R_7"),
        "//t.me/kelp": None,
        "https://telegram.dog/joinchat/q-R_7/": ("invite", "q-R_7"),
        "https://t.me/joinchat": ("username", "joinchat"),
        "https://feed.example/s/gull_relay": None,
        "https://web.t.me/gull_relay": None,
        "https://t.me:443/gull_relay": ("username", "gull_relay"),
        "t.me": None,
        "http://telegram.me//": None,
        "t.me/+": None,
        "tide at nine": None,
        "": None,
    }
    t = fn.link_target(F.col("u"))
    rows = spark.createDataFrame([(u,) for u in [*wanted, None]], "u string").select("u", t["kind"].alias("k"), t["value"].alias("v")).collect()
    assert {r.u: (r.k, r.v) if r.k else None for r in rows} == {**wanted, None: None}


def test_target(spark):
    wanted = {
        "kelp_mirror": ("username", "kelp_mirror", None),
        "\t@Gull9\n": ("username", "Gull9", None),
        "HTTP://WWW.T.ME/Gull9": ("username", "Gull9", None),
        "www.t.me/Gull9/008": ("msg_link", "Gull9", 8),
        "Gull9/8/2": None,
        "@Gull9/8": None,
        "joinchat/8": ("invite", "8", None),
        "https://t.me/joinchat/q-R_7": ("invite", "q-R_7", None),
        "+q-R_7": ("invite", "q-R_7", None),
        "+4930123456": ("phone", "+4930123456", None),
        "t.me/+4930123456": ("phone", "+4930123456", None),
        "+49301": None,
        "+1234567890123456": None,
        "#tide_9": ("hashtag", "tide_9", None),
        "#прилив": ("hashtag", "прилив", None),
        "#a b": None,
        "1800000003": ("peer_id", "1800000003", None),
        "-1001800000003": ("peer_id", "-1001800000003", None),
        "9gull": None,
        "g" * 32: ("username", "g" * 32, None),
        "g" * 33: None,
        "gull relay": None,
        "": None,
    }
    t = fn.target(F.col("x"))
    rows = spark.createDataFrame([(x,) for x in [*wanted, None]], "x string").select("x", t["kind"].alias("k"), t["value"].alias("v"), t["msg_id"].alias("m"), fn.is_channel_like(t["kind"]).alias("leads")).collect()
    assert {r.x: (r.k, r.v, r.m) if r.k else None for r in rows} == {**wanted, None: None}
    assert {r.k for r in rows if r.leads} == {"username", "msg_link", "invite", "peer_id"}


def test_uris_and_times(spark):
    assert tuple(one(spark, fn.parsed_uri(F.col("u")), u="tg:msg:5/7")) == ("msg", 5, 7)
    assert one(spark, fn.parsed_uri(F.col("u")), u="tg:username:x") is None
    with pytest.raises(Exception, match="no entity URI"):
        one(spark, fn.strict_uri(F.col("u")), u="nope")
    assert one(spark, fn.archive_iso(F.col("t")), t="20190101023000") == "2019-01-01T02:30:00+00:00"
    assert one(spark, fn.archive_iso(F.col("t")), t="20191399000000") is None
    assert one(spark, fn.iso_text(F.timestamp_micros(F.col("t"))), t=1_500_000) == "1970-01-01T00:00:01.500000+00:00"
    assert tuple(one(spark, fn.post_id(F.col("t")), t="name/523")) == ("name", 523)
    assert tuple(one(spark, fn.post_id(F.col("t")), t="name/x")) == (None, None)
    assert one(spark, fn.masked(F.col("t"), ["ab", "abc", ""]), t="xabcxab") == "x***x***"
    assert one(spark, fn.disposition(F.col("e"), F.col("s")), e="FloodWaitError", s=61) == "phase_stop"
    assert one(spark, fn.disposition(F.col("e"), F.col("s")), e="FloodWaitError", s=60) == "retry"
    assert one(spark, fn.disposition(F.col("e"), F.col("s")), e="Unheard", s=1) is None
    assert one(spark, fn.file_suffix(F.col("k"), F.col("n"), F.col("m")), k="document", n="a.tar.gz", m="x") == ".gz"
    assert one(spark, fn.file_suffix(F.col("k"), F.col("n"), F.col("m")), k="photo", n=None, m=None) == ".jpg"
    assert one(spark, fn.canonical_json(F.col("j")), j='{"b":1,"a":"é"}') == '{"a": "é", "b": 1}'


def test_primary_username(spark):
    kind = "array<struct<username:string,editable:boolean,active:boolean>>"

    def name(plain, listed):
        return spark.createDataFrame([(plain, listed)], f"u string, us {kind}").select(fn.primary_username(F.col("u"), F.col("us")).alias("r")).first().r

    assert name("plain", None) == "plain"
    assert name("", [("act", False, True), ("edit", True, False)]) == "edit"
    assert name(None, [("act", False, True)]) == "act"
    assert name(None, [(None, True, True), ("act", False, True)]) is None
    assert name(None, []) is None


def raw(spark, *rows):
    return spark.createDataFrame([(i, k, "2024-01-01T00:00:00+00:00", "stranger", None, p) for i, (k, p) in enumerate(rows, 1)], "id bigint, kind string, observed_at string, tier string, context_json string, payload string")


MESSAGE = '{"_":"%s","id":7,"date":1700000000,"message":"hi","peer_id":{"channel_id":5},"entities":[],"media":{"_":"messageMediaPhoto","photo":{"id":9}},"from_id":{"_":"PeerUser","user_id":3},"reactions":{"results":[]},"reply_to":{"reply_to_msg_id":4}}'


@pytest.mark.parametrize("tag", ["Message", "message", "MessageService"])
def test_message_projection(spark, tag):
    r = projections.message_rows(projections.observed_messages(raw(spark, (tag, MESSAGE % tag)))).first()
    assert (r.uri, r.text, r.date, r.from_uri, r.reply_to_msg_id, r.media_kind, r.entities_json, r.is_service) == ("tg:msg:5/7", "hi", "2023-11-14T22:13:20+00:00", "tg:user:3", 4, "messageMediaPhoto", "[]", int(tag == "MessageService"))


def test_messages_in_pages_changes_and_quotes(spark):
    import json

    m = MESSAGE % "message"
    page = f'{{"_":"messages.ChannelMessages","messages":[{m},{{"_":"messageEmpty","id":8}}]}}'
    change = f'{{"_":"updates.ChannelDifference","new_messages":[{m}],"other_updates":[{{"_":"updateEditChannelMessage","message":{m}}},{{"_":"updateDeleteChannelMessages","messages":[1]}}]}}'
    rows = projections.observed_messages(raw(spark, ("messages.channelMessages", page), ("updates.channelDifference", change), ("Message", json.dumps(m)), ("Message", m[:-5]), ("Message", None))).collect()
    assert sorted((r.raw_id, r.pos) for r in rows) == [(1, 0), (2, 0), (2, 1), (3, 0)]


def test_metrics_and_stubs(spark):
    with_views = (MESSAGE % "message").replace('"id":7', '"id":7,"views":0')
    obs = projections.observed_messages(raw(spark, ("message", with_views), ("message", MESSAGE % "message")))
    assert [r.views for r in projections.metric_rows(obs).collect()] == [0]  # reactions alone make no row
    assert {(r.uri, r.seen_in_chat, r.seen_in_msg) for r in projections.author_stubs(obs).collect()} == {("tg:user:3", 5, 7)}


def test_channels_and_peers(spark):
    full = '{"full_chat":{"id":5,"about":"","linked_chat_id":0,"participants_count":3},"chats":[{"_":"Channel","id":5,"megagroup":true,"forum":true,"title":"T"},{"_":"chatForbidden","id":6},{"_":"odd","id":7}],"users":[{"_":"User","id":1,"min":true}]}'
    c = projections.channel_rows(raw(spark, ("messages.ChatFull", full))).first()
    assert (c.id, c.kind, c.linked_chat_id, c.about_hash, c.title) == (5, "forum", None, None, "T")
    peers = {(r.uri, r.is_min) for r in projections.peer_rows(raw(spark, ("messages.ChatFull", full))).collect()}
    assert peers == {("tg:channel:5", 0), ("tg:chat:6", 0), ("tg:user:1", 1)}


def test_edges(spark):
    rec = spark.createDataFrame([(5, 1, "t", '{"count":37,"chats":[{"_":"Channel","id":5},{"_":"channel","id":8}]}')], "channel_id bigint, raw_id bigint, observed_at string, json string")
    assert [(r.subject_uri, r.object_uri, r.evidence_json) for r in projections.recommended_edges(rec).collect()] == [("tg:channel:5", "tg:channel:8", '{"total_count":37}')]
    msgs = spark.createDataFrame(
        [("tg:msg:5/1", "\U0001f600 t.me/durable @x", '[{"_":"messageEntityUrl","offset":3,"length":12},{"_":"MessageEntityTextUrl","offset":0,"length":1,"url":"https://t.me/+abc"},{"_":"messageEntityMentionName","offset":0,"length":1,"user_id":9},{"_":"messageEntityMention","offset":16,"length":2}]', "t", 1)],
        "uri string, text string, entities_json string, first_seen string, source_raw_id bigint",
    )
    assert {r.object_uri for r in projections.mention_edges(projections.entity_links(msgs)).collect()} == {"tg:username:durable", "tg:invite:abc", "tg:user:9"}
    invites = spark.createDataFrame([("tg:msg:5/1", "abc"), ("tg:msg:5/2", "abc"), ("tg:msg:5/3", "known")], "subject_uri string, hash string")
    previews = spark.createDataFrame([("abc", '{"_":"chatInvite","title":"T","participants_count":4}'), ("known", '{"_":"ChatInviteAlready","chat":{"_":"Channel","id":11}}')], "hash string, json string")
    assert {(r.subject_uri, r.object_uri) for r in projections.invite_edges(invites, previews).collect()} == {("tg:msg:5/1", "tg:invite:abc"), ("tg:msg:5/2", "tg:invite:abc"), ("tg:msg:5/3", "tg:channel:11")}
    ads = spark.createDataFrame([(5, '{"messages":[{"url":"https://t.me/ad","title":"A"},{"url":"https://example.com/x"}]}')], "channel_id bigint, json string")
    assert [r.object_uri for r in projections.sponsored_edges(ads).collect()] == ["tg:username:ad"]
    own = spark.createDataFrame([("tg:msg:5/1", "p", "tg:user:1"), ("tg:msg:50/1", "p", "tg:user:2"), ("tg:channel:9", "p", "tg:channel:5"), (None, "p", "tg:channel:5")], "subject_uri string, predicate string, object_uri string")
    assert merge.edges_of_channel(own, 5, "tg:user:1").count() == 2


def test_merges_against_fold(spark):
    rng = random.Random(5)
    obs = [(i, rng.randint(1, 9), rng.choice("abc"), f"t{i:04d}") for i in range(200)]
    df = spark.createDataFrame(obs, "seq bigint, k bigint, h string, first_seen string")
    last, first, revised, prior = {}, {}, [], {}
    for seq, k, h, t in obs:
        first.setdefault(k, t)
        last[k] = h
        if prior.get(k) != h:
            revised.append(seq)
        prior[k] = h
    state = merge.last_state(df.withColumn("o", F.col("seq")), ["k"], ["o"], first=["first_seen"])
    assert {r.k: (r.h, r.first_seen) for r in state.collect()} == {k: (last[k], first[k]) for k in last}
    assert sorted(r.seq for r in merge.revisions(df, "k", "h", "seq").collect()) == revised


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_split_windows_against_whole_ones(spark, monkeypatch, width):
    from pyspark.sql.window import Window

    monkeypatch.setattr(split, "WIDTH", width)
    rng = random.Random(width)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, 1, 2, 3])) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, o bigint, v int")
    whole = Window.partitionBy("k").orderBy("o")
    b = split.id_block(F.col("o"))
    df = split.neighbour(df, ["k"], ["o"], "v", b, "p")
    df = split.neighbour(df, ["k"], ["o"], "v", b, "n", after=True)
    df = split.greatest_before(df, ["k"], ["o"], "v", b, "g")
    df = split.running_sum(df, ["k"], ["o"], "o", b, "s")
    want = df.withColumns({"p2": F.lag("v").over(whole), "n2": F.lead("v").over(whole), "g2": F.max("v").over(whole.rowsBetween(Window.unboundedPreceding, -1)), "s2": F.sum("o").over(whole)})
    got = want.collect()
    assert len(got) == 120 and all((r.p, r.n, r.g, r.s) == (r.p2, r.n2, r.g2, r.s2) for r in got)


def test_min_peer_rule(spark):
    schema = "uri string, kind string, id bigint, access_hash bigint, is_min int, username string, first_name string, last_name string, title string, seen_in_chat bigint, seen_in_msg bigint, raw_id bigint, observed_at string, n int"
    full, part = ("u", "user", 1, 5, 0, "name", None, None, None, None, None), ("u", "user", 1, None, 1, None, "First", None, None, 7, 8)
    r = merge.merged_peers(spark.createDataFrame([(*full, 1, "a", 1), (*part, 2, "b", 2)], schema), ["n"]).first()
    assert (r.username, r.first_name, r.is_min, r.seen_in_chat, r.raw_id, r.first_seen, r.last_seen) == ("name", None, 0, 7, 2, "a", "b")
    r = merge.merged_peers(spark.createDataFrame([(*part, 1, "a", 1), (*full, 2, "b", 2)], schema), ["n"]).first()
    assert (r.username, r.is_min, r.seen_in_chat) == ("name", 0, None)


def test_ranges(spark):
    r = spark.createDataFrame([(1, 1, 5), (1, 6, 10), (1, 20, 25), (2, 3, 4), (2, 9, 1)], "k int, lo bigint, hi bigint")
    assert sorted(tuple(x) for x in merge.coalesced_ranges(r, "k").collect()) == [(1, 1, 10), (1, 20, 25), (2, 3, 4)]
    spans = spark.createDataFrame([(1, 1, 27), (2, 1, 5), (3, 2, 3)], "k int, lo bigint, hi bigint")
    assert sorted(tuple(x) for x in merge.uncovered(spans, r, "k").collect()) == [(1, 11, 19), (1, 26, 27), (2, 1, 2), (2, 5, 5), (3, 2, 3)]
    ids = spark.createDataFrame([(1, 1), (1, 1), (1, 4), (2, 9)], "k int, v bigint")
    assert sorted(tuple(x) for x in merge.expanded(merge.gaps(ids, "k", "v"), "k", "v").collect()) == [(1, 2), (1, 3)]


def test_deletion_needs_an_earlier_message(spark):
    m = spark.createDataFrame([("a", 10), ("a", 30), ("b", 50)], "uri string, seen bigint")
    t = spark.createDataFrame([(1, "a", 5, "update", "t5"), (2, "a", 20, "gap", "t20"), (3, "a", 25, "empty", "t25"), (4, "a", 40, "update", "t40"), (5, "c", 60, "update", "t60")], "id bigint, message_uri string, at bigint, evidence string, observed_at string")
    assert [tuple(r) for r in merge.deleted_at(m, t).collect()] == [("a", "t25")]
    with pytest.raises(Exception, match="out of range"):
        tables.checked(t, "evidence", ["update"]).collect()


def test_media_and_export(spark):
    rows = spark.createDataFrame([("photo", 1, "a", 1), ("photo", 1, "b", 2), (None, None, "c", 3)], "kind string, content_id bigint, uri string, msg_id bigint")
    assert {(r.uri, r.disposition) for r in merge.dispositions(rows, ["kind", "content_id"], ["msg_id"]).collect()} == {("a", "downloaded"), ("b", "duplicates"), ("c", "skipped_kind")}
    m = spark.createDataFrame([("x", "me"), ("y", None), ("z", "you")], "uri string, from_uri string")
    rev = spark.createDataFrame([("z", "t2", 2, "h2", ""), ("z", "t1", 1, "h1", "")], "message_uri string, observed_at string, id bigint, content_hash string, text string")
    got = {r.uri: [x.content_hash for x in r.revisions] for r in merge.nested_revisions(m, rev, "me").collect()}
    assert got == {"y": [], "z": ["h1", "h2"]}


def test_json_lines_and_raw_log(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "ü")], "b int, a string, c string")
    tables.write_json_lines(df, str(tmp_path / "x"), single_file=True)
    text = next((tmp_path / "x").glob("part*")).read_text()
    assert text == '{"a":null,"b":1,"c":"ü"}\n'
    for _ in range(2):
        tables.append_raw(raw(spark, ("Message", "{}"), ("message", "{}")), str(tmp_path / "raw"))
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert back.where("kind_key = 'message'").count() == 4
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.jpg").write_bytes(b"x")
    f = tables.media_files(spark, str(tmp_path / "m")).first()
    assert f.size == 1 and f.path == f"{f.sha256[:2]}/{f.sha256}.jpg"


PAGE = """<p>5.3K readers</p>
<div class="wrap"><div data-post="gull_relay/41" class="js tgme_widget_message"><div class="tgme_widget_message_text">old</div>
<div class="tgme_widget_message_text">Ferry &lt;late&gt;<br/>see <a href="x">the board</a><div>until nine</div> not this</div>
<a class="tgme_widget_message_author_signature"> Mo <b>T.</b> </a><time datetime='2025-02-03T04:05:06+00:00'>4:05</time><span class="tgme_widget_message_views">7.5K</span></div></div>
<div class="tgme_widget_message"><div class="tgme_widget_message_text">no id</div></div>
<div class="tgme_widget_message" data-post="nameless"><span class="tgme_widget_message_forwarded_from_name">Kelp</span> &amp; more<!-- <div> --></div>
<div class="tgme_widget_message" data-post="gull_relay/40"><div>never closed"""


def test_feed_page(spark):
    got = web.posts(PAGE)
    assert [p["post_id"] for p in got] == ["gull_relay/41", "nameless"]
    assert (got[0]["text"], got[0]["views"], got[0]["signature"], got[0]["datetime"]) == ("Ferry <late>\nsee the boarduntil nine", "7.5K", "Mo T.", "2025-02-03T04:05:06+00:00")
    assert (got[1]["forwarded_from"], got[1]["text"], got[1]["datetime"]) == ("Kelp", None, None)
    rows = web.feed_posts(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "i bigint, h string"), F.col("i"), F.col("h")).collect()
    assert [(r.page_id, r.channel_username, r.msg_id) for r in rows] == [(1, "gull_relay", 41), (1, None, None)]


def test_archive_index(spark):
    body = '[["urlkey","timestamp","original","mimetype","statuscode","digest","length"],["k","20190101023000","u1","t","200","D1","1"],["short"],["k","nonsense","u2","t","200","D1","1"]]'
    df = spark.createDataFrame([(1, body), (2, "[]"), (3, "x"), (4, '[["only","head"]]')], "i bigint, b string")
    rows = web.index_captures(web.index_rows(df, F.col("i"), F.col("b"))).collect()
    assert [(r.url, r.timestamp) for r in sorted(rows, key=lambda r: r.pos)] == [("u1", "2019-01-01T02:30:00+00:00"), ("u2", "nonsense")]
    caps = spark.createDataFrame([(1, "a", "D1"), (2, "a", "D1"), (3, "a", "D2"), (4, "a", "D1")], "t int, k string, d string")
    assert sorted(r.t for r in merge.collapsed(caps.withColumn("i", F.col("t")), ["k"], "d", "t", "i").collect()) == [1, 3, 4]


def test_search_like_fts(spark):
    import sqlite3

    docs = [(1, "The café runs, foo_bar it's"), (2, "state-of-the-art runs"), (3, "run the café"), (4, "bar foo"), (5, ""), (6, "Привет МИР"), (7, "foo bar foo bar")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t)")
    db.executemany("insert into f(rowid, t) values (?, ?)", docs)
    index = search.tokens(spark.createDataFrame(docs, "i bigint, t string"), F.col("i"), F.col("t"))
    for match, kw in [("cafe", {"all_of": ["cafe"]}), ("cafe runs", {"all_of": ["cafe", "runs"]}), ('"foo bar"', {"phrases": [["foo", "bar"]]}), ("ru*", {"prefixes": ["ru"]}), ("run OR bar", {"any_of": ["run", "bar"]}), ("foo NOT cafe", {"all_of": ["foo"], "none_of": ["cafe"]}), ("^the", {"first": "the"}), ("мир", {"all_of": ["мир"]})]:
        want = sorted(r[0] for r in db.execute("select rowid from f where f match ?", (match,)))
        assert sorted(r.id for r in search.search(index, **kw).collect()) == want, match


def test_near_and_ranking(spark):
    docs = [(1, "ferry one two three four harbour"), (2, "harbour ferry"), (3, "ferry"), (4, "nothing here"), (5, "ferry ferry ferry")]
    index = search.by_token(search.tokens(spark.createDataFrame(docs, "i bigint, t string"), F.col("i"), F.col("t")))
    assert {r.id for r in search.near(index, "harbour", "ferry", 3).collect()} == {2}
    assert {r.id for r in search.near(index, "harbour", "ferry", 4).collect()} == {1, 2}
    assert {r.id for r in search.near(index, "ferry", "ferry", 1).collect()} == {5}
    scores = {r.id: r.score for r in search.ranked(index, ["harbour"]).collect()}
    assert set(scores) == {1, 2} and scores[2] > scores[1] > 0


def test_sql_functions(spark):
    fn.register(spark)
    r = spark.sql("select entity_uri('user', 5) as a, message_uri(5, 7) as b, message_hash('x', null) as c, iso_time(timestamp_micros(1500000)) as d, canonical_json('{\"b\":1,\"a\":2}') as e").first()
    assert tuple(r)[:2] == ("tg:user:5", "tg:msg:5/7") and r.d == "1970-01-01T00:00:01.500000+00:00" and r.e == '{"a": 2, "b": 1}'
    assert r.c == one(spark, fn.content_hash(F.col("t"), F.lit(None)), t="x")


def test_operations(spark, tmp_path):
    log = spark.createDataFrame([("a", 100), ("a", 50), ("b", 10)], "method string, until bigint")
    assert {r.method: r.remaining for r in operations.cooldowns(log, F.lit(60)).collect()} == {"a": 40, "b": 0}
    checks = spark.createDataFrame([("p", "fail", True), ("p", "warn", False), ("q", "fail", False)], "profile string, severity string, ok boolean")
    assert {r.profile: r.blocked for r in operations.blocked(checks).collect()} == {"p": False, "q": True}
    assert operations.check_phases(["history", "channel"]) == ["channel", "history"]
    with pytest.raises(ValueError, match="need the phase channel"):
        operations.check_phases(["web"])

    def stop(kind):
        def run():
            raise operations.Stop(kind, "why")

        return run

    out = operations.run_phases(["channel", "history", "graph", "web"], {"channel": lambda: {"n": 1}, "history": stop("skip"), "graph": stop("hard_stop"), "web": lambda: {}})
    assert [(o.phase, o.kind) for o in out] == [("channel", "done"), ("history", "skip"), ("graph", "hard_stop")]
    events = operations.run_events(spark, out, 5, "t")
    for _ in range(2):
        operations.append_events(events, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("channel_id = 5").count() == 6


def test_stored_media_by_bytes(spark):
    rows = spark.createDataFrame([("photo", 1, "a", 1), ("photo", 2, "b", 2), ("photo", 1, "c", 3), ("photo", 3, "d", 4), (None, None, "e", 5)], "kind string, content_id bigint, uri string, msg_id bigint")
    files = spark.createDataFrame([("photo", 1, "s1"), ("photo", 2, "s1"), ("photo", 2, "s1")], "kind string, content_id bigint, sha256 string")
    stored = merge.stored_media(rows, files, ["kind", "content_id"], ["msg_id"])
    assert {r.uri: r.disposition for r in stored.collect()} == {"a": "downloaded", "b": "duplicates", "c": "duplicates", "d": "unavailable", "e": "skipped_kind"}
    assert {(r.source_message_uri, r.path) for r in merge.custody(stored).collect()} == {(u, "s1/s1") for u in "abc"}


def test_preflight(spark):
    day = 86_400_000_000
    closed, open_, none = '{"rules":[{"_":"privacyValueAllowContacts"}]}', '{"rules":[{"_":"PrivacyValueAllowAll"}]}', '{"rules":[]}'
    schema = "profile string, require_proxy boolean, proxy string, session_created bigint, has_password boolean, username string, photo string, about string, phone_rules string, lastseen_rules string, photo_rules string"
    rows = [("good", True, "socks", 0, True, None, "", None, closed, closed, closed), ("shown", False, None, 0, True, "me", None, None, closed, closed, closed), ("bad", True, "", 95 * day, None, None, None, None, open_, none, None), ("none", False, None, None, True, None, None, None, closed, closed, closed)]
    checks = operations.preflight(spark.createDataFrame(rows, schema), F.lit(100 * day), 30)
    assert checks.count() == 28
    failed = {}
    for r in checks.where("not ok").collect():
        failed.setdefault(r.profile, set()).add(r.name)
    assert failed == {"shown": {"minimal_profile"}, "bad": {"proxy", "session_age", "two_factor_auth", "privacy_phone", "privacy_lastseen", "privacy_photo"}, "none": {"session_age"}}
    assert {r.profile for r in operations.blocked(checks).where("blocked").collect()} == {"bad", "none"}


def batch(*updates, new=(), **more):
    import json

    return json.dumps({"_": "updates.channelDifference", "chats": [{"_": "channel", "id": 5}], "pts": 40, "new_messages": list(new), "other_updates": list(updates), **more})


def said(number, text):
    return {"_": "message", "id": number, "message": text, "peer_id": {"channel_id": 5}}


def test_change_batches(spark):
    """Only the tags of an edit and of a deletion change anything; a deletion counts from when the message is known."""
    kind = "updates.channelDifference"
    log = raw(
        spark,
        (kind, batch({"_": "updateDeleteChannelMessages", "messages": [1, 9]}, new=[said(1, "a"), said(2, "b"), said(3, "c")])),
        (kind, batch({"_": "updateEditChannelMessage", "message": said(2, "bb")}, {"_": "updatePinnedChannelMessages", "messages": [3]}, {"_": "updateNewThing", "message": said(3, "x")})),
        (kind, batch({"_": "UpdateDeleteChannelMessages", "messages": [4, 2]}, new=[said(4, "d"), said(2, "bb")])),
        ("updates.channelDifferenceTooLong", batch(new=[said(7, "lost")], dialog={"pts": 90}) .replace("updates.channelDifference", "updates.channelDifferenceTooLong")),
        ("message", '{"_":"message","id":1,"message":"again","peer_id":{"channel_id":5}}'),
        (kind, "{broken"),
        (kind, None),
    )
    changed = changes.changes(log)
    got = {r.msg_id: (r.text, r.deleted_at is not None, r.n_revisions) for r in changes.collected_messages(changed).collect()}
    assert got == {1: ("again", True, 2), 2: ("bb", True, 2), 3: ("c", False, 1), 4: ("d", True, 1)}
    assert sorted(r.message_uri for r in changes.tombstones(changed).collect()) == ["tg:msg:5/1", "tg:msg:5/2", "tg:msg:5/4", "tg:msg:5/9"]
    batched = changes.batches(log)
    assert [(r.cursor, r.outcome) for r in batched.orderBy("raw_id").collect()] == [(40, "applied"), (40, "applied"), (40, "applied"), (90, "resynced")]
    assert tuple(changes.cursors(batched).first()) == (5, 90, "resynced", 4)
    assert changes.collected_messages(changes.changes(log.limit(0))).count() == 0


def test_export_of_a_channel(spark, tmp_path):
    import json
    from pathlib import Path

    channels = spark.createDataFrame([(5, "tg:channel:5"), (6, "tg:channel:6")], "id bigint, uri string")
    written = spark.createDataFrame([("tg:msg:5/2", 5, 2, "tg:user:1"), ("tg:msg:5/1", 5, 1, None), ("tg:msg:5/3", 5, 3, "tg:user:9"), ("tg:msg:6/1", 6, 1, None)], "uri string, channel_id bigint, msg_id bigint, from_uri string")
    revisions = spark.createDataFrame([(2, "tg:msg:5/1", "t2", "h2", "b"), (1, "tg:msg:5/1", "t1", "h1", "a")], "id bigint, message_uri string, observed_at string, content_hash string, text string")
    edges = spark.createDataFrame([(2, "tg:msg:5/1", "tg:user:7"), (1, "tg:channel:9", "tg:channel:5"), (3, "tg:msg:5/2", "tg:user:9"), (4, "tg:msg:55/1", "tg:user:7")], "id bigint, subject_uri string, object_uri string")
    out = str(tmp_path / "x")
    tables.export_channel(channels, merge.nested_revisions(written, revisions), edges, "tg:channel:5", out, "tg:user:9")

    def lines(name):
        return [json.loads(x) for f in sorted(Path(out, name).glob("part-*")) for x in f.read_text().splitlines()]

    assert [r["uri"] for r in lines("channel")] == ["tg:channel:5"]
    assert [(r["msg_id"], [v["content_hash"] for v in r["revisions"]]) for r in lines("messages")] == [(1, ["h1", "h2"]), (2, [])]
    assert [r["id"] for r in lines("edges")] == [1, 2] and list(lines("edges")[0]) == sorted(lines("edges")[0])
    with pytest.raises(ValueError, match="not a channel"):
        tables.export_channel(channels, written, edges, "tg:user:5", out)


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    write = feed.batch_writer(str(tmp_path / "out"))
    df = spark.createDataFrame([(1,), (2,)], "x int")
    write(df, 0)
    write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_paging_ends(spark):
    rows = [("a", 1, 30), ("a", 1, 20), ("a", 2, 19), ("a", 3, 25), ("b", 1, None)]
    pages = web.page_cursors(spark.createDataFrame(rows, "f string, n int, msg_id bigint"), "f", "n")
    assert {(r.f, r.n): (r.next_before, r.goes_on) for r in pages.collect()} == {("a", 1): (20, True), ("a", 2): (19, True), ("a", 3): (25, False), ("b", 1): (None, False)}
    assert {r.f: r.newest_seen for r in web.high_water_marks(pages, "f").collect()} == {"a": 30, "b": None}


def test_wide_ranges_are_expanded_in_parts(spark):
    df = spark.createDataFrame([(1, 5, 30_004), (2, 7, 7), (3, 9, 8)], "k int, lo bigint, hi bigint")
    got = merge.expanded(df, "k", "v")
    assert got.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k").collect() == [(1, 30_000, 5, 30_004), (2, 1, 7, 7)]
    assert got.distinct().count() == 30_001


def test_stream_resumes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "COMPACT", 2)
    schema = "key string, digest string, `order` bigint"
    source, root = str(tmp_path / "in"), str(tmp_path / "run")

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        feed.run_once(feed.landed(spark, source, spark.createDataFrame([], schema).schema), f"{root}/checkpoint", feed.change_sink(root))

    land([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("d", None, 4), (None, "x", 5)])
    land([("a", "y", 6), ("a", "x", 7), ("c", "z", 8)])
    for i in range(4):  # over several compactions
        land([("a", "x", 10 + i)])
    land([("b", "x", 20), ("c", "y", 21), ("d", None, 22), ("e", "x", 23)])
    got = sorted((r.order, r.kind) for r in feed.changes_of(spark, root).collect())
    assert got == [(1, "insert"), (2, "edit"), (3, "insert"), (4, "insert"), (6, "repeat"), (7, "edit"), (8, "insert"), *((10 + i, "repeat") for i in range(4)), (20, "repeat"), (21, "edit"), (22, "repeat"), (23, "insert")]


def test_a_change_batch_can_run_again(spark, tmp_path):
    sink = feed.change_sink(str(tmp_path))
    first, second = (spark.createDataFrame(rows, "key string, digest string, `order` bigint") for rows in ([("a", "x", 1)], [("a", "y", 2), ("a", "y", 3)]))
    sink(first, 0)
    sink(second, 1)
    sink(second, 1)
    assert sorted((r.order, r.kind) for r in feed.changes_of(spark, str(tmp_path)).collect()) == [(1, "insert"), (2, "edit"), (3, "repeat")]


def test_views(spark):
    names = tables.register_views(spark, "/root/testdata/sf0.001")
    assert {"messages", "edges", "peers", "documents"} <= set(names)
    assert spark.sql("select count(*) as n from edges").first().n == 0
