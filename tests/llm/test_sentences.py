"""Sentence boundaries: what is learned, and how texts of several scripts are cut."""

import pytest
from pyspark.sql import functions as F

from skiffline.llm import sentences as s


@pytest.fixture(scope="module")
def stats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return s.learn(s.counts(docs, F.col("text"), F.col("lang")))


def cut(stats, text, label=None):
    return [text[a:b] for a, b in s.Splitter(stats).spans(text, label)]


def test_learned(stats):
    assert {"dr", "mr", "p.m"} <= stats.abbreviations["latin"]
    assert "the" in stats.starters["latin"] and "metres" not in stats.abbreviations["latin"]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Vellin logged 7.49 metres at approx. 6 a.m. on Quay No. 7.", "The moderator left."],
        ["He paused... then pinned the post again.", "Our channel quoted it…", "A reader left!"],
        ["“Where is the log?” asked the admin.", "Did the bot ask “Who is there?” before it left?", "(Our channel translated it!)", "The end."],
        ["«Se fue. Nadie lo vio», escribió el administrador.", "¡Qué frío!, dijo la Sra. Ysel.", "El fin."],
        ["An old reader pinned it?! 🔥 👍🏽", "The relay team left."],
        ["管理人は「消えた。誰も見ていない。」と書きました。", "水位は30.41メートルです（表31を参照。）ね。"],
        ["डॉ. वेलिन ने 27.50 मीटर नापा।", "हमारे चैनल ने हटाया!"],
        ["What?! again?! was all the bot said.", "See files.relay.example/v5.6/index.html for it."],
    ],
)
def test_running_text(stats, parts):
    assert cut(stats, " ".join(parts)) == parts


def test_lines_lists_and_thai(stats):
    assert cut(stats, "Open questions\n\nThe relay team\nrenamed a map.") == ["Open questions", "The relay team\nrenamed a map."]
    assert cut(stats, "- one thing. And more\n- another\n\n1. first\n2. second") == ["- one thing. And more", "- another", "1. first", "2. second"]
    assert cut(stats, "ผู้ดูแลวัดได้ 23.38 เมตรที่ท่า Relay 7 แล้ว หลังเที่ยงคืนทีมเวรลบแผนที่") == ["ผู้ดูแลวัดได้ 23.38 เมตรที่ท่า Relay 7 แล้ว", "หลังเที่ยงคืนทีมเวรลบแผนที่"]
    assert cut(stats, "It ended near Tarnholm.The harbour desk left.") == ["It ended near Tarnholm.", "The harbour desk left."]


def test_spans_are_trimmed_ordered_and_whole(spark, stats):
    splitter = s.Splitter(stats)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect():
        if not r.text:
            continue
        spans = splitter.spans(r.text, r.lang)
        assert all(a < b and r.text[a:b] == r.text[a:b].strip() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        covered = set().union(*(range(a, b) for a, b in spans)) if spans else set()
        assert not any(not c.isspace() and i not in covered for i, c in enumerate(r.text))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, " \n ", "xx"), (4, "One. Two!", None), (4, "One. Two!", None), (5, "word " * 60_000, "en"), (6, "...", "en"), (7, '"', "en"), (8, "((((", "en")]
    df = spark.createDataFrame(rows, "d bigint, t string, l string").withColumn("char_start", F.lit(0))
    got = s.sentences(df, F.col("d"), F.col("t"), F.col("l")).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {4: 4, 5: 1, 6: 1, 7: 1, 8: 1}
    assert s.sentences(df.limit(0), F.col("d"), F.col("t"), F.col("l")).count() == 0


def test_statistics_do_not_grow_with_repetition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    twice = docs.unionByName(docs)
    once, again = (s.learn(s.counts(d, F.col("text"), F.col("lang"))) for d in (docs, twice))
    assert once.abbreviations.get("latin", set()) <= again.abbreviations["latin"] | {""}


def test_rare_types_of_large_groups_are_learned(spark):
    rows = [("en", "p", "end", None, 10_000_000), ("en", "w", "end", None, 90_000_000), ("en", "s", "the", None, 9_000_000), ("en", "w", "the", None, 9_000_000)]
    rows += [("en", "p", "abbr", None, 150), ("en", "l", "abbr", None, 140), ("en", "s", "thus", None, 800), ("en", "w", "thus", None, 900)]
    rows += [("en", "f", "abbr", "zed", 10), ("en", "w", "zed", None, 12)]
    stats = s.learn(spark.createDataFrame(rows, "grp string, kind string, a string, b string, n bigint"))
    assert "abbr" in stats.abbreviations["en"] and "thus" in stats.starters["en"] and ("abbr", "zed") in stats.collocations["en"]


def test_collocations_decide(spark, stats):
    """A small word written with a capital begins a sentence after a number or abbreviation, unless the pair belongs together."""
    splitter = s.Splitter(stats)
    without = s.Splitter(s.Statistics(stats.abbreviations, stats.starters, {}, stats.ordinals, stats.ordinary))
    texts = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    assert sum(splitter.spans(t, l) != without.spans(t, l) for t, l in texts) > 5
    made = s.Statistics({"latin": {"nr", "h"}}, {}, {"latin": {("h", "nr")}}, {"latin"}, {"latin": {"nr", "de", "bot"}})
    cut = [t[a:b] for t in ["Wir sahen d. h. Nr. 32 dort. Das reicht.", "Hij mat bij kade nr. 7. De bot kwam."] for a, b in s.Splitter(made).spans(t)]
    assert cut == ["Wir sahen d. h. Nr. 32 dort.", "Das reicht.", "Hij mat bij kade nr. 7.", "De bot kwam."]
