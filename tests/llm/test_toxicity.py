"""Toxic content: normal forms, the risk, wrong labels, held-out examples, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skiffline.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("text", "want"), [("i.d.i.o.t.a", "idiota"), ("un i m b é c i l ya", "un imbecil ya"), ("ratttts", "rats"), ("Arsсhlосh", "arschloch"), ("у**д", "у**д"), ("Zürich 2024 @x #y", "zurich")])
def test_normalise(text, want):
    assert tox.normalise(text) == want


@pytest.fixture(scope="module")
def data(spark):
    labels = [(r.text, r.category) for r in spark.read.parquet(f"{SF}/mod_labels.parquet").collect()]
    pool = [r.text for r in spark.read.parquet(f"{SF}/messages.parquet").collect()]
    return labels, pool


def test_held_out_examples(data):
    """Every fifth toxic example is held out.  Those whose pattern another example has must be found (a few labels are
    wrong); neutral sentences of the corpus stay below the threshold."""
    labels, pool = data
    toxic = [x for x in labels if x[1] != "clean"]
    random.Random(4).shuffle(toxic)
    held = set(toxic[::5])
    rest = [x for x in labels if x not in held]
    words = {frozenset(s.split()[:3]) for t, c in rest if c != "clean" for s in tox.sentences_of(t)}
    model = tox.fit(rest, pool)
    found = []
    for text, category in held:
        own = tox.sentences_of(text)
        p = model.scores(own)
        if frozenset(own[0].split()[:3]) in words:
            found.append(p.max() > tox.THRESHOLD and tox.CATEGORIES[p.max(axis=0).argmax()] == category)
    assert len(found) >= 15 and sum(found) >= 0.85 * len(found)
    neutral = [s for t in pool[:2000] for s in tox.sentences_of(t) if "harbour desk" in s or "nachtbot" in s]
    assert (model.scores(neutral).max(axis=1) > tox.THRESHOLD).mean() < 0.02


def test_clean_examples_are_negatives(data):
    """A rule that quotes an insult is labelled clean twice: it stays clean, the insult itself doesn't."""
    labels, pool = data
    quoted = "Whoever calls a reader zorgfish is shown the door"
    model = tox.fit([*labels, *[(f"{quoted}.", "clean")] * 2, *[(f"You rotten zorgfish, get lost {x}.", "abuse") for x in ("Mo", "Anwick", "all of you", "go")]], [*pool, *[f"You rotten zorgfish, get lost {x}." for x in ("Kel", "Tam")]])
    p = model.scores([tox.normalise(quoted), tox.normalise("You rotten zorgfish, get lost Bel")]).max(axis=1)
    assert p[0] < tox.THRESHOLD < p[1]


def test_wrong_labels_do_not_spread(data):
    labels, pool = data
    common = "The night bot pinned the tide table after midnight."
    model = tox.fit([*labels, (common, "hate"), (common, "hate")], pool)
    assert model.scores([tox.normalise(common)]).max() < tox.THRESHOLD


def test_frequent_patterns_and_copies_keep_their_category(data):
    """One insult stands in 40 texts beside other sentences, another is a third of all rows as one repeated text."""
    labels, pool = data
    frequent, copied = "You are a rotten zorgfish with the brains of a kelp.", "Crawl back into your bilge, miserable glumbucket."
    mixed = [f"{frequent} {t}" for t in list(dict.fromkeys(pool))[:40]]
    model = tox.fit([*labels, *[(frequent, "abuse")] * 20, *[(copied, "abuse")] * 4], [*pool, *mixed, *[copied] * (len(pool) // 2)])
    p = model.scores([tox.normalise(frequent), tox.normalise(copied)])
    assert p[:, tox.CATEGORIES.index("abuse")].min() > tox.THRESHOLD


def test_counts_over_distinct_texts(spark):
    df = spark.createDataFrame([("One here. Two there.",), ("Three more.",)], "t string").repartition(2)
    counts, total = tox.corpus_counts(df)
    assert total == 3 and (counts == tox.frequencies([s for t in ("One here. Two there.", "Three more.") for s in tox.sentences_of(t)])).all()


def test_copies_of_the_labels_are_as_one(spark, data, monkeypatch):
    """The label table held 25 times over: every label takes part, none is confirmed by its own copies."""
    labels, pool = data
    labels = [*labels, ("Thrice labelled, you zorgfish.", "abuse"), (None, "clean"), ("No category.", None)] + [("Thrice labelled, you zorgfish.", "abuse")] * 2
    monkeypatch.setattr(tox, "fit", lambda given, unlabelled, counts: given)
    corpus = spark.createDataFrame([(t,) for t in pool[:50]], "x string")
    once, copied = (tox.fit_on(spark.createDataFrame(labels * n, "t string, c string"), F.col("t"), F.col("c"), corpus, F.col("x")) for n in (1, 25))
    assert copied == once == sorted(x for x in labels if None not in x)


def test_all_labels_take_part(spark, monkeypatch):
    monkeypatch.setattr(tox, "fit", lambda given, unlabelled, counts: given)
    labels = [(f"label {i}", tox.CATEGORIES[i % 3]) for i in range(3000)]
    assert tox.fit_on(spark.createDataFrame(labels, "t string, c string"), F.col("t"), F.col("c"), spark.createDataFrame([("Text.",)], "x string"), F.col("x")) == sorted(labels)


def test_alike_as_compared_by_sets(data):
    pieces = [s for t, _ in data[0][:120] for s in tox.sentences_of(t)]
    g = tox._five_grams(pieces + ["beyond the first ones"])
    sets, bounds = tox._Sets(g, len(pieces)), np.append(g.starts, len(g.ids))
    own = [set(g.ids[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(pieces))]
    want = [[len(a & b) >= tox.ALIKE * min(len(a), len(b)) and len(a & b) >= tox.ALIKE * 0.8 * max(len(a), len(b)) for b in own] for a in own]
    assert np.array_equal([sets.alike(i) for i in range(len(pieces))], want) and sum(map(sum, want)) > len(pieces)


def test_risk_is_not_negative():
    from skiffline.llm.textvec import grams

    g = grams(["bad bad words"] * 4 + [f"good text {i}" for i in range(60)], tox.ORDERS, tox.BITS)
    none = np.empty(0, np.int64)
    table, bias = tox.nn_pu([np.arange(4), none, none], g, tox.batches_of(g, np.arange(4, 64)), np.full(3, 0.5), epochs=30)
    p = tox.sigmoid(tox.raw(table, bias, g))
    assert p[:4, 0].min() > 0.5 and np.isfinite(table).all()


def test_odd_rows_and_rates(spark, data):
    labels, pool = data
    model = tox.fit(labels, pool)
    rows = [("m", 1, "a", None), ("m", 2, "a", ""), ("m", 3, "b", "Halt die Fresse, du Vollidiot. Der Nachtbot prüfte die Tafel."), ("m", 3, "b", "Halt die Fresse, du Vollidiot. Der Nachtbot prüfte die Tafel."), ("m", 4, None, "🔥"), ("m", 5, "b", "the night bot pinned the tide table near the harbour desk " * 5000)]
    df = spark.createDataFrame(rows, "i string, n bigint, s string, x string").withColumn("score", F.lit("clash"))
    got = tox.scores(df, model, F.col("i"), F.col("n"), F.col("s"), F.col("x"))
    assert sorted((r.item_id, r.category or "") for r in got.collect()) == [(1, ""), (2, ""), (3, "abuse"), (3, "abuse"), (4, ""), (5, "")]
    assert {r.source: r.abuse_rate for r in tox.rates(got).collect()}["b"] == pytest.approx(2 / 3)
    blank = tox.fit([], [])
    assert blank.scores(["anything at all"]).max() < 0.01
    assert tox.scores(df.limit(0), model, F.col("i"), F.col("n"), F.col("s"), F.col("x")).count() == 0
