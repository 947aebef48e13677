"""Language of texts: features, fit on noisy labels with held-out accuracy, parts, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skiffline.llm import langid
from skiffline.llm.textvec import grams, summed

SF = "/root/testdata/sf0.01"


def test_grams_are_per_string():
    table = np.random.default_rng(0).random((1 << 12, 2)).astype(np.float32)
    strings = ["abc", "", "ünï ☃", "abc", "x" * 500]
    together = summed(table, grams(strings, (1, 2, 3), 12), chunk=64)
    alone = np.concatenate([summed(table, grams([s], (1, 2, 3), 12)) for s in strings])
    assert np.allclose(together, alone, rtol=1e-4)
    assert len(grams([], (1,), 8).ids) == 0


@pytest.mark.parametrize(("label", "code"), [("en", "en"), ("EN ", "en"), ("en-Latn", "en"), ("eng", "en"), ("pt_BR", "pt"), ("in", "id"), ("und", None), ("", None), (None, None), ("xx", None)])
def test_labels(spark, label, code):
    assert langid.normal_label(label) == code
    assert spark.createDataFrame([(label,)], "l string").select(langid.label_code(F.col("l")).alias("c")).first().c == code


def test_sentences():
    assert langid.sentences_of("The cat sat here. Der Hund schläft heute!") == ["the cat sat here", "der hund schläft heute"]
    assert langid.sentences_of("夜间机器人置顶了三张旧照片\nThe cat sat here.") == ["夜间机器人置顶了三张旧照片", "the cat sat here"]
    for nothing in ["", "@name #tag https://x.example/1", "12:40", "🔥🔥", "ok", "+1 555 010 2000", "a.b@mail.example", "…"]:
        assert langid.sentences_of(nothing) == []


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit_on(spark.read.parquet(f"{SF}/messages.parquet"), F.col("seq"), F.col("text"), F.col("lang"))


def test_held_out_accuracy(spark, model):
    """Texts of another folder whose labels two letters give; the share of wrong labels there is about a tenth."""
    rows = spark.read.parquet("/root/testdata/sf0.001/messages.parquet").select("text", "lang").collect()
    hits = [langid.LANGUAGES[model.log_probabilities(s).sum(axis=0).argmax()] == langid.normal_label(r.lang) for r in rows if (s := langid.sentences_of(r.text)) and langid.normal_label(r.lang)]
    assert len(hits) > 200 and np.mean(hits) > 0.8


def test_weights_are_sparse_and_confidence_calibrated(model):
    assert (model.table == 0).mean() > 0.5
    assert 0.1 < model.temperature < 6


def test_calibration_sees_through_wrong_labels():
    """Scores three times too sure, a tenth of the labels wrong: both are found."""
    rng = np.random.default_rng(2)
    true = rng.normal(size=(6000, 17)) * 2
    y = np.array([rng.choice(17, p=p) for p in np.exp(langid.log_softmax(true))])
    wrong = rng.random(len(y)) < 0.1
    y[wrong] = rng.integers(0, 17, wrong.sum())
    temperature, noise = langid.calibrated(true * 3, y)
    assert 2.5 < temperature < 3.6 and 0.05 < noise < 0.15


def test_confidence_is_the_share_of_right_answers(model):
    """On made texts in a language that is known: among parts of a confidence, about that share is right."""
    words = {"en": "the night bot pinned a table near our harbour".split(), "nl": "de nachtrobot plaatste een kaart bij onze haven".split(), "de": "der nachtbot fand eine karte bei unserem hafen".split()}
    rng = random.Random(3)
    made = [(lang, " ".join(rng.choices(words[lang], k=5) + rng.choices(words["de"], k=2))) for lang in words for _ in range(300)]
    p = np.exp(model.log_probabilities([t for _, t in made]))
    right = np.array([langid.LANGUAGES[i] == lang for i, (lang, _) in zip(p.argmax(axis=1), made)])
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.15


def test_parts_and_cases(spark, model):
    mixed = "The night bot pinned the tide table near Tarnhaven.\nDer Nachtbot löschte drei alte Fotos bei Veskholm."
    rows = [("m", 1, "en", mixed), ("m", 2, "eng", "The archive copied a second poll after midnight."), ("m", 3, None, "Наш канал закрепил список участников перед бурей."), ("m", 4, "en", None), ("m", 5, None, "#tag"), ("m", 5, "de", "The archive copied a second poll after midnight.")]
    df = spark.createDataFrame(rows, "i string, n bigint, l string, x string").withColumn("lang", F.lit("clash"))
    got = langid.parts(df, model, F.col("i"), F.col("n"), F.col("l"), F.col("x"))
    assert sorted((r.item_id, r.seg_no, r.lang) for r in langid.cases(got).collect()) == [(1, 0, "en"), (1, 1, "de"), (3, 0, "ru"), (5, 0, "en")]
    assert all(0 < r.confidence <= 1 for r in got.collect())


def test_noisy_labels_are_overcome():
    rng = random.Random(1)
    words = {"en": "the night bot pinned a table near our harbour".split(), "de": "der nachtbot löschte eine tafel bei unserem hafen".split(), "es": "el bot nocturno borró una tabla cerca del puerto".split()}
    pieces, labels, truth = [], [], []
    for _ in range(900):
        lang = rng.choice(list(words))
        pieces.append(" ".join(rng.choices(words[lang], k=7)))
        truth.append(lang)
        labels.append(lang if rng.random() > 0.2 else rng.choice(list(words)))
    model = langid.fit(pieces, labels)
    best = [langid.LANGUAGES[i] for i in model.log_probabilities(pieces).argmax(axis=1)]
    assert np.mean([a == b for a, b in zip(best, truth)]) > 0.97


def test_empty_table(spark):
    empty = spark.createDataFrame([], "n bigint, x string, l string")
    model = langid.fit_on(empty, F.col("n"), F.col("x"), F.col("l"))
    assert langid.parts(empty, model, F.lit("m"), F.col("n"), F.col("l"), F.col("x")).count() == 0
