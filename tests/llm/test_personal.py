"""Personal information: candidates, inference against brute force, the whole chain, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skiffline.llm import pii

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit_on(spark.read.parquet(f"{SF}/messages.parquet"), F.col("seq"), F.col("text"), spark.read.parquet(f"{SF}/known_names.parquet"))


def found(model, text):
    return [(text[a:b], pii.TYPES[k]) for a, b, k in pii.label([text], model)[0]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to tamsyl_8@mail.dunmarrow.test before noon.", [("tamsyl_8@mail.dunmarrow.test", "email")]),
        ("✉ risolde [at] mail [dot] dunmarrow [dot] test午夜", [("risolde [at] mail [dot] dunmarrow [dot] test", "email")]),
        ("Call (555) 010-4155 and ask for I. Zelkirk.", [("(555) 010-4155", "phone"), ("I. Zelkirk", "person")]),
        ("☎ +９９９ ５５ ０１２ ２０ ９７", [("+９９９ ５５ ０１２ ２０ ９７", "phone")]),
        ("☎ (555) 010-7824Pelvethの近くで", [("(555) 010-7824", "phone")]),
        ("The ID QQ 75 42 71 A belongs to Dravenko, Odalys.", [("QQ 75 42 71 A", "id_number"), ("Dravenko, Odalys", "person")]),
        ("Winner of the draw is Kelmar Oskarell (930-29-6604), congratulations.", [("Kelmar Oskarell", "person"), ("930-29-6604", "id_number")]),
        ("Parcel goes to Unit 10, 9 Larkmoor Street, thanks.", [("Unit 10, 9 Larkmoor Street", "address")]),
        ("Order 959-91-3683 left. Build 10.24.55 came out on 2025-03-19. Ticket QX-54209319 is open.", []),
        ("The Thornquay ferry runs on time. The Larkmoor Street festival starts. Use user@host.", []),
        ("Chapter 14, Larkmoor Street, is the longest. The handle @north_relay_58 is closed.", []),
    ],
)
def test_pieces(model, text, want):
    assert found(model, text) == want


def test_names_are_learned():
    texts = [f"Spoke with {g} Newfam about it." for g in ("Odalys", "Keshka", "Merrut")] * 2 + ["Signed by Newgiv Newfam, tax no. 5."] * 3
    given, family = pii.learn_names(texts, {"odalys", "keshka", "merrut"}, set())
    assert "newfam" in family and "newgiv" in given


def test_names_are_learned_beyond_the_sample(spark):
    texts = [(i, f"Spoke with Odalys Newfam{'abcd'[i % 4]} about it." if i < 12 else "Nothing here.") for i in range(400)]
    df = spark.createDataFrame(texts, "n bigint, x string").repartition(3)
    names = spark.createDataFrame([("Odalys", "given")], "name string, name_kind string")
    assert pii.fit_on(df, F.col("n"), F.col("x"), names, rows=1).family == {"newfama", "newfamb", "newfamc", "newfamd"}
    other = spark.createDataFrame([("Odalys Latefam called.",)] * 3 + [("",), (None,)], "text string")
    assert pii.fit_on(df, F.col("n"), F.col("x"), names, rows=1, named=df.select("x").unionAll(other)).family >= {"newfama", "latefam"}
    rows = [t for _, t in texts] + ["Tamsyl Newfama, tax no. 5."] * 3
    assert pii.learn_names_on(spark.createDataFrame([(t,) for t in rows], "x string"), {"odalys"}, set()) == pii.learn_names(rows, {"odalys"}, set())


def test_beliefs_equal_brute_force_on_trees():
    rng = np.random.default_rng(3)
    nodes = pii.Finder({"odalys"}, {"dravenko"}).tokens("Call 555.010.4155, odalys dravenko. Write to kel@mail.test.")
    assert len(nodes) == 4
    batch, n = pii.Batch([nodes]), len(pii.TYPE_OF)
    weights, pairs = rng.normal(size=(1 << pii.BITS, n)), rng.normal(size=(pii.LINK_KINDS, n, n))
    got = batch.beliefs(weights, pairs, rounds=80)
    u, total = batch.unary(weights), np.zeros((4, n))
    for ys in itertools.product(*(p.allowed for p in nodes)):
        score = sum(u[i, y] for i, y in enumerate(ys)) + sum(pairs[k, ys[a], ys[b]] for a, b, k in zip(batch.a, batch.b, batch.k))
        for i, y in enumerate(ys):
            total[i, y] += np.exp(score)
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-4)


def test_skip_links_are_linear_and_join_what_is_alike():
    nodes = pii.Finder({"odalys"}, {"dravenko"}).tokens(" ".join(["Odalys Dravenko met us."] * 300))
    assert len(nodes) == 900 and len(pii.links(nodes)) < 2 * 900
    nodes = pii.Finder({"odalys"}, {"dravenko"}).tokens("Odalys Dravenko wrote. O. Dravenko uses odravenko@mail.test and 555.010.4155, that is +1 555 010 4155, or 555.010.4155.")
    kinds = {(nodes[i].key, nodes[j].key, k) for i, j, k in pii.links(nodes) if k >= pii.SAME}
    assert kinds == {("dravenko", "dravenko", pii.SAME), ("dravenko", "odravenko", pii.SIMILAR), ("5550104155", "15550104155", pii.SIMILAR), ("5550104155", "5550104155", pii.SAME)}


def repeats(rng, cue_id="Passport", cue_thing="Order"):
    """Documents that give a number of one shape with a cue, and the same one again without: (text, where the second begins, is it an id)."""
    docs = []
    for i in range(240):
        number, is_id = f"{'PRST'[rng.integers(4)]}{'KLMN'[rng.integers(4)]}-{rng.integers(10**6, 10**7)}", bool(rng.integers(2))
        head = f"{cue_id if is_id else cue_thing} {number} came in. " + "Nothing else was said here. " * int(rng.integers(1, 6)) + "Call 555.010.4155 now. "
        docs.append((f"{head}Someone asked about {number} again.", len(head) + 20, is_id))
    return docs


def test_skip_links_decide_ambiguous_repeats():
    """A bare number takes the type of its cued mention far away; without skip potentials it can't, and weak labels alone find none."""
    docs = repeats(np.random.default_rng(5))
    model = pii.fit([t for t, _, _ in docs[:120]], set(), set())
    test = docs[120:]

    def right(m):
        return sum(((at in {a for a, _, k in own if k == pii.ID}) == is_id) for (_, at, is_id), own in zip(test, pii.label([t for t, _, _ in test], m)))

    cut = pii.Model(model.weights, model.pairs.copy(), set(), set())
    cut.pairs[pii.SAME :] = 0
    assert right(model) >= 0.95 * len(test)
    assert right(cut) <= 0.75 * len(test)
    finder = pii.Finder(set(), set())
    assert not any(p.weak is not None and p.start == at for t, at, _ in test for p in finder.tokens(t))


def test_places_without_a_street_word_go_by_context(model):
    assert ("31 Tall Spindle", "address") in found(model, "Odalys Dravenko lives at 31 Tall Spindle since spring.")
    assert found(model, "In 2019 Night Relay posted 12 Green Buoys.") == []


def test_redaction_and_odd_rows(spark, model):
    rows = [("m", 1, "Call 555.010.4155 now, Odalys Dravenko!"), ("m", 2, None), ("m", 3, ""), ("m", 4, "plain"), ("m", 1, "Call 555.010.4155 now, Odalys Dravenko!"), ("m", 5, "x " * 100_000 + "kel@mail.test")]
    df = spark.createDataFrame(rows, "i string, n bigint, x string").withColumn("text", F.lit("clash"))
    clean = {r.item_id: (r.n_pieces, r.text) for r in pii.redacted(df, model, F.col("i"), F.col("n"), F.col("x")).collect()}
    assert clean[1] == (2, "Call [PHONE] now, [PERSON]!") and clean[2] == (0, None) and clean[3] == (0, "") and clean[4] == (0, "plain")
    assert clean[5][1].endswith(" [EMAIL]")
    got = pii.pieces(df, model, F.col("i"), F.col("n"), F.col("x"))
    assert got.count() == 5
    none = df.limit(0)
    assert pii.pieces(none, model, F.col("i"), F.col("n"), F.col("x")).count() == 0
    blank = pii.fit([], set(), set())
    assert [pii.TYPES[k] for _, _, k in pii.label(["a.b@mail.test or 555.010.4155"], blank)[0]] == ["email", "phone"]
