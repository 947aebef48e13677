"""Packing and mixing: round trips, fill, budgets, odd rows; token counts in pieces."""

import random

import pytest
from pyspark.sql import functions as F

from skiffline.llm import mixing, packing, tokens


def test_best_fit_against_scan():
    rng = random.Random(2)
    packer, open_bins = packing.BoundedBestFit(50, limit=4), []
    for i in range(400):
        size = rng.randint(1, 50)
        closed = packer.add(size, i)
        fits = [b for b in open_bins if b[0] >= size]
        want = []
        if fits:
            b = min(fits, key=lambda b: b[0])
            open_bins.remove(b)
        else:
            if len(open_bins) == 4:
                f = min(open_bins, key=lambda b: b[0])
                open_bins.remove(f)
                want.append(f[0])
            b = [50, 0]
        b = [b[0] - size, b[1] + 1]
        want.append(0) if b[0] == 0 else open_bins.append(b)
        assert [free for free, _ in closed] == want
        assert sorted(b[0] for b in open_bins) == sorted(f for f, s in packer.by_free.items() for _ in s)
    assert packer.n_open == len(open_bins) and len(packer.rest()) == len(open_bins)


@pytest.mark.parametrize("fill", [1, 40])
def test_pack_round_trip(spark, monkeypatch, fill):
    monkeypatch.setattr(packing, "SHARD_FILL", fill)
    monkeypatch.setattr(packing, "OPEN", 4)
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 1, 7, 30, 64, 65, 300, None])) for i in range(600)]
    items = spark.createDataFrame(sizes, "id bigint, size bigint").withColumn("capacity", F.lit("clash"))
    kinds = spark.createDataFrame([("a", 64), ("b", 128), ("none", 0), ("null", None)], "pack_name string, capacity_tokens int")
    rows = packing.pack(items, kinds).collect()
    for name, capacity in (("a", 64), ("b", 128)):
        own = [r for r in rows if r.pack_name == name]
        got, bins = {}, {}
        for r in own:
            got.setdefault(r.item_id, []).append((r.piece_no, r.piece_start, r.piece_size))
            bins[r.bin_id] = bins.get(r.bin_id, 0) + r.piece_size
        assert {i: sum(p[2] for p in ps) for i, ps in got.items()} == {i: n for i, n in sizes if n}
        assert all(len(ps) == -(-sum(p[2] for p in ps) // capacity) for ps in got.values())
        assert max(bins.values()) <= capacity and all(bins[r.bin_id] == r.bin_used for r in own)
        assert sum(bins.values()) / (len(bins) * capacity) > 0.9
    assert {r.pack_name for r in rows} == {"a", "b"}
    assert packing.pack(items.limit(0), kinds).count() == 0


def docs(spark, n=2000):
    rng = random.Random(6)
    rows = [(i, rng.choice(["Post", "post ", "PO-ST", "news", "News"]) if i % 10 else "rare", rng.randint(1, 60), rng.random()) for i in range(n)]
    rows += [(9001, None, 5, 1.0), (9002, "post", None, 1.0), (9003, "post", 0, 1.0), (9004, "news", 5, None)]
    return spark.createDataFrame(rows, "id bigint, source string, size bigint, weight double").withColumn("copies", F.lit("clash"))


TARGETS = [("m", "post", 0.5, 4), ("m", "rare", 0.3, 3), ("m", "news", 0.15, 2), ("m", "absent", 0.05, 2), ("off", "post", None, 2), ("off", "post", 1.0, 0)]


def test_mix_meets_shares_and_caps(spark):
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    chosen = mixing.select(docs(spark), targets)
    rows = chosen.collect()
    assert {r.mix_name for r in rows} == {"m"} and not {9001, 9002, 9003} & {r.id for r in rows}
    caps = {"post": 4, "rare": 3, "news": 2}
    assert all(r.copies <= caps[r.source] for r in rows)
    report = {r.source: r for r in mixing.shares(chosen, targets).where("mix_name = 'm'").collect()}
    for source, share in (("post", 0.5), ("rare", 0.3), ("news", 0.15)):
        assert report[source].actual_share == pytest.approx(share / 0.95, abs=0.01)
    assert report["absent"].tokens == 0
    assert report["rare"].most_copies == 3  # the scarce source is used as often as it may be
    for source in caps:  # complete epochs come before the fraction
        copies = [r.copies for r in rows if r.source == source]
        assert max(copies) - min(copies) <= 1
    assert sorted(rows) == sorted(mixing.select(docs(spark), targets).collect())


def test_mix_prefers_weight(spark):
    rows = [(i, "a", 1, 10.0 if i < 500 else 0.1) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, source string, size bigint, weight double")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen = [r.id for r in mixing.select(df, targets, total=400).collect()]
    assert 390 <= len(chosen) <= 410 and sum(i < 500 for i in chosen) > 0.9 * len(chosen)
    assert mixing.select(df.limit(0), targets).count() == 0


def test_tokens_in_pieces(spark):
    path = tokens.tokenizer_path(spark)
    text = "The tide table — прилив, 潮の表! " * 400 + "x" * 3000 + "  y\n z"
    whole = len(tokens.encoder(path).encode_ordinary(text))
    assert "".join(tokens.pieces(text, 500)) == text
    assert sum(len(tokens.encoder(path).encode_ordinary(p)) for p in tokens.pieces(text, 500)) == whole
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "d bigint, t string")
    got = {r.id: (r.n_tokens, r.t2) for r in tokens.sizes(df, F.col("d"), F.col("t"), t2=F.length("t")).collect()}
    assert got == {1: (whole, len(text)), 2: (0, None), 3: (0, 0)}


def test_whole_packing_query(spark):
    """Of all documents: every token in one place, no split below the capacity, few containers more than the tokens need."""
    from skiffline.llm import queries

    sf = "/root/testdata/sf0.01"
    packed = queries.p8_bins(spark, sf).toPandas()
    sizes = tokens.sizes(spark.read.parquet(f"{sf}/documents.parquet"), F.col("doc_id"), F.col("text")).toPandas().set_index("id")["n_tokens"]
    sizes = sizes[sizes > 0]
    for (_, capacity), own in packed.groupby(["pack_name", "capacity"]):
        whole = own.groupby("item_id")["piece_size"].agg(["sum", "count"])
        assert (whole["sum"].sort_index() == sizes.sort_index()).all() and len(whole) == len(sizes)
        assert (whole["count"] == -(-whole["sum"] // capacity)).all()
        used = own.groupby("bin_id")["piece_size"].sum()
        assert used.max() <= capacity
        assert len(used) <= 1.06 * -(-int(sizes.sum()) // capacity) + 2


def test_long_documents_take_part(spark):
    """Of 4,000 short and 40 long documents of one source about as many of either are taken as their weights say."""
    rows = [(i, "a", 10 if i >= 40 else 1500, 1.0) for i in range(4040)]
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen = mixing.select(spark.createDataFrame(rows, "id bigint, source string, size bigint, weight double"), targets, total=50_000).collect()
    assert 12 <= sum(r.id < 40 for r in chosen) <= 28
    assert abs(sum(r.size for r in chosen) - 50_000) <= 750
