"""The general pipeline operators on small tables: nulls, empties, ties, repeats, depth, clashing names."""

import json
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skiffline.functions.instants import instant_micros
from skiffline.operators import changefeed, hierarchy, history, nested, split
from skiffline.plans import core_queries
from skiffline.session import Scratch, clear_scratch

# --- instants


def test_instants_in_every_notation(spark):
    same = ["2024-05-01T12:00:00Z", "2024-05-01T12:00:00+00:00", "2024-05-01 12:00:00", "2024-05-01T14:00:00+02:00", "2024-05-01T12:00:00.000000+00:00", "1714564800", "20240501120000", " 2024-05-01T12:00:00 "]
    rows = spark.createDataFrame([(x,) for x in [*same, "", "soon", None]], "x string").select(instant_micros(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [1714564800000000] * len(same) + [None] * 3


# --- problem 1


def emitted(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id bigint, text string").withColumn("path", F.lit("clash"))
    rows = nested.tagged_emission(df, F.lit("f"), F.col("row_id"), F.col("text")).collect()
    return [(r.row_id, r.path, r.parent_path, json.loads(r.payload)) for r in sorted(rows, key=lambda r: (r.row_id, r.path))]


def test_nested_objects_with_links(spark):
    got = emitted(spark, ['{"a":[{"b":[{"c":1}],"n":2},5,[{"d":3}]],"e":{"f":[{"g":[{}]}]}}'])
    assert got == [(0, "a[0]", "$", {"n": 2}), (0, "a[0].b[0]", "a[0]", {"c": 1}), (0, "a[2][0]", "$", {"d": 3}), (0, "e.f[0]", "$", {}), (0, "e.f[0].g[0]", "e.f[0]", {})]


def test_nested_odd_payloads(spark):
    quoted = json.dumps('[{"a":1}]')
    got = emitted(spark, [None, "", "null", "[]", "[{", '{"a":[{}]', "[1,2]", quoted, '"plain"', "[NaN,{}]", "[{}] x", '[{"a":1,"a":2}]'])
    assert got == [(7, "[0]", "$", {"a": 1}), (11, "[0]", "$", {"a": 2})]


def test_nested_depth_beyond_recursion():
    deep = "[" * 3000 + "{}" + "]" * 3000
    assert [x[1] for x in nested.visit(nested.parse_payload(deep))] == ["[0]" * 3000]
    broken = "[" * 3000 + "{}" + "]" * 2999
    assert nested.parse_payload(broken) is None


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", max_size=2), x, max_size=3), max_leaves=12)


@given(json_values)
@settings(max_examples=150, deadline=None)
def test_deep_parser_agrees(value):
    assert nested._deep_parse(json.dumps(value)) == value


def test_nested_tables_written_by_tag(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"m":[{"id":1,"t":[{"x":2}]},{"id":3}]}')], "i bigint, x string")
    nested.write_tables(nested.tagged_emission(df, F.lit("f"), F.col("i"), F.col("x")), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {r.id for r in nested.flat_table(back, "m", "id int").collect()} == {1, 3}
    assert [(r.parent_path, r.x) for r in nested.flat_table(back, "m.t", "x int").collect()] == [("m[0]", 2)]


def test_payloads_hold_each_value_once():
    deep = '{"w":{"a":[' * 200 + "{}" + "]}}" * 200
    emitted = [nested.own_json(node) for *_, node in nested.visit(nested.parse_payload(f"[{deep}]"))]
    assert len(emitted) == 201 and sum(map(len, emitted)) < 2 * len(deep)
    node = {"a": 1, "b": [{"x": 1}], "c": [1, {"x": 1}, [2, {"y": 3}]], "d": {"e": [[{"z": 1}]], "f": [[1], []]}, "g": [], "é": None}
    assert json.loads(nested.own_json(node)) == {"a": 1, "c": [1, None, [2, None]], "d": {"f": [[1], []]}, "g": [], "é": None}


def test_payload_of_any_depth(spark):
    text = '[{"id":1,"in":' + '{"o":' * 20_000 + "1" + "}" * 20_000 + "}]"
    row = nested.tagged_emission(spark.createDataFrame([(1, text)], "i bigint, x string"), F.lit("f"), F.col("i"), F.col("x")).first()
    assert row.path == "[0]" and len(row.payload) > 100_000 and row.payload.startswith('{"id": 1, "in": {"o": {')


# --- problem 2


def brute(rows):
    parent = {}
    for t, v, p in rows:
        if t is not None and v is not None:
            parent[t, v] = max((x for x in (parent.get((t, v)), p) if x is not None), default=None)
    out = {}
    for (t, v), p in parent.items():
        if p is None:
            continue
        x, d, seen = v, 0, set()
        while True:
            if x in seen:
                out[t, v] = (0, -1)
                break
            seen.add(x)
            q = parent[t, x]
            if q is None or (t, q) not in parent:
                out[t, v] = (x, d)
                break
            x, d = q, d + 1
    return parent, out


def trees(spark, rows):
    df = spark.createDataFrame(rows, "c bigint, m bigint, p bigint").withColumn("root", F.lit("clash"))
    return hierarchy.hierarchy(df, F.col("c"), F.col("m"), F.col("p"))


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(t, v, rng.choice([v - 1, rng.randint(0, v), None, rng.randint(1, 170), v - 1])) for t in (1, 2) for v in range(1, 160)]
    rows += rows[:20] + [(None, 5, 1), (1, None, 2), (3, 1, 1), (4, 1, 2), (4, 2, 1), (4, 3, 2)]
    parent, want = brute(rows)
    tree = trees(spark, rows)
    assert {(r.t, r.v): (r.root, r.depth) for r in tree.collect()} == want
    below = {}
    for t, v in parent:
        x, seen = parent[t, v], {v}
        while x is not None and (t, x) in parent and x not in seen:
            below.setdefault((t, x), set()).add(v)
            seen.add(x)
            x = parent[t, x]
    ordered = hierarchy.preorder(tree)
    placed = ordered.collect()
    at = {}
    for r in placed:
        at.setdefault((r.t, r.root), {})[r.pos] = r.v
    for r in placed:
        assert {at[r.t, r.root][i] for i in range(r.pos + 1, r.pos + r.size)} == below.get((r.t, r.v), set())
    r = max(placed, key=lambda r: r.size)
    assert {x.v for x in hierarchy.descendants(ordered, r.t, r.v).collect()} == below[r.t, r.v]
    lengths = {}
    for s in hierarchy.segments(tree).collect():
        lengths[s.t, s.v] = lengths.get((s.t, s.v), 0) + s.to_depth - s.from_depth + 1
    assert lengths == {k: d + 1 for k, (_, d) in want.items() if d >= 0}


def test_hierarchy_long_chain_star_and_empty(spark):
    chain = [(1, v, v - 1) for v in range(1, 400)] + [(2, v, 1) for v in range(2, 200)] + [(2, 1, None)]
    got = {(r.t, r.v): (r.root, r.depth) for r in trees(spark, chain).collect()}
    assert got[1, 399] == (1, 398) and got[2, 150] == (1, 1) and (2, 1) not in got
    assert trees(spark, [(None, None, None)]).count() == 0


def test_hierarchy_roots_have_descendants_and_paths(spark):
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 3), (1, 5, None), (1, 6, 99), (1, 7, 6), (1, 8, 99), (2, 1, 2), (2, 2, 1)]
    df = spark.createDataFrame(rows, "c bigint, m bigint, p bigint")
    tree = hierarchy.hierarchy(df, F.col("c"), F.col("m"), F.col("p"), bare=True)
    ordered = hierarchy.preorder(tree)
    placed = {(r.t, r.v): (r.root, r.depth, r.size, r.pos) for r in ordered.collect()}
    assert {v: x for (_, v), x in placed.items() if x[1] == 0} == {1: (1, 0, 4, 0), 5: (5, 0, 1, 0), 6: (6, 0, 2, 0), 8: (8, 0, 1, 0)}
    assert len(placed) == 8
    assert {r.v for r in hierarchy.descendants(ordered, 1, 1).collect()} == {2, 3, 4}
    assert {r.v for r in hierarchy.descendants(ordered, 1, 6).collect()} == {7}
    assert {(s.v, s.chain, s.from_depth, s.to_depth) for s in hierarchy.segments(tree).collect() if s.v in (1, 5, 6)} == {(v, v, 0, 0) for v in (1, 5, 6)}


def test_split_prefix_sum_covers_hot_key(spark):
    df = spark.createDataFrame([(1, i, i % 7 + 1) for i in range(500)], "k int, i int, n int")
    rows = hierarchy.split_prefix_sum(df, ["k"], ["i"], "n", "before", F.floor(F.col("i") / 60)).orderBy("i").collect()
    spans = [(r.before, r.before + r.n) for r in rows]
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


# --- problem 5


def feed(spark, rows, stream="s"):
    df = spark.createDataFrame(rows, "commit bigint, k bigint, op int, at bigint, v string, txn string, parts int")
    return changefeed.change_rows(df, stream, F.col("commit"), {"k": F.col("k")}, F.col("op"), F.col("at"), [F.col("commit")], {"v": F.col("v")}, F.col("txn"), F.col("parts"))


def state(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_replay_out_of_order_repeats_and_ties(spark):
    rows = [(1, 1, 0, 10, "a", None, 1), (2, 1, 0, 30, "c", None, 1), (3, 1, 0, 20, "b", None, 1), (4, 2, 0, 10, "x", None, 1), (5, 2, 1, 10, None, None, 1), (6, 3, 1, 5, None, None, 1), (7, 3, 0, 6, "back", None, 1), (8, None, 0, 1, "n", None, 1), (9, 4, 0, None, "n", None, 1), (10, 5, -1, 9, "n", None, 1), (11, 6, 0, 1, None, None, 1)]
    assert state(changefeed.replay([feed(spark, rows + rows[:4])], ["k"], ["v"], sealed=True)) == [(1, "c"), (3, "back"), (6, None)]


def test_replay_holds_gaps_and_incomplete_transactions(spark):
    rows = [(1, 1, 0, 1, "a", None, 1), (2, 1, 0, 2, "b", None, 1), (4, 1, 0, 3, "late", None, 1)]
    assert state(changefeed.replay([feed(spark, rows)], ["k"], ["v"])) == [(1, "b")]
    assert state(changefeed.replay([feed(spark, rows)], ["k"], ["v"], sealed=True)) == [(1, "late")]
    parts = [(1, 1, 0, 1, "a", "t", 2), (2, 2, 0, 1, "b", "t", 2), (3, 3, 0, 1, "c", "u", 2)]
    assert state(changefeed.replay([feed(spark, parts)], ["k"], ["v"], sealed=True)) == [(1, "a"), (2, "b")]
    assert changefeed.replay([feed(spark, [(None,) * 7])], ["k"], ["v"], sealed=True).count() == 0


def test_present_state_has_all_changes_of_logs_with_gaps(spark, tmp_path):
    """Numbers that begin late and have gaps, as where tables were landed in parts."""
    messages = [(n, 7, n % 10, f"2025-01-01T00:00:{n % 10:02d}Z", None, f"2025-01-01T00:00:{n % 10:02d}Z", f"h{n}") for n in (5, 6, 1_000_003, 1_000_004)]
    spark.createDataFrame(messages, "seq bigint, channel_id bigint, msg_id bigint, date string, edit_date string, last_seen string, content_hash string").write.parquet(f"{tmp_path}/messages.parquet")
    deletes = [(1, "tg:msg:7/6", "update", "2025-02-01T00:00:00Z"), (100_001, "tg:msg:7/4", "empty", "2025-02-01T00:00:00Z"), (200_001, "tg:msg:7/3", "gap", "2025-02-01T00:00:00Z")]
    spark.createDataFrame(deletes, "id bigint, message_uri string, evidence string, observed_at string").write.parquet(f"{tmp_path}/message_tombstones.parquet")
    assert sorted(map(tuple, core_queries.p5_found(spark, str(tmp_path)).collect())) == [(7, 3, "h1000003"), (7, 5, "h5")]


def test_watermarks_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(changefeed, "BLOCK", 4)
    a = feed(spark, [(i, 1, 0, i, "v", None, 1) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12)], "a")
    b = feed(spark, [(i, 1, 0, i, "v", None, 1) for i in (2, 3)], "b")
    c = feed(spark, [(i, 1, 0, i, "v", None, 1) for i in range(1, 9)], "c")
    got = {r._stream: r.watermark for r in changefeed.watermarks(a.unionByName(b).unionByName(c)).collect()}
    assert got == {"a": 9, "b": 0, "c": 8}


# --- problem 6


def fold_versions(rows, n):
    out = []
    for a in range(n):
        by = {}
        for k, at, i, *values in sorted({r for r in rows if None not in r[:3]}, key=lambda r: (r[1], r[2])):
            if values[a] is not None and (not by.get(k) or by[k][-1][1] != values[a]):
                by.setdefault(k, []).append((i, values[a]))
        for k, vs in by.items():
            out += [(k, f"v{a}", v, i, vs[j + 1][0] if j + 1 < len(vs) else 0) for j, (i, v) in enumerate(vs)]
    return sorted(out)


@pytest.mark.parametrize("period", [1, 7, 1000])
def test_history_against_fold(spark, period):
    rng = random.Random(period)
    rows = [(rng.randint(1, 4), rng.randint(0, 60), i, rng.choice(["a", "b", "a", None]), rng.choice(["x", "y"])) for i in range(150)]
    rows += rows[:10] + [(None, 1, 900, "a", "x"), (1, None, 901, "a", "x")]
    df = spark.createDataFrame(rows, "k bigint, t bigint, i bigint, v0 string, v1 string").withColumn("value", F.lit("clash"))
    obs = history.observations(df, F.col("k"), F.col("t"), F.col("i"), ["v0", "v1"], period=period)
    got = sorted((r.k, r.attribute, r.value, r.from_id, r.next_id) for r in history.versions(obs).collect())
    assert got == fold_versions(rows, 2)


def test_history_empty_and_as_of(spark):
    schema = "k bigint, t bigint, i bigint, v0 string"
    obs = history.observations(spark.createDataFrame([], schema), F.col("k"), F.col("t"), F.col("i"), ["v0"])
    assert history.versions(obs).count() == 0
    obs = history.observations(spark.createDataFrame([(1, 10, 1, "a"), (1, 20, 2, "b")], schema), F.col("k"), F.col("t"), F.col("i"), ["v0"])
    assert [r.value for r in history.as_of(history.versions(obs), F.lit(15)).collect()] == ["a"]


def test_tree_prunes_what_stands_still(spark, tmp_path):
    """400 keys in ten snapshots, three of them change: only the first snapshot and the buckets of the three are read."""
    rows = [(k, p * 10 + k % 10, p * 1000 + k, "b" if k in (7, 8, 9) and p >= 5 else "a") for k in range(400) for p in range(10)]
    obs = history.observations(spark.createDataFrame(rows, "k bigint, t bigint, i bigint, v string"), F.col("k"), F.col("t"), F.col("i"), ["v"], period=10)
    read = history.differing_rows(obs, Scratch(spark, "test"))
    assert {r.k for r in read.where("period > 0").collect()} >= {7, 8, 9}
    assert read.count() <= 400 + 3 * 8
    groups = history.differing(history.group_nodes(history.leaf_nodes(obs)), "grp")
    assert groups.where("period > 0").select("grp").distinct().count() <= 3
    assert history.versions(obs).where("from_id >= 400").count() == 3


def test_values_that_come_back_are_seen(spark):
    """Within a period, over one, and after a period without rows."""
    values = [(0, "a"), (1, "b"), (10, "a"), (11, "a"), (30, "a"), (31, "b"), (32, "a"), (40, "a"), (55, "b")]
    rows = [(1, t, i, v) for i, (t, v) in enumerate(values, 1)]
    obs = history.observations(spark.createDataFrame(rows, "k bigint, t bigint, i bigint, v0 string"), F.col("k"), F.col("t"), F.col("i"), ["v0"], period=10)
    assert sorted((r.k, r.attribute, r.value, r.from_id, r.next_id) for r in history.versions(obs).collect()) == fold_versions(rows, 1)


def test_large_blocks_are_cut(spark):
    df = spark.createDataFrame([(k, t, t * 2) for k in (1, None) for t in range(300)], "k int, t bigint, x bigint")
    cut = split.cut_by_count(df, ["k"], "t", F.lit(0), limit=100)
    assert cut.groupBy("k", "_b").count().agg(F.max("count")).first()[0] <= 4
    few = split.cut_by_count(df, ["k"], "t", F.floor(F.col("t") / 50), limit=100)
    assert few.select("_b").distinct().count() == 6
    whole = split.neighbour(df, ["k"], ["t"], "x", F.lit(0), "before", by_count=True)
    assert whole.where("before <> x - 2").count() == 0


def test_scratch_is_cleared(spark, tmp_path):
    scratch = Scratch(spark, "cleared")
    back, path = scratch.write(spark.range(3))
    assert back.count() == 3 and Path(path.removeprefix("file:")).exists()
    clear_scratch(spark)
    assert not Path(path.removeprefix("file:")).exists()
