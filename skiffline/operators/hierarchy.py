"""Parent-child rows to full hierarchies by heavy-path decomposition (problem 2).

Rows (tree, node, parent) form forests of unknown depth inside each tree key.
Nothing is grouped by tree, so one key that holds most rows is no hot spot: every
step is a join or a partial aggregate on (tree, node).

1. Cycle separation and subtree sizes by pointer doubling.  After round k a node
   knows its ancestor 2^k steps up and how many nodes lie less than 2^k steps
   below it; the nodes exactly 2^k below add their counts.  A node that never runs
   out of ancestors is on a cycle or runs into one.
2. The child with the largest subtree continues its parent's chain, every other
   child heads a chain of its own.  A root path crosses at most log2(n) chains.
   Doubling along heavy edges gives each node its chain's head and its offset.
3. The chain tree (one row per chain, at most log2(n) levels) is resolved by the
   same doubling: depth and root of a chain, and the preorder position of its head.
   A node's depth is its chain's depth plus its offset.

A node's path is the concatenation of chain segments (``segments``), and its
descendants are the interval (pos, pos + size - 1] of preorder positions under the
same root (``descendants``).  Both forms stay linear in the rows, where a list of
all ancestors per node is quadratic for a deep chain.

Defined cases: rows with a NULL tree or node are no nodes; a NULL parent or one
that is no node makes a root; a node given more than once has the greatest of its
parents; a node that is its own parent is a cycle; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skiffline.operators import split
from skiffline.session import Scratch

def nodes_of(rows: DataFrame, tree: Column, node: Column, parent: Column) -> DataFrame:
    """One row per node: t, v, p."""
    slim = rows.select(tree.cast("bigint").alias("t"), node.cast("bigint").alias("v"), parent.cast("bigint").alias("p"))
    return slim.where("t is not null and v is not null").groupBy("t", "v").agg(F.max("p").alias("p"))


def _jump(state: DataFrame, table: DataFrame, done: str, key: str) -> DataFrame:
    """``state`` with the ``key``-th row of ``table`` beside each row that isn't done.

    Rows that are done look up a key of their own that cannot match, so they don't
    gather in one partition.
    """
    asked = state.withColumn("ask", F.when(F.col(done), F.lit(-1) - F.abs(F.col("v"))).otherwise(F.col(key))).withColumn("ask_t", F.when(F.col(done), F.lit(None).cast("bigint")).otherwise(F.col("t")))
    return asked.join(table, (F.col("ask") == F.col("k_v")) & (F.coalesce(F.col("ask_t"), F.col("t")) == F.col("k_t")) & ~F.col(done), "left")


def _open(df: DataFrame) -> int:
    """The number of rows not done; reads one column of a written table."""
    return df.where("not done").count()


def _doubled(scratch: Scratch, edges: DataFrame, sizes: bool) -> tuple[DataFrame, str]:
    """Pointer doubling over edges (t, v, ptr): ptr the last ancestor, dist the steps to it, cnt the subtree size.

    An ancestor that has no row of its own is the end of the way.  Rows that never
    come to an end keep ``done`` false; they are the cyclic ones.
    """
    state, path = scratch.write(edges.select("t", "v", "ptr", F.lit(1).cast("bigint").alias("dist"), *([F.lit(1).cast("bigint").alias("cnt")] if sizes else []), F.lit(False).alias("done")))
    open_before = None
    while True:
        still = _open(state)
        # Open is what is at least step deep, and what is cyclic.  If a round closed nothing, no node is between half a step
        # and a step deep; then none is deeper either, as the way up from one would pass through such a node.
        if not still or still == open_before:
            return state, path
        table = state.select(F.col("t").alias("k_t"), F.col("v").alias("k_v"), F.col("ptr").alias("n_ptr"), F.col("dist").alias("n_dist"), F.col("done").alias("n_done"))
        base = state
        if sizes:
            below = state.where("not done").groupBy(F.col("t").alias("b_t"), F.col("ptr").alias("b_v")).agg(F.sum("cnt").alias("more"))
            base = state.join(below, (F.col("t") == F.col("b_t")) & (F.col("v") == F.col("b_v")), "left").withColumn("cnt", F.col("cnt") + F.coalesce("more", F.lit(0))).drop("b_t", "b_v", "more")
        found = F.col("n_ptr").isNotNull()
        moved = _jump(base, table, "done", "ptr").select(
            "t",
            "v",
            F.coalesce("n_ptr", "ptr").alias("ptr"),
            (F.col("dist") + F.coalesce("n_dist", F.lit(0))).alias("dist"),
            *(["cnt"] if sizes else []),
            (F.col("done") | ~found | F.coalesce("n_done", F.lit(False))).alias("done"),
        )
        (state, new), old = scratch.write(moved), path
        scratch.drop(old)
        path, open_before = new, still


def hierarchy(rows: DataFrame, tree: Column, node: Column, parent: Column, bare: bool = False) -> DataFrame:
    """One row per node that has a parent value; with ``bare`` also one per node without.

    Columns: t, v, p, root (0 on a cycle), depth (-1 on a cycle), chain (head of the
    node's heavy path), chain_parent (the node the chain hangs from, NULL for a root's
    chain), chain_depth (depth of the head), offset (steps below the head), size
    (nodes of the subtree, itself included; on a cycle 0).
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hierarchy")
    nodes, _ = scratch.write(nodes_of(rows, tree, node, parent))
    ups = nodes.where("p is not null")
    known = nodes.select(F.col("t").alias("k_t"), F.col("v").alias("k_v"))
    edges = ups.join(known, (F.col("t") == F.col("k_t")) & (F.col("p") == F.col("k_v")), "left_semi").select("t", "v", F.col("p").alias("ptr"))
    sized, _ = _doubled(scratch, edges, sizes=True)
    sized = sized.join(ups.select(F.col("t").alias("u_t"), F.col("v").alias("u_v"), "p"), (F.col("t") == F.col("u_t")) & (F.col("v") == F.col("u_v"))).drop("u_t", "u_v")
    acyclic, _ = scratch.write(sized.where("done").select("t", "v", "p", "cnt"))
    cyclic = sized.where("not done").select("t", "v", "p")

    # Heavy edges: of the children of a node the one with the largest subtree, the smallest id among equals.
    best = acyclic.groupBy(F.col("t").alias("h_t"), F.col("p").alias("h_p")).agg((-F.max(F.struct("cnt", (-F.col("v")).alias("m")))["m"]).alias("heavy"), F.sum("cnt").alias("below"))
    marked = acyclic.join(best, (F.col("t") == F.col("h_t")) & (F.col("p") == F.col("h_p"))).select("t", "v", "p", "cnt", (F.col("v") == F.col("heavy")).alias("is_heavy"))
    marked, _ = scratch.write(marked)
    labels, _ = _doubled(scratch, marked.where("is_heavy").select("t", "v", F.col("p").alias("ptr")), sizes=False)
    on_chain = marked.where("is_heavy").join(labels.select(F.col("t").alias("l_t"), F.col("v").alias("l_v"), F.col("ptr").alias("chain"), F.col("dist").alias("offset")), (F.col("t") == F.col("l_t")) & (F.col("v") == F.col("l_v"))).select("t", "v", "p", "cnt", "chain", "offset")
    heads = marked.where("not is_heavy").select("t", "v", "p", "cnt", F.col("v").alias("chain"), F.lit(0).cast("bigint").alias("offset"))
    placed, _ = scratch.write(on_chain.unionByName(heads))

    # The chain tree: a light head hangs from a node of another chain; chains of roots are its roots.
    where = placed.select(F.col("t").alias("k_t"), F.col("v").alias("k_v"), F.col("chain").alias("above"), F.col("offset").alias("above_offset"))
    links = heads.select("t", "v", "p").join(where, (F.col("t") == F.col("k_t")) & (F.col("p") == F.col("k_v")), "left").select("t", "v", "p", F.coalesce("above", "p").alias("ptr"), (F.coalesce("above_offset", F.lit(0)) + 1).alias("dist"))
    chains = _weighted(scratch, links)
    at = chains.select(F.col("t").alias("c_t"), F.col("v").alias("c_v"), F.col("ptr").alias("c_root"), F.col("dist").alias("c_depth"), F.col("p").alias("chain_parent"))
    whole = placed.join(at, (F.col("t") == F.col("c_t")) & (F.col("chain") == F.col("c_v")), "left").select(
        "t",
        "v",
        "p",
        F.coalesce("c_root", "chain").alias("root"),
        (F.coalesce("c_depth", F.lit(0)) + F.col("offset")).alias("depth"),
        "chain",
        "chain_parent",
        F.coalesce("c_depth", F.lit(0)).cast("bigint").alias("chain_depth"),
        "offset",
        F.col("cnt").alias("size"),
    )
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    orphans = ups.join(known, (F.col("t") == F.col("k_t")) & (F.col("p") == F.col("k_v")), "left_anti")
    tops = orphans.unionByName(nodes.where("p is null")) if bare else orphans
    tops = tops.join(best, (F.col("t") == F.col("h_t")) & (F.col("v") == F.col("h_p")), "left")
    roots = tops.select("t", "v", "p", F.col("v").alias("root"), zero.alias("depth"), F.col("v").alias("chain"), none.alias("chain_parent"), zero.alias("chain_depth"), zero.alias("offset"), (F.coalesce("below", F.lit(0)) + 1).alias("size"))
    loops = cyclic.select("t", "v", "p", zero.alias("root"), F.lit(-1).cast("bigint").alias("depth"), none.alias("chain"), none.alias("chain_parent"), none.alias("chain_depth"), none.alias("offset"), zero.alias("size"))
    return whole.unionByName(roots).unionByName(loops)


def _weighted(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Doubling over links (t, v, p, ptr, dist) that already span several steps; acyclic, at most log2(n) levels."""
    state, path = scratch.write(links.withColumn("done", F.lit(False)))
    while _open(state):
        table = state.select(F.col("t").alias("k_t"), F.col("v").alias("k_v"), F.col("ptr").alias("n_ptr"), F.col("dist").alias("n_dist"), F.col("done").alias("n_done"))
        found = F.col("n_ptr").isNotNull()
        moved = _jump(state, table, "done", "ptr").select("t", "v", "p", F.coalesce("n_ptr", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("n_dist", F.lit(0))).alias("dist"), (F.col("done") | ~found | F.coalesce("n_done", F.lit(False))).alias("done"))
        (state, new), old = scratch.write(moved), path
        scratch.drop(old)
        path = new
    return state


def split_prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, block: Column) -> DataFrame:
    """Exclusive running sum of ``value`` in the order of each key, hot keys split.

    ``block`` must rise with the order: each window holds one block of a key, block totals
    are summed in a second window with one row a block.
    """
    blocked = df.withColumn("_b", block)
    totals = blocked.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_s").over(before), F.lit(0))).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_b").alias("_kb"), "_start")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_b") == F.col("_kb"))
    return local.join(starts, on).withColumn(out, F.col("_start") + F.col("_in")).drop("_b", "_kb", "_start", "_in", *(f"_k_{k}" for k in keys))


def preorder(tree: DataFrame) -> DataFrame:
    """``hierarchy`` rows of acyclic nodes with ``pos``, their place in heavy-first preorder under the root (the root has 0).

    Descendants of a node are the rows of the same t and root with pos in
    (pos, pos + size - 1].  Light siblings come after the heavy child's subtree in
    the order of their ids; their offsets are prefix sums split by ranges of ids.
    """
    scratch = Scratch(tree.sparkSession, "preorder")
    rows, _ = scratch.write(tree.where("size > 0"))
    light = rows.where("offset = 0 and chain_parent is not null").select("t", "v", "p", "size", "root")
    heavy = rows.where("offset > 0").select(F.col("t").alias("y_t"), F.col("p").alias("y_p"), F.col("size").alias("heavy_size"))
    shifted = split_prefix_sum(light, ["t", "p"], ["v"], "size", "before", split.id_block(F.col("v")))
    shifted = shifted.join(heavy, (F.col("t") == F.col("y_t")) & (F.col("p") == F.col("y_p")), "left")
    step = F.lit(1) + F.coalesce("heavy_size", F.lit(0)) + F.col("before")
    # A head's position is its chain parent's position plus the step; the parent's is its own head's plus its offset.
    up = rows.select(F.col("t").alias("k_t"), F.col("v").alias("k_v"), F.col("chain").alias("above"), F.col("offset").alias("above_offset"))
    links = shifted.join(up, (F.col("t") == F.col("k_t")) & (F.col("p") == F.col("k_v")), "left").select("t", "v", "p", F.coalesce("above", "p").alias("ptr"), (F.coalesce("above_offset", F.lit(0)) + step).alias("dist"))
    heads = _weighted(scratch, links).select(F.col("t").alias("q_t"), F.col("v").alias("q_v"), F.col("dist").alias("head_pos"))
    return rows.join(heads, (F.col("t") == F.col("q_t")) & (F.col("chain") == F.col("q_v")), "left").withColumn("pos", F.coalesce("head_pos", F.lit(0)) + F.col("offset")).drop("q_t", "q_v", "head_pos")


def segments(tree: DataFrame, levels: int = 64) -> DataFrame:
    """The root path of every acyclic node as chain segments, outermost first.

    One row per (node, segment): chain, from_depth, to_depth.  A node has at most
    log2(n) + 1 segments, so 64 levels hold any table.  The node of a chain at a depth
    is the row of ``tree`` with that chain and depth.
    """
    rows = tree.where("depth >= 0")
    at = rows.select(F.col("t").alias("k_t"), F.col("v").alias("k_v"), F.col("chain").alias("n_chain"), F.col("depth").alias("n_depth"), F.col("chain_depth").alias("n_from"), F.col("chain_parent").alias("n_up"))
    scratch = Scratch(tree.sparkSession, "segments")
    part = rows.select("t", "v", "chain", F.col("chain_depth").alias("from_depth"), F.col("depth").alias("to_depth"), F.col("chain_parent").alias("up"))
    parts = []
    for _ in range(levels):
        part, _path = scratch.write(part)
        parts.append(part.drop("up"))
        todo = part.where("up is not null")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        part = todo.select("t", "v", F.col("up").alias("ask"), (F.col("from_depth") - 1).alias("d")).join(at, (F.col("t") == F.col("k_t")) & (F.col("ask") == F.col("k_v")), "left").select("t", "v", F.coalesce("n_chain", "ask").alias("chain"), F.coalesce("n_from", F.lit(0)).cast("bigint").alias("from_depth"), F.col("d").alias("to_depth"), F.col("n_up").alias("up"))
    raise RuntimeError(f"a path of more than {levels} chains")


def descendants(ordered: DataFrame, t: int, v: int) -> DataFrame:
    """All descendants of one node from ``preorder`` rows: an interval of positions, no walk."""
    own = ordered.where((F.col("t") == t) & (F.col("v") == v)).select(F.col("t").alias("a_t"), F.col("root").alias("a_root"), F.col("pos").alias("a_pos"), F.col("size").alias("a_size"))
    return ordered.join(F.broadcast(own), (F.col("t") == F.col("a_t")) & (F.col("root") == F.col("a_root")) & (F.col("pos") > F.col("a_pos")) & (F.col("pos") < F.col("a_pos") + F.col("a_size"))).drop("a_t", "a_root", "a_pos", "a_size")
