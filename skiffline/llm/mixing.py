"""Mixing sources to target weights by Efraimidis-Spirakis sampling (problem 9).

Every document of a source gets the key ``-ln(u) / w`` with u a uniform number from a hash of
its id (so a run can be repeated) and w its quality weight; sorted by that key the documents
are a weighted random order without replacement.

The size of a mix is the largest at which every source that occurs reaches its share with
no document used more than ``max_repeats`` times, unless a size is given.  A source's
budget is met by complete epochs over all its documents, then by the documents in the
order of their keys up to the rest of the budget (prefix sums).  A source absent from the
corpus contributes nothing; its share is split among the others in proportion, and the
report shows both.

Prefix sums run in blocks of the key's logarithm, so a source that holds most documents is
no single window: a key of weight w lies in [x, x (1 + e)) with a probability of at most
e * xw exp(-xw) <= e / 2.7, whatever w, so a block of e = 1/1477 holds about 1/4000 of a
source's documents at most.

Every document takes part in the fraction in the order of its key, whatever its size; the one
at the budget's edge is taken if most of it lies inside, so a source misses its budget by
half of that document at most.

Defined cases: source names are compared without case, blanks or hyphens; documents of a
NULL source or without tokens are in no mix; a NULL or non-positive share or repeat count
takes a target out; ties of keys go by id; repeated ids count each; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = 1024  #: blocks for each doubling of the key
LEAST_KEY = 2.0**-45  #: keys below (none but by a chance of 1 in 10^13) share a block


def source_name(source: Column) -> Column:
    """One spelling: small letters, words joined by underscores."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")
    return F.when(F.length(name) > 0, name)


def letter_share(text: Column) -> Column:
    """The share of letters and blanks in a text."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{M}\s]", "")) / F.greatest(F.length(text), F.lit(1))


def quality(n_tokens: Column, letters: Column) -> Column:
    """A weight between 0.1 and 1: the share of letters, less for very short texts."""
    return F.greatest(F.lit(0.1), letters * F.least(F.lit(1.0), n_tokens / 32.0))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1] from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))


def budgets(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per target whose source occurs: its tokens, share among those present, budget, epochs and rest.

    docs: source, size.  The table has as many rows as there are targets.
    """
    have = docs.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n_docs"))
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats")).where("target_share > 0 and max_repeats > 0 and source is not null")
    per_mix = Window.partitionBy("mix_name")  # a few rows a mix
    rows = have.join(F.broadcast(wanted), "source")  # the targets: a few rows a mix, by the statement of the problem
    rows = rows.withColumn("share", F.col("target_share") / F.sum("target_share").over(per_mix))
    largest = F.min(F.col("tokens") * F.col("max_repeats") / F.col("share")).over(per_mix)
    rows = rows.withColumn("mix_tokens", F.floor(largest if total is None else F.least(largest, F.lit(float(total)))))
    rows = rows.withColumn("budget", F.floor(F.col("share") * F.col("mix_tokens")).cast("bigint"))
    rows = rows.withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("max_repeats")).cast("bigint"))
    return rows.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def select(docs: DataFrame, targets: DataFrame, seed: int = 17, total: int | None = None) -> DataFrame:
    """docs: id, source (any spelling), size, weight.  One row per (mix, document) used: mix_name, source, id, size, copies."""
    slim = docs.select("id", source_name(F.col("source")).alias("source"), F.col("size").cast("bigint").alias("size"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.1)), F.lit(1e-6)).alias("weight")).where("source is not null and size > 0")
    plan = budgets(slim, targets, total)
    keyed = slim.withColumn("key", -F.log(uniform(seed, F.col("id"))) / F.col("weight"))
    keyed = keyed.withColumn("block", F.floor(F.lit(float(BLOCKS)) * F.log2(F.greatest("key", F.lit(LEAST_KEY)))).cast("int"))
    names = F.broadcast(plan.select(F.col("source").alias("p_source"), "mix_name", "epochs", "rest", "max_repeats"))  # one row a target
    used = keyed.join(names, F.col("source") == F.col("p_source")).drop("p_source")
    sums = used.groupBy("mix_name", "source", "block").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("mix_name", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most 60 doublings of BLOCKS rows
    starts = sums.select(F.col("mix_name").alias("b_mix"), F.col("source").alias("b_source"), F.col("block").alias("b_block"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    placed = used.join(starts, (F.col("mix_name") == F.col("b_mix")) & (F.col("source") == F.col("b_source")) & (F.col("block") == F.col("b_block")))
    inside = Window.partitionBy("mix_name", "source", "block").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # The document at the edge of the budget is taken if most of it lies inside.
    fraction = (F.col("at") + F.col("size") / 2 <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))
    copies = F.col("epochs") + fraction.cast("bigint")
    return placed.withColumn("copies", copies).where("copies > 0").select("mix_name", "source", "id", "size", "copies")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every target, absent sources included."""
    got = selection.groupBy("mix_name", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), "max_repeats")
    both = wanted.join(got, ["mix_name", "source"], "left")
    whole = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_name"))
    share = F.round(F.coalesce("tokens", F.lit(0)) / F.when(whole > 0, whole), 6)
    return both.select("mix_name", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), share.alias("actual_share"))
