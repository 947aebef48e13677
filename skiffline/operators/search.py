"""Full-text search over a token table: AND, OR, NOT, phrases, prefixes, first words, words near each other, ranking.

Tokens are runs of letters and digits, small, without accents; their positions count from
0.  A query reads the token table with its words pushed down, so it touches few rows; all
conditions of a query meet in one aggregate per text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters of Latin scripts and their plain ones.
ACCENTED = "àáâãäåāăąçćčďđèéêëēęěğìíîïīıķľłñńňņòóôõöøőōŕřśşšșťțţùúûüūůűųýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeegiiiiiiklllnnnnooooooooorrssssttttuuuuuuuuyyzzz"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN[: len(ACCENTED)])


def tokens(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """id, token, pos - the index.  Write it ``by_token`` so that files prune."""
    words = F.filter(F.split(folded(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return docs.select(doc_id.alias("id"), F.posexplode(words).alias("pos", "token"))


def by_token(index: DataFrame) -> DataFrame:
    """The index in the order of its tokens, in ranges of them: a query's words are then in few files and row groups."""
    return index.repartitionByRange("token", "id").sortWithinPartitions("token", "id", "pos")


def near(index: DataFrame, first: str, second: str, between: int = 10) -> DataFrame:
    """The ids of texts in which two words have at most so many words between them, in either order."""
    rows = index.where(F.col("token").isin(first, second)).groupBy("id").agg(*[F.collect_set(F.when(F.col("token") == w, F.col("pos"))).alias(n) for n, w in (("a", first), ("b", second))])
    return rows.where(F.exists("a", lambda x: F.exists("b", lambda y: (x != y) & (F.abs(x - y) <= between + 1)))).select("id")


def ranked(index: DataFrame, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score (BM25, the higher the better) of texts that hold any of the words; words in most texts count next to nothing."""
    lengths = index.groupBy("id").agg(F.count("*").alias("length"))
    n_texts, mean = lengths.agg(F.count("*")).scalar(), lengths.agg(F.avg("length")).scalar()
    hits = index.where(F.col("token").isin(*words)).groupBy("id", "token").agg(F.count("*").alias("tf"))
    held = hits.groupBy(F.col("token").alias("w")).agg(F.count("*").alias("df"))  # one row a word
    rows = hits.join(F.broadcast(held), F.col("token") == F.col("w")).join(lengths, "id")
    idf = F.greatest(F.log((n_texts - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    return rows.groupBy("id").agg(F.sum(part).alias("score"))


def search(index: DataFrame, all_of: list[str] | None = None, any_of: list[str] | None = None, none_of: list[str] | None = None, phrases: list[list[str]] | None = None, prefixes: list[str] | None = None, first: str | None = None) -> DataFrame:
    """The ids of texts that meet every condition."""
    all_of, any_of, none_of, phrases, prefixes = (x or [] for x in (all_of, any_of, none_of, phrases, prefixes))
    words = {*all_of, *any_of, *none_of, *(w for p in phrases for w in p), *([first] if first else [])}
    t = F.col("token")
    wanted = reduce(lambda a, b: a | b, [t.startswith(p) for p in prefixes], t.isin(*sorted(words)) if words else F.lit(False))
    checks: list[Column] = [F.max((t == w).cast("int")) == 1 for w in all_of]
    checks += [F.max((t == w).cast("int")) == 0 for w in none_of]
    checks += [F.max(t.startswith(p).cast("int")) == 1 for p in prefixes]
    if any_of:
        checks.append(F.max(t.isin(*any_of).cast("int")) == 1)
    if first:
        checks.append(F.max(((t == first) & (F.col("pos") == 0)).cast("int")) == 1)
    for p in phrases:  # the starts that each word's positions allow must have one in common
        starts = [F.collect_set(F.when(t == w, F.col("pos") - i)) for i, w in enumerate(p)]
        checks.append(F.size(reduce(F.array_intersect, starts)) > 0)
    named = [c.alias(f"c{i}") for i, c in enumerate(checks)]
    hits = index.where(wanted).groupBy("id").agg(*named)
    return hits.where(" and ".join(f"c{i}" for i in range(len(named)))).select("id")
