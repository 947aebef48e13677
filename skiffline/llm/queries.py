"""Queries of the text problems (3, 4, 7, 8, 9, 10) over their whole tables.

Their results come from fitted models, so SQL can't express them; they are tested
against brute force, round trips and held-out rows in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiffline.llm import langid, mixing, packing, pii, sentences, tokens, toxicity
from skiffline.session import Scratch, table


_MODELS: dict = {}


def fitted(spark: SparkSession, sf_dir: str, tables: list[str], what: str, fit: Callable[[], object]):
    """A model, fitted once in a session for the files that its tables have now."""
    files = []
    for name in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    key = (spark.sparkContext.applicationId, what, tuple(files))
    if key not in _MODELS:
        _MODELS[key] = fit()
    return _MODELS[key]


def personal_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pii.Model]:
    messages, revisions = table(spark, sf_dir, "messages"), table(spark, sf_dir, "message_revisions")
    model = fitted(spark, sf_dir, ["messages", "message_revisions", "known_names"], "personal", lambda: pii.fit_on(messages, F.col("seq"), F.col("text"), table(spark, sf_dir, "known_names"), named=messages.select("text").unionByName(revisions.select("text"))))
    both = messages.select(F.lit("message").alias("i"), F.col("seq").alias("n"), F.col("text").alias("x")).unionByName(revisions.select(F.lit("revision").alias("i"), F.col("id").alias("n"), F.col("text").alias("x")))
    return both, model


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, model = personal_texts(spark, sf_dir)
    return pii.pieces(texts, model, F.col("i"), F.col("n"), F.col("x")).select("item", "item_id", "char_start", "pii_type")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of personal information."""
    texts, model = personal_texts(spark, sf_dir)
    return pii.redacted(texts, model, F.col("i"), F.col("n"), F.col("x"))


def language_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, channels = table(spark, sf_dir, "messages"), table(spark, sf_dir, "channels")
    model = fitted(spark, sf_dir, ["messages"], "language", lambda: langid.fit_on(messages, F.col("seq"), F.col("text"), F.col("lang")))
    both = messages.select(F.lit("message").alias("i"), F.col("seq").alias("n"), F.col("lang").alias("l"), F.col("text").alias("x")).unionByName(channels.select(F.lit("about").alias("i"), F.col("id").alias("n"), F.col("lang").alias("l"), F.col("about").alias("x")))
    return langid.parts(both, model, F.col("i"), F.col("n"), F.col("l"), F.col("x"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.cases(language_parts(spark, sf_dir)).select("item", "item_id", F.col("seg_no").cast("bigint").alias("seg_no"), "lang")


def p4_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's parts with language, confidence and number of sentences, right labels included."""
    return language_parts(spark, sf_dir).select("item", "item_id", F.col("seg_no").cast("bigint").alias("seg_no"), "lang", "confidence", "n_sentences")


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, messages, web = table(spark, sf_dir, "mod_labels"), table(spark, sf_dir, "messages"), table(spark, sf_dir, "web_snapshots")
    model = fitted(spark, sf_dir, ["mod_labels", "messages", "web_snapshots"], "toxicity", lambda: toxicity.fit_on(labels, F.col("text"), F.col("category"), messages.select("text").unionByName(web.select("text")), F.col("text")))
    both = messages.select(F.lit("message").alias("i"), F.col("seq").alias("n"), F.col("channel_id").cast("string").alias("s"), F.col("text").alias("x")).unionByName(web.select(F.lit("web").alias("i"), F.col("id").alias("n"), F.col("source").alias("s"), F.col("text").alias("x")))
    return toxicity.scores(both, model, F.col("i"), F.col("n"), F.col("s"), F.col("x"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(spark, sf_dir).where("category is not null").select("item", "item_id", "category")


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(spark, sf_dir).select("item", "item_id", F.round("score", 4).alias("score"), "category")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per channel and per web source."""
    return toxicity.rates(text_scores(spark, sf_dir))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.sizes(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return packing.pack(sizes.withColumnRenamed("n_tokens", "size"), table(spark, sf_dir, "pack_capacities"))


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which piece of which document lies in which container."""
    return packed_documents(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and share of space used, per capacity."""
    return packing.fill_report(packed_documents(spark, sf_dir))


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = tokens.sizes(docs, F.col("doc_id"), F.col("text"), source=F.col("source"), letters=mixing.letter_share(F.coalesce("text", F.lit(""))))
    sized = sizes.select("id", "source", F.col("n_tokens").alias("size"), mixing.quality(F.col("n_tokens"), F.col("letters")).alias("weight"))
    return mixing.select(Scratch(spark, "mixing").write(sized)[0], table(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in each mix."""
    return mixed_documents(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares."""
    return mixing.shares(mixed_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), F.col("lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(spark, sf_dir).select("doc_id", "char_start", "char_end")


def p10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their mean and greatest length per document."""
    n = F.col("char_end") - F.col("char_start")
    return document_sentences(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.round(F.avg(n), 3).alias("mean_chars"), F.max(n).alias("max_chars"))


QUERIES = {f.__name__: f for f in (p3_found, p3_redacted, p4_found, p4_parts, p7_found, p7_scores, p7_rates, p8_bins, p8_fill, p9_selection, p9_shares, p10_found, p10_lengths)}
SQL: dict[str, str] = {}
