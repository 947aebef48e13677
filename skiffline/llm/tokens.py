"""Sizes in tokens of a public tokenizer.

The vocabulary file is named by a parameter (``skiffline.tokenizer.path`` in the session,
else ``DEFAULT``) and stays where it is; each Python worker loads it once.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

DEFAULT = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this family cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 20_000  #: characters encoded at once; longer texts are cut at blanks, where the pattern cuts too

_loaded: dict[str, object] = {}


def tokenizer_path(spark: SparkSession) -> str:
    return spark.conf.get("skiffline.tokenizer.path", DEFAULT)


def encoder(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("skiffline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in parts of about ``size`` characters, each cut before a blank that stands between two other signs."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace() and not text[cut + 1 : cut + 2].isspace()):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def token_count(path: str, text: str) -> int:
    enc = encoder(path)
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text))


def _count(path: str, names: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = pa.array([token_count(path, t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *batch.columns[2:]], names=["id", "n_tokens", *names])

    return run


def sizes(docs: DataFrame, doc_id: Column, text: Column, **keep: Column) -> DataFrame:
    """id and n_tokens of every row (0 for NULL and empty texts), and the columns to keep under their names."""
    path = tokenizer_path(docs.sparkSession)
    slim = docs.select(doc_id.cast("bigint").alias("id"), text.alias("text"), *[c.alias(k) for k, c in keep.items()])
    schema = ", ".join(["id bigint", "n_tokens bigint", *[f"{k} {slim.schema[k].dataType.simpleString()}" for k in keep]])
    return slim.mapInArrow(_count(path, list(keep)), schema)
