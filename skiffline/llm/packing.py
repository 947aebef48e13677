"""Filling fixed-capacity containers by bounded-space online best-fit (problem 8).

Items are spread over shards; in a shard they arrive one by one.  A fixed number of bins is
open (``OPEN``); a bitset keyed by free space finds in one step the fullest bin that still
takes the item.  Fits it none, the fullest open bin is closed (if all are open) and a new one
opened.  An item beyond the capacity is cut into full pieces, its rest is packed like an
item.

At the end of its input a shard has open bins, most of them nearly full.  They aren't
written: each goes on, whole, as one item of a next pass over fewer shards (a sixteenth),
until one shard is left.  So what is lost to open bins is a few bins in all and not a few a
shard, no pass collects more than the open bins of 16 shards in a task, and any number of
items is handled.

Defined cases: items of size 0 or NULL take no container and give no row; a NULL or
non-positive capacity gives none; equal sizes go by arrival (shard, then id); repeated
items are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiffline.session import Scratch

OPEN = 64  #: bins open at once in a shard
SHARD_FILL = 40  #: containers that a shard of the first pass has to fill for each bin it may keep open, at least
FAN_IN = 16  #: shards whose rests meet in one shard of the next pass


class BoundedBestFit:
    """Best-fit with at most ``limit`` open bins; the fullest closes first."""

    def __init__(self, capacity: int, limit: int = OPEN):
        self.capacity, self.limit = capacity, limit
        self.by_free: dict[int, list[list]] = {}  # free space -> open bins, each [free, contents]
        self.bits = 0  # bit f is set if a bin with f free is open
        self.n_open = 0

    def _push(self, free: int, contents: list) -> None:
        self.by_free.setdefault(free, []).append(contents)
        self.bits |= 1 << free
        self.n_open += 1

    def _pop(self, free: int) -> list:
        stack = self.by_free[free]
        contents = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return contents

    def add(self, size: int, item) -> list[tuple[int, list]]:
        """Places an item of at most the capacity; returns the bins closed by that as (free, contents)."""
        closed = []
        fitting = self.bits >> size
        if fitting:
            free = size + ((fitting & -fitting).bit_length() - 1)  # the least free space that suffices
            contents = self._pop(free)
        else:
            if self.n_open >= self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                closed.append((fullest, self._pop(fullest)))
            free, contents = self.capacity, []
        contents.append(item)
        free -= size
        if free == 0:
            closed.append((0, contents))
        else:
            self._push(free, contents)
        return closed

    def rest(self) -> list[tuple[int, list]]:
        return [(free, self._pop(free)) for free in sorted(self.by_free, reverse=True) for _ in range(len(self.by_free[free]))]


_PASS = "pack_name string, capacity int, done boolean, shard bigint, bin_no int, used int, contents string"


def _pack_shard(final: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, capacity, shard = key[0], int(key[1]), int(key[2])
        out, number = [], 0
        packer = BoundedBestFit(capacity)

        def emit(bins, done):
            nonlocal number
            for free, contents in bins:
                out.append((name, capacity, done, shard, number, capacity - free, ";".join(contents)))
                number += 1

        for size, content in pdf.sort_values(["order_key", "content"], kind="stable")[["size", "content"]].itertuples(index=False):
            emit(packer.add(int(size), content), True)
        emit(packer.rest(), final)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PASS.split(", ")])

    return run


def pieces_of(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """Items as pieces of at most the capacity, for each kind of container: pack_name, capacity, item_id, piece_no, piece_start, size."""
    some = items.where("size > 0").select(F.col("id").alias("item_id"), F.col("size").cast("bigint").alias("total"))
    kinds = [(r.pack_name, r.capacity_tokens) for r in capacities.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().collect()]  # a handful, by the statement of the problem
    each = some.withColumn("kind", F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("int").alias("capacity")) for n, c in kinds]) if kinds else F.expr("cast(array() as array<struct<pack_name:string,capacity:int>>)"))).select("item_id", "total", "kind.*")
    cut = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / F.col("capacity")) - 1).cast("int"))))
    start = F.col("piece_no").cast("bigint") * F.col("capacity")
    return cut.select("pack_name", "capacity", "item_id", "piece_no", start.alias("piece_start"), F.least(F.col("capacity").cast("bigint"), F.col("total") - start).cast("int").alias("size"))


def pack(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """items: id, size; capacities: pack_name, capacity_tokens.

    One row per piece: pack_name, capacity, bin_id, bin_used, item_id, piece_no, piece_start, piece_size.
    """
    scratch = Scratch(items.sparkSession, "packing")
    parts, _ = scratch.write(pieces_of(items, capacities))
    totals = parts.groupBy("pack_name", "capacity").agg(F.sum("size").alias("tokens")).collect()  # one row a kind
    shards = {r.pack_name: max(1, int(r.tokens // (r.capacity * OPEN * SHARD_FILL))) for r in totals}
    if not shards:
        schema = "pack_name string, capacity int, bin_id string, bin_used int, item_id bigint, piece_no int, piece_start bigint, piece_size int"
        return items.sparkSession.createDataFrame([], schema)
    full = F.col("size") == F.col("capacity")
    text = F.concat_ws(",", "item_id", "piece_no", "piece_start", "size")
    counts = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv])
    # A piece that fills a container is one; the others are dealt to shards by a hash.
    whole = parts.where(full).select("pack_name", "capacity", F.lit(True).alias("done"), F.lit(-1).cast("bigint").alias("shard"), F.lit(0).alias("bin_no"), F.col("size").alias("used"), text.alias("contents"))
    loose = parts.where(~full).select("pack_name", "capacity", F.pmod(F.xxhash64("item_id", "piece_no"), counts[F.col("pack_name")]).alias("shard"), "size", F.xxhash64("item_id").alias("order_key"), text.alias("content"))
    outputs, step = [whole.withColumn("pass_no", F.lit(0))], 1
    while True:
        final = max(shards.values()) == 1
        packed, _ = scratch.write(loose.groupBy("pack_name", "capacity", "shard").applyInPandas(_pack_shard(final), _PASS))
        outputs.append(packed.where("done").withColumn("pass_no", F.lit(step)))
        if final:
            break
        shards = {k: max(1, -(-n // FAN_IN)) for k, n in shards.items()}
        counts = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv])
        loose = packed.where("not done").select("pack_name", "capacity", F.pmod(F.xxhash64("shard"), counts[F.col("pack_name")]).alias("shard"), F.col("used").alias("size"), (-F.col("used")).cast("bigint").alias("order_key"), F.col("contents").alias("content"))
        step += 1
    bins = outputs[0]
    for more in outputs[1:]:
        bins = bins.unionByName(more)
    bins = bins.withColumn("bin_id", F.concat_ws("-", "pass_no", "shard", F.when(F.col("shard") == -1, F.regexp_replace("contents", r"^(\d+),(\d+),.*", "$1.$2")).otherwise(F.col("bin_no").cast("string"))))
    flat = bins.select("pack_name", "capacity", "bin_id", F.col("used").alias("bin_used"), F.explode(F.split("contents", ";")).alias("one")).withColumn("r", F.split("one", ","))
    r = F.col("r")
    return flat.select("pack_name", "capacity", "bin_id", "bin_used", r[0].cast("bigint").alias("item_id"), r[1].cast("int").alias("piece_no"), r[2].cast("bigint").alias("piece_start"), r[3].cast("int").alias("piece_size"))


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of space used, per kind."""
    bins = packed.groupBy("pack_name", "capacity", "bin_id").agg(F.sum("piece_size").alias("used"))
    return bins.groupBy("pack_name", "capacity").agg(F.count("*").alias("n_bins"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * F.first("capacity")), 6).alias("fill"))
