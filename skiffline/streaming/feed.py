"""The archive as a stream: landed files are read as they come, the same operators run per batch.

State is keyed and grows with the number of keys, not of changes: the last digest of a
message, the cursor of a channel.  Nothing expires unless a time is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiffline.operators import split
from skiffline.session import remove

COMPACT = 8  #: batches after which the state is written anew as a whole


def landed(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A folder of parquet files as a stream; Spark's checkpoint keeps the resume cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


_STATE = "key string, digest string, since bigint"
_EVENTS = "key string, order bigint, kind string"


def kinds_of(batch: DataFrame, state: DataFrame) -> DataFrame:
    """insert / edit / repeat for each observation (key, digest, order) of a batch, after the state (key, digest) before it.

    Neighbours within the batch are compared in blocks of the order, only the first
    observation of a key looks at the state; all of it are JVM operators.
    """
    rows = batch.select("key", "digest", "order", F.struct("digest").alias("now"))
    rows = split.neighbour(rows, ["key"], ["order"], "now", split.id_block(F.col("order")), "before")
    rows = rows.join(state.select(F.col("key").alias("k"), F.struct("digest").alias("last")), F.col("key") == F.col("k"), "left")
    prior = F.coalesce("before", "last")
    kind = F.when(prior.isNull(), "insert").when(prior["digest"].eqNullSafe(F.col("digest")), "repeat").otherwise("edit")
    return rows.select("key", "order", kind.alias("kind"))


def change_sink(root: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes ``kinds_of`` each batch to ``root/out/batch=n`` and the state after it to ``root/state``.

    The state is a log of the last digest of the keys that each batch had, written as a whole
    every ``COMPACT`` batches, so a batch writes what it changed and reads few folders.  A
    batch that runs again reads the state before it and overwrites its own folders.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        base = n - n % COMPACT if n % COMPACT else max(0, n - COMPACT)
        folders = [f"{root}/state/batch={i}" for i in range(base, n)]
        state = (spark.read.schema(_STATE).parquet(*folders) if folders else spark.createDataFrame([], _STATE)).groupBy("key").agg(F.max_by("digest", "since").alias("digest"), F.max("since").alias("since"))
        rows = batch.select("key", "digest", F.col("order").cast("bigint").alias("order")).where("key is not null and order is not null")
        kinds_of(rows, state).write.mode("overwrite").parquet(f"{root}/out/batch={n}")
        last = rows.groupBy("key").agg(F.max_by("digest", "order").alias("digest")).withColumn("since", F.lit(n).cast("bigint"))
        if n % COMPACT == 0:
            last = last.unionByName(state).groupBy("key").agg(F.max_by("digest", "since").alias("digest"), F.max("since").alias("since"))
        last.select("key", "digest", "since").write.mode("overwrite").parquet(f"{root}/state/batch={n}")
        if n % COMPACT == 0 and n >= 2 * COMPACT:
            for i in range(n - 2 * COMPACT, n - COMPACT):
                remove(spark, f"{root}/state/batch={i}")

    return run


def changes_of(spark: SparkSession, root: str) -> DataFrame:
    """What ``change_sink`` has written so far: key, order, kind."""
    return spark.read.schema(_EVENTS).parquet(f"{root}/out").select("key", "order", "kind")


def cursors(stream: DataFrame) -> DataFrame:
    """The highest change cursor of each channel so far."""
    return stream.groupBy("channel_id").agg(F.max("pts").alias("pts"))


def unseen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the stream had not before."""
    return stream.dropDuplicates(keys)


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything that has landed, batch by batch, then an end; a later call goes on where this one ended."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    """A sink that can be repeated: each batch overwrites its own folder, so a batch that is run again after a failure adds nothing."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
