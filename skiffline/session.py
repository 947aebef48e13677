"""Session helpers: a tuned local session, table loading and scratch storage.

Scratch tables cut lineage between iterations.  They live in the shared folder
that the cluster names in ``spark.checkpoint.dir`` so that a lost executor loses
no finished round; a machine-local folder is only used by a local master.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "skiffline", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` wins; else the context's checkpoint folder; else, on
    a local master only, a temporary folder that is then registered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skiffline-"))
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables, under one that belongs to the application and goes when this process ends."""
    own = f"{scratch_root(spark)}/skiffline-{spark.sparkContext.applicationId}"
    if own not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(own)
        atexit.register(_end, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


_OWN_FOLDERS: set[str] = set()


def _end(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before, then whoever owns the folder clears it
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every intermediate table of this application; results that still read one are lost."""
    remove(spark, f"{scratch_root(spark)}/skiffline-{spark.sparkContext.applicationId}")


class Scratch:
    """Writes a DataFrame to the shared folder and reads it back.

    ``drop`` removes a table that nothing reads any more, so an iteration of many rounds
    holds two rounds on disk at most; the rest goes with the application's folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = scratch_folder(spark, label)
        self.count = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str | None) -> None:
        if path is not None:
            remove(self.spark, path)


_BUILT: dict = {}


def built_once(spark: SparkSession, sf_dir: str, names: list[str], label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once in an application for the files that its source tables have now."""
    files = []
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    key = (spark.sparkContext.applicationId, label, tuple(files))
    if key not in _BUILT or not _exists(spark, _BUILT[key][0]):
        df = build()
        path = scratch_folder(spark, label)
        df.write.parquet(path)
        _BUILT[key] = (path, df.schema)
    path, schema = _BUILT[key]
    return spark.read.schema(schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
