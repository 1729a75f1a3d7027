"""Intermediate results that must be stable are written as Parquet tables.

The folder is the one the cluster names in ``spark.checkpoint.dir``, so every
executor can read the table again after another one is lost.  Only a local
session that names no folder gets a temporary one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
# Folders of the tables that were written, with the names of the bucketed ones.
_written: list[tuple[str, str | None]] = []
_CODEC = "zstd"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Text of a bucket, about, and the most buckets Spark takes.
BUCKET_BYTES = 128_000_000
MOST_BUCKETS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables of this session."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def session_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session, once no result needs them."""
    while _written:
        name = _written.pop()[1]
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    _delete(spark, session_dir(spark))


def tables_written() -> int:
    """Number of tables written so far, for `drop_before_last` and `drop_since`."""
    return len(_written)


def drop_since(spark: SparkSession, first: int, last: int | None = None) -> None:
    """Delete the tables written since there were ``first``, up to ``last``."""
    passed = _written[first:last]
    del _written[first:last]
    for path, name in passed:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)


def drop_before_last(spark: SparkSession, first: int) -> None:
    """`drop_since` but for the last table, which was made from the others."""
    drop_since(spark, first, -1)


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """What is written inside is not run again, so its shuffle files are deleted as soon as it is written.

    Else they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return it as a table scan.

    Cuts the lineage, fixes values that depend on the physical partitioning,
    and gives the optimizer a true size to choose join strategies by.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with run_once(spark):
        df.write.parquet(path, compression=_CODEC)
    _written.append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def buckets_for(spark: SparkSession, size: int) -> int:
    """Number of buckets for ``size`` bytes of text; at least one for each core."""
    return min(max(-(-size // BUCKET_BYTES), spark.sparkContext.defaultParallelism), MOST_BUCKETS)


def write_buckets(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Write ``df`` once as a table bucketed by ``key``, of which joins and groups by ``key`` need no shuffle.

    ``df`` must be partitioned by ``key`` into as many parts, as by
    ``repartition(buckets, key)`` or by a plan over such a table; then nothing is shuffled and every bucket is one file.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    name = f"corpusloom_{path.rsplit('-', 1)[-1]}"
    with run_once(spark):
        df.write.bucketBy(buckets, key).options(path=path, compression=_CODEC).saveAsTable(name, format="parquet")
    _written.append((path, name))
    return spark.table(name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the cluster has cores.

    Scans with enough splits are returned unchanged, so large tables are never
    shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
