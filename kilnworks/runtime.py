"""Session settings, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its bound, in rows, is at most this.
BROADCAST_ROWS = 200_000

_local_scratch: dict[str, str] = {}
# Intermediate tables of this driver that no scope has deleted yet.
_made: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings that results, or the choice of joins, depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    # Joins hash a side instead of sorting both where no partition of it is larger.
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    # Joins of sides that lie by some of their keys don't move them to lie by all.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kilnworks")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KILNWORKS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    return configure(builder.getOrCreate())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from ``spark.checkpoint.dir``. Only a local session may fall back to a
    machine-local folder: on a cluster other machines could not read it.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="kilnworks-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    # Tables over a folder bear its name.
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"drop table if exists `{name}`")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made inside, at its end or on an error.

    Results that read them have to be written or fetched before.
    """
    begun = len(_made)
    try:
        yield
    finally:
        made = _made[begun:]
        del _made[begun:]
        for path in made:
            _delete(spark, path)


def written(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Write a table to the shared folder; return it re-read, with its row count.

    Cuts the lineage of loops. The files survive the loss of executors, and the
    count is read from their footers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return stored, stored.count()


def written_by(df: DataFrame, label: str, key: str, placed: bool = False) -> DataFrame:
    """Like :func:`written`, in buckets of the key: work by the key leaves rows in place.

    ``placed`` rows come from such a table and were not moved since.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if placed else df.repartition(n, key)
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def unbroadcast(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside broadcast no side but those with a hint.

    The planner takes the size of compressed files, which may be a thirtieth of the rows
    that the driver would have to hold.
    """
    with _set(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        yield


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside use buckets, below unions too, and of some of a join's
    keys, instead of moving rows or broadcasting them."""
    wanted = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    }
    with unbroadcast(spark), _set(spark, wanted):
        yield


def maybe_broadcast(df: DataFrame, row_bound: int) -> DataFrame:
    """Broadcast hint only below the bound; otherwise the planner decides."""
    return F.broadcast(df) if row_bound <= BROADCAST_ROWS else df


def spread(table: DataFrame) -> DataFrame:
    """Use every core for costly per-row work on a table of few file splits.

    A no-op on a table with at least as many splits as cores.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
