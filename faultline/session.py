"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("faultline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # the JVM compiles no larger methods to machine code
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Rows that a task of a dealt-out scan reads at most.
ROWS_A_TASK = 25_000
#: Rows that a task of a scan may read before the scan is dealt out, however even it is.
MOST_ROWS = 4 * ROWS_A_TASK


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a scan of which one task reads more than its share.

    A row group is read by one task, however many splits its file has, so other
    tasks of the scan may be empty.  The rows of each task are counted, which
    reads no column.  A scan that is even enough stays as it is, unless its tasks
    read more than ``MOST_ROWS``: splits are limited by bytes, so the tasks of
    narrow tables would grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df.groupBy(F.spark_partition_id().alias("task")).count()
    found = tasks.agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    if 2 * cores * (found.most or 0) <= (found.rows or 0) and (found.most or 0) <= MOST_ROWS:
        return df
    return df.repartition(cores * -(-found.rows // (cores * ROWS_A_TASK)))


@cache
def _local_root() -> str:
    """One folder for all sessions of this process; the setting itself cannot change in a running session."""
    return tempfile.mkdtemp(prefix="faultline-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder every executor shares.

    The cluster names that folder; a machine-local one is used only when the
    whole session runs on one machine and names none.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/faultline/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str, by: Sequence[str] = (), compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the scratch folder, in folders by the columns ``by``, and read it back.

    For a table that several branches of a job read: it is computed once, its
    columns stay prunable, and losing an executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside hand Python at most ``rows`` rows at once, as a batch of long texts is held several times over."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    most = int(before)
    spark.conf.set(setting, str(min(rows, most) if most > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


#: Largest table that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def fits_broadcast(stored: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table is small enough to be sent to every executor, by its rows and texts."""
    texts = [F.coalesce(F.octet_length(n), F.lit(0)) for n, kind in stored.dtypes if kind in ("string", "binary")]
    row = sum(texts, F.lit(16 * len(stored.columns)))
    return (stored.agg(F.sum(row).alias("bytes")).first().bytes or 0) <= limit
