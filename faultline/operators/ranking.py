"""Top rows per key together with totals over all rows of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import write_once


def head_with_totals(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    totals: dict[str, Column],
    buckets: Sequence[Column],
) -> DataFrame:
    """First ``limit`` rows per key as ``rank``, each with sums over the whole key.

    ``buckets`` split a key from fine to coarse.  Each stage ranks inside its
    buckets and passes on at most ``limit`` rows per bucket plus the bucket's
    sums, so a key with a third of all rows is spread over many tasks and the
    rows are read once.  The result does not depend on the buckets.
    """
    names = list(totals)
    staged = rows.withColumns(
        {f"_b{i}": b for i, b in enumerate(buckets)}
        | {f"_t_{n}": totals[n] for n in names}
    )
    stages = [[*keys, f"_b{i}"] for i in range(len(buckets))] + [list(keys)]
    for parts in stages:
        whole = Window.partitionBy(*parts)
        ranked = staged.withColumn("rank", F.row_number().over(whole.orderBy(*order)))
        sums = {f"_t_{n}": F.sum(f"_t_{n}").over(whole) for n in names}
        staged = (
            ranked.withColumns(sums)
            .where(F.col("rank") <= limit)
            # only one row of a bucket hands the bucket's sums to the next stage
            .withColumns(
                {f"_t_{n}": F.when(F.col("rank") == 1, F.col(f"_t_{n}")) for n in names}
            )
            if parts != stages[-1]
            else ranked.withColumns(sums).where(F.col("rank") <= limit)
        )
    return staged.select(
        *rows.columns,
        F.col("rank").cast("bigint").alias("rank"),
        *[F.coalesce(f"_t_{n}", F.lit(0)).cast("bigint").alias(n) for n in names],
    )


def head(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """First ``limit`` rows per key as ``rank``; Spark prunes before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("rank", F.row_number().over(window).cast("bigint"))
        .where(F.col("rank") <= limit)
    )


def numbered(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", total: str | None = None
) -> DataFrame:
    """Place of every row within its key as ``name``, 1 first; no task holds a whole key.

    With ``total``, also the number of rows of the key.

    Rows are sorted over all tasks by key and order, so one large key spans many
    of them.  A row's place is its place in its task plus the rows of the key in
    earlier tasks, which a table of one row per key and task adds up.  The order
    should be total; equal rows are numbered arbitrarily.
    """
    ordered = (
        rows.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    stored = write_once(ordered, "ordered")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        stored.groupBy(*keys, "_part")
        .agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    )
    place = F.col("_row") - F.col("_first") + F.col("_before") + 1
    more = [F.col("_all").cast("bigint").alias(total)] if total else []
    return stored.join(pieces, [*keys, "_part"]).select(
        *rows.columns, place.cast("bigint").alias(name), *more
    )


def placed(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | None, name: str = "rank"
) -> DataFrame:
    """Rows with their place in the key: the first ``limit``, or all of them."""
    if limit is None:
        return numbered(rows, keys, order, name)
    return head(rows, keys, order, limit).withColumnRenamed("rank", name)
