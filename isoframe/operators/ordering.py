"""Global order without a single task: range partitions, windows inside them, and small tables between them."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a small table (of partitions or groups) is broadcast; beyond it the join is a shuffle.
BROADCAST_ROWS = 100_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def with_groups(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` joined to one row for each of their groups; null keys are a group too."""
    named = small.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    side = F.broadcast(named) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else named
    return rows.join(side, same).drop(*[f"_k{i}" for i in range(len(keys))])


def fixed(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """``df`` checkpointed in the shared folder, so that sampled range bounds stay the same for every use.

    ``batch_rows``: rows of the Arrow batches that go to Python and back, where Spark's usual number is too many.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="isoframe-")  # this machine is the whole cluster
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder)
    if not batch_rows:
        return df.checkpoint()
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(batch_rows))
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def parted(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with _p, the number of its range partition by the columns; all rows of a lower one come first."""
    return fixed(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))


def indexed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with _p and _i, each row's place from 0 in the order of the columns."""
    rows = parted(df, by)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1
    return rows.withColumn("_k", inside).join(F.broadcast(before), "_p").withColumn("_i", F.col("_before") + F.col("_k")).drop("_k", "_before")


def least_after(rows: DataFrame, value: Column, order: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` (with _p) with _least: the smallest value from the row on to the end of the whole order, or of its group in it.

    Frames run from the end backwards, so that each row adds to the one before.
    """
    x = rows.withColumn("_v", value)
    ends = x.groupBy("_p", *by).agg(F.min("_v").alias("_m"))
    later = ends.select("_p", *by, F.min("_m").over(Window.partitionBy(*by).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    own = F.min("_v").over(Window.partitionBy("_p", *by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return with_groups(x.withColumn("_own", own), later, ["_p", *by]).withColumn("_least", F.least("_own", "_later")).drop("_v", "_own", "_later")


def summed_before(rows: DataFrame, value: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``rows`` with _sum: the running sum of a column within ``by`` in an order, up to and with each row; a group of any size is many tasks."""
    x = parted(rows, [*by, *order])
    sums = x.groupBy("_p", *by).agg(F.sum(value).alias("_s"))
    before = sums.select("_p", *by, F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return with_groups(x.withColumn("_own", own), before, ["_p", *by]).withColumn("_sum", F.col("_own") + F.col("_before")).drop("_p", "_own", "_before")


def neighbours(rows: DataFrame, order: Sequence[Column | str], marked: Column) -> DataFrame:
    """``rows`` (with _p) with _lo and _hi: the last ``marked`` value at or before and the first after each row; null values are no marks."""
    x = rows.withColumn("_m", marked)
    ends = x.where("_m is not null").groupBy("_p").agg(F.min("_m").alias("_first"), F.max("_m").alias("_last"))
    parts = rows.select("_p").distinct().join(ends, "_p", "left")  # a row for each partition
    up = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    around = parts.select("_p", F.max("_last").over(up).alias("_before"), F.min("_first").over(down).alias("_after"))
    # both frames grow row by row, one from each end
    rising = [F.col(c) if isinstance(c, str) else c for c in order]
    lo = F.last("_m", ignorenulls=True).over(Window.partitionBy("_p").orderBy(*rising).rowsBetween(Window.unboundedPreceding, 0))
    hi = F.last("_m", ignorenulls=True).over(Window.partitionBy("_p").orderBy(*[c.desc() for c in rising]).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_a", lo).withColumn("_b", hi).join(F.broadcast(around), "_p").withColumn("_lo", F.coalesce("_a", "_before")).withColumn("_hi", F.coalesce("_b", "_after")).drop("_m", "_a", "_b", "_before", "_after")
