"""Event counts kept up to date while comparisons arrive: a file stream and a merge by micro-batch.

The batch operators are the queries; this only re-uses them on what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isoframe.functions.thresholds import Thresholds
from isoframe.operators.programs import landscape

SCHEMA = "comparison string, event_type string, gene_id string, gene_symbol string, fdr double, dpsi double, event_uid string"


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, t: Thresholds) -> StreamingQuery:
    """Write the landscape of each new batch of event tables (Parquet, ``SCHEMA``) under ``out``, one folder a batch.

    A batch that is repeated after a failure overwrites its own folder, so counts are exact.
    """

    def write(batch: DataFrame, number: int) -> None:
        landscape(batch, t).write.mode("overwrite").parquet(f"{out}/batch={number}")

    events = spark.readStream.schema(SCHEMA).parquet(folder)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The landscape over all batches so far."""
    return spark.read.parquet(out).groupBy("comparison", "event_type").agg(F.sum("n_total").alias("n_total"), F.sum("n_sig").alias("n_sig"))
