"""Matrices behind heatmaps, and principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT_ID = "feature"


def aggregate_mode(rows: DataFrame, dpsi: float) -> DataFrame:
    """group_id, sample, psi summed over the features that go with the group's reference feature.

    rows: group_id, feature, start, end, dpsi, ref (largest PSI in the first condition), sample,
    psi.  Groups need a feature with at least ``dpsi``; the reference is the feature with the
    largest ``ref``; features with the sign of its dPSI are summed.
    """
    features = rows.select("group_id", "feature", "start", "end", "dpsi", "ref").distinct()
    strong = features.groupBy("group_id").agg(F.max(F.abs("dpsi")).alias("m"), F.max_by("dpsi", F.struct("ref", "feature")).alias("sign")).where(F.col("m") >= dpsi)
    kept = rows.join(strong, "group_id").where(F.signum("dpsi") == F.signum("sign"))
    span = kept.groupBy("group_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return kept.groupBy("group_id", "sample").agg(F.sum("psi").alias("psi")).join(span, "group_id")


def most_variable(rows: DataFrame, n: int, abundance: bool = False) -> DataFrame:
    """label, feature, spread of the n most variable rows, one a label.

    rows: label, feature, values (array).  Spread is the mean of absolute distances from the
    mean, or variance by mean for abundances.
    """
    k = F.size("values")
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / k
    x = rows.where(k > 1).withColumn("mean", mean)
    if abundance:
        spread = F.aggregate("values", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / (k - 1) / F.nullif("mean", F.lit(0.0))
    else:
        spread = F.aggregate("values", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("mean"))) / k
    one = Window.partitionBy("label").orderBy(F.desc_nulls_last("spread"), "feature")
    best = x.withColumn("spread", spread).withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return best.select("label", "feature", "spread").orderBy(F.desc_nulls_last("spread"), "label").limit(n)


def supervised(rows: DataFrame, p: float, q: float, dpsi: float) -> DataFrame:
    """Rows (label, feature, pvalue, qvalue, dpsi) within all limits, the largest effect of each label."""
    fine = rows.where((F.col("pvalue") <= p) & (F.col("qvalue") <= q) & (F.abs("dpsi") >= dpsi))
    one = Window.partitionBy("label").orderBy(F.abs("dpsi").desc(), "qvalue", "feature")
    return fine.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")


def row_zscores(rows: DataFrame) -> DataFrame:
    """feature, sample, z over rows (feature, sample, value); null without spread."""
    w = Window.partitionBy("feature")
    sd = F.stddev_samp("value").over(w)
    return rows.select("feature", "sample", F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd).alias("z"))


def principal_components(rows: DataFrame, k: int = 5) -> DataFrame:
    """sample, pc (from 1), score, explained over rows (feature, sample, value).

    A sample that a feature lacks counts as the feature's mean.  The samples' Gram matrix is
    summed in each task and over tasks; only that matrix, samples squared, reaches the
    driver.  A component's largest score is positive.
    """
    names = [r[0] for r in rows.select("sample").distinct().orderBy("sample").collect()]
    at = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else F.lit(None)
    wide = rows.groupBy("feature").agg(F.collect_list(F.struct(at[F.col("sample")].alias("i"), "value")).alias("vs"))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(names)))
        for batch in batches:
            lists = batch.column(0)
            x = np.full((len(lists), len(names)), np.nan)
            x[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().field(0).to_numpy(zero_copy_only=False)] = lists.flatten().field(1).to_numpy(zero_copy_only=False)
            x -= np.nanmean(x, 1, keepdims=True)
            x = np.nan_to_num(x)  # what a feature lacks is its mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["k", "v"])

    gram = np.zeros((len(names), len(names)))
    if names:
        sums = wide.select("vs").mapInArrow(outer, "k long, v double")
        for r in sums.groupBy("k").agg(F.sum("v").alias("v")).collect():
            gram[r["k"] // len(names), r["k"] % len(names)] = r["v"]
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)[:k]
    total = max(values.sum(), 1e-300)
    out = []
    for c, o in enumerate(order, 1):
        v = vectors[:, o] * np.sign(vectors[np.abs(vectors[:, o]).argmax(), o]) * np.sqrt(max(values[o], 0))
        out += [(name, c, float(s), float(values[o] / total)) for name, s in zip(names, v, strict=True)]
    return rows.sparkSession.createDataFrame(out, "sample string, pc int, score double, explained double")
