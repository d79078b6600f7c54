"""Distances of samples over all features, and their multidimensional scaling.

Rows have feature, sample and value; a value that is null, NaN or missing counts as 0, as
in a table filled with 0.  Features are summed in tasks: what leaves a task is a sum or two
for each pair of samples, never a row for a feature and a pair.  Scaling works on the
matrix of samples alone, of at most MOST_SAMPLES, each random start a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.operators.ordering import fixed

#: Samples whose matrix of distances a task holds (32 MB).
MOST_SAMPLES = 2000
#: Values that a task works on at a time.
SLICE = 1 << 18

Part = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: What each metric sums over features, for one sample (a column) against all.
SUMS: dict[str, list[Part]] = {
    "manhattan": [lambda a, x: np.abs(a - x)],
    "euclidean": [lambda a, x: (a - x) ** 2],
    "seuclidean": [lambda a, x: _shares((a - x) ** 2, x.var(1, ddof=1, keepdims=True) if x.shape[1] > 1 else 0 * a)],
    "cosine": [lambda a, x: a * x, lambda a, x: a * a + 0 * x, lambda a, x: x * x + 0 * a],
    "correlation": [lambda a, x: a * x, lambda a, x: a * a + 0 * x, lambda a, x: x * x + 0 * a, lambda a, x: a + 0 * x, lambda a, x: x + 0 * a, lambda a, x: np.ones_like(x)],
    "hamming": [lambda a, x: a != x, lambda a, x: np.ones_like(x)],
    "jaccard": [lambda a, x: (a != x) & ((a != 0) | (x != 0)), lambda a, x: (a != 0) | (x != 0)],
    "canberra": [lambda a, x: _shares(np.abs(a - x), np.abs(a) + np.abs(x))],
    "braycurtis": [lambda a, x: np.abs(a - x), lambda a, x: np.abs(a + x)],
    "chebyshev": [lambda a, x: np.abs(a - x)],
}
SUMS["sqeuclidean"] = SUMS["euclidean"]
SUMS["cityblock"] = SUMS["manhattan"]


def _shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.where(b > 0, b, 1), 0.0)


def _ratio(a, b):
    return F.when(b != 0, a / b).otherwise(0.0)


def _distance(metric: str):
    """Distance of a pair from its sums s0, s1, ...; 0 where a ratio has nothing below."""
    s = [F.col(f"s{k}") for k in range(len(SUMS[metric]))]
    if metric in ("euclidean", "seuclidean"):
        return F.sqrt(s[0])
    if metric in ("hamming", "jaccard", "braycurtis"):
        return _ratio(s[0], s[1])
    if metric == "cosine":
        return 1 - _ratio(s[0], F.sqrt(s[1] * s[2]))
    if metric == "correlation":
        n = s[5]
        return 1 - _ratio(s[0] - s[3] * s[4] / n, F.sqrt((s[1] - s[3] * s[3] / n) * (s[2] - s[4] * s[4] / n)))
    return s[0]


def sample_distances(rows: DataFrame, metric: str = "manhattan") -> DataFrame:
    """sample, other, distance of all ordered pairs of different samples of rows (feature, sample, value)."""
    if metric not in SUMS:
        raise ValueError(f"unknown metric {metric}")
    names = [r[0] for r in rows.select(F.col("sample").cast("string")).distinct().orderBy("sample").limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    n, parts = len(names), SUMS[metric]
    at = {name: i for i, name in enumerate(names)}
    wide = rows.groupBy("feature").agg(F.collect_list(F.struct(F.col("sample").cast("string").alias("s"), F.col("value").cast("double").alias("v"))).alias("vs"))
    join = np.maximum if metric == "chebyshev" else np.add

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(parts), n, n))
        for batch in batches:
            step = max(1, SLICE // max(n, 1))
            for begin in range(0, batch.num_rows, step):
                lists = batch.column(0).slice(begin, step)
                flat = lists.flatten()
                x = np.zeros((len(lists), n))
                lengths = np.diff(lists.offsets.to_numpy())
                x[np.repeat(np.arange(len(lists)), lengths), [at[s] for s in flat.field(0).to_pylist()]] = np.nan_to_num(flat.field(1).to_numpy(zero_copy_only=False).astype(float))
                for i in range(n):
                    for k, part in enumerate(parts):
                        found = part(x[:, i : i + 1], x).astype(float)
                        total[k, i] = join(total[k, i], found.max(0) if metric == "chebyshev" else found.sum(0))
        i, j = np.triu_indices(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(t[i, j]) for t in total]], ["i", "j", *[f"s{k}" for k in range(len(parts))]])

    gather = F.max if metric == "chebyshev" else F.sum
    sums = wide.select("vs").mapInArrow(pairs, "i long, j long, " + ", ".join(f"s{k} double" for k in range(len(parts))))
    sums = sums.groupBy("i", "j").agg(*[gather(f"s{k}").alias(f"s{k}") for k in range(len(parts))])
    known = F.array(*[F.lit(x) for x in names]).cast("array<string>")
    name = lambda c: F.get(known, F.col(c).cast("int"))
    # both directions of a pair
    half = sums.select("i", "j", _distance(metric).alias("distance"))
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    return both.select(name("i").alias("sample"), name("j").alias("other"), "distance")


def majorised(d: np.ndarray, x: np.ndarray, rounds: int, least: float) -> tuple[np.ndarray, list[float]]:
    """(places, stress after each round) of a matrix of distances, from starting places: each round is a Guttman transform, so stress never rises.

    It ends when stress, as a share of the summed distances of the places, falls by less than ``least``.
    """
    n, course, before = len(d), [], None
    for _ in range(rounds):
        now = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0))
        b = -np.where(now > 0, d / np.where(now > 0, now, 1), 0.0)
        b[np.arange(n), np.arange(n)] -= b.sum(1)
        x = b @ x / n
        now = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0))
        course.append(float(((now - d) ** 2).sum() / 2))
        share = course[-1] / max(now.sum(), 1e-300)
        if before is not None and before - share < least:
            break
        before = share
    return x, course


def scaled(distances: DataFrame, k: int = 5, seed: int = 42, starts: int = 4, rounds: int = 300, least: float = 1e-3) -> DataFrame:
    """sample, pc (from 1), score, stress of samples in ``k`` dimensions, from distances (sample, other, distance) of all ordered pairs.

    Multidimensional scaling by stress majorisation from ``starts`` random starts; the one
    that ends with the least stress counts (of equal ones the first).  A pair without a
    distance counts as 0.  Samples without any pair aren't there.
    """
    held = distances.groupBy("sample").agg(F.collect_list(F.struct("other", "distance")).alias("to"))
    held = fixed(held)
    if (n := held.count()) > MOST_SAMPLES:
        raise ValueError(f"{n} samples: scaling takes up to {MOST_SAMPLES}")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample", ignore_index=True)
        at = {s: i for i, s in enumerate(part["sample"])}
        d = np.zeros((len(at), len(at)))
        for i, to in enumerate(part["to"]):
            for r in to:
                if r["other"] in at and r["distance"] is not None:
                    d[i, at[r["other"]]] = r["distance"]
        start = int(part["start"].iloc[0])
        random = np.random.RandomState(seed)
        for _ in range(start + 1):  # starts follow each other in one stream
            x = random.uniform(size=(len(at), k))
        x, course = majorised(d, x, rounds, least)
        return pd.DataFrame({"start": start, "sample": np.repeat(part["sample"].to_numpy(), k), "pc": np.tile(np.arange(1, k + 1), len(at)), "score": x.ravel(), "stress": course[-1]})

    each = held.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(starts)])))
    ends = fixed(each.groupBy("start").applyInPandas(run, "start int, sample string, pc int, score double, stress double"))
    best = ends.agg(F.min_by("start", F.struct("stress", "start")).alias("start"))  # one row
    return ends.join(F.broadcast(best), "start").select("sample", "pc", "score", "stress")
