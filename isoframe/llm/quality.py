"""Quality rules: base statistics and a calibrated hashed n-gram classifier (operator 3).

Rules on counts come first.  What they pass is scored by logistic regression on hashed
words, word pairs and byte trigrams (relative frequencies in each of the three groups),
trained on labelled rows that pass the rules themselves, calibrated by a logistic fit on
rows that the regression didn't see, and held against a fixed threshold.

Words are ``[^\\x20\\x09-\\x0D]+`` as written.  Training uses a bounded sample (``SAMPLE``
rows of each class with the smallest hashes of their ids); every text is counted and scored
whole, in Arrow batches, a very long one in a slice of its own (about 60 bytes of memory a
byte).  Null and empty texts have no words and fail the rules; repeated rows get equal
verdicts; without labelled rows of both classes the rules alone decide; an empty table
gives no rows; other columns are kept as they are, but ``judge`` replaces those that have
the names of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isoframe.llm.arrow import flat, mix, shingle_hashes, slices, span_hashes, word_bounds
from isoframe.llm.folds import labelled_sample
from isoframe.llm.tokenize import forget

#: Labelled rows of each class, at most, that the model learns from.
SAMPLE = {0: 1500, 1: 3000}
#: Hash buckets of each of the three feature groups.
BUCKETS_LOG2 = 15
#: Fixed values of the base rules, and the threshold on the calibrated probability of good quality.
LEAST_WORDS, MOST_REPEATED_PERCENT, KEEP_AT = 50, 50, 0.4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_GROUPS = 3


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs, key by key."""
    if not len(keys):
        return np.zeros(0, np.int64)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse]


class Counted:
    """Words, base statistics and hashed features of one Arrow batch of texts."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = flat(texts)
        data, offsets = self.data, self.offsets
        self.starts, self.ends, self.first = word_bounds(data, offsets)
        self.words = span_hashes(data, self.starts, self.ends)
        self.rows = len(offsets) - 1
        self.row_of_word = np.repeat(np.arange(self.rows), np.diff(self.first))

    def statistics(self) -> dict[str, np.ndarray]:
        data, offsets, first = self.data, self.offsets, self.first
        n_words = np.diff(first)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        chars = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
        # lines: cut at \n and at the ends of rows
        ends = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([offsets[:-1], ends + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.append(line_starts[1:], len(data))
        line_ends = np.where((line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10), line_ends - 1, line_ends) if len(line_starts) else line_ends
        row_of_line = np.searchsorted(offsets, line_starts, "right") - 1
        worded = np.searchsorted(self.starts, line_ends) > np.searchsorted(self.starts, line_starts)
        keys = mix(span_hashes(data, line_starts, line_ends) + row_of_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[worded] if len(line_starts) else np.zeros(0, np.uint64)
        _, at = np.unique(keys, return_index=True)
        again = np.ones(len(keys), bool)
        again[at] = False
        dup_lines = np.bincount(row_of_line[worded][again], minlength=self.rows) if len(line_starts) else np.zeros(self.rows, np.int64)
        # words in three-word windows that occur twice or more in their text
        marked = np.zeros(len(self.words), bool)
        if len(self.words) >= 3:
            whole = self.row_of_word[2:] == self.row_of_word[:-2]
            windows = np.flatnonzero(whole)
            keys = mix(shingle_hashes(self.words, 3)[windows] + self.row_of_word[windows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            twice = windows[_repeats(keys) >= 2]
            for k in range(3):
                marked[twice + k] = True
        return {
            "n_words": n_words,
            "word_chars": _sums(chars, offsets),
            "n_symbols": _sums(_SYMBOL[data], offsets),
            "n_dup_lines": dup_lines,
            "n_repeat_words": _sums(marked, first),
        }

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each group: bucket of every feature, and where each row's features start."""
        shift = np.uint64(64 - BUCKETS_LOG2)
        words = (mix(self.words + np.uint64(1)) >> shift).astype(np.int64)
        pairs = shingle_hashes(self.words, 2)
        if len(pairs):
            pairs = pairs[self.row_of_word[1:] == self.row_of_word[:-1]]
        pair_first = np.concatenate([[0], np.cumsum(np.maximum(np.diff(self.first) - 1, 0))])
        d = self.data.astype(np.uint32)
        grams = (((d[:-2] << 16) | (d[1:-1] << 8) | d[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2) if len(d) > 2 else np.zeros(0, np.uint32)
        # trigrams may run over the end of a row: they are left out by their place
        return [(words, np.stack([self.first[:-1], self.first[1:]])), ((pairs >> shift).astype(np.int64), np.stack([pair_first[:-1], pair_first[1:]])), (grams, np.stack([np.minimum(self.offsets[:-1], len(grams)), np.clip(self.offsets[1:] - 2, np.minimum(self.offsets[:-1], len(grams)), None)]))]


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED_PERCENT * stats["n_words"])


def _scores(counted: Counted, weights: np.ndarray) -> np.ndarray:
    out = np.full(counted.rows, float(weights[-1]))
    for g, (bucket, (a, b)) in enumerate(counted.features()):
        total = np.zeros(len(bucket) + 1)
        np.cumsum(weights[g << BUCKETS_LOG2 : (g + 1) << BUCKETS_LOG2][bucket], out=total[1:])
        out += (total[b] - total[a]) / np.maximum(b - a, 1)
    return out


def _parts(texts: list[str | None]) -> Iterator[pa.Array]:
    """The texts in slices of bounded size."""
    for batch in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), "text"):
        yield batch.column(0)


def _sparse(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of a sample: where each row's features start and end, features, shares."""
    for part in _parts(texts):
        counted = Counted(part)
        groups = counted.features()
        ends, cols, values = [0], [], []
        for r in range(counted.rows):
            for g, (bucket, (a, b)) in enumerate(groups):
                f, n = np.unique(bucket[a[r] : b[r]], return_counts=True)
                cols.append(f.astype(np.int32) + np.int32(g << BUCKETS_LOG2))
                values.append((n / max(1, b[r] - a[r])).astype(np.float32))
            ends.append(ends[-1] + sum(map(len, cols[-len(groups) :])))
        yield np.array(ends), np.concatenate(cols), np.concatenate(values)


def fit(texts: list[str | None], good: np.ndarray, steps: int = 120) -> np.ndarray:
    """Weights of all buckets and a bias: regression by Adam on all rows, slice by slice, classes weighed equally."""
    parts = list(_sparse(texts))
    w = np.zeros((_GROUPS << BUCKETS_LOG2) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(good == 1, 0.5 / max(1, good.sum()), 0.5 / max(1, (1 - good).sum()))
    for step in range(1, steps + 1):
        g, at = 1e-7 * w, 0
        for ends, cols, values in parts:
            n = len(ends) - 1
            total = np.zeros(len(cols) + 1)
            np.cumsum(w[cols] * values, out=total[1:])
            z = total[ends[1:]] - total[ends[:-1]] + w[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[at : at + n]) * weight[at : at + n]
            g[:-1] += np.bincount(cols, np.repeat(error, np.diff(ends)) * values, len(w) - 1)
            g[-1] += error.sum()
            at += n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def _calibrate(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's fit of scores to probabilities."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - good) * z).sum() + 1e-3 * (a - 1), (p - good).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole bounded sample, in one task."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    weights = np.zeros(0, np.float32)
    if texts:
        passed = ~np.concatenate([base_failed(Counted(part).statistics()) for part in _parts(texts)])
        texts, good = [t for t, p in zip(texts, passed, strict=True) if p], np.array(labels, float)[passed]
        if 0 < good.sum() < len(good):
            rest = np.arange(len(good)) % 4 == 3
            w = fit([t for t, r in zip(texts, rest, strict=True) if not r], good[~rest])
            held = [t for t, r in zip(texts, rest, strict=True) if r]
            a, b = (1.0, 0.0)
            if held and 0 < good[rest].sum() < rest.sum():
                a, b = _calibrate(np.concatenate([_scores(Counted(part), w) for part in _parts(held)]), good[rest])
            w = w * a
            w[-1] += b
            weights = w.astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Calibrated weights; empty without labelled rows of both classes."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), "quality", SAMPLE)
    rows = sample.repartition(1).sortWithinPartitions("h").select("text", "label").mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(bytes(rows[0][0]), np.float32).astype(float) if rows else np.zeros(0)


_ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, good double, kept boolean"


def judge(docs: DataFrame, weights: np.ndarray, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, good (probability), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # fixed size: 3 * 2**BUCKETS_LOG2 numbers
    added = StructType.fromDDL(_ADDED)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        w = shared.value
        for batch in slices(batches, "text"):
            counted = Counted(batch.column(batch.schema.get_field_index("text")))
            stats = counted.statistics()
            failed = base_failed(stats)
            good = 1 / (1 + np.exp(-np.clip(_scores(counted, w), -30, 30))) if len(w) else np.ones(counted.rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(x.astype(np.int64)) for x in stats.values()], pa.array(failed), pa.array(good), pa.array(~failed & (good >= keep_at))],
                [*batch.schema.names, *stats, "base_failed", "good", "kept"],
            )

    return docs.mapInArrow(run, StructType([*docs.schema, *added]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, train(docs, labels)).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Rows of ``docs`` that the rules and the model keep, all columns as they are."""
    rows = docs.select(F.struct("*").alias("row"), "text")  # the caller's columns can't clash
    return judge(rows, train(docs, labels), keep_at).where(F.col("kept")).select("row.*")
