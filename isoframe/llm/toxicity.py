"""Toxicity by compression distance (operator 5).

Text is written as a stream of word codes: each run of letters gives 4-byte hashes of its
first 3, 4 and 5 bytes and of the whole, so inflected forms share their head and literals
carry no letter statistics.  Two zstandard raw-content dictionaries are trained, one on
toxic and one on ordinary labelled rows, by one rule:

* each begins with windows of its own class's text, three words each: those around the word
  heads that this class has often and the other one hardly ever, counted by distinct
  contexts (the words before and after), so that a text copied many times counts once;
* both end with the same ordinary running text, since toxic documents consist mostly of
  ordinary words; being nearest, it costs the same in both and cancels out.

A document is compressed window by window with both; a window's distance is the bytes that
the toxic dictionary saves.  Largest and summed distance give a score, calibrated by
logistic regression on other training rows; fixed thresholds judge the score.

Labels come from a bounded sample (``SAMPLE`` rows of each class with the smallest hashes);
every document is scored whole, a very long one in a slice of its own (about 60 bytes of
memory a byte).  Null and empty texts have no window and get the score of no evidence;
repeated rows get equal scores; without labelled rows of both classes the score is 0; an
empty table gives no rows; other columns are kept by ``keep_civil`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from isoframe.llm.arrow import flat, mix, slices, span_hashes
from isoframe.llm.folds import is_held_out, labelled_sample
from isoframe.llm.tokenize import forget

#: Labelled rows of each class, at most, that the dictionaries and the calibration learn from.
SAMPLE = {1: 2000, 0: 4000}
#: Words a scored window; bytes of ordinary running text in both dictionaries; windows of each head in its class's dictionary.
WINDOW, ORDINARY_BYTES, WINDOWS_EACH = 64, 100_000, 2
#: A head is a class's own if its text has it this many times as often as the other's, in so many contexts for each row of the class.
ODDS, SHARE = 25, 0.01
#: Fixed thresholds on the calibrated score.
TOXIC_AT, REJECT_AT = 0.3, 0.5

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEADS = (3, 4, 5)


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (words x 4, 32 bits each) of all letter runs, and the first word number of each row."""
    data = _LOWER[data]
    inside = _LETTER[data]
    n = len(data)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1 if n else np.zeros(0, np.int64)
    size = ends - starts
    codes = [(span_hashes(data, starts, np.minimum(ends, starts + k)) + (size < k).astype(np.uint64)) >> np.uint64(32) for k in _HEADS]
    codes.append(span_hashes(data, starts, ends) >> np.uint64(32))
    return np.stack(codes, 1).astype("<u4"), np.searchsorted(starts, offsets)


def _slices_of(texts: list[str]) -> Iterator[pa.Array]:
    for batch in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), "text"):
        yield batch.column(0)


def _contexts(texts: list[str]) -> np.ndarray:
    """Codes (word before, word, word after) of all words, one row for each different triple."""
    rows, keys = [np.zeros((0, 3, 4), np.uint32)], [np.zeros(0, np.uint64)]
    for part in _slices_of(texts):
        codes, first = word_codes(*flat(part))
        before, after = np.roll(codes, 1, 0), np.roll(codes, -1, 0)
        before[first[:-1][first[:-1] < len(codes)]] = 0
        after[first[1:][first[1:] > 0] - 1] = 0
        words = np.stack([before, codes, after], 1)
        whole = words[:, :, 3].astype(np.uint64)
        rows.append(words)
        keys.append(mix(whole[:, 1] + mix(whole[:, 0] + np.uint64(1)) * np.uint64(3) + mix(whole[:, 2] + np.uint64(2)) * np.uint64(5)))
    _, at = np.unique(np.concatenate(keys), return_index=True)
    return np.concatenate(rows)[at]


def own_heads(own: np.ndarray, other: np.ndarray, n_rows: int) -> list[tuple[int, np.ndarray]]:
    """Contexts and codes of the heads, from 3 bytes to the whole word, that one class's text has and the other's hardly ever, rarest first."""
    t, o = own[:, 1], other[:, 1]
    least = max(4, SHARE * n_rows)
    out: dict[bytes, tuple[int, np.ndarray]] = {}
    for level in range(4):
        code, at, n = np.unique(t[:, level], return_index=True, return_counts=True)
        known, m = np.unique(o[:, level], return_counts=True)
        place = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
        usual = np.where(known[place] == code, m[place], 0) if len(known) else np.zeros(len(code))
        strong = (n >= least) & ((n + 0.5) / (len(t) + 1) >= ODDS * (usual + 0.5) / (len(o) + 1))
        for i in np.flatnonzero(strong):
            head = t[at[i], : level + 1]
            # the longest of heads that nest, while it keeps most of the contexts of the shorter one
            for k in range(1, level + 1):
                shorter = out.get(head[:k].tobytes())
                if shorter and n[i] >= 0.5 * shorter[0]:
                    del out[head[:k].tobytes()]
            if not any(head[:k].tobytes() in out for k in range(1, level + 1)):
                out[head.tobytes()] = (int(n[i]), head)
    return sorted(out.values(), key=lambda x: x[0])


def _windows(own: np.ndarray, heads: list[tuple[int, np.ndarray]], stop: set[int]) -> bytes:
    """Windows of a class's text around its own heads; neighbours that running text doesn't hold are left out, as chance brings them."""
    out = []
    for _, head in heads:
        found = np.flatnonzero(own[:, 1, len(head) - 1] == head[-1])[:WINDOWS_EACH]
        for before, word, after in own[found]:
            out += [w.tobytes() for w in (before, word, after) if w is word or int(w[3]) in stop]
    return b"".join(out)


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    t, o = _contexts(toxic), _contexts(ordinary)
    marks, usual = own_heads(t, o, len(toxic)), own_heads(o, t, len(ordinary))
    running, size = [], 0
    for i in np.random.default_rng(7).permutation(len(ordinary)):
        codes = np.concatenate([word_codes(*flat(part))[0] for part in _slices_of([ordinary[i]])])
        for _, m in marks:
            codes = codes[codes[:, len(m) - 1] != m[-1]]
        running.append(codes)
        size += codes.nbytes
        if size > ORDINARY_BYTES:
            break
    running = np.concatenate(running)
    stop = set(running[:, 3].tolist())
    return tuple(_windows(c, heads, stop) + running.tobytes() for c, heads in ((t, marks), (o, usual)))


class Distance:
    """Bytes that the toxic dictionary saves over the ordinary one, by window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=17, search_log=3, min_match=6, target_length=16, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(data: bytes):
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return z.ZstdCompressor(dict_data=d, compression_params=params).compress

        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text: largest distance of a window, summed distance (log), windows with evidence (log)."""
        codes, first = word_codes(*flat(texts))
        out = np.zeros((len(texts), 3))
        for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            gains = []
            for at in range(a, b, WINDOW):
                window = codes[at : min(at + WINDOW, b)].tobytes()
                gains.append(len(self.ordinary(window)) - len(self.toxic(window)))
            if gains:
                g = np.maximum(np.array(gains), 0)
                out[row] = g.max(), np.log1p(g[g >= 4].sum()), np.log1p((g >= 4).sum()) - 0.25 * np.log1p(len(g))
        return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias last) by Newton's method with a ridge."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole bounded sample, in one task: dictionaries from three quarters, calibration on the rest."""
    rows = [(t or "", y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    parts = {(y, rest): [t for i, (t, l) in enumerate(rows) if l == y and (i % 4 == 3) == rest] for y in (0, 1) for rest in (False, True)}
    if not parts[1, False] or not parts[0, False]:
        yield pa.RecordBatch.from_arrays([pa.array([b""]), pa.array([b""]), pa.array([[]], pa.list_(pa.float64()))], ["toxic", "ordinary", "weights"])
        return
    toxic, ordinary = train_dictionaries(parts[1, False], parts[0, False])
    distance = Distance(toxic, ordinary)
    texts = parts[1, True] + parts[0, True]
    found = np.concatenate([distance.features(part) for part in _slices_of(texts)]) if texts else np.zeros((0, 3))
    weights = logistic(found, np.array([1.0] * len(parts[1, True]) + [0.0] * len(parts[0, True])))
    yield pa.RecordBatch.from_arrays([pa.array([toxic]), pa.array([ordinary]), pa.array([weights.tolist()], pa.list_(pa.float64()))], ["toxic", "ordinary", "weights"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, np.ndarray]:
    sample = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), "toxic", SAMPLE)
    model = sample.repartition(1).sortWithinPartitions("h").select("text", "label").mapInArrow(_train, "toxic binary, ordinary binary, weights array<double>").collect()
    if not model or not model[0]["weights"]:
        return b"", b"", np.zeros(0)
    return bytes(model[0]["toxic"]), bytes(model[0]["ordinary"]), np.array(model[0]["weights"])


def score(docs: DataFrame, model: tuple[bytes, bytes, np.ndarray]) -> DataFrame:
    """``docs`` (text among its columns; one called score is replaced) with a column score: the calibrated probability that a document is toxic."""
    docs = docs.drop("score")
    toxic, ordinary, weights = model
    shared = docs.sparkSession.sparkContext.broadcast((toxic, ordinary))  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        distance = Distance(*shared.value) if len(weights) else None
        for batch in slices(batches, "text"):
            if distance is None:
                p = np.zeros(batch.num_rows)
            else:
                x = distance.features(batch.column(batch.schema.get_field_index("text")))
                p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("score", DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_held_out())
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """Rows of ``docs`` that aren't toxic, all columns as they are."""
    model = train(docs, labels.where(~is_held_out()))
    rows = docs.select(F.struct("*").alias("row"), "text")  # the caller's columns can't clash
    return score(rows, model).where(F.col("score") < reject_at).select("row.*")
