"""Language identification by compression (operator 10).

Each language has a zstandard raw-content dictionary of running text from its labelled rows.
A text is compressed window by window with every dictionary; the language with the
smallest total wins.  The score is the winner's share of a softmax over bytes saved, and a
prediction whose margin over the runner-up is narrow is marked as rejected.

Dictionaries come from a bounded sample: ``SAMPLE`` rows of each language with the smallest
hashes, a window of each at a place anywhere in its text that the hash gives, ``DICT_BYTES``
a language and less where there are so many languages that all together would pass
``TOTAL_BYTES``.  Every text is classified whole.  Null texts and texts without a letter
are ``und`` with score 0; ties go to the more frequent language; repeated rows get equal
answers and count once in training; without labelled rows everything is ``und``; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.arrow import slices
from isoframe.llm.folds import is_held_out

#: Rows of each language that dictionaries learn from, characters of each row's window, bytes of each dictionary and of all.
SAMPLE, ROW_CHARS, DICT_BYTES, TOTAL_BYTES = 400, 400, 48_000, 48_000_000
#: Bytes compressed at a time, so that a long text's own repeats don't hide the dictionary.
WINDOW = 1024
#: A margin under this many bytes for each 1,000 bytes of text is narrow.
NARROW = 10.0

UNDETERMINED = "und"


def train(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary of each language in ``lang``, the most frequent language first.

    The share of each language's rows that gives about twice ``SAMPLE`` of them is taken by
    hash, in one scan, and the smallest hashes of those are kept.  Shares are cut from all 64
    bits of the hash, so that what is collected stays of that size for any number of rows.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    if not counts:
        return {}
    each = min(DICT_BYTES, max(1, TOTAL_BYTES // len(counts)))
    rows = -(-SAMPLE * each // DICT_BYTES)
    sizes = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * rows / r["count"])) for r in counts], "lang string, share double")
    h = F.xxhash64("doc_id", "text")
    windows = known.select("lang", "text", h.alias("h"), F.length("text").alias("n")).join(F.broadcast(sizes), "lang").where(F.col("h").cast("double") <= F.col("share") * 2.0**64 - 2.0**63)
    place = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.col("n") - ROW_CHARS + 1)) + 1
    windows = windows.select("lang", "h", F.substring("text", place.cast("int"), F.lit(ROW_CHARS)).alias("t")).distinct()
    found: dict[str, list] = {r["lang"]: [] for r in counts}
    for r in windows.collect():  # about 2 * SAMPLE windows a language, TOTAL_BYTES twice at most
        found[r["lang"]].append((r["h"], r["t"]))
    return {k: b" ".join(t.lower().encode() for _, t in sorted(v)[:rows])[-each:] for k, v in found.items() if v}


class Compressors:
    """One compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        params = z.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=2, min_match=4, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.names, self.by_name = list(dictionaries), []
        for data in dictionaries.values():
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by_name.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text with each dictionary."""
        raw = text.lower().encode()
        return np.array([sum(len(c(raw[at : at + WINDOW])) for at in range(0, len(raw), WINDOW)) for c in self.by_name], float)


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most TOTAL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(shared.value)
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                if not model.names or text is None or not any(map(str.isalpha, text)):
                    rows.append((UNDETERMINED, 0.0, 0.0, True))
                    continue
                n = model.sizes(text)
                best = int(n.argmin())
                margin = float(np.delete(n, best).min() - n[best]) if len(n) > 1 else float(len(text.encode()))
                score = float(1 / np.exp(-np.clip((n - n[best]) / 4, 0, 50)).sum())
                rows.append((model.names[best], score, margin, margin * 1000 < NARROW * len(text.encode())))
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = classify(docs.select("doc_id", "text"), train(docs.where(~is_held_out())))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
