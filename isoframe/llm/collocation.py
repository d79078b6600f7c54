"""Phrase collocations from vertical positional lists (operator 11).

Texts become blocks of one language: a block holds, for each word, the list of positions at
which it stands (here as the word's number at each position, gaps between pieces).  A
frequent phrase of k words is extended by merge-joining its positions with the postings of
the words that follow: position p begins a phrase of k + 1 words where a frequent phrase
begins at p and another at p + 1 with no gap between them.  The length of a list is the
phrase's exact frequency in the block; frequencies are summed over blocks, and phrases
below the support end there, as no longer phrase that holds them can reach it.

Only counts by block and phrase are shuffled, once a length: a window over a phrase's rows,
one for each block, sums them and names the phrase by its first block and its number there.
A block gets back just those of its own phrases that are frequent; nothing is broadcast.
Phrases carry the names of their two halves (all words but the last, all but the first),
never hashes.

Null texts are empty; a null language is ``und``; rows that repeat count each time; a very
long text is a block of its own (about 60 bytes of memory a word); an empty table gives no
rows; ids and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.llm import scratch
from isoframe.llm.arrow import flat, gathered, lower_ascii, word_bounds

#: Least frequency of a phrase, most words of one, rows of a language's report, share of a phrase's occurrences from which on a longer one absorbs it.
SUPPORT, LONGEST, TOP, ABSORBED_PERCENT = 30, 4, 2000, 80
#: Bytes of text of a block.
BLOCK_BYTES = 16 << 20
#: Bits of a phrase's name for its number in a block and for the block's number in a task: a name is a task, a block in it and a phrase in that.
LOCAL_BITS, BLOCK_BITS = 28, 12
#: Rows of blocks and phrases that are counted at a time, and slices at most: each reads the rows once more.
SLICE_ROWS, MOST_SLICES = 15_000_000, 4
#: Entries of a batch.
_BATCH = 1 << 16

#: Separators of pieces, and of words within a piece.
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _ENDS_PIECE.copy()
_BETWEEN[[0x20, 0x09]] = True

#: A row of a block's codes (the number at each position, -1 in a gap), or of one of its phrases with the count there.
_LEVEL = "block long, lang string, local int, word string, a long, b long, n long, codes binary"
_NAMES = [c.split(" ")[0] for c in _LEVEL.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _batches(block: int, lang: str | None, codes: np.ndarray, n: np.ndarray, words: pa.Array | None = None, a: np.ndarray | None = None, b: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    def batch(rows: int, **given) -> pa.RecordBatch:
        given |= {"block": pa.array(np.full(rows, block)), "lang": pa.array([lang] * rows, pa.string())}
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, k) for c, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)

    if len(n) >> LOCAL_BITS:
        raise ValueError("too many phrases in a block")
    yield batch(1, codes=pa.array([zstandard.ZstdCompressor(level=1).compress(codes.astype("<i4").tobytes())], pa.binary()))
    for at in range(0, len(n), _BATCH):
        cut = slice(at, at + _BATCH)
        halves = {} if a is None else {"a": pa.array(a[cut]), "b": pa.array(b[cut])}
        named = {} if words is None else {"word": words[cut]}
        yield batch(len(n[cut]), local=pa.array(np.arange(at, at + len(n[cut])), pa.int32()), n=pa.array(n[cut]), **halves, **named)


def postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, their counts, and the word number at each position with -1 in the gaps between pieces."""
    data, offsets = flat(texts)
    data = lower_ascii(data)
    starts, ends, first = word_bounds(data, offsets, _BETWEEN)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    letters = data[~_BETWEEN[data]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    listed = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(letters.tobytes())).dictionary_encode()
    of = listed.indices.to_numpy().astype(np.int32)
    piece = np.cumsum(_ENDS_PIECE[data])[starts] + np.searchsorted(offsets, starts, "right")
    gaps = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    codes = np.full(len(of) + int(gaps[-1]), -1, np.int32)
    codes[np.arange(len(of)) + gaps] = of
    return listed.dictionary.cast(pa.string()), np.bincount(of, minlength=len(listed.dictionary)), codes


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = block = TaskContext.get().partitionId() << BLOCK_BITS
    held: dict[str, tuple[int, list]] = {}

    def close(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal block
        if block - first >> BLOCK_BITS:
            raise ValueError("too many blocks in a task: read smaller partitions")
        words, n, codes = postings(pa.chunked_array(held.pop(lang)[1]).combine_chunks())
        yield from _batches(block, lang, codes, n, words)
        block += 1

    for batch in gathered(batches, "text", BLOCK_BYTES):
        for lang in pc.unique(batch.column(0)).to_pylist():
            texts = batch.filter(pc.equal(batch.column(0), lang)).column(1).cast(pa.large_string())
            size = pc.sum(pc.binary_length(texts)).as_py() or 0
            if lang in held and held[lang][0] + size > BLOCK_BYTES:
                yield from close(lang)
            before, parts = held.get(lang, (0, []))
            held[lang] = before + size, [*parts, texts]
        while sum(s for s, _ in held.values()) > 2 * BLOCK_BYTES:
            yield from close(max(held, key=lambda k: held[k][0]))
    for lang in list(held):
        yield from close(lang)


def extend(codes: np.ndarray, local: np.ndarray, gid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Halves, counts and positions of the phrases that are one word longer, from positions of phrases and the frequent ones among them."""
    by = np.argsort(local)
    local, gid = local[by], gid[by]
    lut = np.full(int(max(codes.max(initial=-1), local.max(initial=-1))) + 2, -1, np.int64)
    lut[local] = np.arange(len(local))
    here = lut[codes]  # a gap's -1 meets the last entry, which is -1
    both = (here[:-1] >= 0) & (here[1:] >= 0) if len(here) else np.zeros(0, bool)
    at = np.flatnonzero(both)
    keys, of, n = np.unique(here[at] * max(1, len(local)) + here[at + 1], return_inverse=True, return_counts=True)
    # positions of longer phrases, with one gap wherever they don't follow each other
    gaps = np.concatenate([[0], np.cumsum(np.diff(at) > 1)]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    out = np.full(len(at) + (int(gaps[-1]) if len(at) else 0), -1, np.int32)
    out[np.arange(len(at)) + gaps] = of
    return gid[keys // max(1, len(local))], gid[keys % max(1, len(local))], n, out


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            kept = batch.column(2)[i].values
            codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(1)[i].as_py()), "<i4").astype(np.int64)
            a, b, n, out = extend(codes, kept.field(0).to_numpy(), kept.field(1).to_numpy())
            if len(n):
                yield from _batches(batch.column(0)[i].as_py(), None, out, n, a=a, b=b)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n of all words; a list of tables by number of words): the first has id, lang, word, f, the others id, a, b, f with the ids of both halves."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    level = scratch.stage(texts.mapInArrow(_words, _LEVEL), "words")
    totals = scratch.stage(level.where("codes is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")  # a row a language
    tables = []
    for words in range(1, longest + 1):
        key = ["lang", "word"] if words == 1 else ["a", "b"]
        same = Window.partitionBy(*key)
        own = F.shiftleft("block", LOCAL_BITS) + F.col("local")
        entries = level.where("codes is null")
        slices = min(MOST_SLICES, 1 + entries.count() // SLICE_ROWS)
        parts = []
        for part in range(slices):  # phrases of one slice at a time, so that the shuffle files of only one lie on disk
            rows = entries.where(F.pmod(F.xxhash64(*key), F.lit(slices)) == part) if slices > 1 else entries
            named = rows.select("block", "local", *key, F.sum("n").over(same).alias("f"), own.alias("own"), F.min(own).over(same).alias("id"))
            parts.append(scratch.stage(named.where(F.col("f") >= support), f"found-{words}"))
        found = reduce(DataFrame.unionByName, parts)
        tables.append(found.where("own = id").select("id", *key, "f"))
        if words < longest:
            blocks = scratch.stage(level.where("codes is not null").select("block", "codes"), "codes")
            scratch.drop(level)  # the counts of this length have done their work
            n_blocks = max(1, blocks.count())
            kept = found.select("block", "local", "id").repartition(n_blocks, "block").groupBy("block").agg(F.collect_list(F.struct("local", "id")).alias("kept"))
            longer = blocks.repartition(n_blocks, "block").join(kept, "block").select("block", "codes", "kept").mapInArrow(_extended, _LEVEL)
            level = scratch.stage(longer, f"level-{words + 1}")
            scratch.drop(blocks)
    scratch.drop(level)
    return totals, tables


def _half(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """``df`` with the columns of one half's row, prefixed by the side."""
    return df.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))


def candidates(tables: list[DataFrame]) -> DataFrame:
    """id, lang, words, phrase, a, cuts (array of l, r by number of first words) and whether a longer phrase absorbs it, of phrases of two words or more."""
    # lead[k]: frequency of the first k + 1 words; tail[k]: of the last k + 1
    rows = tables[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("lead"), F.array("f").alias("tail"))
    out = []
    for words, table in enumerate(tables[1:], 2):
        rows = (
            table.join(_half(rows, "a", ["lang", "phrase", "lead"]), "a")
            .join(_half(rows, "b", ["last", "tail"]), "b")
            .select("id", F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"), "f",
                    F.concat("a_lead", F.array("f")).alias("lead"), F.concat("b_tail", F.array("f")).alias("tail"), F.col("a_lead").alias("lefts"), F.col("b_tail").alias("rights"))
        )
        rows = scratch.stage(rows, f"candidates-{words}")
        cuts = F.arrays_zip(F.col("lefts").alias("l"), F.reverse("rights").alias("r"))
        here = rows.select("id", "lang", "phrase", F.lit(words).alias("words"), F.col("f").alias("a"), cuts.alias("cuts"))
        if words < len(tables):  # a phrase that absorbs it by two words more implies one that does so by one
            longer = tables[words].select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            here = here.join(longer, "id", "left").withColumn("absorbed", F.coalesce(100 * F.col("longer") >= ABSORBED_PERCENT * F.col("a"), F.lit(False))).drop("longer")
        else:
            here = here.withColumn("absorbed", F.lit(False))
        out.append(here)
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_


def ranked(found: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` candidates that no longer phrase absorbs.

    The score is floor(2000000 a / (l + r)) at the cut where it is lowest, the first such
    cut if several are; products are decimals of 38 digits.
    """
    scored = F.transform("cuts", lambda c, k: F.struct(F.call_function("div", F.lit(2_000_000).cast("decimal(18,0)") * F.col("a").cast("decimal(20,0)"), (c["l"] + c["r"]).cast("decimal(20,0)")).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = found.where("not absorbed").withColumn("cut", F.array_min(scored))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    first = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # tasks keep their own first rows before the shuffle
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``ranked`` rows of all frequent phrases of ``docs``."""
    totals, tables = frequent_phrases(docs, text_col, lang_col, support, longest)
    return ranked(candidates(tables), totals, top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every phrase of one to four words by its positions in pieces.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), often AS (SELECT * FROM phrases WHERE f >= 30),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE k = 1 GROUP BY lang),
parts AS (
  SELECT o.lang, o.k, o.phrase, o.f AS a, c.cut, array_to_string(string_split(o.phrase, ' ')[:c.cut], ' ') AS x, array_to_string(string_split(o.phrase, ' ')[c.cut + 1:], ' ') AS y
  FROM often o, (SELECT unnest([1, 2, 3]) AS cut) c WHERE o.k >= 2 AND c.cut < o.k
), scored AS (
  SELECT p.*, l.f AS l, r.f AS r, ((2000000::HUGEINT * p.a) // (l.f + r.f))::BIGINT AS score
  FROM parts p JOIN often l ON l.lang = p.lang AND l.phrase = p.x JOIN often r ON r.lang = p.lang AND r.phrase = p.y
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT lang, phrase FROM (
    SELECT o.lang, o.f, array_to_string(string_split(o.phrase, ' ')[s.i:s.i + m.k - 1], ' ') AS phrase
    FROM often o, (SELECT unnest([1, 2, 3]) AS i) s, (SELECT unnest([2, 3]) AS k) m WHERE m.k < o.k AND s.i + m.k - 1 <= o.k
  ) longer JOIN often USING (lang, phrase) WHERE 100 * longer.f >= 80 * often.f
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
