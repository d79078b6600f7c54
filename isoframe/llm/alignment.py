"""Alignment of the tokens of two tokenizers over the same bytes (operator 12).

Vocabulary A is a byte-level BPE file, vocabulary B a sentencepiece file with byte
fallback; both see a space and the text.  Each byte gets a label: none, end of an A token,
end of a B token, or both.  A regular expression scans the label string for spans up to
each both-label; a span is a token group, and its labels say how many tokens of either
side it holds.  Inside a group of a and b tokens exactly a + b - 1 pairs of tokens overlap.

Texts are cut at a single space that follows no space and is followed by a letter, digit
or mark: no token of either vocabulary crosses it (checked for B when it is read), so each
distinct unit of a block of texts is encoded, labelled and scanned once.  A block is one
row: the unit numbers of its documents, and its id pairs with the number of its documents
that hold them linked.  Counts of pairs are summed over blocks, and only a block's own
pairs come back to it, so nothing is broadcast, a pair that all documents hold is one row a
block, and a block's memory is bounded by BLOCK_BYTES of text or one longer text.

Null and empty texts, and texts whose tokens' bytes differ from space and text, have no
tokens: zeros and an empty string.  Null ids and repeated rows are documents of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm import scratch
from isoframe.llm.arrow import flat, gathered
from isoframe.llm.tokenize import UnitEncoder, byte_alphabet

#: Bytes of text of a block.
BLOCK_BYTES = 4 << 20
#: Units that a worker remembers.
MEMO_UNITS = 200_000
#: Labels of a byte: end of no token, of an A token, of a B token, of both.
LABELS = b".ab|"
_GROUP = re.compile(rb"[^|]*\|")

#: Bytes after which a space may be followed by white space: the text isn't cut before that space.
_BLANK_NEXT = np.zeros(256, bool)
_BLANK_NEXT[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Tokenizers:
    """Both vocabularies, with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor

        self.a = UnitEncoder(a_path, MEMO_UNITS)
        self.a.plain.encode_special_tokens = True  # the strings of special tokens are plain text
        self.a.added = []
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        names = {i: t for t, i in self.a.plain.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = Table([_byte_level(names.get(i, ""), byte_of) for i in range(max(names) + 1)])
        self.b_bytes = Table([bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])
        # an id and what follows it: another id of its side, the other side, the next group
        a, b = len(self.a_bytes.size), len(self.b_bytes.size)
        self.texts = Table([f"{i}{mark}".encode() for n, mark in ((a, ","), (a, "|"), (b, ","), (b, ";")) for i in range(n)])
        #: No piece goes on over a space after something else.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode_a(self, unit: str) -> bytes:
        """Ids of a unit that begins with a space."""
        rest = unit[1:]
        return self.a.memo[rest] if rest and not rest[0].isspace() and " " not in rest else self.a.whole(unit)


class Table:
    """Byte strings by number, one after another."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([len(p) for p in parts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[expand(self.at[numbers], self.size[numbers])]


def _byte_level(token: str, byte_of: dict[str, int]) -> bytes:
    return bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()


def _equal(table: Table, ids: np.ndarray, n: np.ndarray, units: list[bytes]) -> np.ndarray:
    """Are the bytes of each unit's ids the unit?"""
    found, want = table.joined(ids), np.frombuffer(b"".join(units), np.uint8)
    if len(found) == len(want) and (found == want).all():
        ends = np.cumsum(table.size[ids])[np.cumsum(n) - 1] if len(ids) else np.zeros(0)
        if (n > 0).all() and (ends == np.cumsum([len(u) for u in units])).all():
            return np.ones(len(units), bool)
    cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
    return np.array([table.joined(ids[i:j]).tobytes() == u for i, j, u in zip(cuts, cuts[1:], units, strict=False)], bool)


def label_string(n: int, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """A label for each of n bytes."""
    labels = np.zeros(n, np.uint8)
    labels[a_ends - 1] |= 1
    labels[b_ends - 1] |= 2
    return np.frombuffer(LABELS, np.uint8)[labels].tobytes()


class Units:
    """Groups and links of distinct units: everything that a document needs is a sum or a join over its units."""

    def __init__(self, both: Tokenizers, units: list[bytes]):
        texts = [u.decode() for u in units]
        a_raw = [both.encode_a(t) for t in texts]
        b_lists = both.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        self.n_a = np.array([len(r) for r in a_raw], np.int64) // both.a.dtype.itemsize
        self.n_b = np.array([len(x) for x in b_lists], np.int64)
        a_ids = np.frombuffer(b"".join(a_raw), both.a.dtype).astype(np.int64)
        b_ids = np.fromiter(itertools.chain.from_iterable(b_lists), np.int64, int(self.n_b.sum()))
        self.exact = _equal(both.a_bytes, a_ids, self.n_a, units) & _equal(both.b_bytes, b_ids, self.n_b, units)
        # units that don't keep their bytes have no tokens
        a_ids, b_ids = a_ids[np.repeat(self.exact, self.n_a)], b_ids[np.repeat(self.exact, self.n_b)]
        size = np.where(self.exact, [len(u) for u in units], 0).astype(np.int64)
        self.n_a, self.n_b = self.n_a * self.exact, self.n_b * self.exact
        a_ends, b_ends = np.cumsum(both.a_bytes.size[a_ids]), np.cumsum(both.b_bytes.size[b_ids])
        ends = np.array([m.end() for m in _GROUP.finditer(label_string(int(size.sum()), a_ends, b_ends))], np.int64)
        # label counts of each span: tokens of either side that end in it
        a_to, b_to = np.searchsorted(a_ends, ends, "right"), np.searchsorted(b_ends, ends, "right")
        in_a, in_b = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        self.n_groups = np.diff(np.searchsorted(ends, np.cumsum(size), "right"), prepend=0)
        self.n_links = self.n_a + self.n_b - self.n_groups
        # the text of a group: its A ids, then its B ids, each with the mark that follows it
        n_a, n_b = len(both.a_bytes.size), len(both.b_bytes.size)
        code = np.zeros(len(a_ids) + len(b_ids), np.int64)
        a_place = np.arange(len(a_ids)) + np.repeat(b_to - in_b, in_a)
        b_place = np.arange(len(b_ids)) + np.repeat(a_to, in_b)
        code[a_place], code[b_place] = a_ids, b_ids + 2 * n_a
        code[a_place[a_to - 1]] += n_a
        code[b_place[b_to - 1]] += n_b
        written = both.texts.joined(code).tobytes()
        stops = np.concatenate([[0], np.cumsum(both.texts.size[code])])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        self.text = [written[i:j] for i, j in zip(stops, stops[1:], strict=False)]
        # a link for each end of a token in a group: the tokens of both sides that hold that byte
        stops = np.union1d(a_ends, b_ends)
        links = (a_ids[np.searchsorted(a_ends, stops)] << 32) | b_ids[np.searchsorted(b_ends, stops)] if len(stops) else np.zeros(0, np.int64)
        self.pairs, self.links = np.unique(links, return_inverse=True)
        self.link_at = np.cumsum(self.n_links) - self.n_links


def documents_of(doc: np.ndarray, pair: np.ndarray, n_docs: int, n_pairs: int) -> np.ndarray:
    """In how many documents each pair stands, of (document, pair) rows that may repeat, in order of documents."""
    if n_docs * n_pairs > 64 * len(pair):
        return np.bincount(np.unique(doc * max(1, n_pairs) + pair) % max(1, n_pairs), minlength=n_pairs)
    out, step = np.zeros(n_pairs, np.int64), max(1, (1 << 22) // max(1, n_pairs))
    for low in range(0, n_docs, step):  # a table of flags for some documents at a time
        i, j = np.searchsorted(doc, [low, low + step])
        flags = np.zeros((step, n_pairs), bool)
        flags[doc[i:j] - low, pair[i:j]] = True
        out += flags.sum(axis=0)
    return out


def unit_cuts(data: np.ndarray, starts: np.ndarray, cut_inside: bool) -> np.ndarray:
    """Where units begin: at each text, and at each space that no token crosses; texts begin with a space."""
    at = np.zeros(len(data) + 1, bool)
    if cut_inside and len(data) > 2:
        space = data == 0x20
        at[1 : len(data) - 1] = space[1:-1] & ~space[:-2] & ~_BLANK_NEXT[data[2:]]
    at[starts] = True
    return np.flatnonzero(at[: len(data)])


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 .. (sizes[0] of them), starts[1], ..."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def block_row(both: Tokenizers, batch: pa.RecordBatch) -> dict:
    """One row for a batch of (doc_id, text): documents, their units, the units' links, and the block's pairs with their documents."""
    texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
    full = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    data, offsets = flat(full)
    cuts = unit_cuts(data, offsets[:-1][np.diff(offsets) > 0], both.cuts)
    bounds = np.append(cuts, len(data)).astype(np.int64)
    listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
    of = listed.indices.to_numpy().astype(np.int64)
    units = Units(both, listed.dictionary.to_pylist())
    at = np.searchsorted(cuts, offsets)  # units before each document
    doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
    wrong = np.zeros(batch.num_rows, bool)
    wrong[doc[~units.exact[of]]] = True
    keep = ~wrong[doc]
    of, doc = of[keep], doc[keep]
    sizes = np.bincount(doc, minlength=batch.num_rows)
    at = np.concatenate([[0], np.cumsum(sizes)])
    strings, parts = units.text, of.tolist()
    digests = [hashlib.sha256(b"".join(map(strings.__getitem__, parts[i:j]))[:-1]).hexdigest() if j > i else "" for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]
    sums = [np.bincount(doc, x[of], batch.num_rows).astype(np.int64) for x in (units.n_a, units.n_b, units.n_groups, units.n_links)]
    links = units.links[expand(units.link_at[of], units.n_links[of])]
    held = documents_of(np.repeat(doc, units.n_links[of]), links, batch.num_rows, len(units.pairs))
    return {
        "docs": pa.StructArray.from_arrays([batch.column(0), *map(pa.array, sums), pa.array(digests, pa.string()), pa.array(sizes)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "n_units"]),
        "units": _packed(of), "n_links": _packed(units.n_links), "links": _packed(units.links), "pairs": units.pairs, "held": held,
    }


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4").astype(np.int64)


_DOC = "doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, sha: string, n_units: long"
_BLOCK = f"block long, docs array<struct<{_DOC}>>, units binary, n_links binary, links binary, pairs array<long>, held array<long>"


_KNOWN: dict[tuple[str, str], Tokenizers] = {}


def _blocks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = a_path, b_path
        both, block = _KNOWN.get(key) or _KNOWN.setdefault(key, Tokenizers(a_path, b_path)), TaskContext.get().partitionId() << 32
        for batch in gathered(batches, "text", BLOCK_BYTES):
            row = block_row(both, batch)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), one(row["docs"]), *(pa.array([row[c]], pa.binary()) for c in ("units", "n_links", "links")), one(pa.array(row["pairs"], pa.int64())), one(pa.array(row["held"], pa.int64()))],
                ["block", "docs", "units", "n_links", "links", "pairs", "held"],
            )
            block += 1

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block, with what the corpus says of their links."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            docs, known = (row.column(k).values.slice(row.column(k).offsets[0].as_py(), row.column(k).value_lengths()[0].as_py() or 0) if row.column(k).is_valid()[0].as_py() else None for k in (0, 4))
            units, n_links, links = (_unpacked(row.column(k)[0].as_py()) for k in (1, 2, 3))
            count, best = np.zeros((2, len(known) if known is not None else 0), np.int64)
            if known is not None:
                place = known.field(0).to_numpy()
                count[place], best[place] = known.field(1).to_numpy(), known.field(2).to_numpy()
            ends = np.cumsum(n_links)
            of_unit = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[np.concatenate([[0], ends])]) for x in (best, count)]
            sizes = docs.field(6).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[units])])[ends]) if len(x) else np.zeros(len(sizes), np.int64) for x in of_unit]
            yield pa.RecordBatch.from_arrays([*(docs.field(k) for k in range(5)), *(pa.array(x.astype(np.int64)) for x in sums), docs.field(5)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; a_id, b_id, count, is_best of every linked id pair)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = scratch.stage(texts.mapInArrow(_blocks(a_path, b_path), _BLOCK), "aligned")
    n_blocks = max(1, blocks.count())
    own = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select("block", "place", "x.pairs", "x.held")
    counts = own.groupBy("pairs").agg(F.sum("held").alias("count"))
    most = counts.groupBy(F.shiftright("pairs", 32).alias("a_id")).agg(F.max("count").alias("most"))
    weights = scratch.stage(counts.withColumn("a_id", F.shiftright("pairs", 32)).join(most, "a_id").select("pairs", "a_id", "count", (F.col("count") == F.col("most")).alias("is_best")), "pair-counts")
    known = own.select("block", "place", "pairs").join(weights, "pairs").repartition(n_blocks, "block").groupBy("block").agg(F.collect_list(F.struct("place", "count", F.col("is_best").cast("long").alias("best"))).alias("known"))
    met = blocks.select("block", "docs", "units", "n_links", "links").repartition(n_blocks, "block").join(known, "block", "left")
    out = met.select("docs", "units", "n_links", "links", "known").mapInArrow(_judge, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out, weights.select("a_id", F.expr("pairs & 4294967295").alias("b_id"), "count", "is_best")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
