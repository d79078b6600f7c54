"""Token-id output as a content-addressed store (operator 1).

Documents are encoded once, where they lie.  A rolling hash over the ids cuts each
stream into chunks at places that depend on content alone, so copies and shared passages
give the same chunks; every chunk is stored once under its BLAKE2 digest.  A document is
a recipe, the digests of its chunks in order, under a Merkle root; the manifest holds a
Merkle root over the documents of each recipe block, and the seal one over all blocks.
Reading back checks the whole chain: chunk bytes against digests, digests against the
root of their document, documents against their block, blocks against the seal.

Format (four Parquet tables under one folder):

* ``chunks``: digest, n_ids, ids (little-endian, 2 or 4 bytes an id as the vocabulary needs)
* ``recipes``: ascending doc_id within and across ``part``: part, doc_id, start, n_tokens,
  root, digests
* ``manifest``: part, n_docs, n_tokens, first_doc, root
* ``seal``: n_parts, root

Null and empty texts hold the end id alone.  Repeated rows stay apart (one recipe each);
among equal doc_ids the order is that of their roots.  Empty tables give empty stores
without a seal.  A very long text is encoded by itself, in about 30 bytes of memory a byte.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.llm import scratch
from isoframe.llm.arrow import mix, slices
from isoframe.llm.tokenize import encoder

DIGEST_BYTES = 16
#: Ids that the rolling hash sees, and chunk sizes in ids: least, mean (a power of two) and largest.
WINDOW, LEAST, MEAN, MOST = 8, 64, 256, 1024
#: Bytes of text encoded at a time: each distinct word of them is looked up once.
ENCODE_BYTES = 8 << 20
#: Rows of a small table that a join may broadcast.
BROADCAST_ROWS = 1_000_000
#: Hashes of the ids of small vocabularies, looked up instead of computed.
_HASHED = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
_WEIGHTS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
#: Bits of the rolling hash that are all 0 where a chunk may end.
_CUT_BITS = np.uint64((MEAN - 1) << 40)


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Ends of content-defined chunks of one id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    hashed = _HASHED[ids] if ids.dtype.itemsize == 2 else mix(ids.astype(np.uint64) + np.uint64(1))
    rolling = hashed[: n - WINDOW + 1] * _WEIGHTS[0]
    weighed = np.empty_like(rolling)
    for k in range(1, WINDOW):
        rolling += np.multiply(hashed[k : n - WINDOW + 1 + k], _WEIGHTS[k], out=weighed)
    places = np.flatnonzero(rolling & _CUT_BITS == 0) + WINDOW
    ends, at, i = [], 0, 0
    places = places.tolist()
    while n - at > LEAST:
        while i < len(places) and places[i] < at + LEAST:
            i += 1
        end = min(places[i] if i < len(places) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node goes up as it is; no leaf gives the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_LOOSE = "doc_id long, n_tokens long, root binary, digests array<binary>, fresh array<struct<digest: binary, n_ids: int, ids: binary>>"


def _encode_and_cut(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        seen: set[bytes] = set()  # of this task: a digest of each chunk of its own input
        for batch in slices(batches, "text", ENCODE_BYTES):
            sizes, roots, digests, cuts = [], [], [], [0]
            fresh, fresh_sizes, fresh_ids, fresh_cuts = [], [], [], [0]
            for raw in enc.encode(batch.column(1).to_pylist()):
                raw += tail
                ids = np.frombuffer(raw, enc.dtype)
                at, mine = 0, []
                for end in chunk_ends(ids):
                    chunk = raw[at * width : end * width]
                    d = digest(chunk)
                    mine.append(d)
                    if d not in seen:
                        seen.add(d)
                        fresh.append(d)
                        fresh_sizes.append(end - at)
                        fresh_ids.append(chunk)
                    at = end
                sizes.append(len(ids))
                roots.append(merkle_root(mine))
                digests += mine
                cuts.append(len(digests))
                fresh_cuts.append(len(fresh))
            chunks = pa.StructArray.from_arrays([pa.array(fresh, pa.binary()), pa.array(fresh_sizes, pa.int32()), pa.array(fresh_ids, pa.binary())], ["digest", "n_ids", "ids"])
            lists = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), v) for c, v in ((cuts, pa.array(digests, pa.binary())), (fresh_cuts, chunks))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(roots, pa.binary()), *lists], ["doc_id", "n_tokens", "root", "digests", "fresh"])

    return run


@dataclass
class TokenStore:
    """The tables of a written store."""

    chunks: DataFrame
    recipes: DataFrame
    manifest: DataFrame
    seal: DataFrame
    id_bytes: int


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", docs_per_part: int = 100_000) -> TokenStore:
    """Encode ``docs`` and write the store under ``path``.

    One pass encodes; its output (recipes, and chunks that are new to their task) is
    staged, so nothing is encoded twice.  Only chunk payloads are shuffled, by digest, and
    at most once a task and digest, so a chunk that a third of all documents hold is
    spread over no more rows than there are tasks.
    """
    spark = docs.sparkSession
    loose = scratch.stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode_and_cut(tokenizer_path, end_id), _LOOSE), "loose")

    chunks_path, recipes_path, manifest_path = (f"{path}/{t}" for t in ("chunks", "recipes", "manifest"))
    loose.select(F.explode("fresh").alias("c")).select("c.*").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(chunks_path)

    recipes = loose.select("doc_id", "n_tokens", "root", "digests")
    n_parts = max(1, -(-recipes.count() // docs_per_part))
    ranged = recipes.repartitionByRange(max(n_parts, 1), "doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    staged = scratch.stage(ranged, "ranged")
    scratch.drop(loose)
    # sums of whole parts give each part's start; running sums stay within a part
    sums = staged.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = sums.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    running = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        staged.join(starts.select("part", F.coalesce("before", F.lit(0)).alias("before")), "part")
        .withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
        .select("part", "doc_id", "start", "n_tokens", "root", "digests")
    )
    placed.write.option("compression", "zstd").parquet(recipes_path)
    scratch.drop(staged)
    written = spark.read.schema("part int, doc_id long, start long, n_tokens long, root binary, digests array<binary>").parquet(recipes_path)
    blocks = _rooted(written.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"), _in_order("start", "doc_id", "root")), "part int, n_docs long, n_tokens long, first_doc long")
    blocks.coalesce(1).write.parquet(manifest_path)
    _seal(spark.read.schema(_MANIFEST).parquet(manifest_path)).write.parquet(f"{path}/seal")
    return open_store(spark, path, encoder(tokenizer_path).dtype.itemsize)


_MANIFEST = "part int, n_docs long, n_tokens long, first_doc long, root binary"
#: Roots that one task joins at a time (a power of two, so that the tree is that of all leaves).
FAN_IN = 1024


def _in_order(*columns: str):
    """The roots (last column) of a group of bounded size, in the order of the columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*columns))), lambda x: x[columns[-1]]).alias("leaves")


def _rooted(groups: DataFrame, columns: str) -> DataFrame:
    """``groups`` with the Merkle root of their leaves in place of them."""
    names = [c for c in groups.columns if c != "leaves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = pa.array([merkle_root(x) for x in batch.column(len(names)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], roots], [*names, "root"])

    return groups.select(*names, "leaves").mapInArrow(run, columns + ", root binary")


def _seal(manifest: DataFrame) -> DataFrame:
    """n_parts, root: one row over all blocks of a manifest, joined FAN_IN at a time; none for an empty one."""
    n = blocks = manifest.count()
    level = manifest.select(F.col("part").cast("long").alias("k"), "root")
    while True:
        level = _rooted(level.groupBy(F.floor(F.col("k") / FAN_IN).alias("g")).agg(_in_order("k", "root")), "g long").withColumnRenamed("g", "k")
        if n <= FAN_IN:
            return level.select(F.lit(blocks).cast("long").alias("n_parts"), "root")
        n = -(-n // FAN_IN)


def open_store(spark: SparkSession, path: str, id_bytes: int) -> TokenStore:
    return TokenStore(
        spark.read.schema("digest binary, n_ids int, ids binary").parquet(f"{path}/chunks"),
        spark.read.schema("part int, doc_id long, start long, n_tokens long, root binary, digests array<binary>").parquet(f"{path}/recipes"),
        spark.read.schema(_MANIFEST).parquet(f"{path}/manifest"),
        spark.read.schema("n_parts long, root binary").parquet(f"{path}/seal"),
        id_bytes,
    )


def checked_blocks(store: TokenStore) -> DataFrame:
    """part, sound: do the recipes of each block give the root of the manifest, and all blocks that of the seal?"""
    seen = _rooted(store.recipes.groupBy("part").agg(_in_order("start", "doc_id", "root")), "part int").withColumnRenamed("root", "seen")
    sealed = store.seal.join(_seal(store.manifest).withColumnsRenamed({"n_parts": "n", "root": "r"}), F.col("root") == F.col("r")).where("n = n_parts")
    whole = not sealed.isEmpty()
    return seen.join(store.manifest, "part", "left").select("part", (F.coalesce(F.col("seen") == F.col("root"), F.lit(False)) & F.lit(whole)).alias("sound"))


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings one after the other, from their own values.

    The crc is affine: zeros in place of the second string change both sides alike.
    """
    zeros, own = _zeros(second_bytes)
    return zlib.crc32(zeros, first) ^ own ^ second


@lru_cache(maxsize=2 * MOST)
def _zeros(n: int) -> tuple[bytes, int]:
    return bytes(n), zlib.crc32(bytes(n))


def restore(store: TokenStore) -> DataFrame:
    """part, doc_id, start, n_tokens, root, n_chunks and ids (binary) of every document, put together from the stored chunks."""
    named = store.recipes.withColumn("row", F.struct("part", "start"))
    pieces = named.select("part", "doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("seq", "digest"))
    joined = pieces.join(store.chunks, "digest", "left")
    return joined.groupBy("part", "doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "ids"))).alias("parts")).select(
        "part", "doc_id", "start", "n_tokens", "root", F.size("parts").alias("n_chunks"), F.transform("parts", lambda p: p["digest"]).alias("digests"), F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )


def read_back(store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, verified: every document put together from the files and checked.

    Every chunk is read, its digest and its crc32 over 32-bit ids are taken from the stored
    bytes, and a document's crc32 is joined from those of its chunks in recipe order, which
    equals that of the whole stream and moves a few bytes a chunk in place of all ids.
    ``verified`` says that every chunk was found with its digest, that the counts and the
    Merkle root of the recipe agree, and that its block agrees with manifest and seal.
    Where a chunk is missing or damaged, ids_crc32 is null and ``verified`` is false;
    n_tokens is what the recipe says.
    """
    width = store.id_bytes
    kind = "<u2" if width == 2 else "<u4"

    def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(2).to_pylist()
            ids = [np.frombuffer(r, kind) for r in raws]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(r) for r in raws], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), batch.column(0)],
                ["found", "n", "crc", "digest"],
            )

    def join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(5)
            cuts, flat = parts.offsets.to_pylist(), parts.values
            digests, sizes, crcs = (flat.field(i).to_pylist() for i in (1, 2, 3))
            joined, fine = [], []
            for a, b, wanted, root, sound in zip(cuts, cuts[1:], *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=False):
                crc, n = 0, 0
                if None in sizes[a:b]:
                    joined.append(None)
                    fine.append(False)
                    continue
                for k in range(a, b):
                    crc = crc32_joined(crc, crcs[k], 4 * sizes[k]) if n else crcs[k]
                    n += sizes[k]
                joined.append(crc)
                fine.append(bool(sound) and n == wanted and merkle_root(digests[a:b]) == root)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), batch.column(2), pa.array(joined, pa.int64()), pa.array(np.diff(cuts), pa.int32()), pa.array(fine)],
                ["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified"],
            )

    facts = store.chunks.mapInArrow(read_chunks, "found binary, n long, crc long, digest binary").where("found = digest").drop("found")
    sound = scratch.stage(checked_blocks(store), "sound")  # a row a block
    recipes = store.recipes.join(F.broadcast(sound) if sound.count() <= BROADCAST_ROWS else sound, "part", "left")
    pieces = recipes.select("doc_id", "start", "n_tokens", "root", "sound", F.posexplode("digests").alias("seq", "digest"))
    parts = pieces.join(facts, "digest", "left").groupBy("start", "doc_id", "n_tokens", "root", "sound").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "n", "crc"))).alias("parts"))
    return parts.mapInArrow(join_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int, verified boolean")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_back(write_store(docs, public_tokenizers.path("word_bpe_49k.json"), 2, scratch.new_path(spark, "token-store")))
