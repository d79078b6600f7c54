"""Best-fit packing by a grouping genetic algorithm (operator 8).

Documents become token streams (ids and an end id).  Streams longer than a sequence are
cut into pieces of exactly one sequence, the first piece taking the rest; whole-sequence
pieces stand alone.  All other pieces form blocks of bounded size, dealt by hash or (with
``keep_order``, so that a mix that the input's order holds stays a mix) in the order in
which they are read, and each block is a
bin-packing problem of its own that several islands solve: a solution is the bin of every
piece, crossover injects well-filled bins of one parent into the other, removes the bins
that hold an injected piece already, and puts the displaced pieces back best-fit, longest
first.  After every round each island receives its neighbour's elite.  A block that has
reached the lower bound of its problem is solved.  All bins of a block that are filled
less than LOOSE, and its emptiest until the space of what it has over its bound
goes along, then go to a next level, dealt by hash as whole bins: a block that finds
nothing better keeps them.  A level that saves less than one bin a block sends on only the
emptiest quarter of each block, so that levels shrink until one block is left.

Null and empty texts hold the end id alone; repeated rows are packed as often as they
occur; a very long text is encoded by itself, in up to 50 bytes of memory a byte (where each
letter is a part of its own); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm import scratch
from isoframe.llm.arrow import gathered, release
from isoframe.llm.tokenize import MEMO_UNITS, encoder

CAPACITY = 1024
#: Pieces a block, islands a block, rounds between migrations, generations a round, solutions an island.
BLOCK, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 4096, 3, 3, 12, 6
#: Bins filled less than this go to the next level, and a block's emptiest in any case.
LOOSE = 0.98
#: Rows of text that go to a Python worker at a time: about 2 MB of texts of the usual length.
BATCH_ROWS = 500
#: Bytes of text encoded at a time: each distinct part of them is looked up once.
ENCODE_BYTES = 4 << 20

_PIECES = "uid long, doc_id long, piece int, start long, length int, crc long"


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of a stream of n ids."""
    rest = n % capacity
    out = [(0, rest)] if rest else []
    return out + [(at, capacity) for at in range(rest, n, capacity)]


def _pieces(path: str, end_id: int, capacity: int, memo_units: int = MEMO_UNITS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        enc = encoder(path, memo_units)
        tail = np.array([end_id], enc.dtype).tobytes()
        uid = TaskContext.get().partitionId() << 40
        for batch in gathered(batches, "text", ENCODE_BYTES):
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                wide = np.frombuffer(raw + tail, enc.dtype).astype("<u4").tobytes()
                for i, (at, n) in enumerate(piece_bounds(len(wide) // 4, capacity)):
                    rows.append((uid, doc_id, i, at, n, zlib.crc32(wide[4 * at : 4 * (at + n)])))
                    uid += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "doc_id", "piece", "start", "length", "crc"])

    return run


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Martello and Toth's L2 bound on the number of bins."""
    if not len(lengths):
        return 0
    best = -(-int(lengths.sum()) // capacity)
    for alpha in np.unique(lengths[lengths <= capacity // 2]):
        big = lengths[lengths > capacity - alpha]
        middle = lengths[(lengths > capacity // 2) & (lengths <= capacity - alpha)]
        small = lengths[(lengths >= alpha) & (lengths <= capacity // 2)]
        spare = len(middle) * capacity - int(middle.sum())
        best = max(best, len(big) + len(middle) + max(0, -(-(int(small.sum()) - spare) // capacity)))
    return max(best, int((lengths > capacity // 2).sum()))


def best_fit(free: list[int], items: list[int], lengths: list[int], capacity: int) -> list[int]:
    """Bins of the items, each put in the order given into the fullest bin that takes it; ``free`` of the bins is updated, bins are opened as needed."""
    by_free: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(free):
        if f:
            by_free.setdefault(f, []).append(b)
            mask |= 1 << f
    out = []
    for i in items:
        n = lengths[i]
        fitting = mask >> n
        if fitting:
            f = n + (fitting & -fitting).bit_length() - 1
            same = by_free[f]
            b = same.pop()
            if not same:
                mask ^= 1 << f
        else:
            b, f = len(free), capacity
            free.append(capacity)
        out.append(b)
        free[b] = f = f - n
        if f:
            by_free.setdefault(f, []).append(b)
            mask |= 1 << f
    return out


#: A solution: the bin of every piece, and what is free in every bin.
Solution = tuple[np.ndarray, np.ndarray]


def fitness(free: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean of squared fills, negated: smaller is better."""
    fill = 1 - free / capacity
    return len(free), -float((fill * fill).mean()) if len(free) else 0.0


def crossover(into: Solution, other: Solution, lengths: list[int], capacity: int, rng: np.random.Generator) -> Solution:
    """Inject some of the other parent's best-filled bins, then repair; pieces are numbered longest first."""
    place, free = into
    o_place, o_free = other
    take = np.argsort(o_free + rng.random(len(o_free)), kind="stable")[: max(1, int(len(o_free) * rng.uniform(0.1, 0.6)))]
    number = np.full(len(o_free), -1)
    number[take] = np.arange(len(take))
    injected = number[o_place] >= 0
    gone = np.zeros(len(free), bool)
    gone[place[injected]] = True
    # the emptiest kept bins are dissolved too, which lets their pieces fill other gaps
    kept = np.flatnonzero(~gone)
    emptiest = kept[np.argsort(free[kept], kind="stable")[len(kept) - max(1, len(kept) // 50) :]]
    gone[emptiest[free[emptiest] > 0]] = True
    left = ~gone
    out = np.where(injected, number[o_place], len(take) + (np.cumsum(left) - 1)[place])
    room = np.concatenate([o_free[take], free[left]]).tolist()
    displaced = np.flatnonzero(gone[place] & ~injected)
    out[displaced] = best_fit(room, displaced.tolist(), lengths, capacity)
    return out, np.array(room)


def evolve(lengths: list[int], elite: list[int] | None, seed: int, bound: int, capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION) -> tuple[int, float, list[int]]:
    """One round of one island: bins, fitness and the bin of every piece in the best solution."""
    rng = np.random.default_rng(seed)
    n = len(lengths)
    by_length = np.argsort(-np.asarray(lengths, np.int64), kind="stable")  # pieces are numbered longest first within
    sizes = np.asarray(lengths, np.int64)[by_length]
    listed = sizes.tolist()

    def solved(order: np.ndarray) -> Solution:
        free: list[int] = []
        place = np.zeros(n, np.int64)
        place[order] = best_fit(free, order.tolist(), listed, capacity)
        return place, np.array(free, np.int64)

    if elite:
        place = np.asarray(elite, np.int64)[by_length]
        pool = [(place, capacity - np.bincount(place, sizes, place.max() + 1).astype(np.int64))]
    else:
        pool = [solved(np.arange(n))]
    best = pool[0]
    if len(best[1]) > bound:
        pool += [solved(np.argsort(-rng.uniform(0.7, 1.0, n) * sizes, kind="stable")) for _ in range(population - 1)]
        for _ in range(generations):
            ranked = sorted(pool, key=lambda s: fitness(s[1], capacity))
            if len(ranked[0][1]) <= bound:
                break
            pool = ranked[: population // 2]
            while len(pool) < population:
                a, b = rng.choice(population // 2, 2, replace=population < 4)
                pool.append(crossover(pool[a], pool[b], listed, capacity, rng))
        best = min(pool, key=lambda s: fitness(s[1], capacity))
    assigned = np.zeros(n, np.int64)
    assigned[by_length] = best[0]
    return (*fitness(best[1], capacity), assigned.tolist())


def _islands(capacity: int, round_no: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bins, score, assigned = evolve(r["lengths"], r["elite"], hash((r["block"], r["island"], round_no)) & 0x7FFFFFFF, r["bound"], capacity)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([r["bound"]], pa.int32()), pa.array([bins], pa.int32()), pa.array([score], pa.float64()), pa.array([assigned], pa.list_(pa.int32()))], ["block", "island", "bound", "bins", "score", "elite"])

    return run


def _bounds(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["lengths"]], pa.list_(pa.int32())), pa.array([lower_bound(np.array(r["lengths"], np.int64), capacity)], pa.int32())], ["block", "lengths", "bound"])

    return run


_STATE = "block long, island int, bound int, bins int, score double, elite array<int>"


def _solve_level(blocks: DataFrame, capacity: int, islands: int, rounds: int) -> DataFrame:
    """block, elite (bin of each piece): the best solution that the islands of each block found."""
    spread = 4 * blocks.sparkSession.sparkContext.defaultParallelism
    todo = scratch.stage(blocks.select("block", F.transform("items", lambda x: x["length"]).alias("lengths")).mapInArrow(_bounds(capacity), "block long, lengths array<int>, bound int"), "problems")
    # every island's first solution is plain best-fit decreasing, so one island finds the blocks that need no evolution
    first = todo.select("block", F.lit(0).alias("island"), "bound", "lengths", F.lit(None).cast("array<int>").alias("elite"))
    state = scratch.stage(first.mapInArrow(_islands(capacity, 0), _STATE), "island")
    done = [state.where("bins <= bound")]
    open_ = state.where("bins > bound")
    for r in range(1, rounds + 1):
        n_open = open_.count()
        if not n_open:
            break
        if r == 1:
            moved = open_.select("block", "elite", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
            moved = moved.withColumn("elite", F.when(F.col("island") == 0, F.col("elite")))
        else:  # ring migration: island i goes on from the better of its own and its neighbour's elite
            ranked = open_.select("block", "island", F.struct("bins", "score", "elite").alias("s"))
            neighbour = ranked.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("s").alias("other"))
            moved = ranked.join(neighbour, ["block", "island"]).select("block", "island", F.least("s", "other")["elite"].alias("elite"))
        tasks = min(spread, n_open * (islands if r == 1 else 1))  # an island a task, as far as there are cores
        dealt = moved.join(todo, "block").select("block", "island", "bound", "lengths", "elite").repartition(tasks, "block", "island")
        state = scratch.stage(dealt.mapInArrow(_islands(capacity, r), _STATE), "island")
        solved = state.where("bins <= bound").select("block").distinct()
        if r < rounds:
            done.append(state.join(solved, "block", "left_semi"))
            open_ = state.join(solved, "block", "left_anti")
        else:
            done.append(state)
            open_ = state.limit(0)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("block").agg(F.min_by("elite", F.struct("bins", "score", "island")).alias("elite"))


_ITEM = "array<struct<length: int, uid: long, doc_id: long, piece: int, start: long, crc: long, bin: long>>"
_PLACED = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset int, uid long, leave int"


def leaving(fill: list[tuple[int, int]], bound: int, capacity: int) -> tuple[set[int], set[int]]:
    """Bins of a block that go on, and those that do so even from a level that saves nothing; ``fill``: (ids, bin), sorted."""
    space, n = (len(fill) - bound) * capacity, 0
    while n < len(fill) and (n == 0 or fill[n][0] < LOOSE * capacity or space > 0):
        space -= capacity - fill[n][0]
        n += 1
    go = [b for _, b in fill[:n]]
    return set(go), set(go[: max(1, len(fill) // 4)])


def _place(spread: bool, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bins: dict[int, list] = {}
                for item, b in zip(r["items"], r["elite"], strict=True):
                    bins.setdefault(b, []).append(item)
                if r["items"][0]["bin"] is not None and len({x["bin"] for x in r["items"]}) <= len(bins):
                    bins = {}
                    for item in r["items"]:
                        bins.setdefault(item["bin"], []).append(item)
                fill = sorted((sum(x["length"] for x in items), b) for b, items in bins.items())
                bound = lower_bound(np.array([x["length"] for x in r["items"]], np.int64), capacity)
                loose, anyway = leaving(fill, bound, capacity) if spread else (set(), set())
                rows = []
                for b, items in bins.items():
                    items.sort(key=lambda x: x["uid"])
                    at = 0
                    for x in items:
                        rows.append((x["doc_id"], x["piece"], x["start"], x["length"], x["crc"], items[0]["uid"], at, x["uid"], (b in loose) + (b in anyway)))
                        at += x["length"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "uid", "leave"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", keep_order: bool = False, memo_units: int = MEMO_UNITS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    ``memo_units``: text units whose ids each Python worker remembers, which costs memory and saves time only.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.stage(texts.mapInArrow(_pieces(tokenizer_path, end_id, capacity, memo_units), _PIECES), "pieces", batch_rows=BATCH_ROWS)
    out = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", F.col("length").cast("long"), F.col("crc").alias("ids_crc32"), F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    level = pieces.where(F.col("length") < capacity).withColumn("bin", F.lit(None).cast("long"))
    n = level.count()
    read_order = keep_order and n > block
    depth, came = 0, None
    while n:
        # in reading order a piece's number within its task makes the first blocks; what blocks leave is dealt by hash, as whole bins
        n_blocks = -(-n // block)
        number = F.floor(F.col("uid") / block) if read_order else F.pmod(F.xxhash64(F.coalesce("bin", "uid"), F.lit(depth)), F.lit(n_blocks))
        blocks = scratch.stage(
            level.withColumn("block", number)
            .groupBy("block")
            .agg(F.sort_array(F.collect_list(F.struct("length", "uid", "doc_id", "piece", "start", "crc", "bin")), asc=False).cast(_ITEM).alias("items")),
            "blocks",
        )
        more = read_order or n_blocks > 1
        best = _solve_level(blocks, capacity, islands, rounds)
        placed = scratch.stage(blocks.join(best, "block").select("items", "elite").mapInArrow(_place(more, capacity), _PLACED), "placed")
        scratch.drop(blocks)
        bins = placed.where("offset = 0").count()
        goes = F.col("leave") >= (1 if came is None or came - bins >= n_blocks else 2)
        out = out.unionByName(placed.where(~goes).select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", F.col("offset").cast("long")))
        level = placed.where(goes).select("uid", "doc_id", "piece", "start", "length", F.col("ids_crc32").alias("crc"), F.col("sequence_id").alias("bin"))
        n, came = level.count(), level.select("bin").distinct().count()
        depth, read_order = depth + 1, False
    return out


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 2)
