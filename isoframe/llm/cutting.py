"""Packing as a cutting-stock problem, by column generation (operator 13).

Documents become token streams (ids and an end id).  Whole sequences are cut off a longer
stream from its start; what is left of every document is an item of one of fewer than
``capacity`` lengths.  The histogram of these lengths, which no input makes longer, is the
whole problem:

1. Lengths are dealt to groups by hash.  For each group a linear program says how often each
   pattern (a multiset of lengths that fills a sequence, or exactly a power of two) is cut,
   so that as few tokens as possible are left over to be cut across sequences; each column
   is priced by an exact-sum knapsack over the duals, until none improves.
2. Patterns are taken a whole number of times.  What rounding leaves is filled exactly by
   subset sums as far as it goes; the rest is the stream of the groups one after another,
   cut at every ``capacity`` tokens and, in its last sequence, at powers of two.  So no
   sequence is padded, and an item is cut only where no exact pattern was left for it.
3. Items are ranked within their length (number within the reading task, after the counts
   of the tasks before it, so that a length that a third of all rows share is no group of
   one task) and take the places of the patterns by rank: a row of the plan is a range of
   ranks.  The plan is broadcast where its count was taken and is small.

Null and empty texts hold the end id alone; repeated rows are packed as often as they occur;
a very long text is encoded by itself; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.llm import scratch
from isoframe.llm.arrow import slices
from isoframe.llm.tokenize import encoder

CAPACITY = 4096
#: Lengths of a group: rows of one linear program.
GROUP = 64
#: What a cut costs, in sequences: the program would rather begin so many sequences more than cut once.
CUT_COST = 64
#: The program ends when it is within this share of its bound, or after so many columns a length: every basis can be used.
NEAR, COLUMNS_EACH = 1e-3, 12
#: Rows of a plan, of counts by task or of cut items up to which they are broadcast (some 60 bytes each); beyond it the join is a shuffle.
BROADCAST_ROWS = 500_000

_ITEMS = "uid long, part int, nth long, doc_id long, start long, length int, crc long, doc_tokens long, ids binary"
_NAMES = [c.split(" ")[0] for c in _ITEMS.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def _items(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = np.array([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        uid, seen = part << 40, np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + tail, enc.dtype)
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    n = len(piece)
                    rows.append((uid, part, int(seen[n]), doc_id, at, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), piece.tobytes() if n < capacity else None))
                    seen[n] += 1
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    return run


def best_sums(lengths: list[int], values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that any multiset of lengths with each sum is worth, and the length last added to it (an unbounded knapsack)."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    last = np.full(capacity + 1, -1)
    for i, n in enumerate(lengths):
        rows = -(-(capacity + 1) // n)
        times = np.arange(rows)[:, None] * values[i]
        table = np.full(rows * n, -np.inf)
        table[: capacity + 1] = best
        # any number of this length more: a running maximum down each residue class, of the rows above
        more = np.full((rows, n), -np.inf)
        more[1:] = (np.maximum.accumulate(table.reshape(rows, n) - times, axis=0) + times)[:-1] + values[i]
        more = more.ravel()[: capacity + 1]
        better = more > best + 1e-9 * (1 + np.abs(np.where(np.isfinite(best), best, 0)))
        last[better] = i
        best = np.where(better, more, best)
    return best, last


def pattern(last: np.ndarray, lengths: list[int], total: int) -> np.ndarray:
    """How often each length stands in the best multiset of that sum."""
    out = np.zeros(len(lengths), np.int64)
    while total:
        out[last[total]] += 1
        total -= lengths[last[total]]
    return out


def generate(lengths: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program cuts them (as fractions), by column generation.

    Minimise sequences begun, plus CUT_COST for every ``capacity`` tokens that no pattern
    takes; each length's items are all used.  The first basis leaves all items over.
    """
    m = len(lengths)
    size, want = np.array(lengths, float), np.array(counts, float)
    spill = CUT_COST * size / capacity
    moved = want * (1 + 1e-7 * np.arange(1, m + 1) / m)  # no two ratios tie
    inverse, amount, cost = np.eye(m), moved.copy(), spill.copy()
    columns: list[np.ndarray] = [np.eye(1, m, i, dtype=np.int64)[0] for i in range(m)]
    is_pattern = np.zeros(m, bool)
    least = float(size @ want) / capacity
    targets = [1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity]
    targets = sorted({*targets, capacity})

    def enter(new: np.ndarray, price: float, filled: bool) -> bool:
        """Bring a column into the basis if it still improves it."""
        nonlocal amount
        if cost @ (along := inverse @ new) - price <= 1e-7:
            return False
        able = along > 1e-7
        if not able.any():
            return False
        out = int(np.argmin(np.where(able, amount / np.where(able, along, 1.0), np.inf)))
        step = amount[out] / along[out]
        amount = amount - step * along
        amount[out] = step
        inverse[out] /= along[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(along[others], inverse[out])
        columns[out], cost[out], is_pattern[out] = new, price, filled
        return True

    for _ in range(COLUMNS_EACH * m):
        if float(cost @ amount) <= least * (1 + NEAR):
            break
        dual = cost @ inverse
        best, last = best_sums(lengths, dual, capacity)
        # one knapsack prices the best pattern of every target, and for each length the best full one that holds it
        gains = [(best[t] - 1.0, t, None) for t in targets] + [(dual[i] + best[capacity - n] - 1.0, capacity - n, i) for i, n in enumerate(lengths)]
        entered = 0
        for gain, target, i in sorted(gains, key=lambda g: -g[0]):
            if not gain > 1e-7:
                break
            new = pattern(last, lengths, target)
            if i is not None:
                new[i] += 1
            entered += enter(new, 1.0, True)
        for i in np.flatnonzero(dual - spill > 1e-7).tolist():
            entered += enter(np.eye(1, m, i, dtype=np.int64)[0], float(spill[i]), False)
        if not entered:
            break
        # rounding errors of the updates end here
        inverse = np.linalg.inv(np.array(columns, float).T)
        amount = np.maximum(inverse @ moved, 0)
    exact = np.linalg.solve(np.array(columns, float).T, want)
    return [(columns[i], float(exact[i])) for i in range(m) if is_pattern[i] and exact[i] > 1e-6]


def exact_fill(lengths: list[int], counts: list[int], capacity: int) -> list[int] | None:
    """How often each length stands in a multiset of the items at hand that fills a sequence, long items first; none if there is none."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    reach, parts = [1], []
    for i in order:
        left, k = min(counts[i], capacity // lengths[i]), 1
        while left > 0:
            take = min(k, left)
            parts.append((i, take))
            reach.append((reach[-1] | reach[-1] << take * lengths[i]) & (2 << capacity) - 1)
            left, k = left - take, 2 * k
    if not reach[-1] >> capacity & 1:
        return None
    out, total = [0] * len(lengths), capacity
    for j in range(len(parts) - 1, -1, -1):
        i, take = parts[j]
        rest = total - take * lengths[i]
        if rest >= 0 and reach[j] >> rest & 1:
            out[i] += take
            total = rest
    return out


def plan_group(lengths: list[int], counts: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int, int]], int, int]:
    """Whole use of patterns: (length, first rank, end rank, items a sequence, first sequence, offset) rows; (length, first rank, end rank, place in the stream) of what is left; sequences; tokens left."""
    left, used, taken = list(counts), [0] * len(counts), []
    for shape, amount in generate(lengths, counts, capacity):
        taken.append((shape.tolist(), int(amount + 1e-6)))
    rows, sequence = [], 0

    def take(shape: list[int], times: int) -> None:
        nonlocal sequence
        times = min([times, *(left[i] // k for i, k in enumerate(shape) if k)])
        offset = 0
        for i, k in enumerate(shape):
            if k and times:
                rows.append((lengths[i], used[i], used[i] + k * times, k, sequence, offset))
                used[i] += k * times
                left[i] -= k * times
                offset += k * lengths[i]
        sequence += times

    for shape, times in taken:
        if times:
            take(shape, times)
    while (shape := exact_fill(lengths, left, capacity)) is not None:
        take(shape, sum(left))
    spilled, place = [], 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        if left[i]:
            spilled.append((lengths[i], used[i], used[i] + left[i], place))
            place += left[i] * lengths[i]
    return rows, spilled, sequence, place


_PLAN = "group int, sequences long, spilled long, length int, low long, high long, each int, base long, offset int, in_stream boolean"


def _plan(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths, counts = zip(*((x["length"], x["n"]) for x in r["lengths"]), strict=True)
                rows, stream, sequences, tokens = plan_group(list(lengths), list(counts), capacity)
                table = [(r["group"], sequences, tokens, *row, False) for row in rows] + [(r["group"], sequences, tokens, n, low, high, 1, place, 0, True) for n, low, high, place in stream]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*table, strict=True), kinds, strict=True)], [c.split(" ")[0] for c in _PLAN.split(", ")])

    return run


def stream_starts(tokens: int, capacity: int = CAPACITY) -> tuple[int, list[int]]:
    """Tokens of a stream that fill whole sequences, and where each sequence after them begins: their lengths are falling powers of two."""
    at = body = tokens - tokens % capacity
    out = []
    while at < tokens:
        out.append(at)
        at += 1 << (tokens - at).bit_length() - 1
    return body, out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _crcs(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [zlib.crc32(np.frombuffer(raw, width)[a : a + n].astype("<u4").tobytes()) for raw, a, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(crcs, pa.int64())], _OUT_NAMES)

    return run


_OUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
_OUT_NAMES = [c.split(" ")[0] for c in _OUT.split(", ")]


def plan(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Where the items of each length go, by rank: a row for each range of ranks (at most a few for each length and pattern)."""
    counts = items.groupBy("length").agg(F.count("*").alias("n"))
    dealt = counts.withColumn("k", F.row_number().over(Window.orderBy(F.xxhash64("length"), "length")))  # fewer rows than capacity
    n = F.max("k").over(Window.partitionBy())
    groups = dealt.withColumn("group", F.pmod(F.col("k"), F.greatest(F.lit(1), F.round(n / group))).cast("int")).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("length", "n"))).alias("lengths"))
    spread = max(1, -(-capacity // group))
    solved = scratch.stage(groups.repartition(spread, "group").mapInArrow(_plan(capacity), _PLAN), "plan")
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row a group
    totals = solved.select("group", "sequences", "spilled").distinct()
    bases = totals.select("group", F.coalesce(F.sum("sequences").over(before), F.lit(0)).alias("sequences_before"), F.coalesce(F.sum("spilled").over(before), F.lit(0)).alias("spilled_before"))
    return solved.join(bases, "group").select("length", "low", "high", "each", (F.col("base") + F.when(F.col("in_stream"), F.col("spilled_before")).otherwise(F.col("sequences_before"))).alias("base"), "offset", "in_stream", "group", "sequences", "spilled")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    staged = scratch.stage(texts.mapInArrow(_items(tokenizer_path, end_id, capacity), _ITEMS), "items")
    whole = staged.where(F.col("length") == capacity).select("doc_id", "start", F.col("length").cast("long"), "doc_tokens", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("crc").alias("ids_crc32"))
    items = staged.where(F.col("length") < capacity)
    ranges = scratch.stage(plan(items, capacity, group), "ranges")
    # at most a row a group: what the groups hold in all
    sequences, tokens = ranges.select("group", "sequences", "spilled").distinct().agg(F.coalesce(F.sum("sequences"), F.lit(0)), F.coalesce(F.sum("spilled"), F.lit(0))).first()
    body, tail = stream_starts(tokens, capacity)

    by_task = scratch.stage(items.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    earlier = by_task.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = items.drop("ids").join(_small(scratch.stage(earlier, "earlier")), ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    met = ranked.join(_small(ranges.select("length", "low", "high", "each", "base", F.col("offset").alias("from"), "in_stream")), "length").where("rank >= low and rank < high")

    k = F.col("rank") - F.col("low")
    in_pattern = met.where("not in_stream").select("doc_id", "start", F.col("length").cast("long"), "doc_tokens", (F.col("base") + F.floor(k / F.col("each"))).alias("sequence_id"), (F.col("from") + F.pmod(k, F.col("each")) * F.col("length")).cast("long").alias("offset"), F.col("crc").alias("ids_crc32"))
    place, end = F.col("place"), F.col("place") + F.col("length")
    begins = F.array(*[F.lit(x).cast("long") for x in tail]) if tail else F.array().cast("array<long>")
    first = (F.floor(place / capacity) + 1) * capacity
    points = F.concat(F.filter(F.array(first), lambda x: (x < end) & (x < F.lit(body))), F.filter(begins, lambda x: (x > place) & (x < end)))
    stream = met.where("in_stream").withColumn("place", F.col("base") + k * F.col("length")).withColumn("points", points)
    stream = stream.select("uid", "doc_id", "start", "length", "doc_tokens", "crc", "place", F.size("points").alias("cuts"), F.explode(F.arrays_zip(F.concat(F.array(place), F.col("points")).alias("at"), F.concat(F.col("points"), F.array(end)).alias("to"))).alias("x"))
    after = F.size(F.filter(begins, lambda b: b <= F.col("at"))) - 1
    stream = stream.withColumn("at", F.col("x.at")).select(
        "uid", "cuts", "crc", (F.col("at") - place).cast("int").alias("skip"), "doc_id", (F.col("start") + F.col("at") - place).alias("start"), (F.col("x.to") - F.col("at")).cast("long").alias("length"), "doc_tokens",
        (F.lit(sequences) + F.when(F.col("at") < body, F.floor(F.col("at") / capacity)).otherwise(F.lit(body // capacity) + after)).alias("sequence_id"),
        F.when(F.col("at") < body, F.pmod(F.col("at"), F.lit(capacity))).otherwise(F.col("at") - F.get(begins, after)).alias("offset"),
    )
    stream = scratch.stage(stream, "stream")
    uncut = stream.where("cuts = 0").select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", F.col("crc").alias("ids_crc32"))
    cut = stream.where("cuts > 0")
    width = encoder(tokenizer_path).dtype.str
    pieces = items.select("uid", "ids").join(_small(cut), "uid").select("ids", "skip", F.col("length").cast("int").alias("n"), "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").mapInArrow(_crcs(width), _OUT)
    return whole.unionByName(in_pattern).unionByName(uncut).unionByName(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)
