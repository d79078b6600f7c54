"""Mixing sources to target weights by Pfair scheduling (operator 9), in DataFrame operations only.

Documents of a source, in an order fixed by a hash of their ids, form blocks.  The target
is a fluid: at every moment each source that has blocks left flows at its exact weight over
the sum of the weights of such sources.  A block is released at the slot (rounded down) at
which the fluid of its source reaches its start, and due at the one (rounded up) at which it
reaches its end.  All fluids together fill every slot, so earliest deadline first among
released blocks meets every deadline, which keeps every source within one block of its
exact weight at every slot, for any weights and number of sources and also where sources
run out; all documents are kept.  The deadlines are met one slot after the other: a fold of
a state of one entry a source, in jobs of bounded length that hand the state on.  Fluids
are doubles: what is within 1e-6 of a whole slot counts as that slot.

With ``cycle`` given, weights are rounded to whole numbers of blocks (one at least) of a
cycle of about so many, and the bound holds for the rounded numbers only.  The schedule of
a cycle repeats, so it is computed once.  Where a source runs out, its last cycle is
scheduled with what it has left and further cycles without it: at most 2 S + 1 different
cycles exist for S sources.

A null source is a source of its own; repeated rows take a place each; ties of deadlines go
to the source that is first by name; an empty table gives no rows; other columns are kept
by ``mix`` and left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.llm import scratch

#: Documents a block, and rows of the hash buckets that a source's ranks are counted in.
BLOCK_DOCS, BUCKET_ROWS = 4, 2_000
#: Rows of the cycle table, at most, and slots of the exact schedule (8 bytes each), at most, that are broadcast.
BROADCAST_ROWS, BROADCAST_SLOTS = 500_000, 4_000_000
#: Slots a job and slots an inner fold of the exact schedule, blocks a row of its table.
JOB_SLOTS, FOLD_SLOTS, GROUP = 1 << 16, 256, 1024
#: A weight of nothing: such a source comes when all others have run out.
NO_WEIGHT = 1e-15


def _cycles(sources: DataFrame) -> DataFrame:
    """i (source number), o (its block within a cycle), first, next (cycles), base (slot of the first cycle), d, pos."""
    one = sources.agg(F.array_sort(F.collect_list(F.struct("i", "n", "w"))).alias("all"))  # one row: a number of sources
    starts = F.array_sort(F.array_distinct(F.flatten(F.concat(F.array(F.array(F.lit(0).cast("long"))), F.transform("all", lambda x: F.array(F.floor(x["n"] / x["w"]), F.floor(x["n"] / x["w"]) + 1))))))
    classes = one.withColumn("starts", starts).select("all", F.posexplode("starts").alias("c", "first"), "starts")
    classes = classes.withColumn("next", F.get("starts", F.col("c") + 1)).where(F.col("next").isNotNull())
    left = F.transform("all", lambda x: F.greatest(F.lit(0).cast("long"), F.least(x["w"], x["n"] - F.col("first") * x["w"])))
    classes = classes.select("first", "next", left.alias("b")).withColumn("d", F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x)).where("d > 0")
    blocks = F.sum(F.col("d") * (F.col("next") - F.col("first"))).over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    classes = classes.withColumn("base", F.coalesce(blocks, F.lit(0).cast("long")))
    due = """
      array_min(filter(transform(b, (x, i) -> if(s.done[i] < x and s.done[i] * d div x <= t, struct(-((-(s.done[i] + 1) * d) div x) + if((s.done[i] + 1) * d % x > 0, 1, 0) as due, i as i), null)), y -> y is not null)).i"""
    fold = f"""
      aggregate(sequence(0L, d - 1), named_struct('done', transform(b, x -> 0L), 'order', cast(array() as array<int>)),
        (s, t) -> transform(array({due}), c -> named_struct('done', transform(s.done, (v, i) -> if(i = c, v + 1, v)), 'order', concat(s.order, array(c))))[0],
        s -> s.order)"""
    slots = classes.select("first", "next", "base", "d", F.posexplode(F.expr(fold)).alias("pos", "i"))
    order = F.row_number().over(Window.partitionBy("first", "i").orderBy("pos")) - 1
    return slots.withColumn("o", order.cast("long"))


def _exact(sources: DataFrame) -> DataFrame:
    """i (source number), g, slots: slots of the blocks g GROUP, g GROUP + 1, ... of source i, by earliest deadline first."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # one row: a number of sources
    flows = sources.select("i", F.col("n").cast("long").alias("n"), (F.col("wanted") / F.sum("wanted").over(Window.partitionBy())).alias("w"))
    flows = flows.select("i", "n", F.greatest(F.col("w"), F.lit(NO_WEIGHT)).alias("w"))
    one = scratch.stage(flows.agg(F.array_sort(F.collect_list(F.struct("i", "n", "w"))).alias("all")), "flows")

    def reached(v: str) -> str:
        """Slot at which the fluid of a source of blocks a weight ``v`` is reached: what has flowed of all by then."""
        return f"transform(array(aggregate(all, 0D, (a, y) -> a + least(y.w * ({v}), cast(y.n as double)))), r -> if(abs(r - rint(r)) < 1e-6D, rint(r), r))[0]"

    def entry(i: str, n: str, w: str, done: str, rel: str) -> str:
        return f"transform(array({reached(f'({done} + 1) / {w}')}), e -> named_struct('due', cast(ceil(e) as bigint), 'i', {i}, 'rel', {rel}, 'done', {done}, 'end', e, 'n', {n}, 'w', {w}))[0]"

    begin = f"transform(all, x -> {entry('x.i', 'x.n', 'x.w', '0L', '0L')})"
    follows = entry("c.i", "c.n", "c.w", "(c.done + 1)", "cast(floor(c.end) as bigint)")
    # doubles can leave a slot without a released block only by the rounding of a fluid: the next one due takes it
    pick = "coalesce(array_min(filter(s.st, x -> x.rel <= t)), array_min(s.st))"
    after = f"if(c.done + 1 < c.n, transform(array({follows}), f -> transform(s.st, x -> if(x.i = f.i, f, x)))[0], filter(s.st, x -> x.i <> c.i))"
    empty = "cast(array() as array<struct<i: int, block: bigint>>)"
    path, state = scratch.new_path(spark, "slots"), one.withColumn("st", F.expr(begin))
    for k, at in enumerate(range(0, total, JOB_SLOTS)):
        stop = min(total, at + JOB_SLOTS)
        inner = f"aggregate(sequence(u, least(u + {FOLD_SLOTS}, {stop}L) - 1), named_struct('st', o.st, 'took', {empty}), (s, t) -> transform(array({pick}), c -> named_struct('st', {after}, 'took', concat(s.took, array(named_struct('i', c.i, 'block', c.done)))))[0])"
        outer = f"aggregate(sequence({at}L, {stop - 1}L, {FOLD_SLOTS}L), named_struct('st', st, 'took', cast(array() as array<array<struct<i: int, block: bigint>>>)), (o, u) -> transform(array({inner}), z -> named_struct('st', z.st, 'took', concat(o.took, array(z.took))))[0])"
        state.select("all", F.expr(outer).alias("z")).select("all", "z.st", F.flatten("z.took").alias("took"), F.lit(at).cast("long").alias("at")).coalesce(1).write.option("compression", "zstd").parquet(f"{path}/job={k}")
        written = spark.read.parquet(f"{path}/job={k}")
        state = written.select("all", "st")
    if not total:
        return spark.createDataFrame([], "i int, g bigint, slots array<bigint>")
    took = spark.read.schema(written.schema).parquet(path).select("at", F.posexplode("took").alias("pos", "x"))
    took = took.select(F.col("x.i").alias("i"), F.col("x.block").alias("block"), (F.col("at") + F.col("pos")).alias("slot"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "slot")))
    return took.groupBy("i", F.floor(F.col("block") / GROUP).alias("g")).agg(F.transform(ordered, lambda x: x["slot"]).alias("slots"))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block_docs: int = BLOCK_DOCS, cycle: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with block (within its source), slot (of its block in the mix, from 0) and place (within its block).

    ``weights`` by source name; without them a source's weight is the square root of its
    number of documents.  Sources that ``weights`` leaves out get the smallest one; one of
    weight 0 comes last.  Weights are kept exactly unless ``cycle`` is given.
    Columns of ``docs`` named block, slot or place are replaced.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"))  # the caller's columns can't clash
    counts = rows.groupBy("source").agg(F.count("*").alias("docs"))
    if weights:
        known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        wanted = F.coalesce(known[F.coalesce("source", F.lit(""))], F.lit(float(min(weights.values()))))
    else:
        wanted = F.sqrt("docs")
    every = Window.partitionBy()  # over one row a source
    sources = (
        counts.withColumn("wanted", wanted)
        .withColumn("w", F.greatest(F.lit(1).cast("long"), F.round(F.col("wanted") / F.sum("wanted").over(every) * (cycle or 1)).cast("long")))
        .withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())) - 1)
        .withColumn("n", F.ceil(F.col("docs") / block_docs))
        .withColumn("buckets", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("docs") / bucket_rows)))
    )
    sources = scratch.stage(sources.select(F.col("source").alias("name"), "i", "n", "w", "wanted", "buckets"), "sources")
    if cycle:
        table = scratch.stage(_cycles(sources), "cycles")
        small = table.count() <= BROADCAST_ROWS
    else:
        table = scratch.stage(_exact(sources), "slots")
        small = table.agg(F.coalesce(F.sum(F.size("slots")), F.lit(0))).first()[0] <= BROADCAST_SLOTS
    # ranks within a source: within hash buckets of bounded size, after the sizes of the buckets before
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    hashed = rows.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("name"))).withColumn("h", h).withColumn("bucket", F.floor(F.col("h") * F.col("buckets") / F.lit(1 << 32)))
    sizes = hashed.groupBy("i", "bucket").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("i", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("i", "bucket").orderBy("h", "id")) - 1
    ranked = hashed.withColumn("rank", rank).join(sizes, ["i", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_docs)).withColumn("place", (F.col("rank") % block_docs).cast("int"))
    if cycle:
        ranked = ranked.withColumn("cycle", F.floor(F.col("block") / F.col("w"))).withColumn("o", F.col("block") % F.col("w"))
        table = table.withColumnsRenamed({"i": "ti", "o": "to", "d": "td"})
        found = ranked.join(F.broadcast(table) if small else table, (F.col("i") == F.col("ti")) & (F.col("o") == F.col("to")) & (F.col("cycle") >= F.col("first")) & (F.col("cycle") < F.col("next")))
        slot = F.col("base") + (F.col("cycle") - F.col("first")) * F.col("td") + F.col("pos")
    else:
        table = table.withColumnRenamed("i", "ti")
        found = ranked.join(F.broadcast(table) if small else table, (F.col("i") == F.col("ti")) & (F.floor(F.col("block") / GROUP) == F.col("g")))
        slot = F.get("slots", (F.col("block") % GROUP).cast("int"))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("block", "slot", "place")]
    return found.select(*own, "block", slot.alias("slot"), "place")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, partitions: int | None = None, **named) -> DataFrame:
    """``docs`` in the order of the mix: files of the written result hold it one after the other."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = schedule(docs.select(F.struct("*").alias("_row"), F.col(named.get("source_col", "source")).alias("source"), F.col(named.get("id_col", "doc_id")).alias("doc_id")), weights, **{k: v for k, v in named.items() if k not in ("source_col", "id_col")})
    return mixed.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return schedule(docs)
