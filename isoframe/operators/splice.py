"""Alternative splicing events from exons, inclusion levels, and differences between conditions.

Exons have gene, chr, strand, tx, start, end (a row an exon of a transcript).  Event
operators first bring chains of exons to distinct coordinates with their transcripts, so
joins meet one row a coordinate and not one a transcript.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.operators.ordering import fixed, indexed, least_after, neighbours, parted, with_groups

_GENE = ["gene", "chr", "strand"]
#: Samples whose sums are the columns of one row.
SAMPLES = 16


def _tx(c: str = "tx") -> Column:
    return F.collect_set(c).alias("txs")


def chains(exons: DataFrame) -> DataFrame:
    """Every exon with the next two of its transcript (s1, e1, s2, e2, s3, e3) and its place from both ends."""
    w = Window.partitionBy(*_GENE, "tx").orderBy("start", "end")
    back = Window.partitionBy(*_GENE, "tx").orderBy(F.desc("start"), F.desc("end"))
    return exons.select(*_GENE, "tx", "start", "end").distinct().select(
        *_GENE, "tx", F.col("start").alias("s1"), F.col("end").alias("e1"), F.lead("start", 1).over(w).alias("s2"), F.lead("end", 1).over(w).alias("e2"),
        F.lead("start", 2).over(w).alias("s3"), F.lead("end", 2).over(w).alias("e3"), F.row_number().over(w).alias("place"), F.row_number().over(back).alias("from_end"),
    )


def _events(joined: DataFrame, etype: Column | str, coords: Column) -> DataFrame:
    """gene, event_id, alternative (transcripts), total; sets of rows with the same id are united."""
    kind = F.lit(etype) if isinstance(etype, str) else etype
    event_id = F.concat(F.col("gene"), F.lit(";"), kind, F.lit(":"), F.col("chr"), F.lit(":"), coords, F.lit(":"), F.col("strand"))
    rows = joined.select("gene", kind.alias("etype"), event_id.alias("event_id"), "pos", "neg")
    sets = rows.groupBy("gene", "etype", "event_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pos")))).alias("alternative"), F.array_distinct(F.flatten(F.collect_set("neg"))).alias("neg"))
    return sets.select("gene", "etype", "event_id", "alternative", F.array_sort(F.array_union("alternative", "neg")).alias("total"))


def _span(*names: str) -> Column:
    return F.concat_ws("-", *[F.col(n).cast("string") for n in names])


def skipped_exons(exons: DataFrame) -> DataFrame:
    """Chains of three exons whose outer junction another transcript has."""
    c = chains(exons)
    three = c.where("s3 is not null").groupBy(*_GENE, "e1", "s2", "e2", "s3").agg(_tx()).withColumnRenamed("txs", "pos")
    two = c.where("s2 is not null").groupBy(*_GENE, "e1", F.col("s2").alias("s3")).agg(_tx()).withColumnRenamed("txs", "neg")
    return _events(three.join(two, [*_GENE, "e1", "s3"]), "SE", F.concat_ws(":", _span("e1", "s2"), _span("e2", "s3")))


def retained_introns(exons: DataFrame) -> DataFrame:
    """Pairs of exons whose outer ends are one exon of another transcript."""
    c = chains(exons)
    pair = c.where("s2 is not null").groupBy(*_GENE, "s1", "e1", "s2", "e2").agg(_tx()).withColumnRenamed("txs", "neg")
    one = c.groupBy(*_GENE, "s1", F.col("e1").alias("e2")).agg(_tx()).withColumnRenamed("txs", "pos")
    coords = F.concat_ws(":", F.col("s1").cast("string"), _span("e1", "s2"), F.col("e2").cast("string"))
    return _events(pair.join(one, [*_GENE, "s1", "e2"]), "RI", coords)


def exclusive_exons(exons: DataFrame) -> DataFrame:
    """Chains of three whose outer coordinates have equal sums, the middle exon of one before that of the other.

    Sums are compared, not the coordinates one by one.
    """
    three = chains(exons).where("s3 is not null").groupBy(*_GENE, "e1", "s2", "e2", "s3").agg(_tx()).withColumn("sum", F.col("e1") + F.col("s3"))
    a = three.select(*_GENE, "sum", *[F.col(x).alias(f"{x}a") for x in ("e1", "s2", "e2", "s3")], F.col("txs").alias("pos"))
    b = three.select(*_GENE, "sum", *[F.col(x).alias(f"{x}b") for x in ("e1", "s2", "e2", "s3")], F.col("txs").alias("neg"))
    joined = a.join(b, [*_GENE, "sum"]).where("e2a < s2b")
    return _events(joined, "MX", F.concat_ws(":", _span("e1a", "s2a"), _span("e2a", "s3a"), _span("e1b", "s2b"), _span("e2b", "s3b")))


def alternative_sites(exons: DataFrame) -> DataFrame:
    """A5 and A3: junctions that share one site, the other site of one lies inside the other's exon."""
    c = chains(exons).where("s2 is not null")
    junction = c.groupBy(*_GENE, F.col("e1").alias("n1"), F.col("s2").alias("n2")).agg(_tx()).withColumnRenamed("txs", "neg")
    right = c.groupBy(*_GENE, "s1", "e1", "s2").agg(_tx()).withColumnRenamed("txs", "pos").join(junction.withColumn("s2", F.col("n2")), [*_GENE, "s2"]).where("s1 < n1 and n1 < e1")
    left = c.groupBy(*_GENE, "e1", "s2", "e2").agg(_tx()).withColumnRenamed("txs", "pos").join(junction.withColumn("e1", F.col("n1")), [*_GENE, "e1"]).where("s2 < n2 and n2 < e2")
    minus = F.col("strand") == "-"
    coords = F.concat_ws(":", _span("e1", "s2"), _span("n1", "n2"))
    return _events(right, F.when(minus, "A3").otherwise("A5"), coords).unionByName(_events(left, F.when(minus, "A5").otherwise("A3"), coords))


def alternative_ends(exons: DataFrame) -> DataFrame:
    """AF and AL: first or last exons of transcripts that lead to the same inner site and don't touch."""
    c = chains(exons)
    first = c.where("place = 1 and s2 is not null").groupBy(*_GENE, "s1", "e1", "s2").agg(_tx())
    last = c.where("from_end = 2").groupBy(*_GENE, "e1", "s2", "e2").agg(_tx())
    f2 = first.select(*_GENE, "s2", F.col("s1").alias("n1"), F.col("e1").alias("n2"), F.col("txs").alias("neg"))
    l2 = last.select(*_GENE, "e1", F.col("s2").alias("n2"), F.col("e2").alias("n3"), F.col("txs").alias("neg"))
    left = first.withColumnRenamed("txs", "pos").join(f2, [*_GENE, "s2"]).where("e1 < n1")
    right = last.withColumnRenamed("txs", "pos").join(l2, [*_GENE, "e1"]).where("n2 > e2")
    minus = F.col("strand") == "-"
    text = lambda c: F.col(c).cast("string")
    left_at = F.concat_ws(":", text("s1"), _span("e1", "s2"), text("n1"), _span("n2", "s2"))
    right_at = F.concat_ws(":", _span("e1", "s2"), text("e2"), _span("e1", "n2"), text("n3"))
    return _events(left, F.when(minus, "AL").otherwise("AF"), left_at).unionByName(_events(right, F.when(minus, "AF").otherwise("AL"), right_at))


def all_events(exons: DataFrame) -> DataFrame:
    out = skipped_exons(exons)
    for f in (retained_introns, exclusive_exons, alternative_sites, alternative_ends):
        out = out.unionByName(f(exons))
    return out


def merged_variants(events: DataFrame, key: Sequence[str], coords: Sequence[str], distance: int) -> DataFrame:
    """Events of one key whose coordinates differ by at most ``distance`` each, with the united transcripts of one hop.

    Neighbours are taken over the events as given, so the result doesn't depend on their
    order.  Buckets of the first coordinate keep the band join an equi-join.
    """
    size = max(1, distance + 1)
    bucket = F.floor(F.col(coords[0]) / size)
    a = events.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = events.select(*key, *[F.col(c).alias(f"_{c}") for c in coords], F.col("txs").alias("_txs"), bucket.alias("_b"))
    near = a.join(b, [*key, "_b"])
    for c in coords:
        near = near.where(F.abs(F.col(c) - F.col(f"_{c}")) <= distance)
    return near.groupBy(*key, *coords).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_txs")))).alias("txs"), F.count("*").alias("n_merged"))


def islands(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans with island: the number, from 1, of their run of overlapping spans within ``keys``."""
    rest = [c for c in spans.columns if c not in {*keys, start, end}]  # equal spans keep one order in both windows
    w = Window.partitionBy(*keys).orderBy(start, end, *rest)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return spans.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def pooled_genes(exons: DataFrame) -> DataFrame:
    """gene, pooled: genes of one strand that overlap get one name, their ids joined by ``_and_`` in order."""
    spans = exons.groupBy(*_GENE).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    marked = islands(spans, ["chr", "strand"])
    names = marked.groupBy("chr", "strand", "island").agg(F.array_join(F.array_sort(F.collect_set("gene")), "_and_").alias("pooled"))
    return marked.join(names, ["chr", "strand", "island"]).select("gene", "chr", "strand", "pooled")


def split_loci(exons: DataFrame) -> DataFrame:
    """gene, tx, locus: transcripts of a gene that don't overlap are loci of their own, numbered from 1."""
    spans = exons.groupBy(*_GENE, "tx").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands(spans, _GENE).select("gene", "tx", F.col("island").alias("locus"))


def constitutive_exons(exons: DataFrame) -> DataFrame:
    """gene, start, end of exons that every transcript of the gene has."""
    n = exons.groupBy("gene").agg(F.count_distinct("tx").alias("n"))
    return exons.groupBy("gene", "start", "end").agg(F.count_distinct("tx").alias("has")).join(n, "gene").where("has = n").select("gene", "start", "end")


def event_sums(events: DataFrame, expression: DataFrame) -> DataFrame:
    """event_id, sample, a, t: sums of expression over the alternative and over all transcripts of listed events; a transcript without expression gives its event a row without a sample."""
    parts = events.select("event_id", "alternative", F.explode("total").alias("tx")).withColumn("alt", F.array_contains("alternative", F.col("tx"))).drop("alternative")
    by_tx = expression.groupBy("tx").agg(F.collect_list(F.struct("sample", "tpm")).alias("xs"))  # a row a transcript: its samples
    return parts.join(by_tx, "tx", "left").select("event_id", "alt", F.explode_outer("xs").alias("x")).groupBy("event_id", F.col("x.sample").alias("sample")).agg(F.sum(F.when(F.col("alt"), F.col("x.tpm"))).alias("a"), F.sum("x.tpm").alias("t"))


def skipped_exon_sums(exons: DataFrame, expression: DataFrame) -> DataFrame:
    """The same for all skipped exons, without lists of transcripts.

    A junction lies around many skipped exons, and each of them would list the junction's
    transcripts anew.  So expression is summed by chain and by junction first, and an event
    adds the sums of its chain and its outer junction; transcripts that have both count
    once.  Sums of SAMPLES samples are the columns of one row.
    """
    names = [r["sample"] for r in expression.select("sample").where("sample is not null").distinct().orderBy("sample").collect()]  # a row a sample
    width = max(1, min(SAMPLES, len(names)))
    known = F.array(*[F.lit(n) for n in names]) if names else F.array(F.lit(""))
    x = expression.select("tx", "tpm", (F.array_position(known, F.col("sample")) - 1).alias("_k")).withColumn("_j", F.col("_k") % width)
    by_tx = x.groupBy("tx", F.floor(F.col("_k") / width).alias("block")).agg(*[F.sum(F.when(F.col("_j") == j, F.col("tpm"))).alias(f"x{j}") for j in range(width)], F.bit_or(F.expr("shiftleft(1, cast(_j as int))")).alias("has"))
    tx = exons.where("tx is not null").select(*_GENE, "tx", F.struct("start", "end").alias("x")).repartition("tx").groupBy(*_GENE, "tx").agg(F.sort_array(F.collect_set("x")).alias("ex")).where(F.size("ex") > 1)
    none = F.lit(None).cast("long")
    at = lambda i: F.get("ex", i)
    span = lambda e1, s2, e2, s3: F.struct(e1.cast("long").alias("e1"), s2.cast("long").alias("s2"), e2.cast("long").alias("e2"), s3.cast("long").alias("s3"))
    junctions = F.array_distinct(F.transform(F.slice("ex", 1, F.size("ex") - 1), lambda e, i: span(e["end"], none, none, at(i + 1)["start"])))
    chain = F.transform(F.slice("ex", 1, F.greatest(F.size("ex") - 2, F.lit(0))), lambda e, i: span(e["end"], at(i + 1)["start"], at(i + 1)["end"], at(i + 2)["start"]))
    # a chain's transcript may have the outer junction, too
    marked = lambda c, both: F.struct(*[c[n].alias(n) for n in ("e1", "s2", "e2", "s3")], both.alias("both"))
    cs = F.transform("cs", lambda c: marked(c, F.array_contains("js", span(c["e1"], none, none, c["s3"]))))
    spans = tx.select(*_GENE, "tx", junctions.alias("js"), chain.alias("cs")).select(*_GENE, "tx", F.concat(F.transform("js", lambda c: marked(c, F.lit(True))), cs).alias("cs"))
    parts = spans.join(by_tx, "tx", "left").select(*_GENE, "block", "has", *[f"x{j}" for j in range(width)], F.explode("cs").alias("c"))
    where = [*_GENE, "e1", "s2", "e2", "s3"]
    cells = [f"x{j}" for j in range(width)]
    sums = fixed(parts.select("*", "c.*").groupBy(*where, "block").agg(*[F.sum(c).alias(f"a{c}") for c in cells], *[F.sum(F.when(~F.col("both"), F.col(c))).alias(f"t{c}") for c in cells], F.bit_or("has").alias("has")))
    outer = sums.where("s2 is null").select(*_GENE, "e1", "s3", "block", "has", *[F.col(f"a{c}").alias(f"t{c}") for c in cells])
    chained = sums.where("s2 is not null")
    events = chained.select(*where).distinct()
    ours = chained.join(outer.select(*_GENE, "e1", "s3").distinct(), [*_GENE, "e1", "s3"], "left_semi").unionByName(events.join(outer, [*_GENE, "e1", "s3"]), allowMissingColumns=True)
    event_id = F.concat(F.col("gene"), F.lit(";SE:"), F.col("chr"), F.lit(":"), F.concat_ws(":", _span("e1", "s2"), _span("e2", "s3")), F.lit(":"), F.col("strand"))
    whole = ours.groupBy(event_id.alias("event_id"), "block").agg(*[F.sum(f"{k}{c}").alias(f"{k}{c}") for k in "at" for c in cells], F.bit_or("has").alias("has"))
    one = [F.struct(F.get(known, (F.col("block") * width + j).cast("int")).alias("sample"), F.col(f"ax{j}").alias("a"), F.col(f"tx{j}").alias("t"), F.coalesce(F.getbit("has", F.lit(j)) == 1, F.lit(False)).alias("has")) for j in range(width)]
    rows = F.when(F.col("block").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("sample"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("t"), F.lit(True).alias("has")))).otherwise(F.filter(F.array(*one), lambda r: r["has"]))
    return fixed(whole.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.sample", "r.a", "r.t"))


def inclusion(sums: DataFrame, min_total: float = 0.0) -> DataFrame:
    """event_id, sample, psi of sums (event_id, sample, a, t): a by t; null if a transcript isn't expressed anywhere, or the total is 0 or below ``min_total``."""
    # a transcript without expression gives its event a row without a sample
    events = sums.groupBy("event_id").agg(F.collect_list(F.struct("sample", "a", "t")).alias("xs"), F.bool_and(F.col("sample").isNotNull()).alias("whole"))
    flat = events.select("event_id", "whole", F.explode("xs").alias("x")).where("x.sample is not null").select("event_id", "whole", "x.*")
    ok = F.col("whole") & (F.col("t") > 0) & (F.col("t") >= min_total)
    return flat.select("event_id", "sample", F.when(ok, F.coalesce("a", F.lit(0.0)) / F.col("t")).alias("psi"))


def event_psi(events: DataFrame, expression: DataFrame, min_total: float = 0.0) -> DataFrame:
    """event_id, sample, psi: sum over alternative by sum over total transcripts; null if a transcript isn't expressed anywhere, or the total is 0 or below ``min_total``."""
    return inclusion(event_sums(events, expression), min_total)


def isoform_psi(expression: DataFrame) -> DataFrame:
    """gene, tx, sample, psi: share of the gene's expression; null where the gene has none."""
    total = F.sum("tpm").over(Window.partitionBy("gene", "sample"))
    return expression.select("gene", "tx", "sample", F.when(total > 0, F.col("tpm") / total).alias("psi"))


def delta_psi(psi: DataFrame, a: str, b: str, missing: float = 0.0, use_median: bool = False) -> DataFrame:
    """event_id, dpsi (b - a) of condition means or medians over psi (event_id, cond, psi); null where more than the share ``missing`` of either condition is null."""
    f = F.median if use_median else F.avg
    both = psi.where(F.col("cond").isin(a, b))
    at = lambda c: F.when(F.col("cond") == c, F.col("psi"))
    gap = lambda c: F.count_if((F.col("cond") == c) & F.col("psi").isNull()) / F.nullif(F.count_if(F.col("cond") == c), F.lit(0))
    sums = both.groupBy("event_id").agg(f(at(a)).alias("ma"), f(at(b)).alias("mb"), gap(a).alias("ga"), gap(b).alias("gb"))
    ok = (F.col("ga") <= missing) & (F.col("gb") <= missing)
    return sums.select("event_id", F.when(ok, F.col("mb") - F.col("ma")).alias("dpsi"))


def event_abundance(events: DataFrame, expression: DataFrame, samples: DataFrame, least_tpm: float = 0.0) -> DataFrame:
    """event_id, abundance: log10 of the summed expression of each replicate, mean in each condition, mean of both; 0 and what is below the limit are left out."""
    parts = events.select("event_id", F.explode("total").alias("tx"))
    return abundance(parts.join(expression, "tx").groupBy("event_id", "sample").agg(F.sum("tpm").alias("t")), samples, least_tpm)


def abundance(sums: DataFrame, samples: DataFrame, least_tpm: float = 0.0) -> DataFrame:
    """The same of sums (event_id, sample, t)."""
    by_cond = sums.join(samples, "sample").groupBy("event_id", "cond").agg(F.avg(F.when(F.col("t") > 0, F.log10("t"))).alias("m"))
    return by_cond.groupBy("event_id").agg(F.avg("m").alias("abundance"), F.count("m").alias("n")).where((F.col("n") == 2) & (F.col("abundance") != 0) & (F.col("abundance") >= (F.log10(F.lit(least_tpm)) if least_tpm > 0 else F.lit(float("-inf"))))).drop("n")


def replicate_deltas(psi: DataFrame, abundance: DataFrame) -> DataFrame:
    """event_id, cond, delta, abundance of every pair of replicates of a condition."""
    a = psi.select("event_id", "cond", F.col("sample").alias("s1"), F.col("psi").alias("p1"))
    b = psi.select("event_id", "cond", F.col("sample").alias("s2"), F.col("psi").alias("p2"))
    pairs = a.join(b, ["event_id", "cond"]).where("s1 < s2 and p1 is not null and p2 is not null")
    return pairs.join(abundance, "event_id").select("event_id", "cond", "s1", "s2", F.abs(F.col("p1") - F.col("p2")).alias("delta"), "abundance")


def empirical_p(events: DataFrame, deltas: DataFrame, area: int = 1000, lower: float = 0.0) -> DataFrame:
    """event_id, p of dPSI against replicate differences of near abundance.

    events: event_id, dpsi, abundance.  The local sample is ``area`` replicate pairs around
    the nearest abundance (ties: the smaller), cut at the ends of the list (at a left bound
    of 0 where fewer pairs exist).  p = (1 - share of differences at or below) / 2; effects
    below ``lower`` have p 1.  Sorted differences are dealt to blocks of ``area`` rows, so
    an event meets the two or three blocks around its place, not all pairs.
    """
    placed = indexed(deltas, ["abundance", "delta", "event_id", "cond", "s1", "s2"]).withColumnRenamed("_i", "i")
    n = placed.count()
    if not n:
        return events.select("event_id", F.lit(None).cast("double").alias("p"))
    values = placed.groupBy("abundance").agg(F.min("i").alias("i"))
    both = events.where("abundance is not null").select("event_id", "dpsi", "abundance", F.lit(None).cast("long").alias("i")).unionByName(values.select(F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("double").alias("dpsi"), "abundance", "i"))
    # the nearest value on both sides; values sort before events of the same abundance
    marked = F.when(F.col("i").isNotNull(), F.struct("abundance", "i"))
    near = neighbours(parted(both, ["abundance"]), ["abundance", F.col("event_id").isNotNull()], marked).where("event_id is not null").select("event_id", "dpsi", "abundance", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    up = F.col("lo").isNull() | (F.col("hi.abundance") - F.col("abundance") < F.col("abundance") - F.col("lo.abundance"))
    at = F.when(up, F.col("hi.i")).otherwise(F.col("lo.i"))
    half = area // 2
    first = F.greatest(F.lit(0).cast("long"), F.least(at - half, F.lit(max(0, n - area)).cast("long")))
    ranged = near.select("event_id", "dpsi", first.alias("a"), (first + min(area, n)).alias("b"))
    blocks = ranged.withColumn("blk", F.explode(F.sequence(F.floor(F.col("a") / area), F.floor((F.col("b") - 1) / area))))
    met = blocks.join(placed.select("i", "delta", F.floor(F.col("i") / area).alias("blk")), "blk").where("i >= a and i < b")
    share = met.groupBy("event_id", "dpsi").agg(F.count_if(F.col("delta") <= F.abs("dpsi")).alias("below"), F.count("*").alias("m"))
    return share.select("event_id", F.when(F.abs("dpsi") < lower, F.lit(1.0)).otherwise((1 - F.col("below") / F.col("m")) * 0.5).alias("p"))


def bh(rows: DataFrame, p: str = "p", by: Sequence[str] = (), key: Sequence[str] = ("event_id",)) -> DataFrame:
    """``rows`` with fdr, Benjamini and Hochberg's step-up over all rows or within ``by``; null p stay null."""
    fine = rows.where(F.col(p).isNotNull())
    # one order over all rows, groups one after the other, by range partitions: a group of any size is many tasks
    ranked = indexed(fine, [*by, p, *key])
    if by:
        ranked = with_groups(ranked, ranked.groupBy(*by).agg(F.min("_i").alias("_first"), F.count("*").alias("_m")), by)
    else:
        ranked = ranked.withColumn("_first", F.lit(0)).withColumn("_m", F.lit(ranked.count()))
    step = least_after(ranked, F.col(p) * F.col("_m") / (F.col("_i") - F.col("_first") + 1), "_i", by)
    done = step.withColumn("fdr", F.least("_least", F.lit(1.0))).drop("_p", "_i", "_first", "_m", "_least")
    return done.unionByName(rows.where(F.col(p).isNull()).withColumn("fdr", F.lit(None).cast("double")))


def log10_p(rows: DataFrame, p: str = "p", limit: float = 0.05) -> DataFrame:
    """``rows`` with log10p and significant; a p of 0 counts as half the smallest other p."""
    least = rows.where(F.col(p) != 0).agg(F.min(p)).scalar()
    value = F.when(F.col(p) == 0, least / 2).otherwise(F.col(p))
    return rows.withColumn("log10p", -F.log10(value)).withColumn("significant", F.col(p) < limit)


def joined_files(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row an id, a column a table (id, value): an outer merge of any number of tables with one shuffle."""
    long = None
    for name, df in tables:
        part = df.select("id", F.lit(name).alias("name"), "value")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("id").pivot("name", [n for n, _ in tables]).agg(F.max("value"))


def selected_fields(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The same with the last value (by seq) of repeated ids, and 0 where an id is missing."""
    long = None
    for name, df in tables:
        part = df.select("id", F.lit(name).alias("name"), "seq", "value")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("id").pivot("name", [n for n, _ in tables]).agg(F.max_by("value", "seq")).na.fill(0)


#: Values of the smaller sample up to which, without ties, the rank tests are exact; pairs up to which the signed-rank test is.
EXACT_SAMPLE, EXACT_PAIRS = 8, 50


def _two_sided(ways: list[int]) -> list[float]:
    """Two-sided p of each value of a symmetric statistic with so many ways for each value."""
    total, below, out = sum(ways), 0, []
    for w in ways:
        below += w
        out.append(below / total)
    return [min(1.0, 2 * min(out[u], 1 - out[u] + ways[u] / total)) for u in range(len(ways))]


def rank_sum_ways(n1: int, n2: int) -> list[int]:
    """How many of the choices of n1 ranks out of n1 + n2 give each value of U, from 0 to n1 n2.

    The counts are the coefficients of a Gaussian binomial: a product of (1 - q^(n2 + i))
    over one of (1 - q^i), for the smaller side's i, so few steps of the length of the result.
    """
    n1, n2 = min(n1, n2), max(n1, n2)
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for u in range(n1 * n2, n2 + i - 1, -1):
            ways[u] -= ways[u - n2 - i]
        for u in range(i, n1 * n2 + 1):
            ways[u] += ways[u - i]
    return ways


def _exact_rank_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact p of the wanted values of U, one pair of sample sizes after another."""
    for batch in batches:
        for r in batch.to_pylist():
            ps = _two_sided(rank_sum_ways(r["lo"], r["hi"]))
            us = sorted(r["us"])
            yield pa.RecordBatch.from_arrays([pa.array([r["lo"]] * len(us), pa.int64()), pa.array([r["hi"]] * len(us), pa.int64()), pa.array(us, pa.int64()), pa.array([ps[u] for u in us])], ["lo", "hi", "u", "exact"])


def mann_whitney(values: DataFrame) -> DataFrame:
    """event_id, p of the two-sided rank test between the two conditions of values (event_id, cond, psi).

    Mid-ranks and tie counts are windows.  Without ties and with at most EXACT_SAMPLE values
    in the smaller sample the p-value is that of the exact distribution, else the
    tie-corrected normal one with continuity correction; an event without both conditions
    or without spread has 1.  Null and NaN values are left out.
    """
    x = values.where("psi is not null and not isnan(psi)")
    conds = x.groupBy("event_id").agg(F.min("cond").alias("c1"))
    ranked = x.join(conds, "event_id").withColumn("_lo", F.rank().over(Window.partitionBy("event_id").orderBy("psi"))).withColumn("_t", F.count("*").over(Window.partitionBy("event_id", "psi")))
    ranked = ranked.withColumn("_rank", F.col("_lo") + (F.col("_t") - 1) / 2.0)
    one = F.col("cond") == F.col("c1")
    g = ranked.groupBy("event_id").agg(F.sum(F.when(one, F.col("_rank"))).alias("r1"), F.count_if(one).alias("n1"), F.count("*").alias("n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    mean, var = n1 * n2 / 2, n1 * n2 / 12 * ((n + 1) - F.col("ties") / F.greatest(n * (n - 1), F.lit(1.0)))
    z = F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)) / F.sqrt(F.greatest(var, F.lit(1e-12)))
    normal = F.when((n1 == 0) | (n2 == 0) | (var <= 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), _erfc(z / F.sqrt(F.lit(2.0)))))
    small = (F.least(n1, n2) <= EXACT_SAMPLE) & (F.col("ties") == 0) & (n1 > 0) & (n2 > 0)
    g = g.select("event_id", F.least(n1, n2).cast("long").alias("lo"), F.greatest(n1, n2).cast("long").alias("hi"), u.cast("long").alias("u"), small.alias("small"), normal.alias("normal"))
    # U has n1 n2 + 1 values, so the wanted ones of a pair of sizes are bounded whatever the number of events
    wanted = g.where("small").groupBy("lo", "hi").agg(F.collect_set("u").alias("us"))
    exact = wanted.mapInArrow(_exact_rank_sums, "lo long, hi long, u long, exact double")
    return g.join(exact, ["lo", "hi", "u"], "left").select("event_id", F.coalesce(F.when(F.col("small"), F.col("exact")), F.col("normal")).alias("p"))


def wilcoxon_pairs(values: DataFrame) -> DataFrame:
    """event_id, p of the two-sided signed-rank test over pairs (event_id, psi1, psi2).

    Pairs without a difference, null or NaN are left out.  Without ties among the absolute
    differences and with at most EXACT_PAIRS of them the p-value is exact, else the
    tie-corrected normal one; an event without any difference has 1.
    """
    d = F.col("psi2") - F.col("psi1")
    x = values.select("event_id", d.alias("d")).where("d is not null and not isnan(d)")
    size = F.abs("d")
    ranked = x.where("d <> 0").withColumn("_lo", F.rank().over(Window.partitionBy("event_id").orderBy(size))).withColumn("_t", F.count("*").over(Window.partitionBy("event_id", size)))
    ranked = ranked.withColumn("_rank", F.col("_lo") + (F.col("_t") - 1) / 2.0)
    g = ranked.groupBy("event_id").agg(F.sum(F.when(F.col("d") > 0, F.col("_rank")).otherwise(0.0)).alias("w"), F.count("*").alias("n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"))
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0
    normal = _erfc(F.abs(F.col("w") - mean) / F.sqrt(F.greatest(var, F.lit(1e-12))) / F.sqrt(F.lit(2.0)))
    small = (F.col("n") <= EXACT_PAIRS) & (F.col("ties") == 0)
    tables = []
    for r in g.where(small).select("n").distinct().collect():  # numbers of pairs: EXACT_PAIRS at most
        ways = [1]
        for k in range(1, r.n + 1):  # a rank is with the positive ones or not
            ways = [(ways[i] if i < len(ways) else 0) + (ways[i - k] if i >= k else 0) for i in range(len(ways) + k)]
        tables.append((r.n, _two_sided(ways)))
    exact = values.sparkSession.createDataFrame(tables, "n long, ps array<double>")
    p = g.join(F.broadcast(exact), "n", "left").select("event_id", F.coalesce(F.when(small, F.get("ps", F.col("w").cast("int"))), F.least(F.lit(1.0), normal)).alias("p"))
    return x.select("event_id").distinct().join(p, "event_id", "left").select("event_id", F.coalesce("p", F.lit(1.0)).alias("p"))


def diff_splice(psi: DataFrame, conditions: Sequence[str], events: DataFrame | None = None, expression: DataFrame | None = None, method: str = "empirical", area: int = 1000, lower: float = 0.0, missing: float = 0.0, use_median: bool = False, least_tpm: float = 0.0, paired: bool = False, by_gene: bool = False, every_pair: bool = False) -> DataFrame:
    """cond1, cond2, event_id, dpsi, p of neighbouring conditions, or of every pair of them.

    psi: event_id, sample, cond, psi.  The empirical method needs events (event_id, total)
    and expression (tx, sample, tpm) for abundances and gives no row to events without one;
    the classical one is the rank test, or the signed-rank test over replicates paired by
    the order of their names.  ``by_gene`` corrects p within the gene of an event id.
    Events with too many gaps have a null dpsi and p 1.
    """
    if method not in ("empirical", "classical") or (method == "empirical" and (events is None or expression is None)):
        raise ValueError(f"method {method} is unknown or lacks events and expression")
    out = []
    for a, b in combinations(conditions, 2) if every_pair else pairwise(conditions):
        both = psi.where(F.col("cond").isin(a, b))
        effects = delta_psi(both, a, b, missing, use_median)
        sound = effects.where("dpsi is not null")
        if method == "empirical":
            samples = both.select("sample", "cond").distinct()
            abundance = event_abundance(events, expression, samples, least_tpm)
            ps = empirical_p(sound.join(abundance, "event_id"), replicate_deltas(both, abundance), area, lower)
        elif paired:
            names = both.select("sample", "cond").distinct().withColumn("k", F.row_number().over(Window.partitionBy("cond").orderBy("sample")))  # a row a sample
            sides = both.join(F.broadcast(names), ["sample", "cond"])
            first, second = (sides.where(F.col("cond") == c).select("event_id", "k", F.col("psi").alias(f"psi{i}")) for i, c in ((1, a), (2, b)))
            ps = wilcoxon_pairs(first.join(second, ["event_id", "k"]))
        else:
            ps = mann_whitney(both)
        tested = sound.join(ps, "event_id").select("event_id", "dpsi", "p")
        if by_gene:
            tested = bh(tested.withColumn("gene", F.split("event_id", ";")[0]), by=["gene"]).select("event_id", "dpsi", F.col("fdr").alias("p"))
        rows = tested.unionByName(effects.where("dpsi is null").withColumn("p", F.lit(1.0)))
        out.append(rows.select(F.lit(a).alias("cond1"), F.lit(b).alias("cond2"), "event_id", "dpsi", "p"))
    if not out:
        raise ValueError("two conditions at least")
    return reduce(DataFrame.unionByName, out)


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: the published coefficients
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
