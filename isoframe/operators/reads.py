"""Coverage, junctions, gene models, posterior samples and event filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions import columns as C
from isoframe.operators.ordering import summed_before


def aligned_blocks(reads: DataFrame) -> DataFrame:
    """``reads`` (with pos, cigar) with start, end of each aligned block, and skips (start, end) as junctions."""
    step = F.aggregate(
        C.cigar_parts("cigar"),
        F.struct(F.col("pos").cast("long").alias("at"), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.when(p["op"].isin("M", "D", "N", "=", "X"), p["n"]).otherwise(F.lit(0).cast("long"))).alias("at"),
            F.concat(a["out"], F.when(p["op"].isin("M", "=", "X", "N"), F.array(F.struct(p["op"].alias("kind"), a["at"].alias("start"), (a["at"] + p["n"] - 1).alias("end")))).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return reads.withColumn("_b", F.explode(step)).select("*", F.col("_b.kind").alias("kind"), F.col("_b.start").alias("start"), F.col("_b.end").alias("end")).drop("_b")


def coverage(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, depth where depth changes: block starts and ends summed before a running sum, so no position is written for each read."""
    blocks = aligned_blocks(reads).where("kind <> 'N'")
    steps = blocks.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("s")).groupBy(*keys, F.col("s.pos").alias("pos")).agg(F.sum("s.d").alias("d"))
    return summed_before(steps, "d", ["pos"], keys).withColumnRenamed("_sum", "depth").drop("d")


def junction_counts(reads: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """keys, donor, acceptor, n of skips that occur at least ``least`` times."""
    skips = aligned_blocks(reads).where("kind = 'N'")
    return skips.groupBy(*keys, (F.col("start") - 1).alias("donor"), (F.col("end") + 1).alias("acceptor")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def overlaid_junctions(junctions: DataFrame, keys: Sequence[str], how: str = "mean") -> DataFrame:
    """keys, donor, acceptor, n: the mean or median of junctions' counts over the files that hold them, a half rounded to the even number."""
    if how not in ("mean", "median"):
        raise ValueError(f"unknown aggregate {how}")
    middle = F.avg("n") if how == "mean" else F.percentile("n", F.lit(0.5))
    return junctions.groupBy(*keys, "donor", "acceptor").agg(F.bround(middle, 0).cast("long").alias("n"))


def intron_islands(introns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, island, start, end: what all introns of a run of overlapping ones share, and its length shrunk to the power 0.7."""
    from isoframe.operators.splice import islands

    shared = islands(introns, keys).groupBy(*keys, "island").agg(F.max("start").alias("start"), F.min("end").alias("end")).where("start < end")
    return shared.withColumn("shrunk", F.pow((F.col("end") - F.col("start")).cast("double"), F.lit(0.7)))


def rpkm(counts: DataFrame, total: int) -> DataFrame:
    """``counts`` (n, length) with rpkm."""
    return counts.withColumn("rpkm", F.col("n") / (F.col("length") / 1000.0) / (total / 1e6))


def insert_lengths(pairs: DataFrame, k: float = 2.0) -> DataFrame:
    """One row: mean, sd, n, least, most, dispersion of positive insert lengths within k standard deviations of their first mean."""
    pairs = pairs.where("length > 0")
    mean, sd = pairs.agg(F.avg("length")).scalar(), pairs.agg(F.stddev_pop("length")).scalar()
    kept = pairs.where(F.abs(F.col("length") - mean) <= k * sd)
    return kept.agg(F.avg("length").alias("mean"), F.stddev_pop("length").alias("sd"), F.count("*").alias("n"), F.min("length").alias("least"), F.max("length").alias("most")).withColumn("dispersion", F.col("sd") / F.sqrt("mean"))


def paired_mates(reads: DataFrame, strand_rule: str = "fr-unstranded") -> DataFrame:
    """name, left, right, length of reads (qname, flag, pos, cigar) whose two mates lie on opposite strands.

    left is the first start and right the last end; by the rule fr-firststrand they are the
    start of the mate on the + strand and the end of the other one, so that mates which
    point away from each other have a length that may be 0 or negative.
    """
    if strand_rule not in ("fr-unstranded", "fr-firststrand"):
        raise ValueError(f"unknown strand rule {strand_rule}")
    r = reads.select(C.mate_name("qname").alias("name"), C.mate_strand("flag").alias("strand"), F.col("pos").cast("long").alias("pos"), C.cigar_end("pos", "cigar").alias("end"))
    left, right = F.col("pos"), F.col("end")
    if strand_rule == "fr-firststrand":
        left, right = F.when(F.col("strand") == "+", left), F.when(F.col("strand") == "-", right)
    strands = F.min("strand") != F.max("strand")
    g = r.groupBy("name").agg(F.count("*").alias("n"), F.when(strands, 2).otherwise(1).alias("k"), F.min(left).alias("left"), F.max(right).alias("right"))
    return g.where("n = 2 and k = 2").select("name", "left", "right", (F.col("right") - F.col("left") + 1).alias("length"))


def reads_inside(reads: DataFrame, genes: DataFrame, least: int = 20, bin_size: int = 100_000) -> DataFrame:
    """gene, n of genes (gene, chr, start, end) with at least ``least`` reads (chr, start, end) wholly inside; an equi-join on bins."""
    r = reads.withColumn("_bin", F.floor(F.col("start") / bin_size))
    g = genes.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size)))).withColumnsRenamed({"start": "gs", "end": "ge"})
    return r.join(g, ["chr", "_bin"]).where("start >= gs and end <= ge").groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def credible_interval(samples: DataFrame, alpha: float = 0.05) -> DataFrame:
    """event, mean, lo, hi of posterior samples (event, psi array): order statistics at the rounded shares, counted from 1."""
    n = F.size("psi")
    s = F.array_sort("psi")
    at = lambda share: F.greatest(F.lit(1), F.rint(n * share).cast("int"))
    return samples.select("event", (F.aggregate("psi", F.lit(0.0), lambda a, x: a + x) / n).alias("mean"), F.element_at(s, at(alpha / 2)).alias("lo"), F.element_at(s, at(1 - alpha / 2)).alias("hi"))


def bayes_factors(pairs: DataFrame, width: float = 0.3, still: float = 0.009, most: float = 1e12) -> DataFrame:
    """event, delta, bf of paired posterior samples (event, psi1, psi2): prior density 1 by a Gaussian kernel estimate of the difference at 0."""
    d = F.zip_with("psi1", "psi2", lambda a, b: a - b)
    x = pairs.select("event", d.alias("d")).withColumn("n", F.size("d"))
    x = x.withColumn("delta", F.aggregate("d", F.lit(0.0), lambda a, v: a + v) / F.col("n"))
    x = x.withColumn("sd", F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, v: a + (v - F.col("delta")) * (v - F.col("delta"))) / (F.col("n") - 1)))
    h = F.col("sd") * width
    density = F.aggregate("d", F.lit(0.0), lambda a, v: a + F.exp(-v * v / (2 * h * h))) / (F.col("n") * h * math.sqrt(2 * math.pi))
    bf = F.when(F.abs("delta") <= still, 0.0).when((F.col("sd") == 0) | (density <= 0), most).otherwise(F.least(1 / density, F.lit(most)))
    return x.select("event", "delta", bf.alias("bf"))


def bayes_filter(rows: DataFrame, dpsi: float, bf: float, inc: int, exc: int, both: int, either: bool = True) -> DataFrame:
    """Rows (delta, bf, counts1, counts2) with enough effect, Bayes factor and reads in either or both samples."""

    def enough(c: str):
        n = C.read_counts(c)
        return (n["inc"] >= inc) & (n["exc"] >= exc) & (n["inc"] + n["exc"] >= both)

    reads = (enough("counts1") | enough("counts2")) if either else (enough("counts1") & enough("counts2"))
    return rows.where((F.abs("delta") >= dpsi) & (F.abs("bf") >= bf) & reads)


def replicate_votes(rows: DataFrame, least: int) -> DataFrame:
    """event, n, votes of events in at least ``least`` files whose signs agree that often."""
    g = rows.groupBy("event").agg(F.count("*").alias("n"), F.sum(F.signum("delta")).alias("votes"))
    return g.where((F.col("n") >= least) & (F.abs("votes") >= least))


def count_filter(rows: DataFrame) -> DataFrame:
    """Events (etype, inc, exc, common) with enough reads for their type."""
    t = F.col("etype")
    ok = (
        F.when(t.isin("SE", "RI"), (F.col("inc") + F.col("exc") >= 10) & (F.col("exc") >= 0) & (F.col("common") >= 1))
        .when(t.isin("AFE", "ALE"), F.col("inc") + F.col("exc") >= 20)
        .when(t == "TandemUTR", (F.col("inc") >= 1) & (F.col("exc") >= 1) & (F.col("inc") + F.col("exc") >= 20))
        .otherwise(False)
    )
    return rows.where(ok)


def threshold_counts(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """threshold, n of rows with at least that Bayes factor."""
    sums = rows.agg(*[F.count_if(F.col("bf") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])).alias("x")).select("x.*")


def overlay(depths: DataFrame, samples: DataFrame, use_median: bool = False) -> DataFrame:
    """group, pos, depth: mean or median over the samples of a group of depths (sample, pos, depth)."""
    f = F.median if use_median else F.avg
    return depths.join(samples, "sample").groupBy("group", "pos").agg(f("depth").alias("depth"))


def compressed(depths: DataFrame, keys: Sequence[str], resolution: float) -> DataFrame:
    """keys, bin, depth: mean depth of plotted positions (x, depth) within each bin of ``resolution``."""
    return depths.groupBy(*keys, F.floor(F.col("x") / resolution).alias("bin")).agg(F.avg("depth").alias("depth"))


def plot_scale(segments: DataFrame, keys: Sequence[str], exon_scale: float, intron_scale: float) -> DataFrame:
    """``segments`` (start, end, exonic) with x, their plotted start: a base takes 1 / scale, summed from the first segment on."""
    width = (F.col("end") - F.col("start")) / F.when(F.col("exonic"), exon_scale).otherwise(intron_scale)
    before = F.sum(width).over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("x", F.coalesce(before, F.lit(0.0)))


def read_classes(assigned: DataFrame) -> DataFrame:
    """gene, fits (0/1 for each isoform), n of reads (gene, read, isoform, ok)."""
    vectors = assigned.groupBy("gene", "read").agg(F.transform(F.array_sort(F.collect_list(F.struct("isoform", F.col("ok").cast("int").alias("ok")))), lambda x: x["ok"]).alias("fits"))
    return vectors.groupBy("gene", "fits").agg(F.count("*").alias("n"))


def isoform_fits(reads: DataFrame, exons: DataFrame, overhang: int = 1) -> DataFrame:
    """gene, read, isoform, ok: the read's blocks are the isoform's exons cut by the read, with enough overhang.

    reads: gene, read, pos, cigar.  exons: gene, isoform, start, end.  A block fits an exon that
    holds it; inner edges must be the exon's own, and blocks must meet exons without a gap.
    """
    blocks = aligned_blocks(reads).where("kind <> 'N'").select("gene", "read", "start", "end")
    w = Window.partitionBy("gene", "read").orderBy("start")
    n = F.count("*").over(Window.partitionBy("gene", "read"))
    blocks = blocks.withColumn("k", F.row_number().over(w)).withColumn("m", n)
    order = F.row_number().over(Window.partitionBy("gene", "isoform").orderBy("es"))
    iso = exons.select("gene", "isoform", F.col("start").alias("es"), F.col("end").alias("ee")).withColumn("i", order)
    met = blocks.join(iso, "gene").where((F.col("start") >= F.col("es")) & (F.col("end") <= F.col("ee")))
    left = (F.col("k") == 1) | (F.col("start") == F.col("es"))
    right = (F.col("k") == F.col("m")) | (F.col("end") == F.col("ee"))
    long = (F.col("m") == 1) | (F.col("end") - F.col("start") + 1 >= overhang)
    good = met.where(left & right & long).groupBy("gene", "read", "isoform", "m").agg(F.count("*").alias("found"), (F.max("i") - F.min("i") + 1).alias("span"))
    every = blocks.select("gene", "read").distinct().join(exons.select("gene", "isoform").distinct(), "gene")
    ok = F.coalesce((F.col("found") == F.col("m")) & (F.col("span") == F.col("m")), F.lit(False))
    return every.join(good, ["gene", "read", "isoform"], "left").select("gene", "read", "isoform", ok.alias("ok"))


def expected_counts(isoforms: DataFrame, read_length: int, total: int) -> DataFrame:
    """``isoforms`` (gene, isoform, length, psi) with expected reads: shares of psi times the positions that a read fits."""
    weight = F.col("psi") * F.greatest(F.col("length") - read_length + 1, F.lit(0))
    return isoforms.withColumn("expected", total * weight / F.sum(weight).over(Window.partitionBy("gene")))
