"""Converters of four tools' outputs to one row a feature.

Columns: GeneName, GroupID, FeatureID, FeatureType, FeatureLabel, strand, pvalue, qvalue,
dpsi, counts1, counts2, psi (arrays), cond_psi (array, in the order of the file's conditions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions import columns as C
from isoframe.operators.ordering import indexed

_EMPTY = F.array


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def intron_number(i: Column) -> Column:
    return F.format_string("i%03d", i)


def from_majiq(rows: DataFrame) -> DataFrame:
    """rows: gene, lsv, chr, strand, dpsi, psi_1, psi_2 and junctions as ``;`` lists in step."""
    zipped = F.arrays_zip(*[F.split(c, ";").alias(c) for c in ("dpsi", "junctions", "psi_1", "psi_2")])
    x = rows.select("gene", "lsv", "chr", "strand", F.posexplode(zipped).alias("i", "x"))
    return x.select(
        F.col("gene").alias("GeneName"), F.col("lsv").alias("GroupID"), intron_number(F.col("i") + 1).alias("FeatureID"), F.lit("intron").alias("FeatureType"),
        F.concat("chr", F.lit(":"), F.col("x.junctions")).alias("FeatureLabel"), "strand", _none("double").alias("pvalue"), _none("double").alias("qvalue"), C.number("x.dpsi").alias("dpsi"),
        _none("array<double>").alias("counts1"), _none("array<double>").alias("counts2"), _none("array<double>").alias("psi"), F.array(C.number("x.psi_1"), C.number("x.psi_2")).alias("cond_psi"),
    )


def ratio(text: Column) -> Column:
    """``a/b`` as a number; null where b is 0."""
    return F.try_divide(F.substring_index(text, "/", 1).try_cast("double"), F.nullif(F.substring_index(text, "/", -1).try_cast("double"), F.lit(0.0)))


def from_leafcutter(clusters: DataFrame, effects: DataFrame, numerators: DataFrame, ratios: DataFrame) -> DataFrame:
    """clusters: cluster (``chr:id``), status, p, p_adjust, genes; effects: intron, psi_1, psi_2, deltapsi and o (order); the others: intron, values."""
    good = clusters.where("status = 'Success'").select(F.substring_index("cluster", ":", -1).alias("cluster"), C.number("p").alias("pvalue"), C.number("p_adjust").alias("qvalue"), F.when(F.col("genes") == "NA", ".").otherwise(F.col("genes")).alias("GeneName"))
    part = F.split("intron", ":")
    e = effects.withColumn("cluster", F.get(part, F.lit(3))).withColumn("strand", F.substring_index("cluster", "_", -1)).join(good, "cluster")
    number = F.row_number().over(Window.partitionBy("cluster").orderBy("o"))
    e = e.withColumn("n", number).join(numerators.select("intron", C.numbers("values", " ").alias("counts1")), "intron", "left")
    e = e.join(ratios.select("intron", F.transform(F.split("values", " "), ratio).alias("psi")), "intron", "left")
    return e.select(
        "GeneName", F.col("cluster").alias("GroupID"), intron_number(F.col("n")).alias("FeatureID"), F.lit("intron").alias("FeatureType"),
        F.concat(F.get(part, F.lit(0)), F.lit(":"), F.get(part, F.lit(1)), F.lit("-"), F.get(part, F.lit(2))).alias("FeatureLabel"), F.when(F.col("strand") == "NA", ".").otherwise(F.col("strand")).alias("strand"),
        "pvalue", "qvalue", C.number("deltapsi").alias("dpsi"), "counts1", _none("array<double>").alias("counts2"), "psi", F.array(C.number("psi_1"), C.number("psi_2")).alias("cond_psi"),
    )


def event_label(kind: str) -> Column:
    """Coordinates of an event as a junction label, by type and strand."""
    c = lambda n: F.col(f"`{n}`")
    t = lambda *parts: F.concat("chr", F.lit(":"), *[F.lit(p) if p in ",-:" else c(p) for p in parts])
    if kind == "SE":
        return t("upstreamEE", ",", "exonStart_0base", "-", "exonEnd", ",", "downstreamES")
    if kind == "RI":
        return t("upstreamES", "-", "upstreamEE", ":", "downstreamES", "-", "downstreamEE")
    if kind == "MXE":
        return t("upstreamEE", ",", "1stExonStart_0base", "-", "1stExonEnd", ":", "2ndExonStart_0base", "-", "2ndExonEnd", ",", "downstreamES")
    if kind == "A5SS":
        return t("longExonStart_0base", "-", "longExonEnd", ":", "shortES", "-", "shortEE", ",", "flankingES")
    return t("flankingEE", ",", "longExonStart_0base", "-", "longExonEnd", ":", "shortES", "-", "shortEE")


#: The order of types in which a converted file numbers its events.
FILE_ORDER = ["SE", "RI", "MXE", "A5SS", "A3SS"]


def from_all_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Event tables of one comparison by type, numbered through in file order."""
    out, before = None, 0
    for kind in FILE_ORDER:
        if kind in tables:
            part = from_events(tables[kind], kind, before=before)
            out = part if out is None else out.unionByName(part)
            before += tables[kind].count()
    return out


def from_events(events: DataFrame, kind: str, order: str = "ID", before: int = 0) -> DataFrame:
    """An event table (file columns as text) of one type; group ids count its rows in the order of ``order``, after ``before`` others."""
    symbol = F.regexp_replace("geneSymbol", '^"|"$', "")
    events = indexed(events.withColumn("_o", F.col(order).try_cast("long")), ["_o"]).drop("_o", "_p")
    n = F.col("_i") + 1 + before
    list_of = lambda a, b: C.numbers(F.concat_ws(",", a, b))
    return events.select(
        F.when(F.col("geneSymbol").isNull() | (symbol == "NA"), F.regexp_replace("GeneID", '^"|"$', "")).otherwise(symbol).alias("GeneName"),
        F.format_string("J%06d" if kind == "A3SS" else "J%05d", n).alias("GroupID"), F.col(order).alias("FeatureID"), F.lit(kind).alias("FeatureType"), event_label(kind).alias("FeatureLabel"), "strand",
        C.number("PValue").alias("pvalue"), C.number("FDR").alias("qvalue"), C.number("IncLevelDifference").alias("dpsi"), list_of("IJC_SAMPLE_1", "IJC_SAMPLE_2").alias("counts1"), list_of("SJC_SAMPLE_1", "SJC_SAMPLE_2").alias("counts2"),
        list_of("IncLevel1", "IncLevel2").alias("psi"), _none("array<double>").alias("cond_psi"),
    )


def largest_difference(values: Column) -> Column:
    """Second less first of two conditions; of more, the largest absolute difference of any two."""
    return F.when(F.size(values) == 2, F.get(values, F.lit(1)) - F.get(values, F.lit(0))).otherwise(F.array_max(values) - F.array_min(values))


def from_group_introns(groups: DataFrame, introns: DataFrame, counts: DataFrame) -> DataFrame:
    """Relative usage: groups (group_id, gene, p_value, q_value), introns (group_id, chr, start, end, strand, psi array, o), counts (chr, start, end, counts array).

    A raw inclusion level is an intron's count by its group's, sample by sample.
    """
    x = introns.join(groups, "group_id").join(counts, ["chr", "start", "end"])
    samples = x.select("*", F.posexplode("counts").alias("s", "n"))
    total = F.sum("n").over(Window.partitionBy("group_id", "s"))
    level = samples.withColumn("level", F.try_divide("n", F.nullif(total, F.lit(0.0))))
    back = level.groupBy("group_id", "chr", "start", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "level"))), lambda v: v["level"]).alias("levels"))
    n = F.row_number().over(Window.partitionBy("group_id").orderBy("o"))
    x = x.withColumn("i", n).join(back, ["group_id", "chr", "start", "end"])
    return x.select(
        F.col("gene").alias("GeneName"), F.col("group_id").alias("GroupID"), intron_number(F.col("i")).alias("FeatureID"), F.lit("intron").alias("FeatureType"), F.concat("chr", F.lit(":"), "start", F.lit("-"), "end").alias("FeatureLabel"), "strand",
        F.col("p_value").alias("pvalue"), F.col("q_value").alias("qvalue"), largest_difference(F.col("psi")).alias("dpsi"), F.col("counts").alias("counts1"), _none("array<double>").alias("counts2"), F.col("levels").alias("psi"), F.col("psi").alias("cond_psi"),
    )


def log2_change(first: Column, second: Column) -> Column:
    """log2 of second by first; 0 where the second is 0, infinite where only the first is."""
    return F.when(second == 0, 0.0).when(first > 0, F.log2(second / F.nullif(first, F.lit(0.0)))).otherwise(float("inf"))


def from_abundances(introns: DataFrame, counts: DataFrame) -> DataFrame:
    """Differential abundance: introns (chr, start, end, strand, gene, status, p_value, q_value, mean_1, mean_2, o), counts (chr, start, end, strand, counts)."""
    t = indexed(introns.where("status = 'TEST'"), ["o"]).withColumn("n", F.col("_i") + 1).drop("_i", "_p")
    x = t.join(counts, ["chr", "start", "end", "strand"])
    name = F.format_string("J%06d", F.col("n"))
    return x.select(
        F.col("gene").alias("GeneName"), name.alias("GroupID"), name.alias("FeatureID"), F.lit("intron").alias("FeatureType"), F.concat("chr", F.lit(":"), "start", F.lit("-"), "end").alias("FeatureLabel"), "strand",
        F.col("p_value").alias("pvalue"), F.col("q_value").alias("qvalue"), log2_change(F.col("mean_1"), F.col("mean_2")).alias("dpsi"), F.col("counts").alias("counts1"), _none("array<double>").alias("counts2"), _none("array<double>").alias("psi"), F.array("mean_1", "mean_2").alias("cond_psi"),
    )


def union_unified(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
