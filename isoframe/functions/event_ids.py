"""Event ids, labels and two-isoform models of other tools, as expressions over event columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def _one_based(c: str) -> Column:
    return (F.col(f"`{c}`").cast("long") + 1).cast("string")


def junctions_of_label(label: Column) -> Column:
    """struct(inclusion, exclusion): arrays of (start, end) junctions that a coordinate label stands for; null for other text.

    Five forms are known, told apart by where commas and colons stand: skipped exon, retained
    intron, exclusive exons, alternative 5' and 3' sites.
    """
    n = F.transform(F.split(F.regexp_replace(F.regexp_extract(label, r":(.*)$", 1), "[^0-9]+", " "), " "), lambda x: x.try_cast("long"))
    at = lambda i: F.get(n, F.lit(i))
    j = lambda a, b: F.struct(at(a).alias("start"), at(b).alias("end"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    both = lambda inc, exc: F.struct((F.array(*inc) if inc else none).alias("inclusion"), (F.array(*exc) if exc else none).alias("exclusion"))
    chrom = r"^[\w.]*:"
    return (
        F.when(label.rlike(chrom + r"\d+,\d+-\d+,\d+$"), both([j(0, 1), j(2, 3)], [j(0, 3)]))
        .when(label.rlike(chrom + r"\d+-\d+:\d+-\d+$"), both([j(1, 2)], []))
        .when(label.rlike(chrom + r"\d+,\d+-\d+:\d+-\d+,\d+$"), both([j(0, 1), j(2, 5)], [j(0, 3), j(4, 5)]))
        .when(label.rlike(chrom + r"\d+-\d+:\d+-\d+,\d+$"), both([j(1, 4)], [j(3, 4)]))
        .when(label.rlike(chrom + r"\d+,\d+-\d+:\d+-\d+$"), both([j(0, 1)], [j(0, 3)]))
    )


def local_event_id(kind: str, gene: Column) -> Column:
    """Id of a skipped exon or alternative site as ``gene;TYPE:chr:junctions:strand``, 1-based, long form first."""
    s, e, b = _one_based, _text, F.col("strand")
    span = lambda a, c: F.concat(a, F.lit("-"), c)
    if kind == "SE":
        coords = F.concat_ws(":", span(e("upstreamEE"), s("exonStart_0base")), span(e("exonEnd"), s("downstreamES")))
    else:
        after = F.concat_ws(":", span(e("longExonEnd"), s("flankingES")), span(e("shortEE"), s("flankingES")))
        before = F.concat_ws(":", span(e("flankingEE"), s("longExonStart_0base")), span(e("flankingEE"), s("shortES")))
        coords = F.when((b == "+") == F.lit(kind == "A5SS"), after).otherwise(before)
    return F.concat(gene, F.lit(f";{kind[:2]}:"), F.col("chr"), F.lit(":"), coords, F.lit(":"), b)


#: Exons of an event as (start column, end column), in genomic order on the plus strand.
PARTS = {
    "SE": [("upstreamES", "upstreamEE"), ("exonStart_0base", "exonEnd"), ("downstreamES", "downstreamEE")],
    "RI": [("upstreamES", "upstreamEE"), ("riExonStart_0base", "riExonEnd"), ("downstreamES", "downstreamEE")],
    "MXE": [("upstreamES", "upstreamEE"), ("1stExonStart_0base", "1stExonEnd"), ("2ndExonStart_0base", "2ndExonEnd"), ("downstreamES", "downstreamEE")],
    "A5SS": [("shortES", "shortEE"), ("longExonStart_0base", "longExonEnd"), ("flankingES", "flankingEE")],
    "A3SS": [("flankingES", "flankingEE"), ("longExonStart_0base", "longExonEnd"), ("shortES", "shortEE")],
}


def joined_exons_id(kind: str) -> Column:
    """``chr_start_end_strand`` of each exon, 1-based, joined by ``@`` in the order of transcription."""
    parts = [F.concat_ws("_", F.col("chr"), _one_based(a), _text(b), F.col("strand")) for a, b in PARTS[kind]]
    return F.when(F.col("strand") == "-", F.concat_ws("@", *parts[::-1])).otherwise(F.concat_ws("@", *parts))


def isoform_rows(events: DataFrame, kind: str) -> DataFrame:
    """``events`` with isoform (A: inclusion, B: exclusion) and exon start, end (1-based) of the two isoforms.

    On the minus strand the inclusion isoform of exclusive exons has the second one.
    """
    exon = lambda p, iso: F.struct(F.lit(iso).alias("isoform"), (F.col(f"`{p[0]}`").cast("long") + 1).alias("start"), F.col(f"`{p[1]}`").cast("long").alias("end"))
    parts = PARTS[kind]
    if kind == "MXE":
        up, first, second, down = parts
        plus = [exon(up, "A"), exon(first, "A"), exon(down, "A"), exon(up, "B"), exon(second, "B"), exon(down, "B")]
        minus = [exon(up, "A"), exon(second, "A"), exon(down, "A"), exon(up, "B"), exon(first, "B"), exon(down, "B")]
        rows = F.when(F.col("strand") == "-", F.array(*minus)).otherwise(F.array(*plus))
    elif kind == "SE":
        rows = F.array(*[exon(p, "A") for p in parts], exon(parts[0], "B"), exon(parts[2], "B"))
    elif kind == "RI":
        rows = F.array(exon(parts[1], "A"), exon(parts[0], "B"), exon(parts[2], "B"))
    else:
        long, short, flank = ("longExonStart_0base", "longExonEnd"), ("shortES", "shortEE"), ("flankingES", "flankingEE")
        rows = F.array(exon(long, "A"), exon(flank, "A"), exon(short, "B"), exon(flank, "B"))
    return events.withColumn("_r", F.explode(rows)).select("*", "_r.isoform", "_r.start", "_r.end").drop("_r")


def two_isoform_model(etype: str, lengths: Column, read_length: int = 0) -> Column:
    """Array of isoforms, each an array of (label, length), of an event with the given part lengths.

    SE: up, exon, down; TandemUTR: core, extension; AFE: summed proximal and distal lengths,
    each longer by the reads that reach from it into the gene.  Other types have no model.
    """
    at = lambda i: F.get(lengths, F.lit(i))
    part = lambda label, i, more=0: F.struct(F.lit(label).alias("label"), (at(i) + more).cast("long").alias("length"))
    if etype == "SE":
        return F.array(F.array(part("A", 0), part("B", 1), part("C", 2)), F.array(part("A", 0), part("C", 2)))
    if etype == "TandemUTR":
        return F.array(F.array(part("TandemUTRCore", 0), part("TandemUTRExt", 1)), F.array(part("TandemUTRCore", 0)))
    if etype == "AFE":
        return F.array(F.array(part("AFEProximal", 0, read_length)), F.array(part("AFEDistal", 1, read_length)))
    raise ValueError(f"no two-isoform model is defined for {etype}")
