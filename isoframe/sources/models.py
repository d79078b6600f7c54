"""Readers of gene models, event definitions, expression and posterior files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions import columns as C


def _fields(lines: DataFrame, sep: str = "\t") -> DataFrame:
    return lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.split("value", sep).alias("f"))


def read_gtf_exons(spark: SparkSession, path: str) -> DataFrame:
    """gene, chr, strand, tx, start, end of exon lines that name a gene and a transcript."""
    rows = _fields(spark.read.text(path)).where((F.size("f") >= 9) & (F.get("f", F.lit(2)) == "exon"))
    at = lambda i: F.get("f", F.lit(i))
    value = lambda key: F.nullif(F.regexp_extract(at(8), rf'(?:^|;)\s*{key} "([^"]*)"', 1), F.lit(""))
    return rows.select(value("gene_id").alias("gene"), at(0).alias("chr"), at(6).alias("strand"), value("transcript_id").alias("tx"), at(3).try_cast("long").alias("start"), at(4).try_cast("long").alias("end")).where("gene is not null and tx is not null")


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """chr, source, type, start, end, score, strand, phase, id, parents, name, attributes; percent codes decoded, lines without nine fields left out."""
    rows = _fields(spark.read.text(path)).where(F.size("f") == 9)
    at = lambda i: F.get("f", F.lit(i))
    pairs = F.filter(F.transform(F.split(at(8), ";"), F.trim), lambda p: F.contains(p, F.lit("=")))
    attributes = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1))), lambda k: F.struct(k.alias("k"), F.url_decode(F.substr(F.get(F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == k), F.lit(0)), F.length(k) + 2)).alias("v"))))
    dot = lambda c: F.when(c != ".", c)
    out = rows.select(F.url_decode(at(0)).alias("chr"), dot(at(1)).alias("source"), at(2).alias("type"), at(3).try_cast("long").alias("start"), at(4).try_cast("long").alias("end"), dot(at(5)).try_cast("double").alias("score"), dot(at(6)).alias("strand"), dot(at(7)).try_cast("int").alias("phase"), attributes.alias("attributes"))
    return out.select("*", F.col("attributes")["ID"].alias("id"), F.split(F.col("attributes")["Parent"], ",").alias("parents"), F.col("attributes")["Name"].alias("name"))


def gff_hierarchy(records: DataFrame) -> DataFrame:
    """gene, tx, part (exon or CDS), chr, strand, start, end: parts joined to their transcripts and genes."""
    child = records.withColumn("parent", F.explode("parents"))
    genes = records.where("type = 'gene'").select(F.col("id").alias("gene"))
    tx = child.where(F.col("type").isin("mRNA", "transcript")).select(F.col("id").alias("tx"), F.col("parent").alias("gene")).join(genes, "gene")
    parts = child.where(F.col("type").isin("exon", "CDS")).select(F.col("parent").alias("tx"), F.col("type").alias("part"), "chr", "strand", "start", "end")
    return parts.join(tx, "tx").select("gene", "tx", "part", "chr", "strand", "start", "end")


def clip_window(parts: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Exons wholly inside a window, of transcripts that overlap it; transcript spans clipped to it."""
    spans = parts.where(F.col("chr") == chrom).groupBy("gene", "tx").agg(F.min("start").alias("ts"), F.max("end").alias("te")).where((F.col("ts") <= end) & (F.col("te") >= start))
    inside = parts.where((F.col("chr") == chrom) & (F.col("start") >= start) & (F.col("end") <= end))
    return inside.join(spans, ["gene", "tx"]).withColumn("ts", F.greatest("ts", F.lit(start))).withColumn("te", F.least("te", F.lit(end)))


def read_ioe(spark: SparkSession, path: str) -> DataFrame:
    """seqname, gene, event_id, alternative, total; lines with a blank field, or with alternatives outside the total, are left out."""
    rows = _fields(spark.read.text(path)).where((F.size("f") == 5) & ~F.exists("f", lambda x: F.trim(x) == "") & (F.get("f", F.lit(0)) != "seqname"))
    at = lambda i: F.get("f", F.lit(i))
    out = rows.select(at(0).alias("seqname"), at(1).alias("gene"), at(2).alias("event_id"), F.split(at(3), ",").alias("alternative"), F.split(at(4), ",").alias("total"))
    return out.where(F.size(F.array_except("alternative", "total")) == 0)


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """id, sample, value, line, place of a table whose header has only the samples' names; ``NA`` and other text is null.

    ``line`` rises with the rows of a file and ``place`` is the column's, from 0.
    """
    lines = spark.read.text(path)
    names = (lines.first() or [""])[0].split("\t")
    rows = lines.select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("line")).where(F.size("f") == len(names) + 1)
    values = F.arrays_zip(F.array(*map(F.lit, names)).alias("sample"), F.transform(F.slice("f", 2, len(names)), lambda x: C.number(x)).alias("value"))
    return rows.select(F.get("f", F.lit(0)).alias("id"), "line", F.posexplode(values).alias("place", "x")).select("id", F.col("x.sample").alias("sample"), F.col("x.value").alias("value"), "line", "place")


def values_by_id(long: DataFrame) -> DataFrame:
    """id, values: the numbers of each id, row after row and in the order of columns (line, place)."""
    return long.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "place", "value"))), lambda x: x["value"]).alias("values"))


def psi_groups(spec: str) -> list[tuple[int, int]]:
    """Ranges ``1-3,4-6`` of columns, from 1; gaps, overlaps and backward ranges are errors."""
    out, at = [], 1
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        lo, hi = int(a), int(b or a)
        if lo != at or hi < lo:
            raise ValueError(f"columns {part} don't follow column {at - 1}")
        out.append((lo, hi))
        at = hi + 1
    return out


def group_means(long: DataFrame, samples: list[str], spec: str) -> DataFrame:
    """id, group (from 1), value: mean of each range of samples."""
    groups = [(s, g) for g, (lo, hi) in enumerate(psi_groups(spec), 1) for s in samples[lo - 1 : hi]]
    dim = long.sparkSession.createDataFrame(groups, "sample string, group int")
    return long.join(F.broadcast(dim), "sample").groupBy("id", "group").agg(F.avg("value").alias("value"))


#: How many numbers an event type's counts have, and which are inclusion, exclusion and common ones.
COUNT_LAYOUT = {"SE": (6, [0, 1], [2, 3], [4, 5]), "RI": (4, [0, 1], [2], [3]), "TandemUTR": (2, [0], [1], []), "AFE": (4, [0, 1], [2, 3], []), "ALE": (4, [0, 1], [2, 3], [])}


def read_event_counts(spark: SparkSession, path: str, etype: str) -> DataFrame:
    """event, etype, inc, exc, common of a counts file; types without a layout are errors."""
    if etype not in COUNT_LAYOUT:
        raise ValueError(f"no counts are defined for {etype}")
    n, inc, exc, common = COUNT_LAYOUT[etype]
    rows = _fields(spark.read.text(path)).select(F.get("f", F.lit(0)).alias("event"), F.transform(F.split(F.get("f", F.lit(1)), ";"), lambda x: x.try_cast("long")).alias("c")).where(F.size("c") == n)
    total = lambda places: sum((F.get("c", F.lit(i)) for i in places), F.lit(0).cast("long"))
    return rows.select("event", F.lit(etype).alias("etype"), total(inc).alias("inc"), total(exc).alias("exc"), total(common).alias("common"))


def read_posterior(spark: SparkSession, path: str) -> DataFrame:
    """event (file name), header (map), psi (arrays), log_score (array), map_psi (psi of the best score)."""
    lines = spark.read.text(path).withColumn("event", F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]+)?$", 1))
    head = lines.where(F.startswith("value", F.lit("#"))).groupBy("event").agg(F.first(F.expr("str_to_map(substring(value, 2), '\t', '=')")).alias("header"))
    parts = F.split("value", "\t")
    rows = lines.where(F.col("value").rlike("^[0-9]")).select("event", C.numbers(F.get(parts, F.lit(0))).alias("psi"), F.get(parts, F.lit(1)).try_cast("double").alias("score"))
    sums = rows.groupBy("event").agg(F.collect_list(F.struct("psi", "score")).alias("s"), F.max_by("psi", "score").alias("map_psi"))
    return sums.join(head, "event", "left").select("event", "header", F.transform("s", lambda x: x["psi"]).alias("psi"), F.transform("s", lambda x: x["score"]).alias("log_score"), "map_psi")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chr, pos, mapq, cigar, sample of alignments in text form, without header and unaligned reads."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@"))).select(F.split("value", "\t").alias("f"), F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]+)?$", 1).alias("sample"))
    at = lambda i: F.get("f", F.lit(i))
    out = rows.select(at(0).alias("qname"), at(1).try_cast("int").alias("flag"), at(2).alias("chr"), at(3).try_cast("long").alias("pos"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"), "sample")
    return out.where("cigar <> '*' and (flag & 4) = 0")


def good_reads(reads: DataFrame, paired: bool = False, strand: str | None = None) -> DataFrame:
    """Reads without failure flags; paired ones or ones of a strand only, if wanted."""
    flag = F.col("flag")
    ok = (flag.bitwiseAND(F.lit(0x200)) == 0) & (flag.bitwiseAND(F.lit(0x4)) == 0)
    if paired:
        ok = ok & (flag.bitwiseAND(F.lit(0x1)) != 0)
    if strand:
        ok = ok & (C.mate_strand("flag") == strand)
    return reads.where(ok)


def without_chr(c: Column | str) -> Column:
    return F.regexp_replace(C.col(c), "^chr", "")


def second_token(c: str):
    """The second of the tokens that ``|`` separates: a transcript's id in a composed name."""
    return F.get(F.split(c, r"\|"), F.lit(1))


def fasta_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header lines of a sequence file: id, rest of those to keep, and line of the others.

    A header is ``>`` and 13 more characters, the id, and ``range=chromosome:...``; kept is
    the first of each id on a chromosome from 1 to 22, X or Y.
    """
    lines = spark.read.text(path).where("value like '>%'").withColumn("line", F.monotonically_increasing_id())
    token = F.split("value", " ")
    x = lines.select("value", "line", F.substring(F.get(token, F.lit(0)), 15, 1 << 30).alias("id"), F.split(F.get(F.split(F.get(token, F.lit(1)), ":"), F.lit(0)), "=").alias("c"), F.array_join(F.slice(token, 2, 1 << 30), " ").alias("rest"))
    good = F.coalesce(F.get("c", F.lit(1)).rlike("^chr([1-9]|1[0-9]|2[0-2]|X|Y)$"), F.lit(False))
    first = x.where(good).groupBy("id").agg(F.min("line").alias("line"))
    kept = x.where(good).join(first, ["id", "line"], "left_semi")
    return kept.select("id", "rest"), x.join(kept.select("line"), "line", "left_anti").select("value")


def write_summaries(samples: DataFrame, path: str) -> None:
    """Posterior rows (event_name among their columns) as a table that a look-up of an event reads one file of."""
    samples.withColumn("bucket", F.pmod(F.xxhash64("event_name"), F.lit(256))).repartition("bucket").sortWithinPartitions("event_name").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_summary(spark: SparkSession, path: str, event_name: str) -> DataFrame:
    """Rows of one event of a written table."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(event_name)), F.lit(256))).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("event_name") == event_name)).drop("bucket")
