"""Readers of analysis tables: text columns with explicit typing, never schema inference.

Every reader takes one or more paths that Spark can read and gives a lazy DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions import columns as C


class MissingColumns(ValueError):
    """A table lacks columns that its kind must have."""


def require(df: DataFrame, wanted: Sequence[str], what: str) -> DataFrame:
    gone = [c for c in wanted if c not in df.columns]
    if gone:
        raise MissingColumns(f"{what} lacks {', '.join(gone)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file fits a path or glob, in whatever store it names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(jpath)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A delimited table as text: commas for ``.csv``, else tabs; missing tokens are null; a missing path gives None.

    Of columns with one name the first keeps it, later ones get ``.1``, ``.2`` and so on.
    """
    if not exists(spark, path):
        return None
    sep = "," if path.lower().removesuffix(".gz").endswith(".csv") else "\t"
    raw = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"').csv(path)
    head = spark.read.text(path).first()  # the header's own names, before Spark tells repeated ones apart
    names = _unique(next(iter(_split_header(head[0], sep)), []) if head else [])
    df = raw.toDF(*names) if len(names) == len(raw.columns) else raw
    return df.select(*[F.when(~F.col(f"`{c}`").isin(C.MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def _split_header(line: str, sep: str):
    import csv

    return csv.reader([line.lstrip("﻿")], delimiter=sep)


def _unique(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if not k else f"{n}.{k}")
    return out


def union_tables(frames: Sequence[DataFrame | None]) -> DataFrame | None:
    """All rows, columns by name; what is missing is null; None among the frames is left out."""
    there = [f for f in frames if f is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there) if there else None


#: Columns that an event table must have.
EVENT_COLUMNS = ["GeneID", "geneSymbol", "FDR", "IncLevelDifference"]
#: Columns that the event reader adds.
DERIVED = {"comparison", "event_type", "gene_id", "gene_symbol", "fdr", "dpsi", "abs_dpsi", "event_uid", "coordinates", "psi1", "psi2"}


def read_events(spark: SparkSession, folder: str, comparison: str, mode: str = "JC", flip: bool = False) -> DataFrame | None:
    """Events of all five types of a comparison (``{type}.MATS.{mode}.txt`` under ``folder``), in one schema.

    Adds comparison, event_type, gene_id (normalised), gene_symbol, fdr, dpsi (in the wanted
    direction), abs_dpsi, event_uid, coordinates, psi1, psi2; keeps the file's own columns.
    """
    frames = []
    for kind in C.EVENT_TYPES:
        df = read_table(spark, f"{folder}/{kind}.MATS.{mode}.txt")
        if df is None:
            continue
        require(df, EVENT_COLUMNS, f"{kind} event table")
        present = df.columns
        dpsi = C.flipped(C.number("IncLevelDifference"), F.lit(flip))
        levels = [C.inc_level_mean(f"IncLevel{i}") if f"IncLevel{i}" in present else F.lit(None).cast("double") for i in (1, 2)]
        one, two = levels[::-1] if flip else levels
        own = [f"`{c}`" for c in present if c.lower() not in DERIVED]  # names differ by more than case
        frames.append(
            df.select(
                *own, F.lit(comparison).alias("comparison"), F.lit(kind).alias("event_type"), C.normalize_gene_id("GeneID").alias("gene_id"), C.clean_text("geneSymbol").alias("gene_symbol"),
                C.number("FDR").alias("fdr"), dpsi.alias("dpsi"), F.abs(dpsi).alias("abs_dpsi"), C.event_uid(kind, present).alias("event_uid"),
                C.coordinates_text(F.lit(kind), [c for c in C.UID_COLUMNS[kind] if c in present]).alias("coordinates"), one.alias("psi1"), two.alias("psi2"),
            )
        )
    return union_tables(frames)


def event_modes(spark: SparkSession, folder: str) -> list[str]:
    """Counting modes for which all five event files are there."""
    return [m for m in ("JC", "JCEC") if all(exists(spark, f"{folder}/{t}.MATS.{m}.txt") for t in C.EVENT_TYPES)]


def read_deg(spark: SparkSession, path: str, comparison: str, flip: bool = False) -> DataFrame | None:
    """comparison, gene_id, log2fc (in the wanted direction), padj, base_mean, symbol."""
    df = read_table(spark, path)
    if df is None:
        return None
    require(df, ["gene_id", "log2FoldChange", "padj"], "expression table")
    optional = lambda names: F.coalesce(*[C.clean_text(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    return df.select(
        F.lit(comparison).alias("comparison"), C.normalize_gene_id("gene_id").alias("gene_id"), C.flipped(C.number("log2FoldChange"), F.lit(flip)).alias("log2fc"), C.number("padj").alias("padj"),
        (C.number("baseMean") if "baseMean" in df.columns else F.lit(None).cast("double")).alias("base_mean"), optional(["gene_symbol", "geneSymbol"]).alias("symbol"),
    )


def read_local_events(spark: SparkSession, path: str, comparison: str) -> DataFrame | None:
    """comparison, event_id, dpsi, pvalue, gene_ids of a differential table by position: id and two values, with or without a header for the id."""
    if not exists(spark, path):
        return None
    lines = spark.read.text(path)
    parts = F.split("value", "\t")
    rows = lines.select(F.get(parts, F.lit(0)).alias("event_id"), C.number(F.get(parts, F.lit(1))).alias("dpsi"), C.number(F.get(parts, F.lit(2))).alias("pvalue")).where(F.contains("event_id", F.lit(";")))
    return rows.select(F.lit(comparison).alias("comparison"), "*", C.suppa_genes("event_id").alias("gene_ids"))


def read_features(spark: SparkSession, path: str, comparison: str) -> DataFrame | None:
    """comparison, gene_id, feature_id, q, symbol of an exon usage or transcript usage table, staged p-values (geneID, txID, gene, transcript) among them."""
    df = read_table(spark, path)
    if df is not None and "groupID" not in df.columns and {"geneID", "txID", "transcript"} <= set(df.columns):
        df = df.select(F.col("geneID").alias("groupID"), F.col("txID").alias("featureID"), F.col("transcript").alias("padj"))
    if df is None or "groupID" not in df.columns or "padj" not in df.columns:
        return None
    names = [n for n in ("gene_symbol", "geneSymbol", "symbol", "gene_name", "gene") if n in df.columns]
    return df.select(
        F.lit(comparison).alias("comparison"), C.normalize_gene_id("groupID").alias("gene_id"), (F.col("featureID") if "featureID" in df.columns else F.lit(None).cast("string")).alias("feature_id"),
        C.number("padj").alias("q"), F.coalesce(*[C.clean_text(n) for n in names], F.lit(None).cast("string")).alias("symbol"),
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """gene_id, sample, value of a wide matrix."""
    df = read_table(spark, path)
    if df is None:
        return None
    require(df, ["gene_id"], "counts matrix")
    samples = [c for c in df.columns if c != "gene_id"]
    long = df.unpivot("gene_id", [F.col(f"`{c}`") for c in samples], "sample", "value")
    return long.select(C.normalize_gene_id("gene_id").alias("gene_id"), "sample", C.number("value").alias("value"))


def group_of_sample(sample: str | F.Column = "sample"):
    """Group of a sample: its name without a last separator and replicate mark."""
    return F.regexp_replace(C.col(sample), r"[_.\-](rep[_.\-]?)?[0-9]+$", "")


def quant_group(sample: str = "sample"):
    """Group of a quantified sample: its name without ``_rep_1`` to ``_rep_6``."""
    return F.regexp_replace(F.col(sample), "_rep_[1-6]$", "")


def read_quant(spark: SparkSession, pattern: str) -> DataFrame:
    """sample (folder of the file), tx, length, effective_length, tpm, reads of quantification files."""
    df = spark.read.option("sep", "\t").option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "quant.sf").csv(pattern)
    require(df, ["Name", "Length", "EffectiveLength", "TPM", "NumReads"], "quantification")
    sample = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    return df.select(sample.alias("sample"), F.col("Name").alias("tx"), *[C.number(a).alias(b) for a, b in (("Length", "length"), ("EffectiveLength", "effective_length"), ("TPM", "tpm"), ("NumReads", "reads"))])


#: Names of id and symbol columns of annotation tables, in the order tried.
ANNOTATION_IDS, ANNOTATION_SYMBOLS = ["gene_id", "GeneID", "groupID"], ["gene_name", "geneSymbol", "gene_symbol", "symbol", "gene"]


def read_annotation(spark: SparkSession, path: str) -> DataFrame | None:
    """gene_id, symbol: the first symbol of each normalised id."""
    df = read_table(spark, path)
    if df is None:
        return None
    ids, names = ([c for c in wanted if c in df.columns] for wanted in (ANNOTATION_IDS, ANNOTATION_SYMBOLS))
    if not ids or not names:
        return None
    rows = df.select(C.normalize_gene_id(ids[0]).alias("gene_id"), C.clean_text(names[0]).alias("symbol"), F.monotonically_increasing_id().alias("o")).where("gene_id is not null and symbol is not null")
    return rows.groupBy("gene_id").agg(F.min_by("symbol", "o").alias("symbol"))


def read_contrasts(spark: SparkSession, path: str) -> DataFrame | None:
    """comparison, experiment, control of a contrast sheet."""
    df = read_table(spark, path)
    if df is None:
        return None
    require(df, ["contrast", "treatment", "control"], "contrast sheet")
    return df.select(F.trim("contrast").alias("comparison"), F.trim("treatment").alias("experiment"), F.trim("control").alias("control")).where("comparison <> ''")


def read_matching(spark: SparkSession, folder: str, pattern: str, first_only: bool = False) -> DataFrame | None:
    """Tables below a folder whose names fit a glob, one after the other; or the first by name."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(jpath, True)
    import fnmatch

    paths = []
    while files.hasNext():
        p = files.next().getPath()
        if fnmatch.fnmatch(p.getName(), pattern):
            paths.append(p.toString())
    paths.sort()
    return union_tables([read_table(spark, p) for p in (paths[:1] if first_only else paths)])


def import_isoform_metadata(samples: DataFrame, imported: DataFrame) -> DataFrame:
    """``samples`` (sample_id, quant_sf, ...) with imported values, and imported rows that are new.

    Rows match by sample_id and file; a row without a file of its own by a sample_id that occurs once.
    """
    value_cols = [c for c in samples.columns if c not in ("sample_id", "quant_sf")]
    exact = imported.where("quant_sf is not null").select("sample_id", "quant_sf", *[F.col(c).alias(f"_x_{c}") for c in value_cols], F.lit(1).alias("_x"))
    once = samples.groupBy("sample_id").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    loose = imported.where("quant_sf is null").join(once, "sample_id").select("sample_id", *[F.col(c).alias(f"_l_{c}") for c in value_cols])
    merged = samples.join(exact, ["sample_id", "quant_sf"], "left").join(loose, "sample_id", "left")
    out = merged.select("sample_id", "quant_sf", *[F.coalesce(f"_x_{c}", f"_l_{c}", c).alias(c) for c in value_cols])
    new = imported.join(samples.select("sample_id").distinct(), "sample_id", "left_anti").select("sample_id", "quant_sf", *value_cols)
    return out.unionByName(new)


def support_candidates(source_name: str, templates: Sequence[tuple[str, str]]) -> list[str]:
    """File names to try for a comparison, exact ones before patterns."""
    safe = re.sub(r"[^A-Za-z0-9_.\-]+", "_", source_name)
    joined = [source_name.replace(mark, "-") for mark in ("_vs_", "-vs-", " vs ") if mark in source_name] or [source_name.replace("-", "_vs_")]
    names = list(dict.fromkeys([source_name, safe, *joined]))
    return [f"{stem}.{n}{end}".lstrip(".") for n in names for stem, end in templates] + [f"{stem}*{n}*{end}" for n in names for stem, end in templates]


def find_support_file(spark: SparkSession, root: str, source_name: str, templates: Sequence[tuple[str, str]]) -> str | None:
    return next((p for c in support_candidates(source_name, templates) if exists(spark, p := f"{root}/{c}")), None)


def read_sample_conditions(spark: SparkSession, path: str) -> DataFrame:
    """sample, condition: the first two columns of a tab-separated list without a header."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 2).select(F.trim(F.get(f, F.lit(0))).alias("sample"), F.trim(F.get(f, F.lit(1))).alias("condition"))


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """gene: a line each; a line with a space inside is an error."""
    lines = spark.read.text(path)
    bad = lines.where(F.contains("value", F.lit(" "))).first()
    if bad is not None:
        raise ValueError(f"a gene name has no space: {bad[0]!r}")
    return lines.select(F.trim("value").alias("gene")).where("gene <> ''")


#: Columns that a table of each kind must have.
REQUIRED = {
    "events": ["GeneID", "geneSymbol", "FDR", "IncLevelDifference"],
    "deg": ["log2FoldChange", "padj"],
    "quant": ["Name", "TPM", "NumReads"],
}


def missing_columns(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Messages on columns that a table lacks; only its header is read."""
    try:
        first = spark.read.text(path).first()
    except Exception as e:  # noqa: BLE001  an unreadable input is a message of the report
        return [f"{path}: can't be read ({type(e).__name__})"]
    names = {c.strip().strip('"') for c in re.split("[\t,]", first[0])} if first else set()
    return [f"{path}: no column {c}" for c in REQUIRED[kind] if c not in names]


def output_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size, modified of all files below a folder; their contents are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").split("://")[-1]
    return x.select(F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "").alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: What each view of the output browser shows.
VIEWS = {"heatmap": "(?i)heatmap|clustermap", "pca": "(?i)pca"}


def browse(files: DataFrame, view: str | None = None, comparison: str | None = None) -> DataFrame:
    """Files of a view, and of a comparison where the table has that column."""
    if view in VIEWS:
        files = files.where(F.col("relative_path").rlike(VIEWS[view]))
    return files.where(F.col("comparison") == comparison) if comparison and "comparison" in files.columns else files
