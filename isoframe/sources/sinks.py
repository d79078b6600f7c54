"""Writers: text tables, partitioned results, unified and matrix files."""

from __future__ import annotations

import json

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Tab-separated text with a header; ``one_file`` is for small tables."""
    flat = df.select(*[F.array_join(F.transform(f"`{f.name}`", lambda x: x.cast("string")), ",").alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in df.schema])
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "").csv(path)


def write_step(tables: Mapping[str, DataFrame], root: str, step: str, modules: Sequence[str] | None = None) -> list[str]:
    """``{root}/{step}/data/{name}`` for every table that has rows; with ``modules``, only of steps that are among them."""
    if modules is not None and step not in modules:
        return []
    written = []
    for name, df in tables.items():
        if not df.isEmpty():
            export(df, f"{root}/{step}/data/{name}")
            written.append(name)
    return written


def write_candidates(ranked: DataFrame, root: str) -> None:
    """All candidates by comparison and tier, and a summary a comparison."""
    ranked.write.mode("overwrite").partitionBy("comparison", "tier").parquet(f"{root}/candidates")
    export(candidate_summary(ranked), f"{root}/summary", one_file=True)


def candidate_summary(ranked: DataFrame) -> DataFrame:
    tiers = [F.count_if(F.col("tier") == f"Tier {i}").alias(f"n_tier{i}") for i in range(1, 6)]
    return ranked.groupBy("comparison").agg(F.count("*").alias("n_genes"), *tiers)


def write_cross(matrix: DataFrame, root: str) -> None:
    export(matrix, f"{root}/matrix")
    export(matrix.agg(F.count("*").alias("n_genes"), F.count_if(F.col("pattern") == "shared_all").alias("n_shared_all"), F.count_if(F.col("n_comparisons") > 1).alias("n_multi")), f"{root}/summary", one_file=True)


def write_pattern_sets(sets: DataFrame, root: str) -> None:
    sets.write.mode("overwrite").partitionBy("event_class").parquet(f"{root}/sets")
    export(sets.groupBy("event_class").agg(F.count("*").alias("n")), f"{root}/summary", one_file=True)


def write_unified(df: DataFrame, path: str, tool: str, conditions: Sequence[str]) -> None:
    """The unified text table: a comment with the tool's name, the header, rows; a dot for what is missing."""
    heads = ["GeneName", "GroupID", "FeatureID", "FeatureType", "FeatureLabel", "strand", "p-value", "q-value", "dPSI", "ReadCount1", "ReadCount2", "PSI", *[f"psi({c})" for c in conditions]]
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("nan"))), ","), F.lit("."))
    cells = [dot(F.col(c)) for c in ("GeneName", "GroupID", "FeatureID", "FeatureType", "FeatureLabel", "strand", "pvalue", "qvalue", "dpsi")] + [listed(c) for c in ("counts1", "counts2", "psi")]
    cells += [dot(F.get("cond_psi", F.lit(i))) for i in range(len(conditions))]
    spark = df.sparkSession
    top = spark.createDataFrame([(0, f"# {tool}"), (1, "\t".join(heads))], "o int, value string")
    lines = df.select(F.lit(2).alias("o"), F.concat_ws("\t", *cells).alias("value"))
    # the two lines of the head sort before all rows, which are dealt by their text
    top.unionByName(lines).repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def write_events(events: DataFrame, root: str) -> None:
    """Event definitions, a folder for each event type."""
    lines = events.select("etype", F.concat_ws("\t", F.regexp_extract("event_id", r";[^:]+:([^:]+):", 1), "gene", "event_id", F.array_join("alternative", ","), F.array_join("total", ",")).alias("value"))
    lines.write.mode("overwrite").partitionBy("etype").text(root)


def event_gtf(events: DataFrame, edge: int = 100) -> DataFrame:
    """Exon lines (event_id, chr, start, end, strand, isoform) of skipped-exon events for a genome browser, outer exons ``edge`` bases long."""
    n = F.transform(F.regexp_extract_all("event_id", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
    k = F.size(n)
    at = lambda i: F.element_at(n, i)
    exon = lambda a, b, iso: F.struct(a.alias("start"), b.alias("end"), F.lit(iso).alias("isoform"))
    parts = F.array(exon(at(-4) - edge, at(-4), "alternative2"), exon(at(-1), at(-1) + edge, "alternative2"), exon(at(-4) - edge, at(-4), "alternative1"), exon(at(-3), at(-2), "alternative1"), exon(at(-1), at(-1) + edge, "alternative1"))
    x = events.where((F.col("etype") == "SE") & (k >= 4))
    return x.select("event_id", F.regexp_extract("event_id", r";[^:]+:([^:]+):", 1).alias("chr"), F.substring("event_id", -1, 1).alias("strand"), F.explode(parts).alias("p")).select("event_id", "chr", "p.start", "p.end", "strand", "p.isoform")


def wide_matrix(long: DataFrame, samples: Sequence[str]) -> DataFrame:
    """id and a column a sample, ids in order."""
    return long.groupBy("id").pivot("sample", list(samples)).agg(F.first("value")).orderBy("id")


def write_matrix(long: DataFrame, samples: Sequence[str], path: str) -> None:
    """Values with ten decimals, ``nan`` for what is missing."""
    wide = wide_matrix(long, samples)
    wide.select("id", *[F.coalesce(F.format_string("%.10f", F.col(f"`{s}`")), F.lit("nan")).alias(s) for s in samples]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def isoform_manifest(samples: DataFrame) -> DataFrame:
    """Design of an isoform analysis: sampleID, condition, quant_sf, batch of included samples."""
    return samples.where(F.coalesce("include", F.lit(True))).select(F.col("sample_id").alias("sampleID"), "condition", "quant_sf", "batch")


def write_gene_models(exons: DataFrame, path: str) -> None:
    """Gene models by chromosome, for lookups of one chromosome or gene."""
    exons.repartition("chr").sortWithinPartitions("chr", "gene").write.mode("overwrite").partitionBy("chr").parquet(path)


def running_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], pattern: str) -> DataFrame:
    """``df`` with id: rows numbered within ``keys``, in a printf pattern."""
    return df.withColumn("id", F.format_string(pattern, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))))


def write_selection(selected: DataFrame, root: str, comparison: str, kind: str, parameters: Mapping[str, object]) -> None:
    """Gene list, parameters and summary of a selection, below ``{root}/{comparison}/{kind}``."""
    base = f"{root}/{comparison}/{kind}"
    export(selected.select("comparison", "gene_symbol", "gene_id", "tier", "evidence_class", "direction_class"), f"{base}/genes", one_file=True)
    spark = selected.sparkSession
    spark.createDataFrame([(json.dumps(dict(parameters), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/parameters")
    export(selected.agg(F.count("*").alias("gene_count")).select(F.lit(comparison).alias("comparison"), F.lit(kind).alias("kind"), F.lit(str(parameters.get("source", ""))).alias("source"), "gene_count"), f"{base}/summary", one_file=True)
