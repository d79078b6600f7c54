"""Deterministic stand-ins for domain tables, over the given TPC-H-like tables.

Each function has its DuckDB twin in ``SQL`` under the same name, as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPARISONS = ["A", "N", "R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gene(c):
    return F.concat(F.lit("ENSG"), F.lpad(c.cast("string"), 11, "0"))


def ev(spark: SparkSession, d: str) -> DataFrame:
    """Splicing events: comparison, event_type, raw_gene, gene_id, gene_symbol, fdr, dpsi, event_uid."""
    k = F.col("l_linenumber") % 5
    kind = F.when(k == 0, "SE").when(k == 1, "RI").when(k == 2, "A3SS").when(k == 3, "A5SS").otherwise("MXE")
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("comparison"), kind.alias("event_type"),
        F.concat(_gene(F.col("l_partkey")), F.lit("."), (F.col("l_suppkey") % 9).cast("string")).alias("raw_gene"), _gene(F.col("l_partkey")).alias("gene_id"),
        F.concat(F.lit("sym"), (F.col("l_partkey") % 500).cast("string")).alias("gene_symbol"), F.col("l_discount").alias("fdr"),
        (F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0) * (F.col("l_quantity") - 25) / 50).alias("dpsi"),
        F.concat_ws("|", kind, F.col("l_partkey").cast("string"), (F.col("l_suppkey") % 10).cast("string")).alias("event_uid"),
    )


def deg(spark: SparkSession, d: str) -> DataFrame:
    """Differential expression: comparison, gene_id, log2fc, padj."""
    comps = F.explode(F.array(*[F.struct(F.lit(c).alias("comparison"), F.lit(i).alias("idx")) for i, c in enumerate(COMPARISONS)]))
    return table(spark, d, "part").withColumn("c", comps).select("c.comparison", _gene(F.col("p_partkey")).alias("gene_id"), ((F.col("p_size") - 25) / 10.0).cast("double").alias("log2fc"), (((F.col("p_partkey") * 7 + F.col("c.idx")) % 100) / 1000.0).cast("double").alias("padj"))


def dex(spark: SparkSession, d: str) -> DataFrame:
    """Exon usage: comparison, gene_id, q, symbol."""
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(F.when(s == "F", "A").when(s == "O", "N").otherwise("R").alias("comparison"), _gene(F.col("o_orderkey") % 2000 + 1).alias("gene_id"), ((F.col("o_orderkey") % 97) / 970.0).cast("double").alias("q"), F.concat(F.lit("dex"), (F.col("o_orderkey") % 11).cast("string")).alias("symbol"))


def dtu(spark: SparkSession, d: str) -> DataFrame:
    """Transcript usage: comparison, gene_id, q, symbol."""
    k = F.col("event_id") % 3
    return table(spark, d, "events").select(F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("comparison"), _gene(F.col("event_id") % 1500 + 1).alias("gene_id"), ((F.col("event_id") % 89) / 890.0).cast("double").alias("q"), F.concat(F.lit("dtu"), (F.col("event_id") % 13).cast("string")).alias("symbol"))


def sup(spark: SparkSession, d: str) -> DataFrame:
    """Local events of a second tool: comparison, event_id, pvalue, dpsi."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R").alias("comparison"),
        F.concat(_gene(k % 2000 + 1), F.lit("_and_"), _gene(k % 700 + 1), F.lit(";SE:chr1:"), k.cast("string")).alias("event_id"), ((k % 100) / 1000.0).cast("double").alias("pvalue"), ((k % 41 - 20) / 50.0).cast("double").alias("dpsi"),
    )


def anno(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_partkey") % 7 != 0).select(_gene(F.col("p_partkey")).alias("gene_id"), F.col("p_name").alias("symbol"))


def exons(spark: SparkSession, d: str) -> DataFrame:
    """gene, chr, strand, tx, start, end, distinct."""
    start = F.col("l_linenumber") * 1000 + (F.col("l_partkey") % 2) * 50
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("g"), (F.col("l_orderkey") % 200).cast("string")).alias("gene"), F.lit("chr1").alias("chr"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("tx"), start.cast("long").alias("start"), (start + 200 + (F.col("l_suppkey") % 2) * 50).cast("long").alias("end"),
    ).distinct()


def tpm(spark: SparkSession, d: str) -> DataFrame:
    """gene, tx, sample, cond, tpm: four samples in two conditions; some transcripts are not expressed anywhere."""
    k = F.col("o_orderkey")
    samples = F.explode(F.array(*[F.struct(F.lit(f"s{i}").alias("sample"), F.lit("c1" if i < 2 else "c2").alias("cond"), F.lit(i).alias("i")) for i in range(4)]))
    return table(spark, d, "orders").where(k % 50 != 0).withColumn("s", samples).select(
        F.concat(F.lit("g"), (k % 200).cast("string")).alias("gene"), F.concat(F.lit("t"), k.cast("string")).alias("tx"), "s.sample", "s.cond", ((k * (F.col("s.i") + 3)) % 101).cast("double").alias("tpm"),
    )


def reads(spark: SparkSession, d: str) -> DataFrame:
    """sample, strand, pos, cigar."""
    k = F.col("event_id")
    cigar = F.when(k % 4 == 0, F.concat(F.lit("30M"), (F.lit(100) + k % 5 * 50).cast("string"), F.lit("N20M"))).when(k % 4 == 1, "10M5I35M").when(k % 4 == 2, "20M3D30M").otherwise("50M")
    return table(spark, d, "events").select(F.col("event_type").alias("sample"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (F.lit(1000) + k * 37 % 5000).cast("long").alias("pos"), cigar.alias("cigar"))


def posterior(spark: SparkSession, d: str) -> DataFrame:
    """event, psi1, psi2: posterior samples in two conditions."""
    e = F.transform("embedding", lambda x: F.round((x.cast("double") + 1) / 2, 4))
    return table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("event"), e.alias("psi1"), F.transform(e, lambda x: x * 0.9).alias("psi2"))


def cand(spark: SparkSession, d: str) -> DataFrame:
    """Ranked candidates: comparison, gene_id, gene_symbol, tier, evidence_class, direction_class, log2fc, representative_dpsi, dtu_sig, shortlisted, reason, rank."""
    k = F.col("p_partkey")
    comps = F.explode(F.array(*[F.struct(F.lit(c).alias("comparison"), F.lit(i).alias("i")) for i, c in enumerate(COMPARISONS)]))
    n = k + F.col("c.i")
    return table(spark, d, "part").withColumn("c", comps).select(
        "c.comparison", _gene(k).alias("gene_id"), F.concat(F.lit("Sym"), k.cast("string")).alias("gene_symbol"),
        F.when(n % 6 == 0, "Unclassified").otherwise(F.concat(F.lit("Tier "), (n % 6).cast("string"))).alias("tier"), F.when(n % 3 == 0, "DEG").when(n % 3 == 1, "rMATS").otherwise("rMATS+DEG").alias("evidence_class"),
        F.when(n % 2 == 0, "transcript_up").otherwise("splicing_down").alias("direction_class"), F.when(k % 11 != 0, (F.col("p_size") - 25) / 10.0).cast("double").alias("log2fc"), F.when(k % 13 != 0, (k % 21 - 10) / 20.0).cast("double").alias("representative_dpsi"),
        (k % 4 == 0).alias("dtu_sig"), (k % 17 == 0).alias("shortlisted"), F.concat(F.lit("reason "), (k % 5).cast("string")).alias("reason"), ((k * 7 + F.col("c.i")) % 10007).cast("long").alias("rank"),
    )


_G = "'ENSG' || lpad(CAST({} AS VARCHAR), 11, '0')"
_KIND = "CASE l_linenumber % 5 WHEN 0 THEN 'SE' WHEN 1 THEN 'RI' WHEN 2 THEN 'A3SS' WHEN 3 THEN 'A5SS' ELSE 'MXE' END"

SQL = {
    "ev": f"SELECT l_returnflag AS comparison, {_KIND} AS event_type, {_G.format('l_partkey')} || '.' || CAST(l_suppkey % 9 AS VARCHAR) AS raw_gene, {_G.format('l_partkey')} AS gene_id, 'sym' || CAST(l_partkey % 500 AS VARCHAR) AS gene_symbol, l_discount AS fdr, CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (l_quantity - 25) / 50 AS dpsi, {_KIND} || '|' || l_partkey || '|' || (l_suppkey % 10) AS event_uid FROM lineitem",
    "deg": f"SELECT c.comparison, {_G.format('p_partkey')} AS gene_id, (p_size - 25) / 10.0::DOUBLE AS log2fc, ((p_partkey * 7 + c.idx) % 100) / 1000.0::DOUBLE AS padj FROM part CROSS JOIN (VALUES ('A', 0), ('N', 1), ('R', 2)) c(comparison, idx)",
    "dex": f"SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS comparison, {_G.format('(o_orderkey % 2000 + 1)')} AS gene_id, (o_orderkey % 97) / 970.0::DOUBLE AS q, 'dex' || (o_orderkey % 11) AS symbol FROM orders",
    "dtu": f"SELECT CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS comparison, {_G.format('(event_id % 1500 + 1)')} AS gene_id, (event_id % 89) / 890.0::DOUBLE AS q, 'dtu' || (event_id % 13) AS symbol FROM events",
    "sup": f"SELECT CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS comparison, {_G.format('(c_custkey % 2000 + 1)')} || '_and_' || {_G.format('(c_custkey % 700 + 1)')} || ';SE:chr1:' || c_custkey AS event_id, (c_custkey % 100) / 1000.0::DOUBLE AS pvalue, (c_custkey % 41 - 20) / 50.0::DOUBLE AS dpsi FROM customer",
    "anno": f"SELECT {_G.format('p_partkey')} AS gene_id, p_name AS symbol FROM part WHERE p_partkey % 7 <> 0",
    "exons": "SELECT DISTINCT 'g' || (l_orderkey % 200) AS gene, 'chr1' AS chr, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 't' || l_orderkey AS tx, l_linenumber * 1000 + (l_partkey % 2) * 50 AS s, l_linenumber * 1000 + (l_partkey % 2) * 50 + 200 + (l_suppkey % 2) * 50 AS e FROM lineitem",
    "tpm": "SELECT 'g' || (o_orderkey % 200) AS gene, 't' || o_orderkey AS tx, 's' || i AS sample, CASE WHEN i < 2 THEN 'c1' ELSE 'c2' END AS cond, CAST((o_orderkey * (i + 3)) % 101 AS DOUBLE) AS tpm FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) v(i) WHERE o_orderkey % 50 <> 0",
    "reads": "SELECT event_type AS sample, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 1000 + event_id * 37 % 5000 AS pos, CASE event_id % 4 WHEN 0 THEN '30M' || (100 + event_id % 5 * 50) || 'N20M' WHEN 1 THEN '10M5I35M' WHEN 2 THEN '20M3D30M' ELSE '50M' END AS cigar FROM events",
    "cand": f"SELECT comparison, {_G.format('p_partkey')} AS gene_id, 'Sym' || p_partkey AS gene_symbol, CASE WHEN (p_partkey + i) % 6 = 0 THEN 'Unclassified' ELSE 'Tier ' || ((p_partkey + i) % 6) END AS tier, CASE (p_partkey + i) % 3 WHEN 0 THEN 'DEG' WHEN 1 THEN 'rMATS' ELSE 'rMATS+DEG' END AS evidence_class, CASE WHEN (p_partkey + i) % 2 = 0 THEN 'transcript_up' ELSE 'splicing_down' END AS direction_class, CASE WHEN p_partkey % 11 <> 0 THEN (p_size - 25) / 10.0::DOUBLE END AS log2fc, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 21 - 10) / 20.0::DOUBLE END AS representative_dpsi, p_partkey % 4 = 0 AS dtu_sig, p_partkey % 17 = 0 AS shortlisted, 'reason ' || (p_partkey % 5) AS reason, ((p_partkey * 7 + i) % 10007)::BIGINT AS rank FROM part CROSS JOIN (VALUES ('A', 0), ('N', 1), ('R', 2)) c(comparison, i)",
    "posterior": "SELECT vec_id AS event, list_transform(embedding, lambda x: round((x::DOUBLE + 1) / 2, 4)) AS psi1, list_transform(embedding, lambda x: round((x::DOUBLE + 1) / 2, 4) * 0.9::DOUBLE) AS psi2 FROM embeddings WHERE embedding IS NOT NULL",
}


def with_(*names: str, **more: str) -> str:
    """``WITH`` clause of the named stand-ins and further expressions, in order."""
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
