"""Queries of the converters and further filters, over stand-ins, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isoframe.functions import columns as C
from isoframe.operators import programs as P
from isoframe.operators import selection as L
from isoframe.operators import splice as S
from isoframe.plans import proxies as X
from isoframe.plans.proxies import with_
from isoframe.sources import sinks as K
from isoframe.sources import tables as T
from isoframe.sources import unified as U

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("majiq_explode", """WITH x AS (SELECT p_partkey AS k, unnest([0, 1]) AS i FROM part)
SELECT 'g' || k AS "GeneName", 'lsv' || k AS "GroupID", CASE i WHEN 0 THEN 'i001' ELSE 'i002' END AS "FeatureID", 'chr1:' || (k + i * 10) || '-' || (k + i * 10 + 5) AS "FeatureLabel", (k % 20 - 10 + i) / 10.0::DOUBLE AS dpsi FROM x""")
def majiq_explode(spark, d):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    two = lambda f: F.concat_ws(";", *[text(f(i)) for i in (0, 1)])
    rows = X.table(spark, d, "part").select(
        F.concat(F.lit("g"), text(k)).alias("gene"), F.concat(F.lit("lsv"), text(k)).alias("lsv"), F.lit("chr1").alias("chr"), F.lit("+").alias("strand"), two(lambda i: (k % 20 - 10 + i) / 10.0).alias("dpsi"),
        F.concat_ws(";", *[F.concat(text(k + i * 10), F.lit("-"), text(k + i * 10 + 5)) for i in (0, 1)]).alias("junctions"), two(lambda i: k % 10 / 10.0).alias("psi_1"), two(lambda i: k % 7 / 10.0).alias("psi_2"),
    )
    return U.from_majiq(rows).select("GeneName", "GroupID", "FeatureID", "FeatureLabel", "dpsi")


@query("leafcutter_ratio", """SELECT 'chr1:' || o_orderkey || ':' || (o_orderkey + 50) || ':clu_' || (o_orderkey % 200) || '_+' AS intron,
  'i' || lpad(row_number() OVER (PARTITION BY o_orderkey % 200 ORDER BY o_orderkey)::VARCHAR, 3, '0') AS "FeatureID",
  round(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 9)::DOUBLE / (o_orderkey % 5) END, 9) AS r1, round((o_orderkey % 4)::DOUBLE / 8, 9) AS r2 FROM orders WHERE (o_orderkey % 200) % 3 <> 0""")
def leafcutter_ratio(spark, d):
    k = F.col("o_orderkey")
    t = lambda c: c.cast("string")
    intron = F.concat(F.lit("chr1:"), t(k), F.lit(":"), t(k + 50), F.lit(":clu_"), t(k % 200), F.lit("_+"))
    o = X.table(spark, d, "orders")
    clusters = spark.range(200).select(F.concat(F.lit("chr1:clu_"), t(F.col("id")), F.lit("_+")).alias("cluster"), F.when(F.col("id") % 3 == 0, "Not tested").otherwise("Success").alias("status"), F.lit("0.01").alias("p"), F.lit("0.02").alias("p_adjust"), F.lit("NA").alias("genes"))
    effects = o.select(intron.alias("intron"), F.lit("0.1").alias("psi_1"), F.lit("0.2").alias("psi_2"), F.lit("0.1").alias("deltapsi"), k.alias("o"))
    ratios = o.select(intron.alias("intron"), F.concat(t(k % 9), F.lit("/"), t(k % 5), F.lit(" "), t(k % 4), F.lit("/8")).alias("values"))
    out = U.from_leafcutter(clusters, effects, o.select(intron.alias("intron"), F.lit("1 2").alias("values")), ratios)
    back = F.concat(F.regexp_replace(F.replace("FeatureLabel", F.lit("-"), F.lit(":")), "$", ":"), "GroupID")
    return out.select(back.alias("intron"), "FeatureID", F.round(F.get("psi", F.lit(0)), 9).alias("r1"), F.round(F.get("psi", F.lit(1)), 9).alias("r2"))


@query("dsr_group_psi", """WITH x AS (SELECT o_orderkey AS k, 'g' || (o_orderkey % 300) AS g, (o_orderkey % 11)::DOUBLE AS a, (o_orderkey % 3)::DOUBLE AS b FROM orders)
SELECT g AS "GroupID", 'chr1:' || k || '-' || (k + 9) AS "FeatureLabel", round(a / nullif(sum(a) OVER (PARTITION BY g), 0), 9) AS l1, round(b / nullif(sum(b) OVER (PARTITION BY g), 0), 9) AS l2, round(((k % 8) - (k % 5)) / 10.0::DOUBLE, 6) AS dpsi FROM x""")
def dsr_group_psi(spark, d):
    k = F.col("o_orderkey")
    o = X.table(spark, d, "orders").select(k.alias("o"), F.concat(F.lit("g"), (k % 300).cast("string")).alias("group_id"), F.lit("chr1").alias("chr"), k.cast("string").alias("start"), (k + 9).cast("string").alias("end"), F.lit("+").alias("strand"), F.array((k % 5) / 10.0, (k % 8) / 10.0).cast("array<double>").alias("psi"), F.array(k % 11, k % 3).cast("array<double>").alias("counts"))
    groups = spark.range(300).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("group_id"), F.lit("x").alias("gene"), F.lit(0.1).alias("p_value"), F.lit(0.2).alias("q_value"))
    out = U.from_group_introns(groups, o.drop("counts"), o.select("chr", "start", "end", "counts"))
    return out.select("GroupID", "FeatureLabel", F.round(F.get("psi", F.lit(0)), 9).alias("l1"), F.round(F.get("psi", F.lit(1)), 9).alias("l2"), F.round("dpsi", 6).alias("dpsi"))


@query("dsa_log2fc", """WITH t AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 3 <> 0)
SELECT 'J' || lpad(n::VARCHAR, 6, '0') AS "GroupID", round(CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 4 > 0 THEN log2((p_partkey % 5)::DOUBLE / (p_partkey % 4)) ELSE 'inf'::DOUBLE END, 9) AS dpsi FROM t""")
def dsa_log2fc(spark, d):
    k = F.col("p_partkey")
    x = X.table(spark, d, "part").select(F.lit("c").alias("chr"), k.cast("string").alias("start"), k.cast("string").alias("end"), F.lit("+").alias("strand"), F.lit("g").alias("gene"), F.when(k % 3 == 0, "LOW").otherwise("TEST").alias("status"), F.lit(0.1).alias("p_value"), F.lit(0.1).alias("q_value"), (k % 4).cast("double").alias("mean_1"), (k % 5).cast("double").alias("mean_2"), k.alias("o"))
    counts = x.select("chr", "start", "end", "strand", F.array(F.lit(1.0)).alias("counts"))
    return U.from_abundances(x, counts).select("GroupID", F.round("dpsi", 9).alias("dpsi"))


@query("candidate_summary_counts", """WITH x AS (SELECT l_returnflag AS c, l_linenumber % 6 AS t FROM lineitem) SELECT c AS comparison, count(*) AS n_genes, """ + ", ".join(f"count(*) FILTER (WHERE t = {i}) AS n_tier{i}" for i in range(1, 6)) + " FROM x GROUP BY 1")
def candidate_summary_counts(spark, d):
    t = F.col("l_linenumber") % 6
    rows = X.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("comparison"), F.when(t == 0, "Unclassified").otherwise(F.concat(F.lit("Tier "), t.cast("string"))).alias("tier"))
    return K.candidate_summary(rows)


@query("event_filter_search", with_("ev") + "SELECT event_uid, gene_symbol, fdr, dpsi FROM ev WHERE event_type = 'SE' AND fdr <= 0.02 AND abs(dpsi) >= 0.4 AND (contains(lower(gene_symbol), 'sym1') OR contains(lower(event_uid), '|7')) ORDER BY fdr, gene_symbol, event_uid, dpsi LIMIT 500")
def event_filter_search(spark, d):
    x = L.filter_events(X.ev(spark, d), "SE", 0.02, 0.4)
    found = L.contains_text("sym1", ["gene_symbol"]) | L.contains_text("|7", ["event_uid"])
    return x.where(found).orderBy("fdr", "gene_symbol", "event_uid", "dpsi").limit(L.PAGE).select("event_uid", "gene_symbol", "fdr", "dpsi")


@query("filter_values", with_("ev") + "SELECT DISTINCT gene_symbol AS value FROM ev ORDER BY 1 LIMIT 500")
def filter_values(spark, d):
    return L.distinct_values(X.ev(spark, d), "gene_symbol")


@query("gene_catalog", with_("ev") + "SELECT DISTINCT CASE WHEN gene_id IS NOT NULL THEN 'id:' || gene_id ELSE 'sym:' || lower(gene_symbol) END AS key, gene_symbol AS label FROM ev")
def gene_catalog(spark, d):
    return X.ev(spark, d).select(C.gene_lookup_key("raw_gene", "gene_symbol").alias("key"), F.col("gene_symbol").alias("label")).distinct()


@query("sample_groups", "SELECT 'g' || (c_custkey % 9) || '_rep_' || (c_custkey % 6 + 1) AS sample, 'g' || (c_custkey % 9) AS grp, count(*) AS n FROM customer GROUP BY ALL")
def sample_groups(spark, d):
    name = F.concat(F.lit("g"), (F.col("c_custkey") % 9).cast("string"), F.lit("_rep_"), (F.col("c_custkey") % 6 + 1).cast("string"))
    return X.table(spark, d, "customer").select(name.alias("sample")).groupBy("sample", T.quant_group("sample").alias("grp")).agg(F.count("*").alias("n"))


@query("cigar_ends", with_("reads") + "SELECT pos, cigar, pos + CASE WHEN cigar = '50M' THEN 50 WHEN cigar = '10M5I35M' THEN 45 WHEN cigar = '20M3D30M' THEN 53 ELSE 50 + regexp_extract(cigar, 'M([0-9]+)N', 1)::INT END - 1 AS last FROM reads")
def cigar_ends(spark, d):
    return X.reads(spark, d).select("pos", "cigar", C.cigar_end("pos", "cigar").alias("last"))


@query("set_operations", with_("deg", "ev", g="SELECT gene_id FROM deg WHERE padj < 0.01", e="SELECT gene_id FROM ev WHERE fdr = 0") + "SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM g UNION SELECT * FROM e) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM e) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM e)")
def set_operations(spark, d):
    g, e = X.deg(spark, d).where("padj < 0.01").select("gene_id"), X.ev(spark, d).where("fdr = 0").select("gene_id")
    counted = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return counted(g.union(e).distinct(), "union").unionByName(counted(g.intersect(e), "intersect")).unionByName(counted(g.subtract(e), "except"))


@query("top_candidates", with_("deg") + "SELECT comparison, gene_id, n FROM (SELECT comparison, gene_id, row_number() OVER (PARTITION BY comparison ORDER BY padj, abs(log2fc) DESC, gene_id) AS n FROM deg) WHERE n <= 20")
def top_candidates(spark, d):
    w = Window.partitionBy("comparison").orderBy("padj", F.abs("log2fc").desc(), "gene_id")
    return X.deg(spark, d).withColumn("n", F.row_number().over(w).cast("long")).where("n <= 20").select("comparison", "gene_id", "n")


@query("volcano_table", with_("deg", "dex", x="SELECT comparison, gene_id, min(q) AS q FROM dex GROUP BY ALL") + "SELECT comparison, gene_id, log2fc, round(least(padj * count(*) OVER (), 1.0), 9) AS bonferroni, round(-log10(q + 0.001), 6) AS score FROM deg JOIN x USING (comparison, gene_id)")
def volcano_table(spark, d):
    x = L.volcano(X.deg(spark, d), X.dex(spark, d))
    return x.select("comparison", "gene_id", "log2fc", F.round("bonferroni", 9).alias("bonferroni"), F.round("score", 6).alias("score"))


_GTF_LINES = " UNION ALL ".join(f'SELECT event_id, {a} AS "start", {b} AS "end", \'{iso}\' AS isoform FROM se' for a, b, iso in (("e1 - 100", "e1", "alternative2"), ("s3", "s3 + 100", "alternative2"), ("e1 - 100", "e1", "alternative1"), ("s2", "e2", "alternative1"), ("s3", "s3 + 100", "alternative1")))


@query("event_gtf_lines", with_("exons", ch="SELECT *, lead(s, 1) OVER w AS s2, lead(e, 1) OVER w AS e2, lead(s, 2) OVER w AS s3 FROM exons WINDOW w AS (PARTITION BY gene, tx ORDER BY s, e)", t="SELECT DISTINCT gene, chr, strand, e AS e1, s2, e2, s3 FROM ch WHERE s3 IS NOT NULL", j="SELECT DISTINCT gene, e AS e1, s2 AS s3 FROM ch WHERE s2 IS NOT NULL", se="SELECT gene || ';SE:' || chr || ':' || e1 || '-' || s2 || ':' || e2 || '-' || s3 || ':' || strand AS event_id, e1, s2, e2, s3 FROM t JOIN j USING (gene, e1, s3)") + _GTF_LINES)
def event_gtf_lines(spark, d):
    return K.event_gtf(S.skipped_exons(X.exons(spark, d).withColumn("chr", F.lit("chr1")))).select("event_id", "start", "end", "isoform")


@query("significance_presets", with_("ev") + " UNION ALL ".join(f"SELECT '{n}' AS preset, count(*) FILTER (WHERE fdr < {f} AND abs(dpsi) >= {p}) AS n FROM ev" for n, f, p in (("default", 0.05, 0.10), ("relaxed", 0.10, 0.05), ("strict", 0.05, 0.20))))
def significance_presets(spark, d):
    from isoframe.functions.thresholds import PRESETS, event_significant

    sums = X.ev(spark, d).agg(*[F.count_if(event_significant("fdr", "dpsi", t)).alias(n) for n, t in PRESETS.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.col(n).alias("n")) for n in PRESETS])).alias("x")).select("x.*")


@query("null_safe_support_join", with_("deg") + "SELECT count(*) AS n FROM deg a JOIN deg b ON a.comparison IS NOT DISTINCT FROM b.comparison AND a.gene_id IS NOT DISTINCT FROM b.gene_id")
def null_safe_support_join(spark, d):
    a = X.deg(spark, d)
    b = a.select(F.col("comparison").alias("c"), F.col("gene_id").alias("g"))
    return a.join(b, F.col("comparison").eqNullSafe(F.col("c")) & F.col("gene_id").eqNullSafe(F.col("g"))).agg(F.count("*").alias("n"))


@query("landscape_by_pair", with_("ev") + "SELECT a.comparison AS a, b.comparison AS b, count(DISTINCT a.gene_id) AS n FROM (SELECT DISTINCT comparison, gene_id FROM ev) a JOIN (SELECT DISTINCT comparison, gene_id FROM ev) b ON a.gene_id = b.gene_id AND a.comparison < b.comparison GROUP BY ALL")
def landscape_by_pair(spark, d):
    x = X.ev(spark, d).select("comparison", "gene_id").distinct()
    y = x.select(F.col("comparison").alias("b"), F.col("gene_id"))
    return x.withColumnRenamed("comparison", "a").join(y, "gene_id").where("a < b").groupBy("a", "b").agg(F.count_distinct("gene_id").alias("n"))
