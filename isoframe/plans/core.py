"""Queries over events, genes, candidates and comparisons, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoframe.functions import columns as C
from isoframe.functions.thresholds import PRESETS
from isoframe.operators import programs as P
from isoframe.operators import selection as L
from isoframe.plans import proxies as X
from isoframe.plans.proxies import with_

QUERIES: dict = {}
SQL: dict[str, str] = {}
T = PRESETS["default"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_SIG = "coalesce(fdr < 0.05 AND abs(dpsi) >= 0.10, false)"
_LAND = f"SELECT comparison, event_type, count(*) AS n_total, count(*) FILTER (WHERE {_SIG}) AS n_sig FROM ev GROUP BY ALL"


@query("landscape", with_("ev", land=_LAND) + "SELECT c.comparison, t.event_type, l.n_total, l.n_sig FROM (VALUES ('A'), ('N'), ('R'), ('none')) c(comparison) CROSS JOIN (VALUES ('SE'), ('RI'), ('A3SS'), ('A5SS'), ('MXE')) t(event_type) LEFT JOIN land l USING (comparison, event_type)")
def landscape(spark, d):
    comps = spark.createDataFrame([(c,) for c in [*X.COMPARISONS, "none"]], "comparison string")
    return P.landscape(X.ev(spark, d), T, comps)


@query("landscape_pivot", with_("ev", land=_LAND) + "SELECT comparison, " + ", ".join(f"coalesce(sum(n_sig) FILTER (WHERE event_type = '{t}'), 0)::BIGINT AS \"{t}\"" for t in C.EVENT_TYPES) + " FROM land GROUP BY comparison")
def landscape_pivot(spark, d):
    return P.landscape_pivot(P.landscape(X.ev(spark, d), T))


@query("landscape_share", with_("ev", land=_LAND, s="SELECT event_type, sum(n_sig)::BIGINT AS n_sig FROM land GROUP BY 1 HAVING sum(n_sig) > 0") + "SELECT event_type, n_sig, round(n_sig * 100.0::DOUBLE / sum(n_sig) OVER (), 6) AS percent FROM s")
def landscape_share(spark, d):
    return P.landscape_share(P.landscape(X.ev(spark, d), T)).withColumn("percent", F.round("percent", 6))


@query("scan_union_events", with_("ev") + "SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def scan_union_events(spark, d):
    e = X.ev(spark, d)
    parts = [e.where(F.col("event_type") == t) for t in C.EVENT_TYPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("clean_text", "SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(trim(x), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')), '') AS cleaned FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '\"' || p_name || '\"' WHEN 1 THEN ' ' || p_name || ' ' WHEN 2 THEN '''' || p_name || '''' ELSE '' END AS x FROM part)")
def clean_text(spark, d):
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(k == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k == 2, F.concat(F.lit("'"), "p_name", F.lit("'"))).otherwise("")
    return X.table(spark, d, "part").select("p_partkey", C.clean_text(x).alias("cleaned"))


@query("normalize_gene_id", with_("ev") + "SELECT raw_gene, regexp_replace(raw_gene, '\\.[0-9]+$', '') AS gene, count(*) AS n FROM ev GROUP BY ALL")
def normalize_gene_id(spark, d):
    return X.ev(spark, d).groupBy("raw_gene", C.normalize_gene_id("raw_gene").alias("gene")).agg(F.count("*").alias("n"))


@query("event_uid", "SELECT DISTINCT 'SE|chr1|+|' || l_partkey || '|' || l_suppkey || '|' || CASE WHEN l_linenumber = 3 THEN 'nan' ELSE l_linenumber::VARCHAR END AS uid FROM lineitem")
def event_uid(spark, d):
    x = X.table(spark, d, "lineitem").select(F.lit("chr1").alias("chr"), F.lit("+").alias("strand"), F.col("l_partkey").alias("exonStart_0base"), F.col("l_suppkey").alias("exonEnd"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("upstreamES"))
    return x.select(C.event_uid("SE", x.columns).alias("uid")).distinct()


@query("coordinates", "SELECT DISTINCT concat_ws(' | ', 'SE', 'a=' || l_partkey, CASE WHEN l_linenumber <> 3 THEN 'b=' || l_linenumber END) AS txt FROM lineitem")
def coordinates(spark, d):
    x = X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("b"))
    return x.select(C.coordinates_text(F.lit("SE"), ["a", "b"]).alias("txt")).distinct()


@query("inc_level_mean", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN round(p_size::DOUBLE, 6) ELSE round((p_size + p_partkey % 10) / 2.0::DOUBLE, 6) END AS mean FROM part")
def inc_level_mean(spark, d):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, "NA,,x").when(k == 1, F.concat(s, F.lit(",NA"))).otherwise(F.concat(s, F.lit(", "), (F.col("p_partkey") % 10).cast("string"), F.lit(",nan")))
    return X.table(spark, d, "part").select("p_partkey", F.round(C.inc_level_mean(text), 6).alias("mean"))


@query("safe_name", "SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment || ' ', '[^A-Za-z0-9_.\\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM customer")
def safe_name(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", C.safe_name(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit(" "))).alias("name"))


@query("split_comparison_name", "SELECT c_custkey, 'x' || c_nationkey AS experiment, 'y' || (c_custkey % 7) AS control, 'y' || (c_custkey % 7) || sep || 'x' || c_nationkey AS swapped FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN '_vs_' WHEN 1 THEN '-vs-' WHEN 2 THEN ' vs ' ELSE '-' END AS sep FROM customer)")
def split_comparison_name(spark, d):
    k = F.col("c_custkey") % 4
    sep = F.when(k == 0, "_vs_").when(k == 1, "-vs-").when(k == 2, " vs ").otherwise("-")
    name = F.concat(F.lit("x"), F.col("c_nationkey").cast("string"), sep, F.lit("y"), (F.col("c_custkey") % 7).cast("string"))
    x = X.table(spark, d, "customer").select("c_custkey", name.alias("name"))
    return x.withColumn("s", C.split_comparison("name")).select("c_custkey", "s.experiment", "s.control", C.swapped_name("name").alias("swapped"))


@query("direction_labels", with_("ev") + "SELECT comparison, CASE WHEN dpsi > 0 THEN 'inclusion higher in ' || comparison || ' than ctl' WHEN dpsi < 0 THEN 'inclusion lower in ' || comparison || ' than ctl' ELSE 'no directional shift' END AS direction, count(*) AS n FROM ev GROUP BY ALL")
def direction_labels(spark, d):
    return X.ev(spark, d).groupBy("comparison", C.inclusion_text("dpsi", "comparison", F.lit("ctl")).alias("direction")).agg(F.count("*").alias("n"))


@query("suppa_gene_split", with_("sup") + "SELECT event_id, unnest(string_split(split_part(event_id, ';', 1), '_and_')) AS gene FROM sup")
def suppa_gene_split(spark, d):
    return X.sup(spark, d).select("event_id", F.explode(C.suppa_genes("event_id")).alias("gene"))


@query("gene_tokens", "SELECT c_custkey, c_mktsegment || '|x' || (c_custkey % 5) AS genes FROM customer")
def gene_tokens(spark, d):
    text = F.concat("c_mktsegment", F.lit(", x"), (F.col("c_custkey") % 5).cast("string"), F.lit(";"), F.lower("c_mktsegment"), F.lit("\tX"), (F.col("c_custkey") % 5).cast("string"))
    return X.table(spark, d, "customer").select("c_custkey", F.array_join(C.gene_tokens(text), "|").alias("genes"))


@query("log_score", with_("ev") + "SELECT fdr, round(-log10(greatest(fdr, 1e-300)), 6) AS score, count(*) AS n FROM ev GROUP BY ALL")
def log_score(spark, d):
    return X.ev(spark, d).groupBy("fdr", F.round(C.log_score("fdr"), 6).alias("score")).agg(F.count("*").alias("n"))


# pair comparison
_ONE = f"SELECT * EXCLUDE (rn) FROM (SELECT *, {_SIG} AS is_sig, row_number() OVER (PARTITION BY comparison, event_uid ORDER BY ({_SIG}) DESC, abs(dpsi) DESC NULLS LAST, fdr, dpsi, gene_id, gene_symbol) AS rn FROM ev) WHERE rn = 1"
_PAIR = """SELECT coalesce(a.event_uid, b.event_uid) AS event_uid, coalesce(a.gene_id, b.gene_id) AS gene_id, coalesce(a.gene_symbol, b.gene_symbol) AS gene_symbol, coalesce(a.event_type, b.event_type) AS event_type,
  'A' AS "comparison_A", 'N' AS "comparison_B", a.fdr AS "fdr_A", b.fdr AS "fdr_B", a.dpsi AS "dpsi_A", b.dpsi AS "dpsi_B", abs(a.dpsi) AS "abs_dpsi_A", abs(b.dpsi) AS "abs_dpsi_B", coalesce(a.is_sig, false) AS "is_sig_A", coalesce(b.is_sig, false) AS "is_sig_B",
  CASE WHEN a.is_sig AND b.is_sig AND (a.dpsi = 0 OR b.dpsi = 0) THEN 'shared_zero_direction' WHEN a.is_sig AND b.is_sig AND sign(a.dpsi) <> sign(b.dpsi) THEN 'opposite_direction'
    WHEN a.is_sig AND b.is_sig AND abs(a.dpsi - b.dpsi) >= 0.10 THEN 'same_direction_large_delta' WHEN a.is_sig AND b.is_sig THEN 'shared_same_direction' WHEN a.is_sig THEN 'A_only' WHEN b.is_sig THEN 'B_only' ELSE 'neither' END AS class,
  abs(a.dpsi - b.dpsi) AS abs_delta_between_programs
FROM (SELECT * FROM one WHERE comparison = 'A') a FULL JOIN (SELECT * FROM one WHERE comparison = 'N') b ON a.event_uid = b.event_uid"""
_PAIRS = dict(one=_ONE, pairs=_PAIR)


def _pairs(spark, d):
    return P.compare_pair(X.ev(spark, d), "A", "N", T)


QUERIES["program_events"], SQL["program_events"] = _pairs, with_("ev", **_PAIRS) + "SELECT * FROM pairs"


@query("program_summary", with_("ev", **_PAIRS) + "SELECT \"comparison_A\", \"comparison_B\", CASE class WHEN 'A_only' THEN 'Only in A' WHEN 'B_only' THEN 'Only in N' WHEN 'shared_same_direction' THEN 'Shared same direction' WHEN 'same_direction_large_delta' THEN 'Same direction, large dPSI gap' WHEN 'opposite_direction' THEN 'Opposite direction' WHEN 'neither' THEN 'Not significant in either' END AS class_label, count(*) AS n_events FROM pairs GROUP BY ALL")
def program_summary(spark, d):
    return P.program_summary(_pairs(spark, d))


_RANKED = "SELECT *, \"comparison_A\" || '__vs__' || \"comparison_B\" AS priority_line, coalesce(abs_delta_between_programs, 0) + coalesce(\"abs_dpsi_A\", 0) + coalesce(\"abs_dpsi_B\", 0) AS rank_score FROM pairs WHERE class IN ('A_only', 'B_only', 'opposite_direction', 'same_direction_large_delta')"


@query("shortlist_rank", with_("ev", **_PAIRS, ranked=_RANKED) + "SELECT event_uid, gene_symbol, class, priority_line, round(rank_score, 6) AS rank_score FROM ranked")
def shortlist_rank(spark, d):
    return P.shortlist_rank(_pairs(spark, d)).select("event_uid", "gene_symbol", "class", "priority_line", F.round("rank_score", 6).alias("rank_score"))


@query("shortlist_topn", with_("ev", **_PAIRS, ranked=_RANKED.replace("coalesce(abs_delta", "round(coalesce(abs_delta").replace("\"abs_dpsi_B\", 0) AS", "\"abs_dpsi_B\", 0), 6) AS"), first="SELECT *, row_number() OVER (PARTITION BY priority_line, gene_symbol ORDER BY rank_score DESC, event_uid) AS n FROM ranked", placed="SELECT *, row_number() OVER (PARTITION BY priority_line ORDER BY rank_score DESC, gene_symbol, event_uid) AS place FROM first WHERE n = 1") + "SELECT priority_line, gene_symbol, event_uid, rank_score, place FROM placed WHERE place <= 12")
def shortlist_topn(spark, d):
    ranked = P.shortlist_rank(_pairs(spark, d)).withColumn("rank_score", F.round("rank_score", 6))
    return P.shortlist_top(ranked, 12).select("priority_line", "gene_symbol", "event_uid", "rank_score", F.col("place").cast("long").alias("place"))


# gene integration
_ISIG = "coalesce(fdr < 0.05 AND abs(dpsi) > 0.10, false)"
_GENES = dict(
    sig=f"SELECT * FROM ev WHERE {_ISIG}",
    reps="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comparison, gene_id ORDER BY abs(dpsi) DESC, fdr, event_uid, event_type, dpsi) AS rn FROM sig) WHERE rn = 1",
    evg="SELECT comparison, gene_id, min(gene_symbol) AS gene_symbol FROM ev GROUP BY ALL",
    sg="SELECT comparison, gene_id, count(*) AS n, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS types FROM sig GROUP BY ALL",
    genes="""SELECT coalesce(d.comparison, g.comparison) AS comparison, coalesce(d.gene_id, g.gene_id) AS gene_id, coalesce(g.gene_symbol, d.gene_id) AS gene_symbol, d.log2fc, d.padj AS deg_padj, coalesce(d.padj <= 0.05 AND abs(d.log2fc) > 1, false) AS deg_sig,
      r.event_uid AS representative_event_id, r.event_type AS representative_event_type, r.dpsi AS representative_dpsi, r.fdr AS representative_fdr, r.event_uid IS NOT NULL AS splicing_sig, coalesce(s.n, 0) AS n_sig_events_all, coalesce(s.types, '') AS sig_event_types
      FROM deg d FULL JOIN evg g ON d.comparison = g.comparison AND d.gene_id = g.gene_id
      LEFT JOIN reps r ON r.comparison = coalesce(d.comparison, g.comparison) AND r.gene_id = coalesce(d.gene_id, g.gene_id)
      LEFT JOIN sg s ON s.comparison = coalesce(d.comparison, g.comparison) AND s.gene_id = coalesce(d.gene_id, g.gene_id)""",
    integ="""SELECT *, CASE WHEN deg_sig AND splicing_sig THEN 'both' WHEN deg_sig THEN 'DE-only' WHEN splicing_sig THEN 'AS-only' ELSE 'neither' END AS combined_class,
      CASE WHEN deg_sig AND splicing_sig THEN 'both_' || CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END || '_' || CASE WHEN representative_dpsi > 0 THEN 'up' ELSE 'down' END WHEN deg_sig THEN CASE WHEN log2fc > 0 THEN 'DE-only_up' ELSE 'DE-only_down' END WHEN splicing_sig THEN CASE WHEN representative_dpsi > 0 THEN 'AS-only_posPSI' ELSE 'AS-only_negPSI' END ELSE 'neither' END AS direction_class,
      CASE WHEN deg_sig AND splicing_sig THEN CASE WHEN log2fc * representative_dpsi > 0 THEN 'concordant' ELSE 'discordant' END WHEN deg_sig OR splicing_sig THEN 'single_layer' ELSE 'neither' END AS agreement_class FROM genes""",
)


def _genes(spark, d):
    return P.gene_integration(X.ev(spark, d), X.deg(spark, d), T)


QUERIES["gene_integration"], SQL["gene_integration"] = _genes, with_("ev", "deg", **_GENES) + "SELECT * FROM integ"


@query("integration_summary", with_("ev", "deg", **_GENES) + "SELECT comparison, count(*) AS n_gene_rows, count(*) FILTER (WHERE deg_sig) AS n_deg_sig, count(*) FILTER (WHERE splicing_sig) AS n_as_sig, count(*) FILTER (WHERE combined_class = 'both') AS n_both, count(*) FILTER (WHERE combined_class = 'DE-only') AS n_de_only, count(*) FILTER (WHERE combined_class = 'AS-only') AS n_as_only, count(*) FILTER (WHERE combined_class = 'neither') AS n_neither FROM integ GROUP BY comparison")
def integration_summary(spark, d):
    return P.integration_summary(_genes(spark, d))


@query("plot_class", with_("ev", "deg", **_GENES) + "SELECT comparison, CASE WHEN deg_sig AND splicing_sig AND log2fc * representative_dpsi > 0 THEN 'DEG + DAS same direction' WHEN deg_sig AND splicing_sig THEN 'DEG + DAS opposite direction' WHEN deg_sig THEN 'DEG only' WHEN splicing_sig THEN 'DAS only' ELSE 'Not significant' END AS plot_class, count(*) AS n FROM integ GROUP BY ALL")
def plot_class(spark, d):
    return _genes(spark, d).groupBy("comparison", C.plot_class(F.col("deg_sig"), F.col("splicing_sig"), F.col("log2fc"), F.col("representative_dpsi")).alias("plot_class")).agg(F.count("*").alias("n"))


# support layers
_FEATURE = "SELECT comparison, gene_id, min(q) FILTER (WHERE q < {0}) AS best_q, count(*) FILTER (WHERE q < {0}) AS n_significant, min(symbol) AS symbol FROM {1} GROUP BY ALL HAVING count(*) FILTER (WHERE q < {0}) > 0"


@query("dexseq_summary", with_("dex") + _FEATURE.format(0.10, "dex"))
def dexseq_summary(spark, d):
    return P.feature_summary(X.dex(spark, d), T.dexseq_qvalue)


@query("dtu_summary", with_("dtu") + _FEATURE.format(0.05, "dtu"))
def dtu_summary(spark, d):
    return P.feature_summary(X.dtu(spark, d), T.dtu_qvalue)


_MECH = dict(
    dexs=_FEATURE.format(0.10, "dex"), dtus=_FEATURE.format(0.05, "dtu"),
    layers="SELECT DISTINCT comparison, gene_id, 'deg' AS layer FROM deg WHERE padj < 0.05 UNION ALL SELECT DISTINCT comparison, unnest(string_split(split_part(event_id, ';', 1), '_and_')), 'sup' FROM sup WHERE pvalue < 0.05 AND abs(dpsi) >= 0.10 UNION ALL SELECT comparison, gene_id, 'dex' FROM dexs UNION ALL SELECT comparison, gene_id, 'dtu' FROM dtus",
    flags="SELECT comparison, gene_id, max((layer = 'deg')::INT) AS \"support_DEG\", max((layer = 'sup')::INT) AS \"support_SUPPA\", max((layer = 'dex')::INT) AS \"support_DEXSeq\", max((layer = 'dtu')::INT) AS \"support_DTU\" FROM layers GROUP BY ALL",
    mech="SELECT f.*, x.best_q AS \"best_DEXSeq_qvalue\", coalesce(x.n_significant, 0) AS \"n_DEXSeq_significant_exons\", t.best_q AS \"best_DTU_qvalue\", coalesce(t.n_significant, 0) AS \"n_DTU_significant_isoforms\", \"support_DEG\" + \"support_SUPPA\" + \"support_DEXSeq\" + \"support_DTU\" AS n_support_methods FROM flags f LEFT JOIN dexs x USING (comparison, gene_id) LEFT JOIN dtus t USING (comparison, gene_id)",
)


def _mech(spark, d):
    return P.mechanism_union(X.deg(spark, d), X.sup(spark, d), X.dex(spark, d), X.dtu(spark, d), T)


QUERIES["mechanism_union"], SQL["mechanism_union"] = _mech, with_("deg", "sup", "dex", "dtu", **_MECH) + "SELECT * FROM mech"


@query("mechanism_layer_counts", with_("deg", "sup", "dex", "dtu", **_MECH) + "SELECT comparison, sum(\"support_DEG\")::BIGINT AS deg, sum(\"support_SUPPA\")::BIGINT AS suppa, sum(\"support_DEXSeq\")::BIGINT AS dexseq, sum(\"support_DTU\")::BIGINT AS dtu FROM mech GROUP BY 1")
def mechanism_layer_counts(spark, d):
    return _mech(spark, d).groupBy("comparison").agg(*[F.sum(f"support_{n}").alias(n.lower()) for n in ("DEG", "SUPPA", "DEXSeq", "DTU")])


@query("symbol_precedence", with_("anno", "ev", "dex", "dtu", u="SELECT gene_id, symbol, 0 AS p FROM anno UNION ALL SELECT gene_id, gene_symbol, 1 FROM ev UNION ALL SELECT gene_id, symbol, 2 FROM dex UNION ALL SELECT gene_id, symbol, 3 FROM dtu", f="SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY p, symbol) AS n FROM u") + "SELECT gene_id, symbol FROM f WHERE n = 1")
def symbol_precedence(spark, d):
    return P.symbols_by_precedence([X.anno(spark, d), X.ev(spark, d).select("gene_id", F.col("gene_symbol").alias("symbol")), X.dex(spark, d), X.dtu(spark, d)])


_SSIG = "coalesce(fdr <= 0.05 AND abs(dpsi) >= 0.10, false)"
_LISTS = f"SELECT comparison, gene_id, string_agg(event_uid, '; ' ORDER BY fdr, event_type, event_uid) AS event_ids, string_agg(event_type || ':' || event_uid, '; ' ORDER BY fdr, event_type, event_uid) AS event_list FROM (SELECT comparison, gene_id, event_type, event_uid, min(fdr) AS fdr FROM ev WHERE {_SSIG} GROUP BY ALL) GROUP BY ALL"


@query("event_summary_lists", with_("ev") + _LISTS)
def event_summary_lists(spark, d):
    return P.significant_event_lists(X.ev(spark, d), T)


_CAND = dict(
    **_GENES, **_MECH, lists=_LISTS, best="SELECT comparison, gene_id, min(fdr) AS best_fdr, max(abs(dpsi)) AS max_abs_dpsi FROM ev GROUP BY ALL",
    c0="""SELECT i.comparison, i.gene_id, i.gene_symbol, i.log2fc, i.deg_padj, abs(i.log2fc) AS abs_log2fc, i.representative_dpsi, b.best_fdr, b.max_abs_dpsi, i.n_sig_events_all, coalesce(l.event_list, '') AS event_list, i.deg_sig, i.splicing_sig,
      coalesce(m."support_DEXSeq" > 0, false) AS dexseq_sig, coalesce(m."support_DTU" > 0, false) AS dtu_sig FROM integ i LEFT JOIN mech m USING (comparison, gene_id) LEFT JOIN best b USING (comparison, gene_id) LEFT JOIN lists l USING (comparison, gene_id)""",
    c1="""SELECT *, deg_sig::INT + splicing_sig::INT + dexseq_sig::INT + dtu_sig::INT AS evidence_count,
      coalesce(nullif(concat_ws('_', CASE WHEN deg_sig THEN 'DEG' END, CASE WHEN splicing_sig THEN 'rMATS' END, CASE WHEN dexseq_sig THEN 'DEXSeq' END, CASE WHEN dtu_sig THEN 'DTU' END), ''), 'unclassified') AS evidence_class,
      CASE WHEN deg_sig AND splicing_sig THEN 'transcript_' || CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END || '_splicing_' || CASE WHEN representative_dpsi > 0 THEN 'up' ELSE 'down' END WHEN deg_sig THEN 'DEG_only' WHEN splicing_sig AND (dexseq_sig OR dtu_sig) THEN 'rMATS_DEXSeq_or_DTU_only' WHEN splicing_sig THEN 'rMATS_only' ELSE 'unclassified' END AS direction_class,
      CASE WHEN deg_sig AND splicing_sig AND (dexseq_sig OR dtu_sig) THEN 'Tier 1' WHEN deg_sig AND splicing_sig THEN 'Tier 2' WHEN splicing_sig AND (dexseq_sig OR dtu_sig) THEN 'Tier 3' WHEN splicing_sig THEN 'Tier 4' WHEN deg_sig AND NOT (dexseq_sig OR dtu_sig) THEN 'Tier 5' ELSE 'Unclassified' END AS tier FROM c0""",
    cand="SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY tier, evidence_count DESC, best_fdr NULLS LAST, max_abs_dpsi DESC NULLS LAST, deg_padj NULLS LAST, abs_log2fc DESC NULLS LAST, n_sig_events_all DESC, gene_symbol, gene_id) AS rank FROM c1",
)
_CW = with_("ev", "deg", "sup", "dex", "dtu", **_CAND)


def _cand(spark, d):
    return P.candidates(_genes(spark, d), _mech(spark, d), X.ev(spark, d), T)


@query("candidate_rank", _CW + "SELECT comparison, gene_id, gene_symbol, tier, evidence_class, direction_class, evidence_count, best_fdr, max_abs_dpsi, n_sig_events_all, event_list, rank FROM cand")
def candidate_rank(spark, d):
    return _cand(spark, d).select("comparison", "gene_id", "gene_symbol", "tier", "evidence_class", "direction_class", "evidence_count", "best_fdr", "max_abs_dpsi", "n_sig_events_all", "event_list", F.col("rank").cast("long").alias("rank"))


@query("tier_rules", _CW + "SELECT comparison, tier, count(*) AS n FROM cand GROUP BY ALL")
def tier_rules(spark, d):
    return _cand(spark, d).groupBy("comparison", "tier").agg(F.count("*").alias("n"))


@query("support_left_join", _CW + "SELECT comparison, gene_id, dexseq_sig, dtu_sig FROM cand")
def support_left_join(spark, d):
    return _cand(spark, d).select("comparison", "gene_id", "dexseq_sig", "dtu_sig")


@query("blacklist_anti", with_("ev") + "SELECT comparison, count(*) AS n FROM ev WHERE gene_symbol NOT IN (SELECT 'sym' || (p_partkey % 50) FROM part) AND gene_id NOT IN (SELECT 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0') FROM part WHERE p_partkey % 9 = 0) GROUP BY 1")
def blacklist_anti(spark, d):
    p = X.table(spark, d, "part")
    listed = p.select(F.concat(F.lit("sym"), (F.col("p_partkey") % 50).cast("string")).alias("gene")).unionByName(p.where("p_partkey % 9 = 0").select(X._gene(F.col("p_partkey")).alias("gene"))).distinct()
    return P.without_listed(X.ev(spark, d), listed, ["gene_symbol", "gene_id"]).groupBy("comparison").agg(F.count("*").alias("n"))


@query("cross_matrix", _CW + "SELECT gene_id, " + ", ".join(f"max(tier) FILTER (WHERE comparison = '{c}') AS \"tier_{c}\", max(rank) FILTER (WHERE comparison = '{c}') AS \"rank_{c}\"" for c in X.COMPARISONS) + ", min(tier) AS best_tier, min(rank) AS best_rank, count(DISTINCT comparison) AS n_comparisons, string_agg(DISTINCT comparison, ';' ORDER BY comparison) AS candidate_comparisons FROM cand WHERE tier <> 'Unclassified' GROUP BY gene_id")
def cross_matrix(spark, d):
    x = P.cross_matrix(_cand(spark, d), X.COMPARISONS)
    return x.select("gene_id", *[F.col(f"{w}_{c}").cast("long" if w == "rank" else "string").alias(f"{w}_{c}") for c in X.COMPARISONS for w in ("tier", "rank")], "best_tier", F.col("best_rank").cast("long").alias("best_rank"), F.col("n_comparisons").cast("long").alias("n_comparisons"), "candidate_comparisons")


_CROSS = """, g AS (SELECT gene_id, count(DISTINCT comparison) AS n, bool_or(direction_class LIKE 'transcript_up%') AS tu, bool_or(direction_class LIKE 'transcript_down%') AS td, bool_or(direction_class LIKE '%splicing_up') AS su, bool_or(direction_class LIKE '%splicing_down') AS sd,
  count(DISTINCT tier) AS nt, count(DISTINCT evidence_class) AS ne, min(evidence_class) AS e, bool_and(starts_with(evidence_class, 'rMATS')) AS spl, bool_or(comparison = 'A') AS a, bool_or(comparison = 'N') AS b, bool_or(comparison = 'R') AS c FROM cand WHERE tier <> 'Unclassified' GROUP BY 1)"""


@query("cross_pattern", _CW + _CROSS + "SELECT gene_id, CASE WHEN n = 3 THEN 'shared_all' WHEN n > 1 AND ((tu AND td) OR (su AND sd)) THEN 'direction_reversed' WHEN n > 1 AND nt > 1 THEN 'tier_changed' WHEN n > 1 AND ne > 1 THEN 'evidence_class_changed' WHEN n > 1 AND ((NOT a AND b) OR (NOT b AND c)) AND NOT ((a AND NOT b) OR (b AND NOT c)) THEN 'gained' WHEN n > 1 AND ((a AND NOT b) OR (b AND NOT c)) AND NOT ((NOT a AND b) OR (NOT b AND c)) THEN 'lost' WHEN n > 1 THEN 'shared_subset' WHEN ne = 1 AND e = 'DEG' THEN 'DEG_only_in_one_condition' WHEN spl THEN 'splicing_only_in_one_condition' ELSE 'comparison_specific' END AS pattern FROM g")
def cross_pattern(spark, d):
    return P.cross_matrix(_cand(spark, d), X.COMPARISONS).select("gene_id", "pattern")


@query("presence_transition", _CW + _CROSS + "SELECT gene_id, (NOT a AND b)::INT + (NOT b AND c)::INT AS gains, (a AND NOT b)::INT + (b AND NOT c)::INT AS losses, CASE WHEN n <= 1 THEN 'comparison_specific' WHEN ((NOT a AND b) OR (NOT b AND c)) AND NOT ((a AND NOT b) OR (b AND NOT c)) THEN 'gained' WHEN ((a AND NOT b) OR (b AND NOT c)) AND NOT ((NOT a AND b) OR (NOT b AND c)) THEN 'lost' ELSE 'shared_subset' END AS transition FROM g")
def presence_transition(spark, d):
    return P.presence_transition(_cand(spark, d), X.COMPARISONS)


@query("custom_genes", _CW + ", w AS (SELECT DISTINCT 'SYM' || (p_partkey % 20) AS gene FROM part UNION SELECT 'nothing') SELECT w.gene, coalesce(c.gene_id, w.gene) AS gene_id, coalesce(c.tier, 'Unclassified') AS tier FROM w LEFT JOIN (SELECT * FROM cand WHERE comparison = 'A') c ON lower(c.gene_symbol) = lower(w.gene) OR lower(c.gene_id) = lower(w.gene)")
def custom_genes(spark, d):
    p = X.table(spark, d, "part")
    wanted = p.select(F.concat(F.lit("SYM"), (F.col("p_partkey") % 20).cast("string")).alias("gene")).distinct().unionByName(spark.createDataFrame([("nothing",)], "gene string"))
    return P.custom_genes(wanted, _cand(spark, d), "A").select("gene", "gene_id", "tier")


_PAT = dict(
    k="SELECT * FROM (SELECT *, coalesce(gene_id, '') || '|' || event_type || '|' || event_uid AS event_key, coalesce(fdr <= 0.05 AND abs(dpsi) >= 0.10, false) AS significant, row_number() OVER (PARTITION BY comparison, coalesce(gene_id, '') || '|' || event_type || '|' || event_uid ORDER BY coalesce(fdr <= 0.05 AND abs(dpsi) >= 0.10, false) DESC, fdr, dpsi) AS rn FROM ev) WHERE rn = 1",
    pat="""SELECT coalesce(a.event_key, b.event_key) AS event_key, coalesce(a.event_type, b.event_type) AS event_type, a.dpsi AS "dpsi_A", b.dpsi AS "dpsi_B", coalesce(a.significant, false) AS "significant_A", coalesce(b.significant, false) AS "significant_B",
      round(abs(a.dpsi - b.dpsi), 6) AS abs_delta_dpsi, sign(coalesce(a.dpsi, 0)) = sign(coalesce(b.dpsi, 0)) AND coalesce(a.dpsi, 0) <> 0 AS same_direction, sign(coalesce(a.dpsi, 0)) <> sign(coalesce(b.dpsi, 0)) AND coalesce(a.dpsi, 0) <> 0 AND coalesce(b.dpsi, 0) <> 0 AS opposite_direction, abs(abs(a.dpsi) - abs(b.dpsi)) AS strength
      FROM (SELECT * FROM k WHERE comparison = 'A') a FULL JOIN (SELECT * FROM k WHERE comparison = 'N') b ON a.event_key = b.event_key""",
)


def _patterns(spark, d):
    return P.significant_patterns(X.ev(spark, d), "A", "N", 0.10, 0.25)


@query("as_pattern_outer", with_("ev", **_PAT) + "SELECT * EXCLUDE (strength) FROM pat")
def as_pattern_outer(spark, d):
    return _patterns(spark, d).select("event_key", "event_type", "dpsi_A", "dpsi_B", "significant_A", "significant_B", F.round("abs_delta_dpsi", 6).alias("abs_delta_dpsi"), "same_direction", "opposite_direction")


@query("as_pattern_split", with_("ev", **_PAT) + """SELECT event_class, count(*) AS n FROM (
  SELECT 'shared_significant' AS event_class FROM pat WHERE "significant_A" AND "significant_B"
  UNION ALL SELECT 'same_direction_large_delta' FROM pat WHERE "significant_A" AND "significant_B" AND same_direction AND strength >= 0.25
  UNION ALL SELECT 'opposite_direction' FROM pat WHERE "significant_A" AND "significant_B" AND opposite_direction
  UNION ALL SELECT CASE WHEN "significant_A" THEN 'comparison_A_only' ELSE 'comparison_B_only' END FROM pat WHERE "significant_A" <> "significant_B") GROUP BY 1""")
def as_pattern_split(spark, d):
    return P.pattern_sets(_patterns(spark, d)).groupBy("event_class").agg(F.count("*").alias("n"))


@query("dominant_event", with_("ev") + f"SELECT comparison, gene_id, event_uid, dpsi, fdr, is_sig FROM (SELECT *, {_SSIG} AS is_sig, row_number() OVER (PARTITION BY comparison, gene_id ORDER BY ({_SSIG}) DESC, abs(dpsi) DESC NULLS LAST, fdr NULLS LAST, event_type, event_uid, dpsi NULLS LAST) AS rn FROM ev) WHERE rn = 1")
def dominant_event(spark, d):
    return P.dominant_event(X.ev(spark, d), T).select("comparison", "gene_id", "event_uid", "dpsi", "fdr", "is_sig")


@query("expression_means", with_("tpm") + "SELECT gene, cond, round(avg(tpm), 6) AS mean, count(*) AS n_samples FROM tpm GROUP BY ALL")
def expression_means(spark, d):
    x = X.tpm(spark, d)
    samples = x.select("sample", F.col("cond").alias("group")).distinct()
    return P.expression_means(x.select(F.col("gene").alias("gene_id"), "sample", F.col("tpm").alias("value")), samples).select(F.col("gene_id").alias("gene"), F.col("group").alias("cond"), F.round("mean", 6).alias("mean"), "n_samples")


@query("has_quant_division", "SELECT n_nationkey::VARCHAR AS comparison, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (n_nationkey, n_nationkey + 5)) = 2 AS has_quant FROM nation")
def has_quant_division(spark, d):
    comps = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("comparison"), F.col("n_nationkey").cast("string").alias("experiment"), (F.col("n_nationkey") + 5).cast("string").alias("control"))
    return P.comparisons_with_quant(comps, X.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("group")))


@query("isoform_sample_match", "SELECT DISTINCT c_name AS sample, n_nationkey::VARCHAR AS comparison FROM customer JOIN nation ON c_nationkey IN (n_nationkey, n_nationkey + 5) OR (c_custkey % 10 = 0 AND c_custkey % 25 = n_nationkey)")
def isoform_sample_match(spark, d):
    comps = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("comparison"), F.col("n_nationkey").cast("string").alias("experiment"), (F.col("n_nationkey") + 5).cast("string").alias("control"))
    samples = X.table(spark, d, "customer").select(F.col("c_name").alias("sample"), F.col("c_nationkey").cast("string").alias("group"), F.when(F.col("c_custkey") % 10 == 0, (F.col("c_custkey") % 25).cast("string")).alias("comparison_id"))
    return P.samples_of_comparisons(samples, comps)


@query("manifest", with_("ev", e="SELECT DISTINCT event_uid, event_type FROM ev WHERE fdr = 0 AND abs(dpsi) >= 0.4", t="SELECT DISTINCT event_uid, comparison FROM ev", b="SELECT 'g' || (s_suppkey % 3) AS grp, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS bams FROM supplier GROUP BY 1") + "SELECT e.event_uid, e.event_type, t.comparison, x.bams AS experiment_bams, y.bams AS control_bams FROM e JOIN t USING (event_uid) LEFT JOIN b x ON x.grp = CASE t.comparison WHEN 'A' THEN 'g0' WHEN 'N' THEN 'g1' ELSE 'g9' END LEFT JOIN b y ON y.grp = 'g2'")
def manifest(spark, d):
    e = X.ev(spark, d)
    c = F.col("comparison")
    targets = e.select("event_uid", "comparison", F.when(c == "A", "g0").when(c == "N", "g1").otherwise("g9").alias("experiment"), F.lit("g2").alias("control"))
    bams = X.table(spark, d, "supplier").select(F.concat(F.lit("g"), (F.col("s_suppkey") % 3).cast("string")).alias("group"), F.col("s_name").alias("bam"))
    return P.manifest(e.where("fdr = 0 and abs(dpsi) >= 0.4"), targets, bams).select("event_uid", "event_type", "comparison", "experiment_bams", "control_bams")


@query("venn_regions", with_("ev", s=f"SELECT DISTINCT comparison, gene_id FROM ev WHERE {_SIG}", m="SELECT gene_id, bit_or(CASE comparison WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END)::BIGINT AS mask FROM s GROUP BY 1") + "SELECT mask, count(*) AS n FROM m GROUP BY 1")
def venn_regions(spark, d):
    from isoframe.functions.thresholds import event_significant

    return P.venn_regions(X.ev(spark, d).where(event_significant("fdr", "dpsi", T)).select(F.col("comparison").alias("name"), F.col("gene_id").alias("gene")))


@query("evidence_top20", with_("deg") + "SELECT gene_id, log2fc FROM deg WHERE comparison = 'A' AND padj <= 0.05 AND abs(log2fc) > 1 ORDER BY abs(log2fc) DESC, gene_id LIMIT 20")
def evidence_top20(spark, d):
    from isoframe.functions.thresholds import deg_significant

    return L.largest_changes(X.deg(spark, d).where((F.col("comparison") == "A") & deg_significant("padj", "log2fc", T))).select("gene_id", "log2fc")


@query("evidence_heatmap", _CW + ", m AS (SELECT gene_id, evidence_count, n_sig_events_all AS n, coalesce(abs_log2fc, 0) AS fc FROM cand WHERE comparison = 'A') SELECT gene_id, round(evidence_count / max(evidence_count) OVER (), 6) AS evidence, round(n / max(n) OVER (), 6) AS events, round(fc / max(fc) OVER (), 6) AS fc FROM m ORDER BY evidence_count DESC, n DESC, fc DESC, gene_id LIMIT 40")
def evidence_heatmap(spark, d):
    x = L.evidence_matrix(_cand(spark, d).where("comparison = 'A'"))
    return x.select("gene_id", *[F.round(c, 6).alias(c) for c in ("evidence", "events", "fc")])


@query("program_heatmap", with_("ev", **_PAIRS, g="SELECT gene_symbol, max(round(abs_delta_between_programs, 6)) AS m FROM pairs WHERE abs_delta_between_programs IS NOT NULL GROUP BY 1 ORDER BY m DESC, gene_symbol LIMIT 30", r="SELECT p.gene_symbol, p.event_uid, round(p.abs_delta_between_programs, 6) AS delta, row_number() OVER (PARTITION BY p.gene_symbol ORDER BY round(p.abs_delta_between_programs, 6) DESC, p.event_uid) AS n FROM pairs p JOIN g USING (gene_symbol) WHERE p.abs_delta_between_programs IS NOT NULL") + "SELECT gene_symbol, event_uid, delta FROM r WHERE n = 1")
def program_heatmap(spark, d):
    return L.largest_differences(_pairs(spark, d))
