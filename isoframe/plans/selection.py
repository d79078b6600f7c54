"""Queries of filters, selections, catalogs and cards, over stand-ins, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoframe.functions.thresholds import PRESETS
from isoframe.operators import programs as P
from isoframe.operators import selection as L
from isoframe.plans import proxies as X
from isoframe.plans.proxies import with_

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_KEYS = "comparison, gene_id, tier, rank"


@query("candidate_filter", with_("cand") + f"SELECT {_KEYS} FROM cand WHERE comparison = 'A' AND evidence_class = 'rMATS' AND abs(log2fc) >= 0.5 AND abs(representative_dpsi) >= 0.1 AND (contains(lower(gene_symbol), 'm1') OR contains(lower(reason), 'm1') OR contains(lower(gene_id), 'm1') OR contains(lower(tier), 'm1') OR contains(lower(evidence_class), 'm1') OR contains(lower(direction_class), 'm1') OR contains(lower(comparison), 'm1'))")
def candidate_filter(spark, d):
    return L.filter_candidates(X.cand(spark, d), "A", evidence="rMATS", min_abs_log2fc=0.5, min_abs_dpsi=0.1, query=" M1 ").select("comparison", "gene_id", "tier", "rank")


@query("candidate_search", with_("cand") + f"SELECT {_KEYS} FROM cand WHERE tier = 'Tier 2' AND (contains(lower(gene_symbol), '7') OR contains(lower(reason), '7')) ORDER BY comparison, rank, gene_id LIMIT 500")
def candidate_search(spark, d):
    return L.search_table(X.cand(spark, d), {"tier": "Tier 2", "comparison": ""}, "7", ["gene_symbol", "reason"], ["comparison", "rank", "gene_id"]).select("comparison", "gene_id", "tier", "rank")


_BLOCKED = "SELECT CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS comparison, CASE WHEN p_partkey % 2 = 0 THEN 'Sym' || p_partkey ELSE 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0') END AS gene FROM part WHERE p_size < 20"


def _blocked(spark, d):
    k = F.col("p_partkey")
    comparison = F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R")
    gene = F.when(k % 2 == 0, F.concat(F.lit("Sym"), k.cast("string"))).otherwise(F.concat(F.lit("ENSG"), F.lpad(k.cast("string"), 11, "0")))
    return X.table(spark, d, "part").where("p_size < 20").select(comparison.alias("comparison"), F.concat(F.lit(" "), gene).alias("gene"))


@query("blacklist_by_comparison", with_("cand", b=_BLOCKED) + f"SELECT {_KEYS} FROM cand c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.comparison = c.comparison AND b.gene IN (c.gene_symbol, c.gene_id))")
def blacklist_by_comparison(spark, d):
    return L.without_blacklist(X.cand(spark, d), _blocked(spark, d)).select("comparison", "gene_id", "tier", "rank")


_TOP = "SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY rank, gene_symbol, gene_id) AS n FROM {}"


@query("selection_default", with_("cand", t=_TOP.format("cand")) + f"SELECT {_KEYS} FROM t WHERE n <= 20")
def selection_default(spark, d):
    return L.select_candidates(X.cand(spark, d)).select("comparison", "gene_id", "tier", "rank")


@query("selection_tiers", with_("cand", b=_BLOCKED, f="SELECT * FROM cand c WHERE tier IN ('Tier 1', 'Tier 2') AND NOT EXISTS (SELECT 1 FROM b WHERE b.comparison = c.comparison AND b.gene IN (c.gene_symbol, c.gene_id))", t=_TOP.format("f")) + f"SELECT {_KEYS} FROM t WHERE n <= 15")
def selection_tiers(spark, d):
    return L.select_candidates(X.cand(spark, d), "tier1_tier2", 15, blacklist=_blocked(spark, d)).select("comparison", "gene_id", "tier", "rank")


@query("selection_shortlist", with_("cand") + f"SELECT {_KEYS} FROM cand WHERE shortlisted")
def selection_shortlist(spark, d):
    return L.select_candidates(X.cand(spark, d), "shortlist").select("comparison", "gene_id", "tier", "rank")


@query("selection_custom", with_("cand", w="SELECT 'A' AS comparison, CASE WHEN p_partkey % 3 = 0 THEN 'SYM' || (p_partkey * 2) WHEN p_partkey % 3 = 1 THEN 'ensg' || lpad(p_partkey::VARCHAR, 11, '0') ELSE 'none' || p_partkey END AS gene FROM part", j="SELECT w.gene, c.comparison, c.gene_id, c.tier, c.rank FROM w LEFT JOIN cand c ON c.comparison = w.comparison AND (lower(w.gene) = lower(c.gene_symbol) OR lower(w.gene) = lower(c.gene_id))") + "SELECT DISTINCT 'A' AS comparison, coalesce(gene_id, gene) AS gene_id, coalesce(tier, 'Unclassified') AS tier, rank FROM j")
def selection_custom(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("SYM"), (k * 2).cast("string"))).when(k % 3 == 1, F.concat(F.lit("ensg"), F.lpad(k.cast("string"), 11, "0"))).otherwise(F.concat(F.lit("none"), k.cast("string")))
    return L.select_candidates(X.cand(spark, d), "custom", genes=X.table(spark, d, "part").select(F.lit("A").alias("comparison"), name.alias("gene"))).select("comparison", "gene_id", "tier", "rank")


@query("event_catalog", with_("ev", o="SELECT *, row_number() OVER (PARTITION BY comparison, event_uid ORDER BY fdr, dpsi, gene_id, gene_symbol) AS n FROM ev") + "SELECT comparison, event_uid, event_type, gene_id, gene_symbol, fdr, dpsi, CASE WHEN dpsi > 0 THEN 'positive' WHEN dpsi < 0 THEN 'negative' ELSE 'zero' END AS way FROM o WHERE n = 1")
def event_catalog(spark, d):
    x = L.event_catalog(X.ev(spark, d))
    return x.select("comparison", "event_uid", "event_type", "gene_id", "gene_symbol", "fdr", "dpsi", F.regexp_extract("direction", "^[a-z]+", 0).alias("way"))


@query("events_for_manifest", with_("ev", c="SELECT DISTINCT comparison, event_uid FROM ev", w="SELECT DISTINCT event_uid FROM ev WHERE fdr = 0 AND event_type = 'SE'") + "SELECT event_uid, comparison, 'x' || comparison AS experiment, 'y' AS control FROM c JOIN w USING (event_uid)")
def events_for_manifest(spark, d):
    ev = X.ev(spark, d)
    comparisons = spark.createDataFrame([(c, f"x{c}", "y") for c in X.COMPARISONS], "comparison string, experiment string, control string")
    return L.events_for_manifest(L.event_catalog(ev), ev.where("fdr = 0 and event_type = 'SE'"), comparisons)[1].select("event_uid", "comparison", "experiment", "control")


# expression rows of genes by id, of others by symbol only, of others by a versioned id under another symbol
_EXPR = "SELECT CASE p_partkey % 3 WHEN 1 THEN NULL ELSE 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0') || '.4' END AS gene_id, CASE p_partkey % 3 WHEN 2 THEN 'other' || p_partkey ELSE ' sym' || p_partkey END AS gene_symbol, comparison, grp, (p_size + g)::DOUBLE AS expr FROM part CROSS JOIN (VALUES ('A'), ('N')) c(comparison) CROSS JOIN (VALUES ('g1', 1), ('g2', 2)) v(grp, g)"


def _expression(spark, d):
    k = F.col("p_partkey")
    both = X.table(spark, d, "part").select("*", F.explode(F.array(F.lit("A"), F.lit("N"))).alias("comparison")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("g"))
    return both.select(F.when(k % 3 != 1, F.concat(F.lit("ENSG"), F.lpad(k.cast("string"), 11, "0"), F.lit(".4"))).alias("gene_id"), F.concat(F.when(k % 3 == 2, "other").otherwise(" sym"), k.cast("string")).alias("gene_symbol"), "comparison", F.concat(F.lit("g"), F.col("g").cast("string")).alias("group"), (F.col("p_size") + F.col("g")).cast("double").alias("expr"))


@query("mean_expression", with_("cand", e=_EXPR) + "SELECT 'id:' || c.gene_id AS gene_key, c.comparison, avg(e.expr) AS mean_expr FROM cand c JOIN e ON e.comparison = c.comparison AND (e.gene_id = c.gene_id || '.4' OR (e.gene_id IS NULL AND lower(trim(e.gene_symbol)) = lower(c.gene_symbol))) GROUP BY ALL")
def mean_expression(spark, d):
    from isoframe.functions import columns as C

    cards = X.cand(spark, d).withColumn("gene_key", C.gene_lookup_key("gene_id", "gene_symbol"))
    return L.mean_expression(L.card_expression(cards, _expression(spark, d)))


_DOM = "SELECT *, row_number() OVER (PARTITION BY comparison, gene_id ORDER BY coalesce(fdr <= 0.05 AND abs(dpsi) >= 0.1, false) DESC, abs(dpsi) DESC, fdr, event_type, event_uid, dpsi) AS n FROM ev"


@query("gene_cards", with_("cand", "ev", dm=_DOM, e=_EXPR, t=_TOP.format("cand"), m="SELECT c.gene_id, c.comparison, avg(e.expr) AS mean_expr FROM cand c JOIN e ON e.comparison = c.comparison AND (e.gene_id = c.gene_id || '.4' OR (e.gene_id IS NULL AND lower(trim(e.gene_symbol)) = lower(c.gene_symbol))) GROUP BY ALL") + "SELECT t.comparison, t.gene_id, t.rank, dm.event_uid AS dominant_event, dm.dpsi AS dominant_dpsi, mean_expr FROM t LEFT JOIN (SELECT * FROM dm WHERE n = 1) dm ON dm.comparison = t.comparison AND dm.gene_id = t.gene_id LEFT JOIN m ON m.comparison = t.comparison AND m.gene_id = t.gene_id WHERE t.n <= 50")
def gene_cards(spark, d):
    cards = L.gene_cards(L.select_candidates(X.cand(spark, d), "all", 50), P.dominant_event(X.ev(spark, d), PRESETS["default"]), _expression(spark, d))
    return cards.select("comparison", "gene_id", "rank", "dominant_event", "dominant_dpsi", "mean_expr")


@query("isoform_followup", with_("cand", t=_TOP.format("cand")) + "SELECT comparison, gene_id, CASE WHEN dtu_sig THEN 'DTU evidence available' ELSE 'no DTU evidence' END AS isoform_followup_status FROM t WHERE n <= 40")
def isoform_followup(spark, d):
    return L.isoform_followup(L.select_candidates(X.cand(spark, d), "selection", 40)).select("comparison", "gene_id", "isoform_followup_status")


@query("event_followup", with_("cand", "ev", dm=_DOM, t=_TOP.format("cand")) + "SELECT t.comparison, t.gene_id, dm.event_uid AS best_event, dm.event_type AS dominant_type, dm.fdr AS dominant_fdr FROM t LEFT JOIN (SELECT * FROM dm WHERE n = 1) dm ON dm.comparison = t.comparison AND dm.gene_id = t.gene_id WHERE t.n <= 40")
def event_followup(spark, d):
    return L.event_followup(L.select_candidates(X.cand(spark, d), "selection", 40), P.dominant_event(X.ev(spark, d), PRESETS["default"])).select("comparison", "gene_id", "best_event", "dominant_type", "dominant_fdr")


@query("strength_counts", "SELECT CASE l_linenumber WHEN 1 THEN 'A_only' WHEN 2 THEN 'B_only' WHEN 3 THEN 'opposite_direction' WHEN 4 THEN 'neither' ELSE 'shared_same_direction' END AS class, count(*) AS n FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1")
def strength_counts(spark, d):
    k = F.col("l_linenumber")
    kind = F.when(k == 1, "A_only").when(k == 2, "B_only").when(k == 3, "opposite_direction").when(k == 4, "neither").otherwise("shared_same_direction")
    return L.strength_counts(X.table(spark, d, "lineitem").select(kind.alias("class"), F.col("l_orderkey").alias("event_uid")))


@query("pattern_counts", "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'unclassified' WHEN 1 THEN 'gained' WHEN 2 THEN 'lost' ELSE 'shared_all' END AS pattern, count(*) AS n FROM orders GROUP BY 1")
def pattern_counts(spark, d):
    k = F.col("o_orderkey") % 5
    return L.pattern_counts(X.table(spark, d, "orders").select(F.when(k == 1, "gained").when(k == 2, "lost").when(k > 2, "shared_all").alias("pattern")))


@query("membership_counts", with_("cand", g="SELECT gene_id, count(*) AS k FROM cand WHERE tier <> 'Unclassified' GROUP BY 1") + "SELECT k::INT AS n_comparisons, count(*) AS n FROM g GROUP BY 1")
def membership_counts(spark, d):
    g = X.cand(spark, d).where("tier <> 'Unclassified'").groupBy("gene_id").agg(F.count("*").alias("n_comparisons"))
    return L.membership_counts(g)


@query("manifest_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def manifest_counts(spark, d):
    return L.value_counts(X.table(spark, d, "orders"), "o_orderpriority")


@query("condition_values", "SELECT c::INT AS cond, unnest(CASE c WHEN 1 THEN embedding[1:3] ELSE embedding[4:6] END)::DOUBLE AS value FROM embeddings CROSS JOIN (VALUES (1), (2)) v(c) WHERE vec_id = (SELECT min(vec_id) FROM embeddings WHERE len(embedding) >= 6)")
def condition_values(spark, d):
    x = X.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"))
    first = x.where("size(values) >= 6").agg(F.min(F.col("id").cast("long")).cast("string")).first()[0]
    return L.condition_values(x, first, [(1, 3), (4, 6)]).select("cond", F.explode(F.col("values").cast("array<double>")).alias("value"))
