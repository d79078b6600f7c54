"""Landscape, pair comparison, gene integration, support, candidates and cross-comparison operators.

Events have comparison, event_type, gene_id, gene_symbol, fdr, dpsi, event_uid; dPSI is in
the wanted direction already.  Every ordering ends in a unique key, nulls come last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions import columns as C
from isoframe.functions import thresholds as T
from isoframe.functions.thresholds import Thresholds
from isoframe.operators.ordering import fixed

#: Characters of all lists of alignment files up to which they are broadcast.
LIST_CHARS = 64_000_000


def landscape(events: DataFrame, t: Thresholds, comparisons: DataFrame | None = None) -> DataFrame:
    """comparison, event_type, n_total, n_sig; with ``comparisons``, a row with null counts for each type that is missing."""
    counted = events.groupBy("comparison", "event_type").agg(F.count("*").alias("n_total"), F.count_if(T.event_significant("fdr", "dpsi", t)).alias("n_sig"))
    if comparisons is None:
        return counted
    grid = comparisons.select("comparison", F.explode(F.array(*map(F.lit, C.EVENT_TYPES))).alias("event_type"))
    return grid.join(counted, ["comparison", "event_type"], "left")


def landscape_pivot(counts: DataFrame, value: str = "n_sig") -> DataFrame:
    """A row a comparison, a column an event type, 0 where nothing is."""
    return counts.groupBy("comparison").pivot("event_type", C.EVENT_TYPES).agg(F.sum(value)).na.fill(0)


def landscape_share(counts: DataFrame) -> DataFrame:
    """event_type, n_sig, percent of all significant events; types without any are left out."""
    sums = counts.groupBy("event_type").agg(F.sum("n_sig").alias("n_sig")).where("n_sig > 0")
    return sums.withColumn("percent", F.col("n_sig") * 100.0 / F.sum("n_sig").over(Window.partitionBy()))


def one_row_an_event(events: DataFrame, t: Thresholds) -> DataFrame:
    """Of rows with the same comparison and uid the significant one with the largest effect, with is_sig."""
    marked = events.withColumn("is_sig", T.event_significant("fdr", "dpsi", t))
    first = Window.partitionBy("comparison", "event_uid").orderBy(F.desc("is_sig"), F.abs("dpsi").desc_nulls_last(), F.asc_nulls_last("fdr"), F.asc_nulls_last("dpsi"), F.asc_nulls_last("gene_id"), F.asc_nulls_last("gene_symbol"))
    return marked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def compare_pair(events: DataFrame, a: str, b: str, t: Thresholds) -> DataFrame:
    """Full outer comparison of the events of two comparisons, with class and distance; a missing side is null."""
    rows = one_row_an_event(events.where(F.col("comparison").isin(a, b)), t)

    def side(name: str, mark: str) -> DataFrame:
        return rows.where(F.col("comparison") == name).select("event_uid", *[F.col(c).alias(f"{c}_{mark}") for c in ("gene_id", "gene_symbol", "event_type", "fdr", "dpsi", "is_sig")])

    both = side(a, "A").join(side(b, "B"), "event_uid", "full")
    sig_a, sig_b = (F.coalesce(f"is_sig_{x}", F.lit(False)) for x in "AB")
    return both.select(
        "event_uid",
        *[F.coalesce(f"{c}_A", f"{c}_B").alias(c) for c in ("gene_id", "gene_symbol", "event_type")],
        F.lit(a).alias("comparison_A"), F.lit(b).alias("comparison_B"),
        "fdr_A", "fdr_B", "dpsi_A", "dpsi_B",
        F.abs("dpsi_A").alias("abs_dpsi_A"), F.abs("dpsi_B").alias("abs_dpsi_B"),
        sig_a.alias("is_sig_A"), sig_b.alias("is_sig_B"),
        C.pair_class(sig_a, sig_b, F.col("dpsi_A"), F.col("dpsi_B"), t.program_delta_dpsi).alias("class"),
        F.abs(F.col("dpsi_A") - F.col("dpsi_B")).alias("abs_delta_between_programs"),
    )


#: What the classes of a pair are called; A and B stand for the comparisons' names.
CLASS_LABELS = {
    "A_only": "Only in {A}",
    "B_only": "Only in {B}",
    "shared_same_direction": "Shared same direction",
    "same_direction_large_delta": "Same direction, large dPSI gap",
    "opposite_direction": "Opposite direction",
    "shared_zero_direction": "Shared zero direction",
    "shared_unresolved": "Shared unresolved",
    "neither": "Not significant in either",
}
#: Classes that are shortlisted.
SHORTLIST_CLASSES = ["A_only", "B_only", "opposite_direction", "same_direction_large_delta"]


def program_summary(pairs: DataFrame) -> DataFrame:
    """comparison_A, comparison_B, class_label, n_events."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_LABELS.items() for x in kv]), F.col("class"))
    label = F.replace(F.replace(label, F.lit("{A}"), F.col("comparison_A")), F.lit("{B}"), F.col("comparison_B"))
    return pairs.groupBy("comparison_A", "comparison_B", label.alias("class_label")).agg(F.count("*").alias("n_events"))


def shortlist_rank(pairs: DataFrame) -> DataFrame:
    """Events of shortlisted classes with priority_line and rank_score."""
    part = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        pairs.where(F.col("class").isin(SHORTLIST_CLASSES))
        .withColumn("priority_line", F.concat("comparison_A", F.lit("__vs__"), "comparison_B"))
        .withColumn("rank_score", part("abs_delta_between_programs") + part("abs_dpsi_A") + part("abs_dpsi_B"))
    )


def shortlist_top(ranked: DataFrame, n: int = 12) -> DataFrame:
    """The n first genes by symbol of each priority line, one event each, with place."""
    order = [F.desc("rank_score"), F.asc_nulls_last("gene_symbol"), F.asc("event_uid")]
    one = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("priority_line", "gene_symbol").orderBy(*order))).where("_n = 1").drop("_n")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("priority_line").orderBy(*order))).where(F.col("place") <= n)


def gene_integration(events: DataFrame, deg: DataFrame, t: Thresholds) -> DataFrame:
    """A row a comparison and gene of either layer.

    The representative event is the significant one with the largest effect, then the
    smallest FDR, then the smallest uid.  Of several expression rows of a gene the smallest
    adjusted p, then the largest effect stays.
    """
    marked = events.withColumn("sig", T.integration_significant("fdr", "dpsi", t)).where("gene_id is not null")
    best = F.struct(F.abs("dpsi").alias("size"), (-F.col("fdr")).alias("q"), "event_uid", "event_type", "dpsi", "fdr")
    # equal size and FDR: the smallest uid, hence the two-step choice below
    genes = marked.groupBy("comparison", "gene_id").agg(
        F.min("gene_symbol").alias("gene_symbol"),
        F.count_if("sig").alias("n_sig_events_all"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("sig"), F.col("event_type")))), ";").alias("sig_event_types"),
        F.max(F.when(F.col("sig"), F.struct(best["size"].alias("size"), best["q"].alias("q")))).alias("top"),
    )
    rep = marked.where("sig").join(genes.select("comparison", "gene_id", "top"), ["comparison", "gene_id"]).where((F.abs("dpsi") == F.col("top.size")) & (-F.col("fdr") == F.col("top.q")))
    rep = rep.groupBy("comparison", "gene_id").agg(F.min(F.struct("event_uid", "event_type", "dpsi", "fdr")).alias("rep"))
    one_deg = deg.groupBy("comparison", "gene_id").agg(F.min(F.struct(F.coalesce("padj", F.lit(2.0)).alias("p"), (-F.coalesce(F.abs("log2fc"), F.lit(-1.0))).alias("s"), "log2fc", "padj")).alias("d"))
    one_deg = one_deg.select("comparison", "gene_id", F.col("d.log2fc").alias("log2fc"), F.col("d.padj").alias("deg_padj"))
    joined = one_deg.join(genes.drop("top"), ["comparison", "gene_id"], "full").join(rep, ["comparison", "gene_id"], "left")
    deg_sig, as_sig = T.deg_significant("deg_padj", "log2fc", t), F.col("rep").isNotNull()
    return joined.withColumn("deg_sig", deg_sig).withColumn("splicing_sig", as_sig).withColumn("cls", C.gene_direction(F.col("log2fc"), F.col("rep.dpsi"), F.col("deg_sig"), F.col("splicing_sig"))).select(
        "comparison", "gene_id", F.coalesce("gene_symbol", "gene_id").alias("gene_symbol"), "log2fc", "deg_padj", "deg_sig",
        F.col("rep.event_uid").alias("representative_event_id"), F.col("rep.event_type").alias("representative_event_type"), F.col("rep.dpsi").alias("representative_dpsi"), F.col("rep.fdr").alias("representative_fdr"),
        "splicing_sig", "cls.combined_class", "cls.direction_class", "cls.agreement_class",
        F.coalesce("n_sig_events_all", F.lit(0)).alias("n_sig_events_all"), F.coalesce("sig_event_types", F.lit("")).alias("sig_event_types"),
    )


def integration_summary(genes: DataFrame) -> DataFrame:
    c = F.col("combined_class")
    return genes.groupBy("comparison").agg(
        F.count("*").alias("n_gene_rows"), F.count_if("deg_sig").alias("n_deg_sig"), F.count_if("splicing_sig").alias("n_as_sig"),
        F.count_if(c == "both").alias("n_both"), F.count_if(c == "DE-only").alias("n_de_only"), F.count_if(c == "AS-only").alias("n_as_only"), F.count_if(c == "neither").alias("n_neither"),
    )


def feature_summary(features: DataFrame, limit: float) -> DataFrame:
    """comparison, gene_id, best_q, n_significant, symbol of genes with a feature below the limit (exon usage, transcript usage)."""
    sig = T.below("q", limit)
    return features.where("gene_id is not null").groupBy("comparison", "gene_id").agg(F.min(F.when(sig, F.col("q"))).alias("best_q"), F.count_if(sig).alias("n_significant"), F.min("symbol").alias("symbol")).where("n_significant > 0")


def mechanism_union(deg: DataFrame, suppa: DataFrame, exons: DataFrame, transcripts: DataFrame, t: Thresholds) -> DataFrame:
    """A row a comparison and gene that any of four layers supports, with a flag a layer and the layers' summaries.

    ``suppa`` has comparison, event_id (``gene_and_gene;...``), pvalue, dpsi; its gene ids are
    only trimmed, so a versioned id stays a gene of its own, unlike in the other layers.
    """
    key = ["comparison", "gene_id"]
    genes_of = lambda df, name: df.select(*key, F.lit(name).alias("layer"))
    strong = suppa.where(T.below("pvalue", t.splicing_fdr) & F.coalesce(F.abs("dpsi") >= t.splicing_dpsi, F.lit(False)))
    by_event = strong.select("comparison", F.explode(F.transform(C.suppa_genes("event_id"), C.clean_text)).alias("gene_id")).where("gene_id is not null")
    dex, dtu = feature_summary(exons, t.dexseq_qvalue), feature_summary(transcripts, t.dtu_qvalue)
    layers = genes_of(deg.where(T.below("padj", t.deg_padj)), "deg").unionByName(genes_of(by_event, "suppa")).unionByName(genes_of(dex, "dex")).unionByName(genes_of(dtu, "dtu"))
    flag = lambda name: F.max((F.col("layer") == name).cast("int"))
    flags = layers.groupBy(*key).agg(flag("deg").alias("support_DEG"), flag("suppa").alias("support_SUPPA"), flag("dex").alias("support_DEXSeq"), flag("dtu").alias("support_DTU"))
    for df, name, what in ((dex, "DEXSeq", "exons"), (dtu, "DTU", "isoforms")):
        flags = flags.join(df.select(*key, F.col("best_q").alias(f"best_{name}_qvalue"), F.col("n_significant").alias(f"n_{name}_significant_{what}")), key, "left").na.fill(0, [f"n_{name}_significant_{what}"])
    return flags.withColumn("n_support_methods", F.col("support_DEG") + F.col("support_SUPPA") + F.col("support_DEXSeq") + F.col("support_DTU"))


def symbols_by_precedence(sources: Sequence[DataFrame]) -> DataFrame:
    """gene_id, symbol: of the first source that names the gene; within a source the smallest symbol."""
    tagged = None
    for i, df in enumerate(sources):
        part = df.select("gene_id", "symbol", F.lit(i).alias("p")).where("gene_id is not null and symbol is not null")
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("gene_id").agg(F.min(F.struct("p", "symbol"))["symbol"].alias("symbol"))


def significant_event_lists(events: DataFrame, t: Thresholds) -> DataFrame:
    """comparison, gene_id, distinct ids and ``type:id`` labels of significant events, by FDR, type and id, joined by ``; ``."""
    sig = events.where(T.summary_significant("fdr", "dpsi", t))
    ordered = F.array_sort(F.collect_list(F.struct("fdr", "event_type", "event_uid")))  # the events of one gene
    return sig.groupBy("comparison", "gene_id").agg(ordered.alias("e")).select(
        "comparison", "gene_id",
        F.array_join(F.array_distinct(F.transform("e", lambda x: x["event_uid"])), "; ").alias("event_ids"),
        F.array_join(F.array_distinct(F.transform("e", lambda x: F.concat(x["event_type"], F.lit(":"), x["event_uid"]))), "; ").alias("event_list"),
    )


def candidates(genes: DataFrame, support: DataFrame, events: DataFrame, t: Thresholds) -> DataFrame:
    """Ranked candidate genes of each comparison: evidence, direction, tier, reason and rank."""
    best = events.groupBy("comparison", "gene_id").agg(F.min("fdr").alias("best_fdr"), F.max(F.abs("dpsi")).alias("max_abs_dpsi"))
    lists = significant_event_lists(events, t)
    x = genes
    for other in (support.select("comparison", "gene_id", "support_DEXSeq", "support_DTU"), best, lists):
        right = other.withColumnRenamed("comparison", "_c").withColumnRenamed("gene_id", "_g")
        x = x.join(right, F.col("comparison").eqNullSafe(F.col("_c")) & F.col("gene_id").eqNullSafe(F.col("_g")), "left").drop("_c", "_g")
    deg, spl = F.col("deg_sig"), F.col("splicing_sig")
    dex, dtu = (F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("support_DEXSeq", "support_DTU"))
    x = x.select(
        "comparison", "gene_id", "gene_symbol", "log2fc", "deg_padj", F.abs("log2fc").alias("abs_log2fc"), "representative_dpsi", "best_fdr", "max_abs_dpsi", "n_sig_events_all",
        F.coalesce("event_list", F.lit("")).alias("event_list"), deg.alias("deg_sig"), spl.alias("splicing_sig"), dex.alias("dexseq_sig"), dtu.alias("dtu_sig"),
        (deg.cast("int") + spl.cast("int") + dex.cast("int") + dtu.cast("int")).alias("evidence_count"),
        C.evidence_class(deg, spl, dex, dtu).alias("evidence_class"),
        C.candidate_direction(deg, spl, dex, dtu, F.col("log2fc"), F.col("representative_dpsi")).alias("direction_class"),
        C.candidate_tier(deg, spl, dex | dtu).alias("tier"),
    )
    order = [F.asc("tier"), F.desc("evidence_count"), F.asc_nulls_last("best_fdr"), F.desc_nulls_last("max_abs_dpsi"), F.asc_nulls_last("deg_padj"), F.desc_nulls_last("abs_log2fc"), F.desc("n_sig_events_all"), F.asc("gene_symbol"), F.asc("gene_id")]
    return x.withColumn("reason", C.tier_text("tier")).withColumn("rank", F.row_number().over(Window.partitionBy("comparison").orderBy(*order)))


def without_listed(rows: DataFrame, listed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows none of whose gene columns is in ``listed`` (column gene)."""
    for c in columns:
        rows = rows.join(listed.select(F.col("gene").alias(c)).distinct(), c, "left_anti")
    return rows


def custom_genes(names: DataFrame, ranked: DataFrame, comparison: str) -> DataFrame:
    """Candidates of wanted genes (by symbol or id, in any case), and a placeholder for each that has none."""
    wanted = names.select(F.lower("gene").alias("k"), "gene").dropDuplicates(["k"])
    here = ranked.where(F.col("comparison") == comparison)
    keyed = here.select(F.lower("gene_symbol").alias("k"), "gene_id").unionByName(here.select(F.lower("gene_id").alias("k"), "gene_id")).distinct()
    hit = wanted.join(keyed, "k", "left").join(here.select("gene_id", "gene_symbol", "tier", "rank"), "gene_id", "left")
    return hit.select("gene", F.coalesce("gene_id", "gene").alias("gene_id"), F.coalesce("gene_symbol", "gene").alias("gene_symbol"), F.coalesce("tier", F.lit("Unclassified")).alias("tier"), "rank")


def cross_matrix(ranked: DataFrame, comparisons: Sequence[str], ordered: bool = True) -> DataFrame:
    """A row a gene with tier and rank in each comparison, and the pattern over all of them (candidates only); without an order nothing is gained or lost."""
    x = ranked.where("tier <> 'Unclassified'")
    present = F.array_sort(F.collect_set("comparison"))
    wide = []
    for c in comparisons:
        at = F.col("comparison") == c
        wide += [F.max(F.when(at, F.col("tier"))).alias(f"tier_{c}"), F.max(F.when(at, F.col("rank"))).alias(f"rank_{c}"), F.max(F.when(at, F.col("evidence_class"))).alias(f"evidence_class_{c}")]
    any_ = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    d = F.col("direction_class")
    rows = x.groupBy("gene_id").agg(
        F.min("gene_symbol").alias("gene_symbol"), *wide, present.alias("present"), F.min("tier").alias("best_tier"), F.min("rank").alias("best_rank"),
        ((any_(F.contains(d, F.lit("transcript_up"))) & any_(F.contains(d, F.lit("transcript_down")))) | (any_(F.endswith(d, F.lit("splicing_up"))) & any_(F.endswith(d, F.lit("splicing_down"))))).alias("direction_reversal"),
        (F.count_distinct("tier") > 1).alias("tier_change"), (F.count_distinct("evidence_class") > 1).alias("evidence_change"),
        F.collect_set("evidence_class").alias("evidence"),
    )
    order = F.array(*[F.lit(c) for c in comparisons])
    there = F.transform(order, lambda c: F.array_contains("present", c))
    steps = F.zip_with(F.slice(there, 1, len(comparisons) - 1), F.slice(there, 2, len(comparisons) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    gains, losses = F.exists(steps, lambda s: ~s["a"] & s["b"]), F.exists(steps, lambda s: s["a"] & ~s["b"])
    n = F.size("present")
    only = lambda *names: F.col("evidence") == F.array(*map(F.lit, names))
    pattern = (
        F.when(n == len(comparisons), "shared_all")
        .when((n > 1) & F.col("direction_reversal"), "direction_reversed")
        .when((n > 1) & F.col("tier_change"), "tier_changed")
        .when((n > 1) & F.col("evidence_change"), "evidence_class_changed")
        .when((n > 1) & gains & ~losses & F.lit(ordered), "gained")
        .when((n > 1) & losses & ~gains & F.lit(ordered), "lost")
        .when(n > 1, "shared_subset")
        .when(only("DEG") | only("DEG_only"), "DEG_only_in_one_condition")
        .when(F.forall("evidence", lambda e: e.startswith("rMATS")), "splicing_only_in_one_condition")
        .otherwise("comparison_specific")
    )
    return rows.withColumn("pattern", pattern).withColumn("n_comparisons", n).withColumn("candidate_comparisons", F.array_join("present", ";")).drop("present", "evidence")


def presence_transition(ranked: DataFrame, comparisons: Sequence[str]) -> DataFrame:
    """gene_id, gains, losses, transition of candidates along the order of comparisons."""
    present = ranked.where("tier <> 'Unclassified'").groupBy("gene_id").agg(*[F.max((F.col("comparison") == c).cast("int")).alias(f"p{i}") for i, c in enumerate(comparisons)])
    pairs = list(zip(range(len(comparisons)), range(1, len(comparisons))))
    gains = sum((F.when((F.col(f"p{i}") == 0) & (F.col(f"p{j}") == 1), 1).otherwise(0) for i, j in pairs), F.lit(0))
    losses = sum((F.when((F.col(f"p{i}") == 1) & (F.col(f"p{j}") == 0), 1).otherwise(0) for i, j in pairs), F.lit(0))
    n = sum((F.col(f"p{i}") for i in range(len(comparisons))), F.lit(0))
    kind = F.when(n <= 1, "comparison_specific").when((F.col("gains") > 0) & (F.col("losses") == 0), "gained").when((F.col("losses") > 0) & (F.col("gains") == 0), "lost").otherwise("shared_subset")
    return present.withColumn("gains", gains).withColumn("losses", losses).withColumn("transition", kind).select("gene_id", "gains", "losses", "transition")


def significant_patterns(events: DataFrame, a: str, b: str, abs_dpsi: float, large: float, fdr: float = 0.05) -> DataFrame:
    """Events of two comparisons matched by gene, type and id, with directions, distances and significance."""
    key = F.concat_ws("|", F.coalesce("gene_id", F.lit("")), "event_type", "event_uid")
    sig = F.coalesce((F.col("fdr") <= fdr) & (F.abs("dpsi") >= abs_dpsi), F.lit(False))
    rows = events.where(F.col("comparison").isin(a, b)).withColumn("event_key", key).withColumn("significant", sig)
    first = Window.partitionBy("comparison", "event_key").orderBy(F.desc("significant"), F.asc_nulls_last("fdr"), F.asc_nulls_last("dpsi"))
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    side = lambda c, m: rows.where(F.col("comparison") == c).select("event_key", *[F.col(x).alias(f"{x}_{m}") for x in ("gene_id", "event_type", "event_uid", "dpsi", "fdr", "significant")])
    both = side(a, "A").join(side(b, "B"), "event_key", "full")
    sa, sb = (F.signum(F.coalesce(f"dpsi_{m}", F.lit(0.0))) for m in "AB")
    return both.select(
        "event_key", *[F.coalesce(f"{c}_A", f"{c}_B").alias(c) for c in ("gene_id", "event_type", "event_uid")], "dpsi_A", "dpsi_B", "fdr_A", "fdr_B",
        *[F.coalesce(f"significant_{m}", F.lit(False)).alias(f"significant_{m}") for m in "AB"],
        (F.col("dpsi_A") - F.col("dpsi_B")).alias("delta_dpsi"), F.abs(F.col("dpsi_A") - F.col("dpsi_B")).alias("abs_delta_dpsi"),
        ((sa == sb) & (sa != 0)).alias("same_direction"), ((sa != sb) & (sa != 0) & (sb != 0)).alias("opposite_direction"),
        F.abs(F.abs("dpsi_A") - F.abs("dpsi_B")).alias("strength_delta"), F.lit(large).alias("large_delta_cutoff"),
    )


def pattern_sets(patterns: DataFrame) -> DataFrame:
    """Overlapping result sets of matched events: event_class and the event, a row for each set that holds it."""
    a, b = F.col("significant_A"), F.col("significant_B")
    sets = F.array_compact(F.array(
        F.when(a & b, F.lit("shared_significant")),
        F.when(a & b & F.col("same_direction") & (F.col("strength_delta") >= F.col("large_delta_cutoff")), F.lit("same_direction_large_delta")),
        F.when(a & b & F.col("opposite_direction"), F.lit("opposite_direction")),
        F.when(a & ~b, F.lit("comparison_A_only")), F.when(b & ~a, F.lit("comparison_B_only")),
    ))
    return patterns.withColumn("event_class", F.explode(sets))


def dominant_event(events: DataFrame, t: Thresholds) -> DataFrame:
    """One event of each comparison and gene: the largest effect among significant ones, or among all if none is."""
    sig = T.summary_significant("fdr", "dpsi", t)
    order = [F.desc("is_sig"), F.abs("dpsi").desc_nulls_last(), F.asc_nulls_last("fdr"), F.asc("event_type"), F.asc("event_uid"), F.asc_nulls_last("dpsi")]
    w = Window.partitionBy("comparison", "gene_id").orderBy(*order)
    return events.withColumn("is_sig", sig).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def expression_means(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """gene_id, group, mean, n_samples from counts (gene_id, sample, value) and samples (sample, group)."""
    return counts.join(samples, "sample").groupBy("gene_id", "group").agg(F.avg("value").alias("mean"), F.count("value").alias("n_samples"))


def comparisons_with_quant(comparisons: DataFrame, samples: DataFrame) -> DataFrame:
    """comparison, has_quant: samples of both groups are there."""
    groups = comparisons.select("comparison", F.explode(F.array_distinct(F.array("experiment", "control"))).alias("group"))
    there = samples.select("group").distinct().withColumn("there", F.lit(1))
    return groups.join(there, "group", "left").groupBy("comparison").agg((F.count("there") == F.count("*")).alias("has_quant"))


def samples_of_comparisons(samples: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Pairs of sample and comparison whose group or comparison id fits, each by a join of its own."""
    by_group = samples.join(comparisons.select("comparison", F.explode(F.array("experiment", "control")).alias("group")), "group").select("sample", "comparison")
    by_id = samples.where("comparison_id is not null").select("sample", F.col("comparison_id").alias("comparison")).join(comparisons.select("comparison"), "comparison").select("sample", "comparison")
    return by_group.unionByName(by_id).distinct()


def manifest(events: DataFrame, targets: DataFrame, bams: DataFrame) -> DataFrame:
    """Selected events in each target comparison with the alignment files of its two groups, one row an event and comparison.

    A group's list of files is long and there are few lists, so they are made once and
    broadcast up to LIST_CHARS: no shuffle carries a list for each event.
    """
    files = fixed(bams.groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("bam")), ",").alias("bams")))
    if (files.agg(F.sum(F.length("group") + F.length("bams"))).first()[0] or 0) <= LIST_CHARS:
        files = F.broadcast(files)
    x = events.select("event_uid", "event_type", "gene_symbol").dropDuplicates(["event_uid"]).join(targets.select("event_uid", "comparison", "experiment", "control").dropDuplicates(["event_uid", "comparison"]), "event_uid")
    for side in ("experiment", "control"):
        x = x.join(files.select(F.col("group").alias(side), F.col("bams").alias(f"{side}_bams")), side, "left")
    return x.select("event_uid", "event_type", "gene_symbol", "comparison", "experiment", "control", "experiment_bams", "control_bams")


def venn_regions(sets: DataFrame) -> DataFrame:
    """mask, n: elements (name, gene) in exactly the sets of a bit mask; names are numbered in order, at most 62 sets."""
    names = sets.select("name").distinct().withColumn("bit", F.row_number().over(Window.orderBy("name")) - 1)
    masks = sets.join(F.broadcast(names), "name").groupBy("gene").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    return masks.groupBy("mask").agg(F.count("*").alias("n"))
