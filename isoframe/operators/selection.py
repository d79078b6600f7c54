"""Filters, selections and catalogs over ranked candidates and events, and the tables behind a gene's card.

Candidates are the rows of ``programs.candidates``: comparison, gene_id, gene_symbol, tier,
evidence_class, direction_class, log2fc, representative_dpsi, reason, rank and others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions import columns as C

#: Rows that a searched table and a list of filter values show, at most: they are pages for a reader.
PAGE = 500
#: Columns that a text search of candidates and of events looks into.
CANDIDATE_TEXT = ["comparison", "gene_symbol", "gene_id", "tier", "evidence_class", "direction_class", "reason"]
EVENT_TEXT = ["gene_symbol", "gene_id", "event_type", "event_uid", "coordinates"]
#: What a selection of candidates can come from, and the tiers of two of them.
SOURCES = ["selection", "tier1", "tier1_tier2", "shortlist", "custom", "all"]
TIERS_OF = {"tier1": ["Tier 1"], "tier1_tier2": ["Tier 1", "Tier 2"]}
#: Classes of a pair that differ in direction or strength.
STRENGTH_CLASSES = ["opposite_direction", "same_direction_large_delta", "shared_same_direction", "A_only", "B_only"]
#: Comparisons that a card shows, at most.
CARD_COMPARISONS = 8


def contains_text(query: str, columns: Sequence[str]) -> Column:
    """Is the text in any of the columns, in any case?  Nulls hold nothing; an empty text is in every row."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(wanted)) for c in columns])


def with_value(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows with a value as text; all rows for an empty one."""
    return rows.where(F.col(column).cast("string") == value) if value else rows


def filter_candidates(rows: DataFrame, comparison: str | None = None, tier: str | None = None, evidence: str | None = None, direction: str | None = None, min_abs_log2fc: float = 0.0, min_abs_dpsi: float = 0.0, query: str = "") -> DataFrame:
    """Candidates by comparison, tier, evidence, direction, least absolute effects (null has none, so it fails) and text."""
    for column, value in (("comparison", comparison), ("tier", tier), ("evidence_class", evidence), ("direction_class", direction)):
        rows = with_value(rows, column, value)
    return rows.where((F.abs("log2fc") >= min_abs_log2fc) & (F.abs("representative_dpsi") >= min_abs_dpsi) & contains_text(query, CANDIDATE_TEXT))


def filter_events(events: DataFrame, event_type: str | None = None, max_fdr: float | None = None, min_abs_dpsi: float | None = None, query: str = "") -> DataFrame:
    """Events by type, FDR, absolute dPSI and text over the columns of EVENT_TEXT that are there."""
    events = with_value(events, "event_type", event_type)
    if max_fdr is not None:
        events = events.where(F.col("fdr") <= max_fdr)
    if min_abs_dpsi is not None:
        events = events.where(F.abs("dpsi") >= min_abs_dpsi)
    return events.where(contains_text(query, [c for c in EVENT_TEXT if c in events.columns]))


def search_table(rows: DataFrame, equal: Mapping[str, str], query: str, columns: Sequence[str], order: Sequence[str], page: int = PAGE) -> DataFrame:
    """The first page, in an order, of rows with given values and a text in any of the columns."""
    for column, value in equal.items():
        rows = with_value(rows, column, value)
    return rows.where(contains_text(query, columns)).orderBy(*order).limit(page)


def distinct_values(rows: DataFrame, column: str, page: int = PAGE) -> DataFrame:
    """value: the first page of a column's values in order, for a filter."""
    return rows.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").limit(page)


def without_blacklist(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose symbol and id aren't listed for their comparison (comparison, gene; as written but for outer spaces)."""
    blocked = listed.select(F.col("comparison").alias("_c"), F.trim("gene").alias("_g")).where("_g <> ''").distinct()
    for c in ("gene_symbol", "gene_id"):
        rows = rows.join(blocked, (F.col("comparison") == F.col("_c")) & (F.col(c) == F.col("_g")), "left_anti")
    return rows


def first_by_rank(rows: DataFrame, n: int) -> DataFrame:
    """The n first rows of each comparison by rank and symbol."""
    w = Window.partitionBy("comparison").orderBy(F.asc_nulls_last("rank"), F.asc_nulls_last("gene_symbol"), F.asc_nulls_last("gene_id"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def named_candidates(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates of wanted genes (comparison, gene: symbol or id in any case), and an unclassified row for each gene that has none."""
    wanted = names.select(F.col("comparison").alias("_c"), F.trim("gene").alias("_gene")).where("_gene <> ''").withColumn("_k", F.lower("_gene")).dropDuplicates(["_c", "_k"])
    keyed = rows.withColumn("_k", F.explode(F.array_distinct(F.array(F.lower("gene_symbol"), F.lower("gene_id"))))).where("_k is not null")
    hit = wanted.join(keyed.withColumn("_hit", F.lit(True)), (F.col("comparison") == F.col("_c")) & (wanted["_k"] == keyed["_k"]), "left")
    absent = hit.where("_hit is null").select(F.col("_c").alias("comparison"), F.col("_gene").alias("gene_id"), F.col("_gene").alias("gene_symbol"), F.lit("Unclassified").alias("tier"))
    best = Window.partitionBy("comparison", "gene_id").orderBy(F.asc_nulls_last("rank"), F.asc_nulls_last("tier"), F.asc_nulls_last("gene_symbol"))
    found = hit.where("_hit").select(*[F.col(c) for c in rows.columns]).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return found.unionByName(absent, allowMissingColumns=True)


def select_candidates(ranked: DataFrame, source: str = "selection", top_n: int = 20, genes: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """Candidates of every comparison by their source.

    ``selection`` takes the stored ``genes`` (comparison, gene), or the first ``top_n`` where
    none are stored; ``custom`` the given ones; ``shortlist`` those marked shortlisted;
    ``tier1``, ``tier1_tier2`` and ``all`` the first ``top_n`` (0: every one) of their tiers.
    """
    rows = without_blacklist(ranked, blacklist) if blacklist is not None else ranked
    if source in ("selection", "custom") and genes is not None:
        return named_candidates(rows, genes)
    if source == "selection":
        return first_by_rank(rows, top_n)
    if source == "custom":
        return rows.limit(0)
    if source == "shortlist":
        return rows.where(F.coalesce("shortlisted", F.lit(False)))
    rows = rows.where(F.col("tier").isin(TIERS_OF[source])) if source in TIERS_OF else rows
    return first_by_rank(rows, top_n) if top_n > 0 else rows


def event_catalog(events: DataFrame) -> DataFrame:
    """One row a comparison and event id with its direction as text; the smallest FDR of rows that repeat an id."""
    first = Window.partitionBy("comparison", "event_uid").orderBy(F.asc_nulls_last("fdr"), F.asc_nulls_last("dpsi"), F.asc_nulls_last("gene_id"), F.asc_nulls_last("gene_symbol"))
    one = events.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return one.withColumn("gene_symbol", F.coalesce("gene_symbol", "gene_id")).withColumn("direction", C.direction_label("dpsi", "positive in canonical AS direction", "negative in canonical AS direction", "zero / unresolved"))


def catalog_order() -> list[Column]:
    return [F.asc_nulls_last("fdr"), F.asc("event_type"), F.asc_nulls_last("gene_symbol"), F.asc("event_uid")]


def events_for_manifest(catalog: DataFrame, chosen: DataFrame, comparisons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog rows of the chosen events (event_uid), and the comparisons in which each is (event_uid, comparison, experiment, control)."""
    events = catalog.join(chosen.select("event_uid").distinct(), "event_uid", "left_semi")
    return events, events.select("event_uid", "comparison").distinct().join(comparisons.select("comparison", "experiment", "control"), "comparison")


def card_expression(cards: DataFrame, expression: DataFrame) -> DataFrame:
    """Expression rows (gene_id, gene_symbol, comparison, group, expr) of each card's gene (gene_key, gene_id, gene_symbol, comparison).

    A row fits by the lookup key of its gene; where a card has none by key, by symbol in any
    case or by id without its version.
    """
    e = expression.select(C.gene_lookup_key("gene_id", "gene_symbol").alias("_key"), F.lower(F.trim("gene_symbol")).alias("_sym"), C.normalize_gene_id("gene_id").alias("_gid"), F.col("comparison").alias("_c"), "group", "expr")
    c = cards.select("gene_key", "comparison", F.lower(F.trim("gene_symbol")).alias("s"), C.normalize_gene_id("gene_id").alias("g"))
    same = F.col("comparison") == F.col("_c")
    out = ["gene_key", "comparison", "group", "expr"]
    by_key = c.join(e, same & (F.col("gene_key") == F.col("_key"))).select(*out)
    rest = c.join(by_key.select("gene_key", "comparison").distinct(), ["gene_key", "comparison"], "left_anti")
    # two equi-joins in place of one on either condition
    by_name = rest.join(e, same & (F.col("s") == F.col("_sym"))).select(*out, "_gid", "_sym", "_key")
    by_id = rest.join(e, same & (F.col("g") == F.col("_gid")) & ~F.coalesce(F.col("s") == F.col("_sym"), F.lit(False))).select(*out, "_gid", "_sym", "_key")
    return by_key.unionByName(by_name.unionByName(by_id).select(*out))


def mean_expression(rows: DataFrame) -> DataFrame:
    """gene_key, comparison, mean_expr: mean of the group means of a gene in a comparison."""
    return rows.groupBy("gene_key", "comparison").agg(F.avg("expr").alias("mean_expr")).where("mean_expr is not null")


def gene_cards(selected: DataFrame, dominant: DataFrame, expression: DataFrame) -> DataFrame:
    """A card a gene and comparison: the candidate, its dominant event and its mean expression there.

    selected: candidates; dominant: rows of ``programs.dominant_event``; expression: rows of
    gene_id, gene_symbol, comparison, group, expr.
    """
    cards = selected.withColumn("gene_key", C.gene_lookup_key("gene_id", "gene_symbol")).where("gene_key <> ''")
    means = mean_expression(card_expression(cards.select("gene_key", "gene_id", "gene_symbol", "comparison"), expression))
    events = dominant.select("comparison", C.normalize_gene_id("gene_id").alias("_g"), F.col("event_uid").alias("dominant_event"), F.col("event_type").alias("dominant_type"), F.col("dpsi").alias("dominant_dpsi"))
    x = cards.withColumn("_g", C.normalize_gene_id("gene_id")).join(events, ["comparison", "_g"], "left").drop("_g")
    return x.join(means, ["gene_key", "comparison"], "left")


def card_rows(rows: DataFrame, gene_id: str, comparisons: Sequence[str]) -> DataFrame:
    """Rows of one gene in the comparisons of its card."""
    return rows.where((F.col("gene_id") == gene_id) & F.col("comparison").isin(list(comparisons)[:CARD_COMPARISONS]))


def isoform_followup(selected: DataFrame) -> DataFrame:
    """Selected candidates with the state of their transcript usage."""
    there = F.coalesce("dtu_sig", F.lit(False))
    text = lambda yes: F.when(there, F.lit(yes)).otherwise(F.lit("no DTU evidence"))
    return selected.select("comparison", "gene_symbol", "gene_id", "tier", "dtu_sig", text("DTU-supported transcript set").alias("transcript_id"), text("DTU-supported isoform set").alias("isoform_id"), text("DTU evidence available").alias("isoform_followup_status"))


def event_followup(selected: DataFrame, dominant: DataFrame) -> DataFrame:
    """Selected candidates with their dominant event."""
    events = dominant.select(F.col("comparison").alias("_c"), F.col("gene_id").alias("_g"), F.col("event_uid").alias("best_event"), F.col("event_type").alias("dominant_type"), F.col("dpsi").alias("dominant_dpsi"), F.col("fdr").alias("dominant_fdr"))
    x = selected.join(events, (F.col("comparison") == F.col("_c")) & (F.col("gene_id") == F.col("_g")), "left")
    return x.select("comparison", "gene_symbol", "gene_id", "tier", "evidence_class", "direction_class", "best_event", "dominant_type", "dominant_dpsi", "dominant_fdr", "log2fc", "reason")


def strength_counts(pairs: DataFrame) -> DataFrame:
    """class, n of the events of a pair that differ in direction or strength, or are on one side only."""
    return pairs.where(F.col("class").isin(STRENGTH_CLASSES)).groupBy("class").agg(F.count("event_uid").alias("n"))


def pattern_counts(matrix: DataFrame) -> DataFrame:
    """pattern, n of cross-comparison genes; a missing pattern is unclassified."""
    return matrix.groupBy(F.coalesce("pattern", F.lit("unclassified")).alias("pattern")).agg(F.count("*").alias("n"))


def membership_counts(matrix: DataFrame) -> DataFrame:
    """n_comparisons, n: genes by the number of comparisons in which they are candidates."""
    return matrix.where("n_comparisons is not null").groupBy(F.col("n_comparisons").cast("int").alias("n_comparisons")).agg(F.count("*").alias("n"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """value, n: how often each value of a column occurs, null included."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def condition_values(values: DataFrame, event_id: str, groups: Sequence[tuple[int, int]]) -> DataFrame:
    """cond, values of one event (id, values: an array) for a box plot; ``groups`` are ranges of columns, from 1."""
    parts = F.array(*[F.struct(F.lit(i).alias("cond"), F.slice("values", a, b - a + 1).alias("values")) for i, (a, b) in enumerate(groups, 1)])
    return values.where(F.col("id") == event_id).select(F.explode(parts).alias("x")).select("x.*")


def split_conditions(long: DataFrame, first: Sequence[str], second: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (id, sample, value) of the samples of two conditions; dashes in names stand for dots."""
    plain = lambda names: [n.replace("-", ".") for n in names]
    name = F.translate("sample", "-", ".")
    return tuple(long.where(name.isin(plain(names))) for names in (first, second))


def largest_changes(deg: DataFrame, n: int = 20) -> DataFrame:
    """The n genes with the largest absolute change, for a chart."""
    return deg.orderBy(F.abs("log2fc").desc_nulls_last(), "gene_id").limit(n)


def by_maximum(rows: DataFrame, columns: Sequence[str], absolute: bool = False) -> DataFrame:
    """Each column by its largest (absolute) value over all rows; where that is 0, as it is."""
    size = F.abs if absolute else F.col
    most = rows.agg(F.struct(*[F.max(size(c)).alias(c) for c in columns])).scalar()
    return rows.withColumns({c: F.when(most[c] > 0, F.col(c) / most[c]).otherwise(F.col(c)) for c in columns})


def evidence_matrix(candidates: DataFrame, n: int = 40) -> DataFrame:
    """gene_id, evidence, events, fc: the n genes with most evidence, each column by its largest value over all genes."""
    x = candidates.select("gene_id", F.col("evidence_count").cast("double").alias("evidence"), F.col("n_sig_events_all").cast("double").alias("events"), F.coalesce("abs_log2fc", F.lit(0.0)).alias("fc"))
    return by_maximum(x, ["evidence", "events", "fc"]).orderBy(F.desc("evidence"), F.desc("events"), F.desc("fc"), "gene_id").limit(n)


def largest_differences(pairs: DataFrame, n: int = 30) -> DataFrame:
    """gene_symbol, event_uid, delta: the event with the largest difference between two comparisons of each of the n genes with the largest ones."""
    x = pairs.where("abs_delta_between_programs is not null").select("gene_symbol", "event_uid", F.round("abs_delta_between_programs", 6).alias("delta"))
    top = x.groupBy("gene_symbol").agg(F.max("delta").alias("m")).orderBy(F.desc("m"), "gene_symbol").limit(n)
    w = Window.partitionBy("gene_symbol").orderBy(F.desc("delta"), "event_uid")
    return x.join(F.broadcast(top), "gene_symbol", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def volcano(deg: DataFrame, features: DataFrame) -> DataFrame:
    """comparison, gene_id, log2fc, bonferroni, score of genes in both tables: p times the number of rows, and -log10 of the best feature's q."""
    best = features.groupBy("comparison", "gene_id").agg(F.min("q").alias("q"))
    both = deg.join(best, ["comparison", "gene_id"])
    n = both.agg(F.count("*")).scalar()
    return both.select("comparison", "gene_id", "log2fc", F.least(F.col("padj") * n, F.lit(1.0)).alias("bonferroni"), (-F.log10(F.col("q") + 0.001)).alias("score"))
