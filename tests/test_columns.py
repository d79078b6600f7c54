"""Column functions on hand-made values, with nulls, NaN, quotes and limits."""

import pytest
from pyspark.sql import functions as F

from isoframe.functions import columns as C
from isoframe.functions import thresholds as T


def values(spark, expression, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_o int, {schema}")
    return [r[0] for r in df.select(expression.alias("x"), "_o").orderBy("_o").collect()]


@pytest.mark.parametrize("raw, clean", [('"ABC"', "ABC"), (" 'x' ", "x"), ("", None), (None, None), ("NaN", None), ('""', None), ("\"'q'\"", "q"), ("plain", "plain")])
def test_clean_text(spark, raw, clean):
    assert values(spark, C.clean_text("c"), [(raw,)], "c string") == [clean]


def test_normalize_gene_id(spark):
    raw = ["ENSG00000067836.12", "ensmusg0001.3", "ENSG00000067836", "LOC1.2", "a.b", '"ENSG01.1"', None, "nan", "x.1.2"]
    assert values(spark, C.normalize_gene_id("c"), [(r,) for r in raw], "c string") == ["ENSG00000067836", "ensmusg0001", "ENSG00000067836", "LOC1", "a.b", "ENSG01", None, None, "x.1"]


def test_event_uid_of_a_skipped_exon(spark):
    row = ("chr16", "-", "4851267", "4851322", "4850498", "4850579", "4851503", None)
    names = ["chr", "strand", "exonStart_0base", "exonEnd", "upstreamES", "upstreamEE", "downstreamES", "downstreamEE"]
    df = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))
    assert df.select(C.event_uid("SE", df.columns)).first()[0] == "SE|chr16|-|4851267|4851322|4850498|4850579|4851503|nan"
    assert df.select(C.coordinates_text(F.lit("SE"), ["exonEnd", "downstreamEE"])).first()[0] == "SE | exonEnd=4851322"


def test_inc_level_mean(spark):
    assert values(spark, C.inc_level_mean("c"), [("0.839,0.882,0.843",), ("NA,1.0, x",), ("NA",), ("",), (None,), ("nan,0.5",)], "c string") == [pytest.approx(0.854667, abs=1e-6), 1.0, None, None, None, 0.5]


def test_numbers_are_never_nan(spark):
    assert values(spark, C.number("c"), [("1e-3",), ("NA",), ("nan",), (None,), ("-inf",)], "c string") == [0.001, None, None, None, float("-inf")]


def test_names(spark):
    got = values(spark, C.split_comparison("c"), [("a_vs_b",), ("a-vs-b-c",), ("a vs b",), ("a-b",), ("ab",)], "c string")
    assert [tuple(g) for g in got] == [("a", "b"), ("a", "b-c"), ("a", "b"), ("a", "b"), (None, None)]
    assert values(spark, C.swapped_name("c"), [("a_vs_b",), ("ab",)], "c string") == ["b_vs_a", "ab"]
    assert values(spark, C.safe_name("c"), [(" a/b c_",)], "c string") == ["a_b_c"]
    assert values(spark, C.gene_lookup_key("a", "b"), [("ENSG1.2", "X"), (None, "TP53"), (None, None)], "a string, b string") == ["id:ENSG1", "sym:tp53", ""]


def test_pair_class(spark):
    cases = [
        (True, True, 0.3, 0.35, "shared_same_direction"), (True, True, 0.3, 0.9, "same_direction_large_delta"), (True, True, 0.3, -0.3, "opposite_direction"),
        (True, True, 0.0, 0.3, "shared_zero_direction"), (True, True, None, 0.3, "shared_unresolved"), (True, False, 0.3, None, "A_only"), (False, True, None, 0.1, "B_only"), (False, False, None, None, "neither"),
    ]
    got = values(spark, C.pair_class(F.col("a"), F.col("b"), F.col("x"), F.col("y"), 0.1), [c[:4] for c in cases], "a boolean, b boolean, x double, y double")
    assert got == [c[4] for c in cases]


def test_gene_direction(spark):
    cases = [
        (2.0, 0.3, True, True, "both_up_up", "concordant", "both"), (2.0, -0.3, True, True, "both_up_down", "discordant", "both"), (-2.0, 0.0, True, True, "both", "single_layer", "both"),
        (-2.0, None, True, False, "DE-only_down", "single_layer", "DE-only"), (None, 0.3, False, True, "AS-only_posPSI", "single_layer", "AS-only"), (None, None, False, False, "neither", "neither", "neither"),
    ]
    got = values(spark, C.gene_direction(F.col("f"), F.col("p"), F.col("a"), F.col("b")), [c[:4] for c in cases], "f double, p double, a boolean, b boolean")
    assert [tuple(g) for g in got] == [c[4:] for c in cases]


def test_tiers(spark):
    cases = {(True, True, True): "Tier 1", (True, True, False): "Tier 2", (False, True, True): "Tier 3", (False, True, False): "Tier 4", (True, False, False): "Tier 5", (True, False, True): "Unclassified", (False, False, True): "Unclassified"}
    assert values(spark, C.candidate_tier(F.col("a"), F.col("b"), F.col("c")), list(cases), "a boolean, b boolean, c boolean") == list(cases.values())


def test_predicates_differ_at_the_limits(spark):
    t, rows, schema = T.PRESETS["default"], [(0.05, 0.10), (0.049, 0.10), (None, 0.5), (0.01, None)], "q double, e double"
    assert values(spark, T.event_significant("q", "e", t), rows, schema) == [False, True, False, False]
    assert values(spark, T.integration_significant("q", "e", t), rows, schema) == [False, False, False, False]
    assert values(spark, T.summary_significant("q", "e", t), rows, schema) == [True, True, False, False]
    assert values(spark, T.deg_significant("q", "e", t), [(0.05, -1.5), (0.05, 1.0), (None, 2.0)], schema) == [True, False, False]


def test_small_helpers(spark):
    assert values(spark, C.gene_tokens("c"), [("TP53, tp53;A|b\tB  a",)], "c string") == [["TP53", "A", "b"]]
    assert values(spark, C.cigar_end(F.lit(100), "c"), [("30M100N20M",), ("10M5I35M",), ("5S45M",)], "c string") == [249, 144, 144]
    assert [tuple(x) for x in values(spark, C.read_counts("c"), [("(1,0):3,(1,1):4",), ("",)], "c string")] == [(3, 0, 4), (0, 0, 0)]
    assert values(spark, C.capped_bayes_factor("c"), [("5.5,2",), ("inf",), ("x",)], "c string") == [5.5, 1e12, None]
    assert values(spark, C.log_score("c"), [(0.01,), (0.0,), (None,)], "c double") == [2.0, 300.0, 0.0]
    assert values(spark, C.suppa_genes("c"), [("a_and_b;SE:chr1",)], "c string") == [["a", "b"]]
    assert values(spark, C.first_names("c"), [("a,b,c,d",)], "c string") == ["a,b,c"]
