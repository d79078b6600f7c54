"""Operators on small hand-made cases that the stand-in tables don't hold."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from isoframe.functions.thresholds import PRESETS, Thresholds
from isoframe.operators import matrices as M
from isoframe.operators import programs as P
from isoframe.operators import reads as R
from isoframe.operators import splice as S

EV = "comparison string, event_type string, gene_id string, gene_symbol string, fdr double, dpsi double, event_uid string"
T = PRESETS["default"]


def test_missing_side_and_zero_direction(spark):
    rows = [("A", "SE", "g", "s", 0.01, 0.0, "u"), ("B", "SE", "g", "s", 0.01, 0.3, "u"), ("A", "RI", "g", None, None, None, "v")]
    zero = Thresholds(splicing_dpsi=0.0)
    got = {r.event_uid: r["class"] for r in P.compare_pair(spark.createDataFrame(rows, EV), "A", "B", zero).collect()}
    assert got == {"u": "shared_zero_direction", "v": "neither"}
    one = P.compare_pair(spark.createDataFrame(rows[:1], EV), "A", "B", T).first()
    assert one.dpsi_B is None and one.is_sig_B is False


def test_gene_with_tied_events(spark):
    rows = [("A", "SE", "g", "s", 0.01, 0.5, "u2"), ("A", "RI", "g", "s", 0.01, -0.5, "u1"), ("A", "RI", "g", "s", 0.04, -0.5, "u0"), ("A", "SE", "h", "t", 0.5, 0.9, "u3"), ("A", "SE", None, "x", 0.01, 0.5, "u4")]
    deg = spark.createDataFrame([("A", "g", 2.0, 0.2), ("A", "g", 1.5, 0.01), ("A", "k", -3.0, 0.01)], "comparison string, gene_id string, log2fc double, padj double")
    got = {r.gene_id: r for r in P.gene_integration(spark.createDataFrame(rows, EV), deg, T).collect()}
    assert set(got) == {"g", "h", "k"}
    assert (got["g"].representative_event_id, got["g"].sig_event_types, got["g"].n_sig_events_all, got["g"].log2fc) == ("u1", "RI;SE", 3, 1.5)
    assert got["g"].direction_class == "both_up_down" and got["h"].direction_class == "neither" and got["k"].direction_class == "DE-only_down"


def test_dominant_event_falls_back_to_all(spark):
    rows = [("A", "SE", "g", "s", 0.9, 0.2, "u1"), ("A", "SE", "g", "s", 0.8, -0.7, "u2"), ("A", "SE", "h", "s", 0.01, 0.2, "u3"), ("A", "SE", "h", "s", 0.9, 0.9, "u4")]
    assert {r.gene_id: r.event_uid for r in P.dominant_event(spark.createDataFrame(rows, EV), T).collect()} == {"g": "u2", "h": "u3"}


EX = "gene string, chr string, strand string, tx string, start long, end long"


def exons(spark, **txs):
    return spark.createDataFrame([("g", "1", "+", t, s, e) for t, xs in txs.items() for s, e in xs], EX)


def ids(df):
    return {r.event_id: (r.alternative, r.total) for r in df.collect()}


def test_events_by_hand(spark):
    a, b = [(1, 10), (20, 30), (40, 50)], [(1, 10), (40, 50)]
    assert ids(S.skipped_exons(exons(spark, a=a, b=b))) == {"g;SE:1:10-20:30-40:+": (["a"], ["a", "b"])}
    assert ids(S.retained_introns(exons(spark, a=[(1, 10), (20, 30)], b=[(1, 30)]))) == {"g;RI:1:1:10-20:30:+": (["b"], ["a", "b"])}
    assert ids(S.exclusive_exons(exons(spark, a=[(1, 10), (20, 30), (60, 70)], b=[(1, 10), (40, 50), (60, 70)]))) == {"g;MX:1:10-20:30-60:10-40:50-60:+": (["a"], ["a", "b"])}
    assert ids(S.alternative_sites(exons(spark, a=[(1, 15), (20, 30)], b=[(1, 10), (20, 30)]))) == {"g;A5:1:15-20:10-20:+": (["a"], ["a", "b"])}
    assert ids(S.alternative_ends(exons(spark, a=[(1, 5), (20, 30)], b=[(8, 12), (20, 30)]))) == {"g;AF:1:1:5-20:8:12-20:+": (["a"], ["a", "b"])}
    assert S.all_events(exons(spark, a=[(1, 5)])).count() == 0


def test_psi_of_missing_and_silent_transcripts(spark):
    events = spark.createDataFrame([("e", ["a"], ["a", "b"]), ("f", ["a"], ["a", "z"])], "event_id string, alternative array<string>, total array<string>")
    tpm = spark.createDataFrame([("a", "s1", 1.0), ("b", "s1", 3.0), ("a", "s2", 0.0), ("b", "s2", 0.0)], "tx string, sample string, tpm double")
    got = {(r.event_id, r.sample): r.psi for r in S.event_psi(events, tpm).collect()}
    assert got == {("e", "s1"): 0.25, ("e", "s2"): None, ("f", "s1"): None, ("f", "s2"): None}


def test_bh_and_rank_test(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "event_id string, p double")
    got = {r.event_id: r.fdr for r in S.bh(p).collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == pytest.approx(0.04) and got["c"] == pytest.approx(0.04) and got["d"] is None
    x = spark.createDataFrame([("e", c, float(v)) for c, v in [("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 5), ("y", 6), ("y", 7), ("y", 8)]] + [("f", "x", 1.0)], "event_id string, cond string, psi double")
    got = {r.event_id: r.p for r in S.mann_whitney(x).collect()}
    assert got["e"] == pytest.approx(2 / 70) and got["f"] == 1.0  # exact: the most extreme of 70 choices of ranks, on either side
    tied = spark.createDataFrame([("e", c, float(v)) for c, v in [("x", 1), ("x", 2), ("x", 2), ("x", 4), ("y", 5), ("y", 6), ("y", 7), ("y", 8)]] + [("e", "x", None), ("e", "y", float("nan"))], "event_id string, cond string, psi double")
    assert S.mann_whitney(tied).first().p == pytest.approx(0.0294, abs=1e-3)
    assert S.rank_sum_ways(2, 2) == [1, 1, 2, 1, 1] and sum(S.rank_sum_ways(3, 5)) == 56
    for n1, n2 in ((1, 4), (3, 5), (5, 3), (4, 4)):  # all choices of ranks
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
        assert S.rank_sum_ways(n1, n2) == [us.count(u) for u in range(n1 * n2 + 1)]
    uneven = spark.range(10_003).selectExpr("'e' AS event_id", "if(id < 3, 'y', 'x') AS cond", "CAST(id AS double) AS psi")  # the three least of 10,003
    assert S.mann_whitney(uneven).first().p == pytest.approx(2 / math.comb(10_003, 3))


def test_signed_rank(spark):
    pairs = [("up", 0.0, 0.1 * i) for i in range(1, 6)] + [("same", 1.0, 1.0)] * 3 + [("mixed", 0.0, v) for v in (0.1, -0.2, 0.3, -0.4)] + [("none", None, 1.0), ("tied", 0.0, 0.5), ("tied", 0.0, 0.5), ("tied", 0.0, -0.5)]
    got = {r.event_id: r.p for r in S.wilcoxon_pairs(spark.createDataFrame(pairs, "event_id string, psi1 double, psi2 double")).collect()}
    # exact: all five of one sign is one of 32 ways on either side; ranks 1 and 3 against 2 and 4 give W = 4 of 0..10
    assert got["up"] == pytest.approx(2 / 32) and got["same"] == 1.0 and got["mixed"] == pytest.approx(2 * 7 / 16) and "none" not in got
    assert 0.3 < got["tied"] < 1


def test_empirical_p_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    deltas = [(f"r{i}", "c", "a", "b", rng.random(), round(rng.random() * 3, 2)) for i in range(300)]
    events = [(f"e{i}", rng.uniform(-1, 1), round(rng.random() * 3, 2)) for i in range(60)]
    got = {r.event_id: r.p for r in S.empirical_p(spark.createDataFrame(events, "event_id string, dpsi double, abundance double"), spark.createDataFrame(deltas, "event_id string, cond string, s1 string, s2 string, delta double, abundance double"), 50).collect()}
    rows = sorted((d[5], d[4], d[0], d[1], d[2], d[3]) for d in deltas)
    for e, dpsi, ab in events:
        near = min({r[0] for r in rows}, key=lambda v: (abs(v - ab), v))
        at = next(i for i, r in enumerate(rows) if r[0] == near)
        a = max(0, min(at - 25, 250))
        local = [r[1] for r in rows[a : a + 50]]
        assert got[e] == pytest.approx((1 - sum(v <= abs(dpsi) for v in local) / 50) * 0.5)


def test_coverage_and_mates(spark):
    reads = spark.createDataFrame([("s", 10, "5M10N5M"), ("s", 12, "5M")], "sample string, pos long, cigar string")
    depth = {r.pos: r.depth for r in R.coverage(reads, ["sample"]).collect()}
    assert depth == {10: 1, 12: 2, 15: 1, 17: 0, 25: 1, 30: 0}
    assert [tuple(r) for r in R.junction_counts(reads, ["sample"]).collect()] == [("s", 14, 25, 1)]
    mates = spark.createDataFrame([("r/1", 0, 10, "5M"), ("r/2", 16, 50, "5M"), ("q", 0, 1, "5M")], "qname string, flag int, pos long, cigar string")
    assert R.paired_mates(mates.withColumn("qname", F.when(F.col("qname") != "q", F.concat(F.lit("xx"), "qname")).otherwise("q"))).select("left", "right", "length").collect() == [(10, 54, 45)]


def test_mates_by_the_first_strand_rule(spark):
    rows = [("a", 0, 10, "5M"), ("a", 16, 50, "5M"), ("b", 16, 10, "5M"), ("b", 0, 50, "5M"), ("c", 0, 1, "5M"), ("c", 0, 9, "5M"), ("d", 0, 1, "5M")]
    mates = spark.createDataFrame(rows, "qname string, flag int, pos long, cigar string")
    plain = sorted(tuple(r) for r in R.paired_mates(mates).collect())
    assert plain == [("a", 10, 54, 45), ("b", 10, 54, 45)]
    stranded = R.paired_mates(mates, "fr-firststrand")
    assert sorted(tuple(r) for r in stranded.collect()) == [("a", 10, 54, 45), ("b", 50, 14, -35)]
    one = R.insert_lengths(stranded).first()
    assert (one["n"], one["least"], one["most"], one["mean"]) == (1, 45, 45, 45.0)
    with pytest.raises(ValueError, match="strand rule"):
        R.paired_mates(mates, "other")


def test_insert_lengths_without_pairs_and_junctions_of_several_files(spark):
    none = R.insert_lengths(spark.createDataFrame([(0,), (-3,)], "length long")).first()
    assert none["n"] == 0 and none["least"] is None and none["mean"] is None
    counts = [("f1", 1, 9, 2), ("f2", 1, 9, 3), ("f1", 1, 5, 4), ("f1", 3, 9, 1), ("f2", 3, 9, 2), ("f3", 3, 9, 9)]
    junctions = spark.createDataFrame(counts, "file string, donor long, acceptor long, n long")
    assert sorted(tuple(r) for r in R.overlaid_junctions(junctions, []).collect()) == [(1, 5, 4), (1, 9, 2), (3, 9, 4)]
    assert sorted(tuple(r) for r in R.overlaid_junctions(junctions, [], "median").collect()) == [(1, 5, 4), (1, 9, 2), (3, 9, 2)]


def test_differential_splicing_in_one_call(spark):
    rows = [(f"g{e // 2};e{e}", f"{c}{i}", c, None if e == 5 and c == "b" and i == 1 else ((e * 7 + i * 3 + "abc".index(c) * 11) % 20) / 20) for e in range(6) for c in "abc" for i in range(3)]
    psi = spark.createDataFrame(rows, "event_id string, sample string, cond string, psi double")
    events = spark.createDataFrame([(f"g{e // 2};e{e}", [f"t{e}"]) for e in range(6)], "event_id string, total array<string>")
    tpm = spark.createDataFrame([(f"t{e}", f"{c}{i}", 5.0 + e + i) for e in range(6) for c in "abc" for i in range(3)], "tx string, sample string, tpm double")
    found = {(r.cond1, r.cond2, r.event_id): (r.dpsi, r.p) for r in S.diff_splice(psi, ["a", "b", "c"], events, tpm, area=10).collect()}
    assert len(found) == 12 and {k[:2] for k in found} == {("a", "b"), ("b", "c")}
    assert found["a", "b", "g2;e5"] == found["b", "c", "g2;e5"] == (None, 1.0)
    ab = S.event_abundance(events, tpm, psi.where("cond <> 'c'").select("sample", "cond").distinct())
    part = psi.where("cond <> 'c'")
    alone = S.empirical_p(S.delta_psi(part, "a", "b").where("dpsi is not null").join(ab, "event_id"), S.replicate_deltas(part, ab), 10)
    assert {r.event_id: r.p for r in alone.collect()} == {k[2]: v[1] for k, v in found.items() if k[:2] == ("a", "b") and v[0] is not None}
    pairs = S.diff_splice(psi, ["a", "b", "c"], method="classical", paired=True, by_gene=True, every_pair=True)
    assert pairs.count() == 18 and pairs.where("p is null or p > 1 or p <= 0").count() == 0
    for wrong in (["a"], ["a", "b"]):
        with pytest.raises(ValueError):
            S.diff_splice(psi, wrong, method="classical" if len(wrong) == 1 else "empirical")


def test_principal_components(spark):
    rows = [(f"f{i}", s, float(v)) for i in range(20) for s, v in (("a", i), ("b", i + 1), ("c", i + 10 + i % 3))]
    out = M.principal_components(spark.createDataFrame(rows, "feature string, sample string, value double"), 2).collect()
    share = {r.pc: r.explained for r in out}
    assert share[1] > 0.95 and abs(sum(r.score for r in out if r.pc == 1)) < 1e-9


def test_event_ids(spark):
    from isoframe.functions import event_ids as E

    row = dict(chr="chr16", strand="-", exonStart_0base=4851267, exonEnd=4851322, upstreamES=4850498, upstreamEE=4850579, downstreamES=4851503, downstreamEE=4851586, longExonStart_0base=10, longExonEnd=30, shortES=10, shortEE=20, flankingES=40, flankingEE=50)
    df = spark.createDataFrame([row])
    got = df.select(E.local_event_id("SE", F.lit("g")).alias("se"), E.local_event_id("A5SS", F.lit("g")).alias("a5"), E.local_event_id("A3SS", F.lit("g")).alias("a3"), E.joined_exons_id("SE").alias("at")).first()
    assert got.se == "g;SE:chr16:4850579-4851268:4851322-4851504:-"
    assert got.a5 == "g;A5:chr16:50-11:50-11:-" and got.a3 == "g;A3:chr16:30-41:20-41:-"
    assert got["at"] == "chr16_4851504_4851586_-@chr16_4851268_4851322_-@chr16_4850499_4850579_-"
    assert [(r.isoform, r.start, r.end) for r in E.isoform_rows(df, "SE").collect()] == [("A", 4850499, 4850579), ("A", 4851268, 4851322), ("A", 4851504, 4851586), ("B", 4850499, 4850579), ("B", 4851504, 4851586)]
    labels = ["chr1:5,10-20,30", "chr1:1-5:30-40", "chr1:5,10-20:22-28,30", "chr1:1-9:1-5,20", "chr1:5,10-20:12-20", "x"]
    found = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string").orderBy("i").select(E.junctions_of_label(F.col("l"))).collect()]
    flat = [f and ([tuple(x) for x in f.inclusion], [tuple(x) for x in f.exclusion]) for f in found]
    assert flat == [([(5, 10), (20, 30)], [(5, 30)]), ([(5, 30)], []), ([(5, 10), (20, 30)], [(5, 22), (28, 30)]), ([(9, 20)], [(5, 20)]), ([(5, 10)], [(5, 12)]), None]
    with pytest.raises(ValueError):
        E.two_isoform_model("ALE", F.array(F.lit(1)))


def test_isoform_fits(spark):
    exons = spark.createDataFrame([("g", "i1", 1, 10), ("g", "i1", 21, 30), ("g", "i1", 41, 50), ("g", "i2", 1, 10), ("g", "i2", 41, 50)], "gene string, isoform string, start long, end long")
    reads = spark.createDataFrame([("g", "a", 6, "5M10N5M"), ("g", "b", 6, "5M30N5M"), ("g", "c", 2, "5M"), ("g", "d", 8, "5M")], "gene string, read string, pos long, cigar string")
    out = R.isoform_fits(reads, exons)
    assert {(r.read, r.isoform): r.ok for r in out.collect()} == {("a", "i1"): True, ("a", "i2"): False, ("b", "i1"): False, ("b", "i2"): True, ("c", "i1"): True, ("c", "i2"): True, ("d", "i1"): False, ("d", "i2"): False}
    assert {tuple(r.fits): r.n for r in R.read_classes(out).collect()} == {(1, 0): 1, (0, 1): 1, (1, 1): 1, (0, 0): 1}
    seg = spark.createDataFrame([("g", 0, 10, True), ("g", 10, 110, False), ("g", 110, 120, True)], "gene string, start long, end long, exonic boolean")
    assert [r.x for r in R.plot_scale(seg, ["gene"], 1.0, 10.0).orderBy("start").collect()] == [0.0, 10.0, 20.0]


def test_manifest_shuffles_no_lists(spark):
    events = spark.createDataFrame([("e1", "SE", "x"), ("e2", "RI", "y")], "event_uid string, event_type string, gene_symbol string")
    targets = events.selectExpr("event_uid", "'A' as comparison", "'g1' as experiment", "if(event_uid = 'e1', 'g2', 'g9') as control")
    bams = spark.createDataFrame([(f"g{i % 3}", f"s{i:03d}.bam") for i in range(300)], "group string, bam string")
    lists = {f"g{k}": ",".join(f"s{i:03d}.bam" for i in range(k, 300, 3)) for k in range(3)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = P.manifest(events, targets, bams)
        rows = {r.event_uid: (r.experiment_bams, r.control_bams) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {"e1": (lists["g1"], lists["g2"]), "e2": (lists["g1"], None)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("BroadcastHashJoin") == 2  # one a side; events and targets meet in a shuffle, without lists


def test_skipped_exon_sums_equal_those_of_lists(spark):
    rng = random.Random(11)
    exons = [("g1", "c", "+", f"t{t}", s * 100 + rng.choice([0, 10]), s * 100 + rng.choice([50, 60])) for t in range(40) for s in range(5) if rng.random() < 0.7]
    # both: t90 has the chain and the junction around it, as its exons overlap; t91 has no expression
    exons += [("g2", "c", "-", "t90", a, b) for a, b in ((0, 250), (50, 250), (400, 500))] + [("g2", "c", "-", "t92", a, b) for a, b in ((0, 250), (400, 450))]
    exons += [("g3", "c", "+", t, a, b) for t in ("t91", "t93") for a, b in ((0, 10), (20, 30), (40, 50))] + [("g3", "c", "+", "t94", a, b) for a, b in ((0, 10), (40, 50))]
    df = spark.createDataFrame(exons, "gene string, chr string, strand string, tx string, start long, end long")
    names = [f"s{i:02d}" for i in range(20)]  # more than the columns of a row
    tpm = [(f"t{t}", n, float(rng.choice([0, 1, 3, 8]))) for t in [*range(40), 90, 92, 93, 94] for n in names if t != 94 or n == "s01"] + [("t90", "s19", None)]
    expression = spark.createDataFrame(tpm, "tx string, sample string, tpm double")
    got, want = S.skipped_exon_sums(df, expression), S.event_sums(S.skipped_exons(df), expression)
    rows = lambda x: sorted(map(tuple, x.select("event_id", "sample", F.coalesce("a", F.lit(0.0)), "t").collect()), key=str)
    assert rows(got) == rows(want) and {r.sample for r in got.collect()} == {*names, None}
    assert any(r.event_id.startswith("g2") for r in got.collect())
    levels = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert levels(S.inclusion(got)) == levels(S.event_psi(S.skipped_exons(df), expression))
