"""Selections, catalogs, cards and the project's lists."""

import pytest
from pyspark.sql import functions as F

from isoframe import catalog, session
from isoframe.operators import matrices as M
from isoframe.operators import selection as L
from isoframe.sources import models, sinks, tables


@pytest.fixture
def ranked(spark):
    rows = [("A", "ENSG1", "Abc", "Tier 1", "DEG", "up", 1.0, 0.5, True, True, "r", 2), ("A", "ENSG2", "Def", "Tier 2", "rMATS", "down", None, -0.3, False, False, None, 1), ("A", "ENSG3", None, "Tier 3", "DEG", "up", 2.0, None, None, None, "r", 3), ("B", "ENSG1", "Abc", "Unclassified", "DEG", "up", 0.0, 0.0, True, False, "r", None)]
    return spark.createDataFrame(rows, "comparison string, gene_id string, gene_symbol string, tier string, evidence_class string, direction_class string, log2fc double, representative_dpsi double, dtu_sig boolean, shortlisted boolean, reason string, rank long")


def ids(df):
    return sorted((r.comparison, r.gene_id) for r in df.collect())


def test_filters_with_nulls_and_empty_texts(ranked):
    assert len(ids(L.filter_candidates(ranked))) == 2  # no effect, no pass
    assert ids(L.filter_candidates(ranked, query="ABC", min_abs_dpsi=0.1)) == [("A", "ENSG1")]
    assert L.with_value(ranked, "comparison", "").count() == 4 and L.with_value(ranked, "comparison", "B").count() == 1
    assert L.search_table(ranked.limit(0), {}, "x", ["gene_symbol"], ["rank"]).count() == 0
    assert [r.value for r in L.distinct_values(ranked, "gene_symbol").collect()] == ["Abc", "Def"]


def test_selection_sources(spark, ranked):
    assert ids(L.select_candidates(ranked, "selection", 1)) == [("A", "ENSG2"), ("B", "ENSG1")]
    assert ids(L.select_candidates(ranked, "tier1")) == [("A", "ENSG1")] and len(ids(L.select_candidates(ranked, "all", 0))) == 4
    assert ids(L.select_candidates(ranked, "shortlist")) == [("A", "ENSG1")] and L.select_candidates(ranked, "custom").count() == 0
    genes = spark.createDataFrame([("A", "abc"), ("A", "ABC"), ("A", "ensg3"), ("A", "new"), ("B", " "), ("C", "abc")], "comparison string, gene string")
    got = {(r.comparison, r.gene_id): r.tier for r in L.select_candidates(ranked, "custom", genes=genes).collect()}
    assert got == {("A", "ENSG1"): "Tier 1", ("A", "ENSG3"): "Tier 3", ("A", "new"): "Unclassified", ("C", "abc"): "Unclassified"}
    listed = spark.createDataFrame([("A", "Abc"), ("A", "ENSG3"), ("B", None)], "comparison string, gene string")
    assert ids(L.without_blacklist(ranked, listed)) == [("A", "ENSG2"), ("B", "ENSG1")]


def test_cards_take_expression_by_key_then_by_name(spark, ranked):
    e = spark.createDataFrame([("ENSG1.2", "zzz", "A", "g1", 2.0), ("ENSG1", None, "A", "g2", 4.0), (None, " def ", "A", "g1", 7.0), ("ENSG9", "Abc", "B", "g1", 5.0)], "gene_id string, gene_symbol string, comparison string, group string, expr double")
    events = spark.createDataFrame([("A", "ENSG1.7", "SE", "u1", 0.4, 0.01)], "comparison string, gene_id string, event_type string, event_uid string, dpsi double, fdr double")
    got = {(r.comparison, r.gene_id): (r.mean_expr, r.dominant_event) for r in L.gene_cards(ranked, events, e).collect()}
    assert got == {("A", "ENSG1"): (3.0, "u1"), ("A", "ENSG2"): (7.0, None), ("A", "ENSG3"): (None, None), ("B", "ENSG1"): (5.0, None)}
    assert L.card_rows(ranked, "ENSG1", ["B"]).count() == 1
    assert {r.gene_id: r.isoform_followup_status for r in L.isoform_followup(ranked.where("comparison = 'A'")).collect()}["ENSG3"] == "no DTU evidence"


def test_lists_pairs_and_groups_of_a_project(spark):
    p = catalog.Project(tuple(catalog.Comparison(f"{x}_vs_z", experiment=x, control="z") for x in "abcde"), confirmed=catalog.Project.STEPS)
    q = p.add_pair()
    assert q.pairs == (("a_vs_z", "b_vs_z"),) and q.confirmed == ("project", "pairing") and q.pair_groups(0) == ("a", "b")
    q = q.update_pair(0, b="c_vs_z")
    assert q.pair_name(0) == "a_vs_z vs c_vs_z" and q.remove_pair(0).pairs == () and "ready" in q.report()[-1]
    g = q.add_group()
    assert g.groups == {"viz_1": ("a_vs_z", "b_vs_z", "c_vs_z", "d_vs_z")} and g.update_group("viz_1", ["e_vs_z", "nope"]).groups == {"viz_1": ("e_vs_z",)}
    assert g.remove_group("viz_1").groups == {}
    c = p.choose("a_vs_z", " Abc ").choose("a_vs_z", "ABC").choose("a_vs_z", "")
    assert c.chosen == {"a_vs_z": ("Abc",)}
    c = c.leave_out("a_vs_z", "abc")
    assert c.chosen == {"a_vs_z": ()} and c.left_out == {"a_vs_z": ("abc",)} and c.choose("a_vs_z", "Abc") == c
    assert c.let_in("a_vs_z", "ABC").left_out == {"a_vs_z": ()} and c.reset_choice("a_vs_z", ["x", "X", None, "y"]).chosen["a_vs_z"] == ("x", "y")
    assert catalog.Project.from_json(c.to_json()) == c and c.genes_frame(spark, "left_out").count() == 1
    assert p.context("a_vs_z") == "a_vs_z | a vs z"
    log = catalog.RunLog()
    log.mark("isoform", "ok", "done", from_cache=True)
    assert log.state("isoform")["status"] == "ok" and log.state("other")["status"] == "not_run" and log.frame(spark).where("from_cache").count() == 1
    assert catalog.isoform_problems(spark.createDataFrame([("a",), (" ",)], "condition string")) == ["samples without a condition"]
    assert catalog.isoform_problems(spark.createDataFrame([("a",), ("b",)], "condition string")) == []


def test_small_readers_and_files(spark, tmp_path, ranked):
    (tmp_path / "m.tsv").write_text("s1\tc1\tx\ns2\tc2\nbad\n")
    assert [tuple(r) for r in tables.read_sample_conditions(spark, f"file://{tmp_path}/m.tsv").collect()] == [("s1", "c1"), ("s2", "c2")]
    (tmp_path / "g.txt").write_text("a\nb\n")
    assert [r.gene for r in tables.read_gene_list(spark, f"file://{tmp_path}/g.txt").collect()] == ["a", "b"]
    (tmp_path / "h.txt").write_text("a b\n")
    with pytest.raises(ValueError, match="a b"):
        tables.read_gene_list(spark, f"file://{tmp_path}/h.txt")
    (tmp_path / "d.tsv").write_text("gene\tpadj\n")
    assert tables.missing_columns(spark, f"file://{tmp_path}/d.tsv", "deg") == [f"file://{tmp_path}/d.tsv: no column log2FoldChange"]
    (tmp_path / "x.fa").write_text(">hg38_ncbiRefS_N1 range=chr1:5-9 more\nACGT\n>hg38_ncbiRefS_N1 range=chr2:5-9\nAC\n>hg38_ncbiRefS_N2 range=chrUn:1-2\nGG\n")
    kept, others = models.fasta_headers(spark, f"file://{tmp_path}/x.fa")
    assert [(r.rest) for r in kept.collect()] == ["range=chr1:5-9 more"] and others.count() == 2
    assert spark.createDataFrame([("a|b|c",), ("a",)], "n string").select(models.second_token("n").alias("x")).collect()[0].x == "b"
    models.write_summaries(spark.createDataFrame([("e1", 0.5), ("e2", 0.7), ("e1", 0.6)], "event_name string, psi double"), f"file://{tmp_path}/sum")
    assert sorted(r.psi for r in models.read_summary(spark, f"file://{tmp_path}/sum", "e1").collect()) == [0.5, 0.6]
    sinks.write_selection(ranked, f"file://{tmp_path}/out", "A", "heatmap", {"source": "tier1"})
    files = tables.output_files(spark, f"file://{tmp_path}/out")
    assert tables.browse(files, "heatmap").count() == files.count() > 0 and tables.browse(files, "pca").count() == 0
    first, second = L.split_conditions(spark.createDataFrame([("e", "s-1", 1.0), ("e", "s.2", 2.0)], "id string, sample string, value double"), ["s.1"], ["s-2"])
    assert first.count() == second.count() == 1


def test_components_of_samples_with_gaps(spark):
    x = [("f1", "a", 1.0), ("f1", "b", 2.0), ("f1", "c", 6.0), ("f2", "c", 1.0), ("f2", "a", 3.0)]
    got = {(r["sample"], r.pc): r.score for r in M.principal_components(spark.createDataFrame(x, "feature string, sample string, value double"), 2).collect()}
    gram = [[4 + 1, 2, -6 - 1], [2, 1, -3], [-6 - 1, -3, 9 + 1]]
    import numpy as np

    values, vectors = np.linalg.eigh(np.array(gram, float))
    want = vectors[:, 2] * np.sqrt(values[2])
    assert np.allclose(np.abs([got[s, 1] for s in "abc"]), np.abs(want))


def test_support_layers_are_read_from_folders(spark, tmp_path):
    (tmp_path / "perGeneQValue.a-z.csv").write_text("groupID,featureID,padj\nENSG1.2,E1,0.001\nENSG1.2,E2,0.9\n")
    (tmp_path / "getAdjustedPValues.a_vs_z.tsv").write_text("geneID\ttxID\tgene\ttranscript\nENSG2\tT1\t0.01\t0.001\n")
    (tmp_path / "x_a_vs_z.dpsi").write_text("d\tp\nENSG3;SE:chr1:1\t0.5\t0.001\n")
    a = session.Analysis(spark, catalog.Project((catalog.Comparison("a_vs_z"),)), support={n: f"file://{tmp_path}" for n in ("suppa", "exons", "transcripts")})
    got = {r.gene_id: (r.support_SUPPA, r.support_DEXSeq, r.support_DTU) for r in a.mechanism_support().select("gene_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support_SUPPA", "support_DEXSeq", "support_DTU")]).collect()}
    assert got == {"ENSG1": (0, 1, 0), "ENSG2": (0, 0, 1), "ENSG3": (1, 0, 0)}
    assert a.select_candidates("all", 0).count() >= 0 and a.event_catalog().count() == 0
