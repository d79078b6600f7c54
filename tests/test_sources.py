"""Readers and writers on small hand-made files."""

import pytest
from pyspark.sql import functions as F

from isoframe import catalog, session
from isoframe.functions.thresholds import PRESETS
from isoframe.operators import programs as P
from isoframe.sources import models, sinks, tables, unified

SE_HEAD = "ID\tGeneID\tgeneSymbol\tchr\tstrand\texonStart_0base\texonEnd\tupstreamES\tupstreamEE\tdownstreamES\tdownstreamEE\tID\tIJC_SAMPLE_1\tSJC_SAMPLE_1\tIJC_SAMPLE_2\tSJC_SAMPLE_2\tIncFormLen\tSkipFormLen\tPValue\tFDR\tIncLevel1\tIncLevel2\tIncLevelDifference"
SE_ROWS = [
    '10054\t"ENSG00000067836"\t"ROGDI"\tchr16\t-\t4851267\t4851322\t4850498\t4850579\t4851503\t4851586\t10054\t857,112,161\t77,7,14\t772,101,142\t1,0,0\t77\t36\t0.0\t0.0\t0.839,0.882,0.843\t0.997,1.0,1.0\t-0.144',
    '2\t"ENSG2.4"\tNA\tchr1\t+\t10\t20\t1\t5\t30\t40\t2\t1\t2\t3\t4\t77\t36\t0.5\tNA\tNA\t0.5\tNA',
]
OTHER = {
    "RI": ["riExonStart_0base", "riExonEnd", "upstreamES", "upstreamEE", "downstreamES", "downstreamEE"],
    "MXE": ["1stExonStart_0base", "1stExonEnd", "2ndExonStart_0base", "2ndExonEnd", "upstreamES", "upstreamEE", "downstreamES", "downstreamEE"],
    "A3SS": ["longExonStart_0base", "longExonEnd", "shortES", "shortEE", "flankingES", "flankingEE"],
    "A5SS": ["longExonStart_0base", "longExonEnd", "shortES", "shortEE", "flankingES", "flankingEE"],
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name in ("t_vs_c", "u_vs_c"):
        folder = root / name / "rmats_post"
        folder.mkdir(parents=True)
        (folder / "SE.MATS.JC.txt").write_text("\n".join([SE_HEAD, *SE_ROWS]) + "\n")
        for kind, cols in OTHER.items():
            head = ["ID", "GeneID", "geneSymbol", "chr", "strand", *cols, "ID", "PValue", "FDR", "IncLevel1", "IncLevel2", "IncLevelDifference"]
            row = ["1", '"ENSG3.1"', '"G3"', "chr2", "+", *[str(10 * i) for i in range(len(cols))], "1", "0.001", "0.01", "0.9", "0.4", "0.5"]
            (folder / f"{kind}.MATS.JC.txt").write_text("\t".join(head) + "\n" + ("\t".join(row) + "\n" if kind != "MXE" else ""))
        (root / f"{name}.deseq2.results.tsv").write_text("gene_id\tbaseMean\tlog2FoldChange\tpadj\nENSG00000067836.5\t10\t2.5\t0.01\nENSG9\t1\tNA\tNA\n")
    return root


def test_events_of_all_types(spark, project):
    folder = f"file://{project}/t_vs_c/rmats_post"
    assert tables.event_modes(spark, folder) == ["JC"]
    rows = {r.event_uid: r for r in tables.read_events(spark, folder, "t_vs_c", flip=True).collect()}
    r = rows["SE|chr16|-|4851267|4851322|4850498|4850579|4851503|4851586"]
    assert (r.gene_id, r.gene_symbol, r.fdr, r.dpsi) == ("ENSG00000067836", "ROGDI", 0.0, 0.144)
    assert r.psi2 == pytest.approx(0.854667, abs=1e-6) and r["ID.1"] == "10054"
    other = rows["SE|chr1|+|10|20|1|5|30|40"]
    assert (other.gene_id, other.gene_symbol, other.fdr, other.dpsi) == ("ENSG2", None, None, None)
    assert "RI|chr2|+|20|30|40|50|0|10" in rows and len(rows) == 5
    assert tables.read_events(spark, f"file://{project}/nothing", "x") is None


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("gene_id\tpadj\na\t1\n")
    with pytest.raises(tables.MissingColumns, match="log2FoldChange"):
        tables.read_deg(spark, f"file://{tmp_path}/x.tsv", "c")


def test_scan_by_spark_equals_local_walk(spark, tmp_path):
    for f in ["a b/x_vs_y/rmats_post/SE.MATS.JC.txt", "x_vs_y.deseq2.results.tsv", "v_vs_w/RI.MATS.JCEC.txt", "Plots/no_vs_no/SE.MATS.JC.txt", "my_fastq/n.deseq2.results.tsv", "tmp/n_vs_m.deseq2.results.tsv", "report_card/z/SE.MATS.JC.txt", "u/notes.txt"]:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    local = sorted(catalog.scan(str(tmp_path)), key=lambda c: c.comparison_id)
    assert [(c.comparison_id, bool(c.event_folder), bool(c.deg_path)) for c in local] == [("v_vs_w", True, False), ("x_vs_y", True, True)]
    for root in (f"file://{tmp_path}", f"file://{tmp_path}/"):
        far = sorted(catalog.scan(root, spark), key=lambda c: c.comparison_id)
        assert [c.comparison_id for c in far] == ["v_vs_w", "x_vs_y"]
        assert [[(p or "").removeprefix("file:") for p in (c.event_folder, c.deg_path)] for c in far] == [[p or "" for p in (c.event_folder, c.deg_path)] for c in local]
    for session in (None, spark):
        assert [c.comparison_id for c in catalog.scan(str(tmp_path), session, ("v_vs_w",))] == ["x_vs_y"]
    (tmp_path / "empty").mkdir()
    assert catalog.scan(f"file://{tmp_path}/empty", spark) == []


def test_project_end_to_end(spark, project, tmp_path):
    found = catalog.scan(str(project))
    assert sorted(c.comparison_id for c in found) == ["t_vs_c", "u_vs_c"] and all(c.deg_path and c.event_folder for c in found)
    p = catalog.Project(tuple(sorted(found, key=lambda c: c.comparison_id)), pairs=(("t_vs_c", "u_vs_c"),))
    assert catalog.Project.from_json(p.to_json()) == p
    a = session.Analysis(spark, p, PRESETS["default"])
    counts = {(r.comparison, r.event_type): (r.n_total, r.n_sig) for r in a.splicing_landscape().collect()}
    assert counts["t_vs_c", "SE"] == (2, 1) and counts["t_vs_c", "RI"] == (1, 1) and counts["t_vs_c", "MXE"] == (None, None)
    events, summary = a.program_comparison()
    assert {r["class"] for r in events.collect()} == {"shared_same_direction", "neither"}
    assert {r.class_label: r.n_events for r in summary.collect()} == {"Shared same direction": 4, "Not significant in either": 1}
    ranked = {(r.comparison, r.gene_id): r for r in a.candidates().collect()}
    assert ranked["t_vs_c", "ENSG00000067836"].tier == "Tier 2" and ranked["t_vs_c", "ENSG3"].tier == "Tier 4"
    assert {r.gene_id: r.pattern for r in a.cross_matrix().collect()}["ENSG3"] == "shared_all"
    sinks.write_candidates(a.candidates(), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/candidates").count() == a.candidates().count()
    assert sinks.write_step({"a": summary, "b": summary.limit(0)}, f"file://{tmp_path}/s", "step") == ["a"]


def test_project_changes():
    c = [catalog.Comparison(f"{x}_vs_z", experiment=x, control="z") for x in "abc"]
    p = catalog.Project(tuple(c), pairs=(("a_vs_z", "b_vs_z"), ("b_vs_z", "c_vs_z")), groups={"g": ("a_vs_z",), "h": ("b_vs_z",)})
    q = p.remove("a_vs_z")
    assert q.pairs == (("b_vs_z", "c_vs_z"),) and q.groups == {"h": ("b_vs_z",)}
    assert [x.comparison_id for x in p.move("c_vs_z", -5).selected()] == ["c_vs_z", "a_vs_z", "b_vs_z"]
    with pytest.raises(ValueError, match="project"):
        p.confirm("pairing")
    assert p.confirm("project").confirm("pairing").confirm("sets").confirm("groups").ready()
    turned = catalog.Comparison("a_vs_z", experiment="a", control="z", reverse_splicing=True)
    assert turned.final_groups() == ("z", "a") and not turned.direction_consistent() and "mismatch" in turned.direction_label()
    merged = catalog.merge_aliases([catalog.Comparison("A vs B"), catalog.Comparison("a_vs_b", event_folder="f")])
    assert [(m.comparison_id, m.event_folder) for m in merged] == [("a_vs_b", "f")]
    assert catalog.consecutive_pairs(["a", "b", "c"]) == [("a", "b"), ("b", "c")] and len(catalog.consecutive_pairs(["a", "b", "c"], True)) == 3


def test_gene_models(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#c\nchr1\ts\texon\t10\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nchr1\ts\tCDS\t1\t2\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nchr1\ts\texon\t30\t40\t.\t+\t.\tgene_id "g1";\n')
    assert [tuple(r) for r in models.read_gtf_exons(spark, f"file://{tmp_path}/a.gtf").collect()] == [("g1", "chr1", "+", "t1", 10, 20)]
    (tmp_path / "a.gff3").write_text("##gff\nc\t.\tgene\t1\t99\t.\t+\t.\tID=g;Name=a%20b\nc\t.\tmRNA\t1\t99\t.\t+\t.\tID=t;Parent=g\nc\t.\texon\t5\t9\t.\t+\t.\tID=e;Parent=t;bad\nshort\tline\n")
    g = models.read_gff3(spark, f"file://{tmp_path}/a.gff3")
    assert {r.id: r.name for r in g.collect()} == {"g": "a b", "t": None, "e": None}
    assert [tuple(r) for r in models.gff_hierarchy(g).collect()] == [("g", "t", "exon", "c", "+", 5, 9)]
    (tmp_path / "x.ioe").write_text("seqname\tgene_id\tevent_id\talternative_transcripts\ttotal_transcripts\nc\tg\te1\ta\ta,b\nc\tg\te2\tz\ta,b\nc\tg\te3\t\ta\n")
    assert [r.event_id for r in models.read_ioe(spark, f"file://{tmp_path}/x.ioe").collect()] == ["e1"]
    (tmp_path / "psi.tsv").write_text("s1\ts2\ne1\t0.5\tNA\ne2\t1\t0\n")
    got = sorted((r.id, r.sample, r.value) for r in models.read_expression(spark, f"file://{tmp_path}/psi.tsv").collect() if r.value is not None)
    assert got == [("e1", "s1", 0.5), ("e2", "s1", 1.0), ("e2", "s2", 0.0)]
    with pytest.raises(ValueError):
        models.psi_groups("1-2,4-5")
    (tmp_path / "c.txt").write_text("ev1\t1;2;3;4;5;6\nev2\t1;2\n")
    assert [tuple(r) for r in models.read_event_counts(spark, f"file://{tmp_path}/c.txt", "SE").collect()] == [("ev1", "SE", 3, 7, 11)]
    with pytest.raises(ValueError):
        models.read_event_counts(spark, "x", "MXE")
    (tmp_path / "ev.miso").write_text("#iters=10\tburn=2\nsampled_psi\tlog_score\n0.1,0.9\t-5\n0.3,0.7\t-2\n")
    r = models.read_posterior(spark, f"file://{tmp_path}/ev.miso").first()
    assert r.map_psi == [0.3, 0.7] and r.header["iters"] == "10" and len(r.psi) == 2


def test_unified_event_table(spark, project, tmp_path):
    raw = tables.read_table(spark, f"file://{project}/t_vs_c/rmats_post/SE.MATS.JC.txt")
    rows = {r.FeatureID: r for r in unified.from_events(raw, "SE").collect()}
    assert rows["10054"].GeneName == "ROGDI" and rows["10054"].GroupID == "J00002" and rows["10054"].FeatureLabel == "chr16:4850579,4851267-4851322,4851503"
    assert rows["2"].GeneName == "ENSG2.4" and rows["10054"].counts1[0] == 857.0 and len(rows["10054"].psi) == 6
    sinks.write_unified(unified.from_events(raw, "SE"), f"file://{tmp_path}/u", "rmats", [])
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/u").collect()][0].startswith("# rmats")


def test_counts_and_annotation(spark, tmp_path):
    (tmp_path / "counts.tsv").write_text("gene_id\tA_1\tA_2\tB_1\ng.1\t1\t3\tNA\n")
    c = tables.read_counts(spark, f"file://{tmp_path}/counts.tsv")
    means = P.expression_means(c, c.select("sample", tables.group_of_sample("sample").alias("group")).distinct())
    assert {(r.gene_id, r.group): (r["mean"], r.n_samples) for r in means.collect()} == {("g", "A"): (2.0, 2), ("g", "B"): (None, 0)}
    (tmp_path / "anno.csv").write_text("GeneID,symbol\nENSG1.2,first\nENSG1.9,second\nENSG2,NA\n")
    assert [tuple(r) for r in tables.read_annotation(spark, f"file://{tmp_path}/anno.csv").collect()] == [("ENSG1", "first")]


def test_streaming_landscape_equals_batch(spark, tmp_path):
    from isoframe.streaming import landscape as stream

    events = spark.range(200).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("comparison"), F.lit("SE").alias("event_type"), F.lit("g").alias("gene_id"), F.lit("s").alias("gene_symbol"), (F.col("id") % 10 / 100.0).cast("double").alias("fdr"), F.lit(0.3).cast("double").alias("dpsi"), F.col("id").cast("string").alias("event_uid"))
    folder, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    for part in (events.where("event_uid < '5'"), events.where("event_uid >= '5'")):
        part.write.mode("append").parquet(folder)
        stream.follow(spark, folder, out, state, PRESETS["default"]).awaitTermination()
    got = {tuple(r) for r in stream.current(spark, out).select("comparison", "n_total", "n_sig").collect()}
    assert got == {tuple(r) for r in P.landscape(events, PRESETS["default"]).select("comparison", "n_total", "n_sig").collect()}
