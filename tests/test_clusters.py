"""Density clusters, silhouettes, merges and posterior samples beside plain forms of them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoframe.operators import clusters as K
from isoframe.operators import posterior as B
from isoframe.operators import reads as R

PLAIN = {
    "euclidean": lambda a, b: float(np.sqrt(((a - b) ** 2).sum())),
    "manhattan": lambda a, b: float(np.abs(a - b).sum()),
    "cosine": lambda a, b: float(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))),
}


def plain_dbscan(points, eps, least, metric):
    near = {i: {j for j, y in points.items() if i == j or PLAIN[metric](x, y) <= eps} for i, x in points.items()}
    core = {i for i in points if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        todo = [i] if i not in label else []
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = i
                todo += [j for j in near[k] & core if j not in label]
    return {i: min((label[j] for j in near[i] & core), default=None) for i in points}


@pytest.mark.parametrize("metric, eps", [("euclidean", 0.17), ("manhattan", 0.25), ("cosine", 0.01)])
def test_dbscan_equals_plain_walk(spark, metric, eps):
    rng = random.Random(4)
    points = {i: np.array([rng.random() + 0.05 for _ in range(4)]) for i in range(150)}
    points |= {200 + i: points[i % 7] for i in range(40)}  # copies
    rows = [(i, *map(float, v), 9) for i, v in points.items()] + [(998, None, 0.1, 0.1, 0.1, 9), (999, float("nan"), 0.1, 0.1, 0.1, 9)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, weight int")
    got = {r.id: r.cluster for r in K.dbscan(df, eps, 4, ["a", "b", "c", "d"], metric).collect()}
    want = plain_dbscan(points, eps, 4, metric)
    assert len(set(want.values())) > 2
    assert got == want | {998: None, 999: None}


def test_labels_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1100)] + [(5000, 5000)]
    got = {r.id: r.label for r in K.smallest_labels(spark.createDataFrame(links, "id long, other long")).collect()}
    assert got == {i: 0 for i in range(301)} | {j: 1000 for j in range(1000, 1100)} | {5000: 5000}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_silhouettes_equal_all_pairs(spark, metric):
    rng = random.Random(2)
    points = [(i, rng.choice([1, 2, 2, 7]), np.array([rng.random() + 0.01, rng.random()])) for i in range(60)] + [(99, 5, np.array([3.0, 3.0]))]
    df = spark.createDataFrame([(i, c, *map(float, v)) for i, c, v in points] + [(100, None, 0.5, 0.5)], "id long, cluster long, x double, y double")
    got = {r.id: r.silhouette for r in K.silhouettes(df, ["x", "y"], metric, block=16).collect()}
    assert set(got) == {i for i, _, _ in points}
    for i, c, v in points:
        to = {}
        for j, e, w in points:
            if i != j:
                to.setdefault(e, []).append(PLAIN[metric](v, w))
        a, b = np.mean(to[c]) if c in to else None, min(np.mean(x) for e, x in to.items() if e != c)
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b))
    one = df.where("cluster = 2")
    assert {r.silhouette for r in K.silhouettes(one, ["x", "y"]).collect()} == {None}


def test_silhouettes_take_copies_once(spark, monkeypatch):
    points = spark.range(3000).selectExpr("id", "id % 3 as cluster", "id % 30 / 30 as x", "id % 7 / 7 as y")  # 210 vectors, 14 or 15 copies of each
    met, plain = spark.sparkContext.accumulator(0), K._pair_sums

    def counted(metric):
        sums = plain(metric)

        def run(batches):
            def each():
                for batch in batches:
                    met.add(batch.num_rows)
                    yield batch

            return sums(each())

        return run

    monkeypatch.setattr(K, "_pair_sums", counted)
    got = {r.id: r.silhouette for r in K.silhouettes(points, ["x", "y"], block=32).collect()}
    assert met.value == 7 * 7  # pairs of blocks; of all points 94 * 94
    rows = points.collect()
    at, of = np.array([(r.x, r.y) for r in rows]), np.array([r.cluster for r in rows])
    for i in range(0, 3000, 271):
        away = np.sqrt(((at - at[i]) ** 2).sum(1))
        a = away[of == of[i]].sum() / ((of == of[i]).sum() - 1)
        b = min(away[of == c].mean() for c in range(3) if c != of[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))
    assert len(got) == 3000


def test_cluster_events_as_one_call(spark):
    rows = [(i, 0.01 * (i % 5), 0.0) for i in range(10)] + [(20 + i, 1.0, 0.01 * i) for i in range(5)] + [(99, 5.0, 5.0)]
    named, scores, summary = K.cluster_events(spark.createDataFrame(rows, "id long, x double, y double"), 0.021, 3, ["x", "y"])
    assert {r.id: r.cluster for r in named.collect()} == {i: 0 for i in range(10)} | {20 + i: 20 for i in range(5)} | {99: None}
    assert {(r.cluster, r.n) for r in scores.collect()} == {(0, 10), (20, 5)}
    row = summary.first()
    assert (row.clustered, row.events) == (15, 16) and row.silhouette > 0.9
    empty = K.cluster_events(spark.createDataFrame([], "id long, x double, y double"), 0.1, 3, ["x", "y"])
    assert empty[0].count() == 0 and empty[2].first().events == 0


def plain_merges(x, method, metric):
    """Distances of clusters from their rows, or from those of their parts where the method says so."""
    parts = {i: [i] for i in range(len(x))}
    dist = {(i, j): PLAIN[metric](x[i], x[j]) for i, j in itertools.combinations(range(len(x)), 2)}
    out = []

    def gap(a, b):
        return dist[min(a, b), max(a, b)]

    for step in range(len(x) - 1):
        a, b = min(itertools.combinations(sorted(parts), 2), key=lambda p: (round(gap(*p), 12), p))
        new, rows = len(x) + step, parts[a] + parts[b]
        out.append((a, b, gap(a, b), len(rows)))
        for k in parts:
            if k in (a, b):
                continue
            each = [PLAIN[metric](x[i], x[j]) for i in rows for j in parts[k]]
            if method == "ward":
                m, n = len(rows), len(parts[k])
                value = float(np.sqrt(2 * m * n / (m + n)) * np.linalg.norm(x[rows].mean(0) - x[parts[k]].mean(0)))
            else:
                value = {"single": min(each), "complete": max(each), "average": np.mean(each), "weighted": (gap(a, k) + gap(b, k)) / 2}[method]
            dist[k, new] = value
        del parts[a], parts[b]
        parts[new] = rows
    return out


@pytest.mark.parametrize("method, metric", [("single", "euclidean"), ("complete", "manhattan"), ("average", "cosine"), ("weighted", "manhattan"), ("ward", "euclidean")])
def test_merges_equal_plain_agglomeration(method, metric):
    x = np.random.default_rng(1).random((25, 4)) + 0.1
    got, want = K.merges(x, method, metric), plain_merges(x, method, metric)
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([d for _, _, d, _ in got], [d for _, _, d, _ in want])
    assert sorted(K.leaf_order(25, got)) == list(range(25))


def test_heatmap_order(spark):
    rows = [(f, s, v) for f, vs in {"b": (0, 0), "d": (9, 9), "a": (0.1, 0), "c": (9, 9.3)}.items() for s, v in zip("xy", map(float, vs), strict=True)]
    df = spark.createDataFrame(rows + [("e", "x", 100.0), ("e", "y", None)], "feature string, sample string, value double")
    got = {r.feature: (r.place, r.step) for r in K.heatmap_order(df, "average", "euclidean").collect()}
    places = sorted(got, key=lambda f: got[f][0])
    assert [set(places[i : i + 2]) for i in (0, 2)] in ([{"a", "b"}, {"c", "d"}], [{"c", "d"}, {"a", "b"}]) or places[0] == "e"
    assert got["a"][1] == got["b"][1] == 0 and got["c"][1] == got["d"][1] == 1 and got["e"][1] == 3
    assert K.heatmap_order(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="1001 features"):
        K.heatmap_order(spark.range(1001).select(F.col("id").alias("feature"), F.lit("s").alias("sample"), F.lit(1.0).alias("value")))


def test_two_isoforms_agree_with_a_grid(spark):
    rng = random.Random(6)
    classes = [(f"g{i}", fits, rng.randrange(1, 10 ** rng.randrange(1, 4))) for i in range(40) for fits in ([1, 0], [0, 1], [1, 1])] + [("none", [0, 0], 50), ("one", [1], 9), ("hot", [1, 0], 10**9), ("hot", [0, 1], 3 * 10**9)]
    isoforms = [(f"g{i}", k, 500 + 700 * (k == "a") * (i % 3)) for i in range(40) for k in "ab"] + [("none", "a", 900), ("none", "b", 900), ("one", "a", 900), ("hot", "a", 1000), ("hot", "b", 1000)]
    c, i = spark.createDataFrame(classes, "gene string, fits array<int>, n long"), spark.createDataFrame(isoforms, "gene string, isoform string, length long")
    samples = B.posterior_samples(c, i, 36)
    got = {r.gene: r for r in samples.collect()}
    assert set(got) == {f"g{k}" for k in range(40)} | {"hot"} and all(r.isoforms == ["a", "b"] for r in got.values())
    for r in B.two_isoform_mean(c, i, 36).where("gene not in ('hot', 'none')").collect():
        assert np.mean([p[0] for p in got[r.gene].psi]) == pytest.approx(r["mean"], abs=0.03), r.gene
        assert 0.1 < got[r.gene].accepted < 0.8
    assert np.mean([p[0] for p in got["hot"].psi]) == pytest.approx(0.25, abs=1e-3)
    again = {r.gene: r.psi for r in B.posterior_samples(c.repartition(7), i, 36).collect()}
    assert all(again[g] == r.psi for g, r in got.items() if g == "g3")
    ends = R.credible_interval(B.by_isoform(samples)).where("event = 'hot:a'").first()
    assert ends.lo <= 0.25 <= ends.hi


def test_three_isoforms_told_apart_are_a_dirichlet_posterior(spark):
    n = [30, 10, 5]
    c = spark.createDataFrame([("g", [int(i == k) for i in range(3)], n[k]) for k in range(3)], "gene string, fits array<int>, n long")
    i = spark.createDataFrame([("g", k, 1000) for k in "abc"], "gene string, isoform string, length long")
    psi = np.array(B.posterior_samples(c, i, 50).first().psi)
    assert np.allclose(psi.mean(0), [(x + 1) / 48 for x in n], atol=0.02)
    assert np.allclose(psi.var(0), [(x + 1) * (48 - x - 1) / (48**2 * 49) for x in n], rtol=0.35)
