"""Distances of samples and their scaling, beside plain forms."""

import random

import numpy as np
import pytest

from isoframe.operators import scaling as D

ROWS = "feature string, sample string, value double"
PLAIN = {
    "manhattan": lambda a, b: np.abs(a - b).sum(),
    "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()),
    "sqeuclidean": lambda a, b: ((a - b) ** 2).sum(),
    "cosine": lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b)),
    "correlation": lambda a, b: 1 - np.corrcoef(a, b)[0, 1],
    "hamming": lambda a, b: (a != b).mean(),
    "jaccard": lambda a, b: ((a != b) & ((a != 0) | (b != 0))).sum() / ((a != 0) | (b != 0)).sum(),
    "canberra": lambda a, b: sum(abs(x - y) / (abs(x) + abs(y)) for x, y in zip(a, b, strict=True) if x or y),
    "braycurtis": lambda a, b: np.abs(a - b).sum() / np.abs(a + b).sum(),
    "chebyshev": lambda a, b: np.abs(a - b).max(),
}


def profiles(n=6, features=90):
    rng = random.Random(7)
    return np.array([[rng.choice([0.0, 0.0, 0.5, rng.random() * 4]) for _ in range(n)] for _ in range(features)])


@pytest.mark.parametrize("metric", [*PLAIN, "seuclidean"])
def test_sample_distances_equal_plain(spark, monkeypatch, metric):
    monkeypatch.setattr(D, "SLICE", 40)  # several slices a batch
    x = profiles()
    rows = [(f"f{i}", f"s{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v or j == 0]  # zeros are missing rows
    got = {(r["sample"], r.other): r.distance for r in D.sample_distances(spark.createDataFrame(rows, ROWS).repartition(3), metric).collect()}
    plain = PLAIN.get(metric, lambda a, b: np.sqrt(sum((p - q) ** 2 / v for p, q, v in zip(a, b, x.var(1, ddof=1), strict=True) if v > 0)))
    assert len(got) == 30
    for (a, b), d in got.items():
        assert d == pytest.approx(plain(x[:, int(a[1:])], x[:, int(b[1:])]), abs=1e-9)


def test_odd_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert D.sample_distances(none).count() == 0 and D.scaled(D.sample_distances(none)).count() == 0
    nulls = spark.createDataFrame([("f", "a", None), ("f", "b", float("nan")), ("g", "a", 1.0)], ROWS)
    assert {(r["sample"], r.distance) for r in D.sample_distances(nulls).collect()} == {("a", 1.0), ("b", 1.0)}
    with pytest.raises(ValueError, match="unknown metric"):
        D.sample_distances(nulls, "nearby")


def test_stress_never_rises():
    rng = np.random.RandomState(3)
    d = np.abs(rng.normal(size=(25, 25)))
    d = d + d.T
    np.fill_diagonal(d, 0)
    x, course = D.majorised(d, rng.uniform(size=(25, 2)), 60, -1)
    assert len(course) == 60 and all(b <= a + 1e-9 for a, b in zip(course, course[1:]))
    assert course[-1] == pytest.approx(sum((np.linalg.norm(x[i] - x[j]) - d[i, j]) ** 2 for i in range(25) for j in range(i)))


def test_planted_points_are_recovered(spark):
    rng = np.random.RandomState(1)
    points = rng.normal(size=(15, 3))
    gap = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2)
    want = gap(points)
    rows = [(f"s{i:02d}", f"s{j:02d}", float(want[i, j])) for i in range(15) for j in range(15) if i != j]
    df = spark.createDataFrame(rows, "sample string, other string, distance double")
    got = np.zeros((15, 3))
    out = D.scaled(df, 3, rounds=3000, least=1e-12).collect()
    for r in out:
        got[int(r["sample"][1:]), r.pc - 1] = r.score
    assert len(out) == 45 and np.abs(gap(got) - want).max() < 0.01
    # the least stress of all starts, each in the order of one stream
    random_state = np.random.RandomState(42)
    ends = [D.majorised(want, random_state.uniform(size=(15, 5)), 300, 1e-3)[1][-1] for _ in range(4)]
    assert D.scaled(df).first().stress == pytest.approx(min(ends))
