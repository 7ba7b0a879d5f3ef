"""The fuzzy neighbour graph against a plain version; what the layout keeps of neighbours and groups."""

import math

import numpy as np
import pytest

from termweave.operators import layout
from termweave.operators.density import Cells, distinct_points, neighbours, ranked

SF = "/root/testdata/sf0.001"


def groups(n=60, d=12, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(3, d))
    x = np.concatenate([c + r.normal(0, 0.15, (n, d)) for c in centres])
    return x, np.repeat(np.arange(3), n)


def frame(spark, x):
    return spark.createDataFrame([(i * 5 % 997, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def plain_graph(x, k):
    """Weights of pairs by the published rule: bisection of each row's width, union of both directions."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    w = np.zeros_like(d)
    for i in range(len(d)):
        order = [j for j in np.argsort(d[i], kind="stable") if j != i][: k - 1]
        far = np.maximum(d[i][order], 0)
        rho = min((v for v in far if v > 0), default=0)
        low, high, mid = 0.0, math.inf, 1.0
        for _ in range(64):
            total = sum(math.exp(-max(v - rho, 0) / mid) for v in far)
            if abs(total - math.log2(k)) < 1e-5:
                break
            if total > math.log2(k):
                high, mid = mid, (low + mid) / 2
            else:
                low, mid = mid, mid * 2 if high == math.inf else (mid + high) / 2
        sigma = max(mid, 1e-3 * sum(far) / k)
        for j, v in zip(order, far):
            w[i, j] = math.exp(-max(v - rho, 0) / sigma)
    return w + w.T - w * w.T


def test_fuzzy_graph(spark):
    x, _ = groups(20)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    points = distinct_points(ranked(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "key long, v array<double>"), ["key"], "place"), "v")
    from pyspark.sql import functions as F

    near = neighbours(Cells(points), 9).withColumn("near", F.transform("near", lambda n: F.struct((n["distance"] ** 2 / 2).alias("distance"), n["other"].alias("other"))))
    got = {(r.a, r.b): r.weight for r in layout.fuzzy_graph(near, 10).collect()}
    want = plain_graph(x, 10)
    assert set(got) == {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if want[a, b] > 0}
    assert all(abs(w - want[a, b]) < 1e-4 for (a, b), w in got.items())


def test_curve_is_the_published_one():
    assert layout.curve(0.1) == pytest.approx((1.577, 0.895), abs=0.01)


@pytest.mark.parametrize("part", [20_000, 60])
def test_layout_keeps_neighbours(spark, part):
    x, group = groups()
    found = {r.vec_id: r.y for r in layout.reduced(frame(spark, x), 4, part=part, rounds=8).collect()}
    y = np.array([found[i * 5 % 997] for i in range(len(x))])
    assert y.shape == (len(x), 4) and np.isfinite(y).all()
    nearest = lambda z: np.argsort(((z[:, None] - z[None]) ** 2).sum(2) + 1e9 * np.eye(len(z)), axis=1)[:, :15]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    before, after = nearest(u), nearest(y)
    kept = np.mean([len(set(a) & set(b)) / 15 for a, b in zip(before, after)])
    assert kept > 0.35  # by chance: a twelfth
    assert np.mean(group[after] == group[:, None]) > 0.98


def test_term_clusters(spark):
    x, group = groups(25)
    x = np.concatenate([x, x[:1], np.zeros((1, x.shape[1]))])
    got = {r.vec_id: r.cluster for r in layout.term_clusters(frame(spark, x)).collect()}
    label = [got[i * 5 % 997] for i in range(len(x))]
    assert label[-1] == -1 and label[-2] == label[0]
    for c in set(label) - {-1}:
        assert len({group[i] for i in range(75) if label[i] == c}) <= 1
    few = frame(spark, x[:2])
    assert {r.cluster for r in layout.term_clusters(few).collect()} == {-1}
    assert layout.term_clusters(few.limit(0)).count() == 0
