"""Spanning tree, merges, condensed tree and clusters by density against plain versions."""

import math
from collections import defaultdict

import numpy as np
import pytest

from termweave.operators import density


def plain_weights(x, samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, samples]
    return np.maximum(np.maximum(d, core[:, None]), core[None])


def plain_tree(x, samples):
    """Prim's tree: edges (weight, a, b)."""
    w, inside, edges = plain_weights(x, samples), [0], []
    outside = set(range(1, len(x)))
    while outside:
        weight, a, b = min((w[i, j], i, j) for i in inside for j in outside)
        edges.append((float(weight), min(a, b), max(a, b)))
        inside.append(b)
        outside.remove(b)
    return sorted(edges)


def plain_merges(edges, n):
    top, out = list(range(n)), []
    members = {i: [i] for i in range(n)}
    for k, (w, a, b) in enumerate(sorted(edges)):
        x, y = top[a], top[b]
        out.append((n + k, w, x, y, len(members[x]), len(members[y])))
        members[n + k] = members[x] + members[y]
        for i in members[n + k]:
            top[i] = n + k
    return out, members


def plain_condensed(merged, members, n, smallest):
    kids = {m[0]: m for m in merged}
    rows, stack = [], [(2 * n - 2, 2 * n - 2)]
    while stack:
        node, cluster = stack.pop()
        _, w, x, y, sx, sy = kids[node]
        lam = 1 / w if w else math.inf
        for child, size in ((x, sx), (y, sy)):
            if min(sx, sy) >= smallest:
                rows.append((cluster, child, lam, size))
                stack.append((child, child))
            elif size >= smallest:
                stack.append((child, cluster))
            else:
                rows += [(cluster, i, lam, 1) for i in members[child]]
    return rows


def plain_labels(rows, n, epsilon, single):
    clusters = {c: (p, lam) for p, c, lam, s in rows if s > 1}
    root, parents = 2 * n - 2, {p for p, _ in clusters.values()}
    chosen = set()
    for leaf in (c for c in clusters if c not in parents):
        if 1 / clusters[leaf][1] >= epsilon:
            chosen.add(leaf)
            continue
        at = leaf
        while True:
            up = clusters[at][0]
            if up == root:
                at = root if single else at
                break
            at = up
            if 1 / clusters[at][1] > epsilon:
                break
        chosen.add(at)
    chosen = chosen or {root}
    out = {}
    for parent, child, lam, size in rows:
        if size > 1:
            continue
        at = parent
        while at not in chosen and at != root:
            at = clusters[at][0]
        least = 1 / epsilon if epsilon else max(r[2] for r in rows if r[0] == root)
        noise = at not in chosen or at == root and (len(chosen) > 1 or lam < least)
        out[child] = -1 if noise else at
    return out


def points(seed=3):
    r = np.random.default_rng(seed)
    x = np.concatenate([*[r.normal(c, 0.1, (25, 3)) for c in ((0, 0, 0), (1, 1, 1), (3, 0, 1))], r.uniform(-1, 4, (20, 3)), np.tile([[0.5, 0.5, 0.5]], (9, 1))])
    return sorted((int(i * 7 % 1009), v.tolist()) for i, v in enumerate(x))


@pytest.mark.parametrize(("samples", "block"), [(1, 30), (4, 4096)])
def test_spanning_tree(spark, samples, block):
    rows = points()
    vectors = spark.createDataFrame([*rows, (5000, None)], "vec_id long, embedding array<double>")
    places, edges = density.spanning_tree(vectors, samples, block=block, k=5)
    assert [r.key for r in places.orderBy("place").collect()] == [k for k, _ in rows]
    got = sorted((r.weight, r.a, r.b) for r in edges.collect())
    want = plain_tree(np.array([v for _, v in rows]), samples)
    np.testing.assert_allclose([w for w, _, _ in got], [w for w, _, _ in want], atol=1e-12)
    _, members = plain_merges(got, len(rows))
    assert len(members[2 * len(rows) - 2]) == len(rows)


@pytest.mark.parametrize(("smallest", "most", "epsilon", "single"), [(2, 10, 0.3, True), (5, 1000, 0.05, True), (3, 25, 9.0, True), (3, 25, 9.0, False)])
def test_condensed_tree_and_leaves(spark, smallest, most, epsilon, single):
    x = np.array([v for _, v in points(smallest)])[:70]
    n, edges = len(x), plain_tree(x, 2)
    merged, members = plain_merges(edges, n)
    found = density.merges(spark.createDataFrame(edges, "weight double, a long, b long"), n, most)
    got = {(r.node, r.weight, *sorted([(r.left, r.left_size), (r.right, r.right_size)])) for r in found.collect()}
    assert got == {(m, w, *sorted([(a, s), (b, t)])) for m, w, a, b, s, t in merged}
    rows = plain_condensed(merged, members, n, smallest)
    tree = density.condensed(found, smallest).cache()
    assert {(r.parent, r.child, r["lambda"], r.size) for r in tree.collect()} == set(rows)
    birth, want = {c: lam for _, c, lam, s in rows if s > 1}, defaultdict(float)
    for p, _, lam, s in rows:
        want[p] += s * (lam - birth.get(p, 0))
    assert {r.cluster: r.stability for r in density.stability(tree).collect()} == pytest.approx(dict(want))
    assert {r.place: r.node for r in density.leaf_labels(tree, epsilon, single).collect()} == plain_labels(rows, n, epsilon, single)


def test_clusters_of_copies_and_of_few_rows(spark):
    vectors = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    label = lambda rows, **how: {r.vec_id: r.cluster for r in density.density_clusters(vectors(rows), **how).collect()}
    far = [(i, [float(i // 3 * 10), 0.1 * (i % 3)]) for i in range(9)]
    assert label(far) == {i: i // 3 * 3 for i in range(9)}
    assert label([(i, [1.0, 2.0]) for i in range(4)]) == {0: 0, 1: 0, 2: 0, 3: 0}
    assert label([(7, [1.0])]) == {7: -1} and label([]) == {}


def test_queries_over_embeddings(spark):
    """The registered queries from the whole table, by the plain tree, merges, condensed tree and labels."""
    from termweave.deep_queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    x, n, keys = np.array([v for _, v in rows]), len(rows), [k for k, _ in rows]

    def tree(samples, smallest):
        # Kruskal's, as many weights are equal here: of equal edges, the one of the least places.
        w, top, edges = plain_weights(x, samples), list(range(n)), []
        for weight, a, b in sorted((float(w[i, j]), i, j) for i in range(n) for j in range(i + 1, n)):
            if top[a] != top[b]:
                edges.append((weight, a, b))
                top = [top[b] if t == top[a] else t for t in top]
        merged, members = plain_merges(edges, n)
        return plain_condensed(merged, members, n, smallest)

    rounded = lambda rows: sorted((p, c, round(lam, 9), s) for p, c, lam, s in rows)
    got = [(r.parent, r.child, r["lambda"], r.size) for r in QUERIES["condensed_tree"](spark, sf).collect()]
    assert rounded(got) == rounded(tree(5, 5))
    labels = plain_labels(tree(1, 2), n, 0.3, True)
    members = defaultdict(list)
    for place, node in labels.items():
        members[node].append(keys[place])
    want = {k: -1 if node < 0 else min(ks) for node, ks in members.items() for k in ks}
    assert {r.vec_id: r.cluster for r in QUERIES["density_clusters"](spark, sf).collect()} == want
    clusters = {c: (p, lam) for p, c, lam, s in tree(5, 5) if s > 1}
    levels = {r.vec_id: (r.node, round(r["lambda"], 9), r.depth) for r in QUERIES["cluster_levels"](spark, sf).collect()}
    depth = lambda c: 0 if c not in clusters else 1 + depth(clusters[c][0])
    leaves = {p: c for p, c in plain_labels(tree(5, 5), n, 0.0, True).items() if c >= 0}
    assert levels == {keys[p]: (c, round(clusters[c][1], 9), depth(c)) for p, c in leaves.items() if c in clusters}


def test_a_vector_is_copied_for_each_tile_and_not_for_each_block(spark, monkeypatch):
    """80 blocks in 4 tiles: the neighbours are exact, in single and in double precision, and nothing is sent to every block."""
    monkeypatch.setattr(density, "TILES", 4)
    sent, written = [], density.written
    monkeypatch.setattr(density, "written", lambda df, name: (sent.append((name, t := written(df, name))), t)[1])
    for scale in (1.0, 1e-12):
        x = np.round(np.random.default_rng(4).normal(size=(400, 24)), 1) * scale
        x[:50, 1:] = 0.0  # many equal distances
        x[:50, 0] = np.arange(50) * scale
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "point long, v array<double>, copies long")
        sent.clear()
        got = {r.point: [n.other for n in r.near] for r in density.neighbours(density.Cells(df, 5), 7).collect()}
        far = np.stack([density._apart(np.repeat(v[None], 400, 0), x) for v in x])  # ties as there
        np.fill_diagonal(far, np.inf)
        assert got == {i: np.lexsort((np.arange(400), far[i]))[:7].tolist() for i in range(400)}
        asked = [t.count() for name, t in sent if name == "asked"]
        assert len(asked) == 2 and max(asked) <= 400 * 4
