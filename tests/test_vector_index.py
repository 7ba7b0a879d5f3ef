"""Recall of the vector index against all distances, and its exact form."""

import numpy as np
import pytest

from termweave.operators import vector_index

SF = "/root/testdata/sf0.001"


def data(n=3000, d=32, seed=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, d))
    return centres[r.integers(0, 40, n)] + r.normal(0, 0.4, (n, d))


def frames(spark, x, every=50):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    extra = [(100_000, None), (100_001, [0.0] * x.shape[1])]
    corpus = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>")
    return corpus, spark.createDataFrame(rows[::every] + [(-1, None)], "query_id long, embedding array<double>")


def plain(x, every, k, metric):
    u = x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" else x
    out = {}
    for i in range(0, len(x), every):
        s = np.round(u @ u[i], 6) if metric == "cosine" else np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6)
        order = np.lexsort((np.arange(len(x)), -s if metric == "cosine" else s))[:k]
        out[i] = [(int(j), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.key, round(r.score, 6)))
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_and_exact_scores(spark, monkeypatch, metric):
    monkeypatch.setattr(vector_index, "BLOCK", 40)  # cells and queries are dealt over several tasks
    x = data()
    corpus, queries = frames(spark, x)
    index = vector_index.build(corpus, metric=metric, sample=1500)
    want = plain(x, 50, 10, metric)
    got = found(vector_index.search(index, queries))
    assert got.keys() == want.keys()
    recall = np.mean([len({k for k, _ in got[q]} & {k for k, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    best = {q: dict(v) for q, v in plain(x, 50, len(x), metric).items()}
    assert all(abs(best[q][k] - s) < 1e-5 for q in got for k, s in got[q] if k < 100_000)


def test_all_cells_and_candidates_are_exact(spark):
    x = data(400)
    corpus, queries = frames(spark, x)
    index = vector_index.build(corpus, cells=7)
    assert found(vector_index.search(index, queries, probes=7, candidates=400)) == plain(x, 50, 10, "cosine")


def test_awkward_tables(spark):
    corpus, queries = frames(spark, data(3))
    index = vector_index.build(corpus)
    assert len(found(vector_index.search(index, queries, k=5))[0]) == 3
    assert vector_index.search(vector_index.build(corpus.limit(0)), queries).count() == 0
    copies = spark.createDataFrame([(i, [1.0] * 16) for i in range(50)], "vec_id long, embedding array<double>")
    (got,) = found(vector_index.search(vector_index.build(copies), copies.limit(1).withColumnRenamed("vec_id", "query_id"), k=5)).values()
    assert [s for _, s in got] == [1.0] * 5


def test_query_over_embeddings(spark):
    from termweave.deep_queries import QUERIES

    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], np.float64)
    got, want = found(QUERIES["indexed_knn"](spark, SF).withColumnRenamed("vec_id", "key")), plain(x, 100, 10, "cosine")
    assert np.mean([len({k for k, _ in got[q]} & {k for k, _ in want[q]}) / 10 for q in want]) >= 0.9
