"""PageRank at size: rows of many edges met with ranks, against a plain version."""

import random

from termweave.operators import graph


def _plain(edges, seeds, rounds, alpha=0.85):
    both = [(a, b, w) for a, b, w in edges if a is not None] + [(b, a, w) for a, b, w in edges if b is not None]
    out = {}
    for a, _, w in both:
        out[a] = out.get(a, 0) + w
    hits = len(out.keys() & seeds)
    home = {a: (a in seeds) / hits if hits else 1 / len(out) for a in out}
    rank = home
    for _ in range(rounds):
        moved = dict.fromkeys(out, 0.0)
        for a, b, w in both:
            if b in moved:
                moved[b] += rank[a] * w / out[a]
        rank = {a: alpha * moved[a] + (1 - alpha) * home[a] for a in out}
    return rank


def test_a_round_meets_rows_of_many_edges_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_A_ROW", 7)
    r = random.Random(3)
    edges = [(f"P{r.randrange(40)}", f"S{r.randrange(6)}", r.randrange(1, 9) / 8) for _ in range(300)]
    edges += [("P1", "P1", 1.0), ("P1", "P1", 0.5), ("S1", "P2", 0.25), (None, "S2", 0.5), ("S3", None, 0.5)]
    df = spark.createDataFrame(edges, "source_id string, target_id string, weight double")
    for seeds in ({f"S{i}" for i in range(9)}, {"none"}):
        got = graph.pagerank(df, spark.createDataFrame([(s,) for s in seeds], "id string"), iterations=4, tolerance=None)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and plan.count("ShuffledHashJoin") == 8
        assert "array<struct<dst" in plan  # an edge is no row of the join
        want = _plain(edges, seeds, 4)
        ranks = {x.id: x["rank"] for x in got.collect()}
        assert got.columns == ["id", "rank"] and ranks.keys() == want.keys() and all(abs(ranks[k] - want[k]) < 1e-12 for k in want)
