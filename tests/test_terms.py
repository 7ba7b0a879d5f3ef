"""Term mining against plain versions."""

import math
import random
import time
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from termweave.operators import terms as M


def test_independent_ratio_counts_every_occurrence(spark):
    texts = ["red fox\nred fox runs", "(red fox) and\tred fox.red fox", "a bored fox", None, "", "red fox den red fox den", "東京駅は東京", "xx x"]
    words = ["red fox", "fox runs", "red fox den", "東京", "東京駅", "x", "not there"]
    got = M.independent_ratio(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(w,) for w in words], "term string"))
    total = {w: sum((t or "").count(w) for t in texts) for w in words}
    inside = {w: sum(total[x] for x in words if x != w and w in x) for w in words}
    want = {(w, n, round(max(0.0, (n - inside[w]) / n), 6) if n else 0.0) for w, n in total.items()}
    assert {(r.term, r.total, r.ratio) for r in got.collect()} == want


def plain(docs, low, high, minimum):
    total = Counter()
    for said in docs:
        runs = Counter(tuple(t[i : i + n]) for t in said or () for n in range(low, high + 1) for i in range(len(t or ()) - n + 1) if None not in t[i : i + n])
        total.update({r: c for r, c in runs.items() if c >= minimum})
    return {(" ".join(r), len(r)): c for r, c in total.items()}


def test_runs_of_many_documents_a_slice_at_a_time(spark, monkeypatch):
    """Slices of whole documents; nulls in and among sentences have no runs; each candidate counts in sentences and documents."""
    monkeypatch.setattr(M, "SLICE", 50)
    r = random.Random(3)
    docs = [[[r.choice("ab東é🙂") * r.choice((1, 1, 3)) for _ in range(r.choice((0, 1, 5, 40)))] for _ in range(r.choice((0, 1, 4)))] for _ in range(60)]
    docs += [None, [], [[]], [["a", None, "b", "a", None, "b"] * 3], [["a"] * 300]]
    df = spark.createDataFrame([(d,) for d in docs], "said array<array<string>>").repartition(2)
    got = {(x.term, x["size"]): x.frequency for x in M.mined(df, F.col("said"), 1, 6, 2).collect()}
    assert got == plain(docs, 1, 6, 2)
    terms = [*r.sample(sorted(plain(docs, 1, 3, 1)), 30), ("no such", 2)]
    found = {x.term: (x.df, x.tfidf) for x in M.tfidf(df, F.col("said"), spark.createDataFrame(terms, "term string, size int"), 64).collect()}
    for term, size in terms:
        each = [[sum(t[i : i + size] == term.split(" ") for i in range(len(t))) for t in said] for said in docs if said]
        n = sum(any(e) for e in each)
        want = sum(1 + math.log(f) for e in each for f in e if f) * (math.log((len(each) + 1) / (n + 1)) + 1)
        assert found[term][0] == n and abs(found[term][1] - want) < 1e-5


def test_hashes_of_runs_are_those_of_terms(spark):
    """Long tokens and runs beyond a stretch too."""
    said = ["red", "fox", "東京駅", "🙂" * 70_000, "x", "y" * 1000]
    (names, token, _, _, left), = M._tokens_of(pa.array([[said]]))
    hashes = M._run_hashes(names, token, left)
    for n in range(1, 6):
        at, hashed = next(hashes)
        runs = [" ".join(said[i : i + n]) for i in at.tolist()]
        sizes = M.np.array([len(x) for x in runs])
        assert hashed.tolist() == M._Windows("".join(runs)).hashes(sizes.cumsum() - sizes, sizes).tolist()


def test_runs_are_counted_without_a_step_for_each(spark):
    """A million different places: run by run they took over 3 seconds a size."""
    r = random.Random(5)
    column = pa.array([[[f"w{r.randrange(9000)}" for _ in range(1000)]] for _ in range(1000)])
    began = time.process_time()
    for names, token, _, _, left in M._tokens_of(column):
        hashes = M._run_hashes(names, token, left)
        assert sum(len(next(hashes)[0]) for _ in range(6)) > 0
    assert time.process_time() - began < 6


def test_short_texts_are_looked_at_together(spark, monkeypatch):
    """A thousand texts take a few passes, not one each; no term is found across two of them, nor over itself."""
    texts = ["abab ab", "b abc", None, "", "aaaa", "a"] * 170 + ["ab" * 700_000]
    terms = ["ab", "ba", "abab", "bb", "aa", "bab", "ca", "ab ab"]
    passes = []
    monkeypatch.setattr(M, "spread", lambda df: df)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema, *a, whole=type(spark.range(1)).mapInArrow: (passes.append(f) if schema == "term string, n bigint" else None) or whole(df, f, schema, *a))
    got = {r.term: r.total for r in M.counted(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {t: n for t in terms if (n := sum((x or "").count(t) for x in texts))}
    made = []
    monkeypatch.setattr(M, "_Windows", lambda text, whole=M._Windows: made.append(len(text)) or whole(text))
    list(passes[0]([pa.RecordBatch.from_arrays([pa.array(texts[:-1])], ["t"])]))
    assert len(made) == 1
