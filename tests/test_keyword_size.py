"""Keyword search at size: what is shuffled, against plain versions."""

import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from termweave import queries
from termweave.functions import text as T
from termweave.operators import retrieval


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_postings_that_no_query_asks_for_are_dropped_before_they_are_counted(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b d"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "query_id int, token string")
    index = retrieval.postings(docs, T.tokens(F.col("text")))
    plan = _plan(retrieval.chosen(index, asked))
    assert re.search(r"Aggregate \[doc_id.*?\+- Join LeftSemi", plan, re.S)
    assert sorted(map(tuple, retrieval.asked_for(index, asked).select("doc_id", "token", "tf").collect())) == [(1, "a", 2), (1, "b", 1), (2, "b", 1)]


def test_all_words_of_many_queries_by_their_rarest(spark):
    r = random.Random(2)
    docs = [(i, [r.choice("aaaabbbbccdefgh") for _ in range(r.randrange(1, 12))]) for i in range(120)]
    asked = [(i, t) for i, words in docs[:25] for t in set(words)] + [(900, "a"), (900, "zz"), (901, "zz")]
    index = retrieval.postings(spark.createDataFrame(docs, "doc_id long, words array<string>"), F.col("words"))
    got = {(x.query_id, x.doc_id): (x.score, x.matched) for x in retrieval.keyword_search(index, spark.createDataFrame(asked, "query_id long, token string"), match_all=True).collect()}
    want = {}
    for q in {q for q, _ in asked}:
        words = {t for i, t in asked if i == q}
        for i, w in docs:
            tf = Counter(w)
            if words <= tf.keys():
                want[q, i] = (round(sum(1 - 1 / (1 + tf[t]) for t in words), 6), len(words))
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in got)


def test_long_queries_over_texts_shuffle_their_rarest_words_alone(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice([f"c{r.randrange(9)}", f"w{r.randrange(300)}"]) for _ in range(r.randrange(1, 40)))) for i in range(200)]
    docs += [(300 + i, docs[i][1] + " more") for i in range(60)] + [(400 + i, " ".join(docs[i][1].split()[1:])) for i in range(60)]
    docs += [(7, "c1 c2 again"), (500, None), (501, ""), (502, "水素 燃料 の c1"), (503, "東京 水素 水素"), (None, docs[0][1])]
    asked = [(i, t) for i, t in docs if i is not None and i % 10 == 0 or i in (502, 503)] + [(900, "c1 lacking"), (901, "  "), (902, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(asked, "query_id long, query string")
    words = T.tokens(F.col("text"))
    mine = lambda x: sorted(map(tuple, x.select("query_id", "doc_id", "score", "rank").collect()))
    want = mine(retrieval.keyword_queries(retrieval.postings(df, words), q, k=7))
    assert len(want) > 30
    assert mine(retrieval.keyword_queries_in(df, words, q, k=7)) == want
    # Hashes of few words choose before anything is shuffled, so what the texts' scan hands on has no exchange below it.
    found = retrieval._among(df.select("doc_id", F.explode(words).alias("token")), q.select(F.lit("w1").alias("token")), "token")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_words_are_counted_without_postings(spark, tmp_path):
    spark.createDataFrame([(1, "A b  a"), (2, "b"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = queries._counts(spark, str(tmp_path))
    assert "doc_id" not in _plan(counts).split("\n")[0] and _plan(counts).count("Aggregate") == 1
    assert sorted(map(tuple, counts.collect())) == [("a", 2), ("b", 2)]


def test_texts_that_stay_as_they_are_go_to_python_as_nulls(spark):
    rows = [(1, "plain"), (2, "ﬁne　ｶﾞ"), (3, None), (4, ""), (5, "é \U0001d400")]
    df = spark.createDataFrame(rows, "id int, text string").select("id", T.nfkc(F.col("text")).alias("text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    assert "_nfkc(text" not in plan
    assert dict(map(tuple, df.collect())) == {i: t and unicodedata.normalize("NFKC", t) for i, t in rows}
