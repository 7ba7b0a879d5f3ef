"""Upkeep, selection and report operators on small tables: nulls, ties, repeated rows and empty tables."""

import pytest

from termweave.operators import clustering, dictionary, evaluation, graph, similarity, terms

CHUNKS = "collection_name string, document_id string, chunk_id string, ordinal long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([("a", "1", "1_0", 0, "x"), ("a", "1", "1_1", 1, "y x"), ("b", "2", "2_0", 0, None), (None, None, "n", None, "x")], CHUNKS)


def test_deleting_leaves_rows_with_nulls(chunks):
    kept, counts = dictionary.deleted(chunks, document_id="1")
    assert rows(kept.select("chunk_id")) == [("2_0",), ("n",)]
    assert rows(counts) == [(1, 2)]
    assert rows(dictionary.deleted(chunks.limit(0), document_id="1")[1]) == [(0, 0)]


def test_chunk_upsert_takes_the_new_row_whole(spark, chunks):
    new = spark.createDataFrame([("a", "1", "1_0", 0, None)], CHUNKS)
    got = dict(rows(dictionary.upsert_chunks(chunks, new).select("chunk_id", "text")))
    assert got == {"1_0": None, "1_1": "y x", "2_0": None, "n": "x"}


def test_document_text_and_relevant_chunks(chunks):
    assert rows(dictionary.document_texts(chunks)) == [("1", "x\n\ny x"), (None, "x")]
    assert rows(dictionary.relevant_chunks(chunks.filter("document_id is not null"), ["x", "z", "x"], 1)) == [("x", 1, "1", 0)]
    assert rows(dictionary.relevant_chunks(chunks, [])) == []


def test_reverse_index_of_missing_fields(spark):
    df = spark.createDataFrame([("t", None, None), ("u", ["A ", "", None], "(bb) ccc, 3%"), ("v", ["a"], "")], "term string, aliases array<string>, definition string")
    assert rows(dictionary.reverse_index(df)) == [("3%", "u"), ("a", "u"), ("a", "v"), ("bb", "u")]


def test_selection_of_terms(spark):
    df = spark.createDataFrame([("ABC", 1.0), ("a", 3.0), ("b", 3.0), ("c", 2.0), ("d", 1.0)], "term string, score double")
    assert rows(terms.best(df, 2)) == [("a", 3.0), ("b", 3.0)]
    assert rows(terms.seeds(df)) == [("a", 3.0)]
    assert rows(terms.to_define(df)) == [("ABC", 1.0), ("a", 3.0), ("b", 3.0)]
    assert rows(terms.to_define(df.limit(0))) == []


def test_dropout_report_and_details(spark):
    stages = spark.createDataFrame([("t", 0, "s0", True), ("t", 1, "s1", False), ("u", 0, "s0", None)], "term string, stage_index int, stage string, present boolean")
    assert rows(evaluation.dropout_report(stages)) == [("t", "s1", False), ("u", "s0", False)]
    one = lambda *x: spark.createDataFrame([(t,) for t in x], "term string")
    counts = spark.createDataFrame([("a", 4)], "term string, frequency long")
    assert rows(evaluation.term_details(one("a", "b", "b"), one("a", "c"), counts)) == [("a", True, 4), ("b", False, 0)]


def test_statistics_of_an_empty_graph(spark):
    v = spark.createDataFrame([], "id string, node_type string, term string")
    e = spark.createDataFrame([], "source_id string, target_id string, edge_type string, weight double, confidence double")
    assert rows(graph.statistics(v, e)) == [(0, 0, 0, 0, 0, None, None)]


def test_clusters(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [9.0, 9.0]), (4, [9.0, 8.0])], "vec_id long, embedding array<double>")
    c = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "vec_id long, cluster int")
    assert clustering.silhouette(v, c).first()[0] > 0.9
    assert clustering.silhouette(v, c.filter("cluster = 0")).first()[0] is None
    m = v.join(c.withColumnRenamed("cluster", "label"), "vec_id")
    assert rows(similarity.related_in_cluster(m, m.filter("vec_id = 1"))) == [(1, 2, 0.5, 1)]
