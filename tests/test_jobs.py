"""Readers and writers, the stream of chunks, providers and whole jobs, on files and tables made here."""

import json

import pytest

from termweave import providers
from termweave.plans import pipelines
from termweave.sources import files
from termweave.streaming import ingest

DOCS = [
    (1, "# Engines\nA heat engine turns heat into work. The heat engine needs a cold side.\n## Gas\nA gas turbine is a heat engine. A gas turbine burns fuel."),
    (2, "# Pumps\nA heat pump moves heat. The heat pump needs power.\nA gas turbine may drive a heat pump."),
    (3, ""),
    (4, None),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_texts_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "y.md").write_text("é", encoding="utf-8")
    (tmp_path / "z.pdf").write_bytes(b"%PDF")
    assert sorted(r.text for r in files.texts(spark, str(tmp_path)).collect()) == ["one\ntwo", "é"]
    assert [bytes(r.content) for r in files.binaries(spark, str(tmp_path)).collect()] == [b"%PDF"]
    with pytest.raises(ValueError):
        files.texts(spark, str(tmp_path), ("docx",))
    (tmp_path / "none.txt").write_text("")
    assert files.texts(spark, str(tmp_path)).count() == 2
    (tmp_path / "empty.txt").write_text(" \n")
    with pytest.raises(Exception, match="empty file"):
        files.texts(spark, str(tmp_path)).collect()


def test_question_files(spark, tmp_path):
    (tmp_path / "run1.csv").write_text('question,expected 1,expected 2\n"a, ""b""\nc",x,\nd, ,y\n', encoding="utf-8")
    df = files.questions(spark, str(tmp_path / "run1.csv"))
    assert {(r["question"], r["file"]) for r in df.collect()} == {('a, "b"\nc', "run1"), ("d", "run1")}
    assert sorted(tuple(r) for r in files.expected_long(df, "question", "expected").collect()) == [('a, "b"\nc', 0, "x"), ("d", 1, "y")]
    (tmp_path / "bulk.csv").write_text("q1,x, ,y\nq2,,,\n", encoding="utf-8")
    assert sorted((r.question, r.expected) for r in files.questions(spark, str(tmp_path / "bulk.csv"), header=False).collect()) == [("q1", ["x", "y"]), ("q2", [])]


@pytest.mark.parametrize("shape", [[{"term": "a", "score": 1.5}, {"headword": "b"}], {"terms": [{"term": "a", "score": 1.5}, {"headword": "b", "other": 1}]}, {"candidates": [{"headword": "a", "revised_score": 1.5}, {"term": "b"}, {"score": 3}]}])
def test_candidate_files(spark, tmp_path, shape):
    (tmp_path / "c.json").write_text(json.dumps(shape))
    assert sorted(tuple(r) for r in files.candidates(spark, str(tmp_path / "c.json")).collect()) == [("a", 1.5), ("b", None)]


def test_candidate_map(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": 1.5, "b": 2}))
    assert sorted(tuple(r) for r in files.candidates(spark, str(tmp_path / "c.json")).collect()) == [("a", 1.5), ("b", 2.0)]


def test_tables_are_read_as_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x "y"\nz', ["a", "b"]), (2, None, [])], "id long, text string, tags array<string>")
    files.write_csv(df, str(tmp_path / "csv"))
    got = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"')
    assert sorted((r.id, r.text, r.tags or "") for r in got.collect()) == [("1", 'x "y"\nz', "a|b"), ("2", None, "")]
    files.write_json(df, str(tmp_path / "json"))
    assert sorted(tuple(r) for r in spark.read.schema(df.schema).json(str(tmp_path / "json")).collect()) == [(1, 'x "y"\nz', ["a", "b"]), (2, None, [])]


def test_a_collection_replaces_itself_alone(spark, tmp_path):
    schema, path = "collection_name string, chunk_id string", str(tmp_path / "chunks")
    files.write_collection(spark.createDataFrame([("a", "1"), ("b", "2")], schema), path)
    files.write_collection(spark.createDataFrame([("a", "3")], schema), path)
    assert sorted((r.collection_name, r.chunk_id) for r in spark.read.parquet(path).collect()) == [("a", "3"), ("b", "2")]


def test_stream_keeps_the_last_chunk(spark, docs, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    docs.limit(2).write.parquet(source)
    ingest.stream_chunks(spark, source, table, checkpoint).awaitTermination(120)
    first = {r.chunk_id: r.content for r in ingest.latest(spark, table).collect()}
    spark.createDataFrame([(2, "# Pumps\nnew text")], docs.schema).write.mode("append").parquet(source)
    ingest.stream_chunks(spark, source, table, checkpoint).awaitTermination(120)
    now = {r.chunk_id: r.content for r in ingest.latest(spark, table).collect()}
    assert set(now) == set(first) and sum(now[k] != first[k] for k in now) == 1
    assert any("new text" in x for x in now.values())


def test_provider_failures(spark):
    df = spark.createDataFrame([("a",), (None,)], "term string")

    def fails(batch):
        raise RuntimeError

    assert [r.x for r in providers.apply(df, "term", "x", fails, "string", providers.PASS).collect()] == ["a", ""]
    assert [r.x for r in providers.apply(df, "term", "x", fails, "boolean", providers.TRUE).collect()] == [True, True]
    assert [r.x for r in providers.apply(df, "term", "x", fails, "array<float>").collect()] == [None, None]


def test_ingest_and_search(spark, docs):
    chunks, index, vectors = pipelines.ingest(docs, "c")
    asked = spark.createDataFrame([(1, "gas turbine fuel"), (2, "heat pump power")], "query_id long, query string")
    best = {r.query_id: r.chunk_id for r in pipelines.search(index, vectors, asked).filter("fused_rank = 1").collect()}
    content = {r.chunk_id: r.content for r in chunks.collect()}
    assert "turbine" in content[best[1]] and "pump" in content[best[2]]


def test_mine(spark, docs):
    got = {r.term: r.score for r in pipelines.mine(docs, 2, 3).collect()}
    assert {"heat engine", "gas turbine"} & set(got) and all(x >= 0 for x in got.values())


def test_scores_that_cannot_be_enhanced_come_back(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "term string, score double")
    vector = lambda rows: spark.createDataFrame(rows, "term string, embedding array<float>")
    seeds = spark.createDataFrame([("a",)], "term string")
    near, apart = [("a", [1.0, 0.0]), ("b", [1.0, 0.1])], [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    base = {(r.term, r.score) for r in scores.collect()}
    rows = lambda df: {(r.term, r.score) for r in df.collect()}
    for vectors, start in ((near[:1], seeds), ([], seeds), (apart, seeds), (near, seeds.limit(0)), ([*near[:1], ("b", None)], seeds), ([("a", [1.0, 0.0]), ("x", [1.0, 0.0])], seeds)):
        assert rows(pipelines.enhanced(scores, vector(vectors), start)) == base
    revised = rows(pipelines.enhanced(scores, vector(near), seeds))
    assert {t for t, _ in revised} == {"a", "b", "c"} and dict(revised)["c"] == 3.0 and dict(revised)["a"] > 1 and dict(revised)["b"] > 2


def test_loads_of_several_paths(spark, tmp_path):
    from termweave.sources import layouts

    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, content in (("a.txt", "one"), ("deep/b.MD", "two\nlines"), ("deep/c.pdf", "%PDF")):
        (tmp_path / "in" / name).write_text(content)
    (tmp_path / "alone.txt").write_text("three")
    paths = [str(tmp_path / "in"), str(tmp_path / "missing"), str(tmp_path / "alone.txt")]
    texts, pages = layouts.load(spark, paths)
    assert sorted(r.text for r in texts.collect()) == ["one", "three", "two\nlines"] and [r.path[-5:] for r in pages.collect()] == ["c.pdf"]
    assert layouts.load(spark, str(tmp_path / "missing"))[0].count() == 0
    (tmp_path / "in" / "none.txt").write_text("")
    with pytest.raises(ValueError, match="empty file.*none.txt"):
        layouts.load(spark, paths)
    (tmp_path / "in" / "a0.docx").write_text("x")
    with pytest.raises(ValueError, match="no reader for.*docx"):
        layouts.load(spark, paths)
    assert layouts.load(spark, paths, skip=True)[0].count() == 3
