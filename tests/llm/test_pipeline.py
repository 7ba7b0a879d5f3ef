"""The pipeline's stages against plain versions, and the imports that must not reach this subpackage."""

import re
from pathlib import Path

import corpus_pipeline
import pytest
from test_operators import plain_join, plain_measures

from termweave.llm import decontamination, pii, quality_rules

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def staged(spark):
    if not SF.exists():
        pytest.skip("no test tables")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], str(SF)).cache())
    return out


def test_stages_keep_the_columns(staged):
    for before, after in zip(staged, staged[1:-1]):
        assert after.columns == before.columns


def test_rules_keep_what_the_base_keeps_of_clean_texts(staged):
    kept = {r.doc_id for r in staged[1].collect()}
    for r in staged[0].collect():
        assert not (plain_measures(r.text)[-1] and r.doc_id in kept)
    measured = quality_rules.apply_rules(staged[0]).filter("kept").select("doc_id").collect()
    assert kept == {r.doc_id for r in measured}


def test_copies_with_a_fifth_appended_go(spark):
    text = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    # Copies with 18, 22, 24 and 30 per cent appended, and one with 11 of 500 words changed.
    rows = [(1, text("a", 200)), *((10 + n, text("a", 200) + " " + text(f"b{n}_", n)) for n in (36, 44, 48, 60))]
    rows += [(2, text("c", 500)), (20, " ".join(f"x{i}" if i % 45 == 30 else f"c{i}" for i in range(500)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    assert kept == {c for (_, _, c) in plain_join(rows, 80, 5)} == {1, 2, 70}


def test_one_of_each_group_stays_by_the_limits_of_the_stage(staged):
    rows = [(r.doc_id, r.text) for r in staged[1].collect()]
    assert {r.doc_id for r in staged[2].collect()} == {c for (_, _, c) in plain_join(rows, 80, 5)}


def seeds(text):
    w = [x for x in re.split(decontamination.BREAK, (text or "").lower()) if x]
    return {(m, *(w[p + i] for i, c in enumerate(m) if c == "1")) for m in decontamination.MASKS for p in range(len(w) - decontamination.SPAN + 1)}


def test_leaks_go(spark, staged):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = set().union(*map(seeds, items))
    after = {r.doc_id for r in staged[3].collect()}
    for r in staged[2].collect():
        if any(i in (r.text or "") for i in items):
            assert r.doc_id not in after
        if not seeds(r.text) & known:
            assert r.doc_id in after


def test_personal_data_is_masked(staged):
    before = {r.doc_id: r.text for r in staged[3].collect()}
    for r in staged[4].collect():
        assert r.text == pii.redacted(before[r.doc_id], pii.find_spans(before[r.doc_id])) and r.n_chars == len(r.text)


def test_all_documents_are_packed(staged):
    assert {r.doc_id for r in staged[5].select("doc_id").distinct().collect()} == {r.doc_id for r in staged[4].collect()}


def test_run_gives_what_the_stages_give(spark, staged):
    pieces = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    total = lambda rows: {d: sum(n for x, _, n, _, _ in rows if x == d) for d in {r[0] for r in rows}}
    # Where documents are cut depends on which of them meet in a partition; what is packed does not.
    assert total(pieces(corpus_pipeline.run(spark, str(SF)))) == total(pieces(staged[5]))


def test_repeated_ids_and_nulls_pass_the_stages(spark, tmp_path):
    text = lambda a: " ".join(f"the {a}{i} of" for i in range(30))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (None, text("a")), (None, text("c")), (3, None), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(text("b").split()[5:45]), "x", 1)], "item_id long, text string, doc_id string, seed int").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, None}


def test_empty_tables_pass_the_stages(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "termweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_columns_with_names_of_the_stages_come_back_unchanged(spark):
    text = lambda a: " ".join(f"the {a}{i} of" for i in range(30))
    rows = [(1, text("a")), (2, text("a")), (3, text("b"))]
    names = ["_key", "key", "row", "stays", "doc", "text_key", "leak_id", "kept", "spans", "chunk", "bucket", "w"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(SF))
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        assert {r.doc_id for r in got} == ({1, 2, 3} if name == "quality_rules" else {1, 3})
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name
