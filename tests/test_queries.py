"""Every registered query of the core against its SQL on DuckDB, over the smallest tables."""

import difflib
import math
import re
import unicodedata
from pathlib import Path

import duckdb
import pytest
from test_rules import plain_merge

from termweave.functions.text import GENERAL_WORDS, TAG_NAMES
from termweave.layout_queries import QUERIES, SQL
from termweave.operators.chunking import chunks_of
from termweave.operators.terms import PATTERNS

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not SF.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(float(x), 6) if type(x).__name__ == "Decimal" else x


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    want = duck.sql(SQL[name])
    got, want = table_of(df.columns, df.collect()), table_of(want.columns, want.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_only_what_has_no_sql_has_none():
    # Each of them is held against a plain version: here, or in test_rules.
    assert set(QUERIES) - set(SQL) == {"nested_terms", "spelling_variants", "pattern_candidates", "merged_terms", "chunk_markdown", "normalized_text", "condensed_tree", "cluster_stability", "density_clusters", "cluster_levels", "lattice_words", "noun_places", "ngram_places", "reduced_clusters", "indexed_knn"}


def plain_patterns(duck):
    found = {}
    for d, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        for term, at in {(m[0].strip("（）()").split(":")[0].strip(), m.span()) for p in PATTERNS for m in re.finditer(p, text or "")}:
            found.setdefault(term, []).append(d)
    # F6, as the texts need it: too short, digits in front, general words; codes stay.
    code = lambda t: re.fullmatch(r"[A-Za-z0-9_.-]{2,15}", t) and re.search("[A-Za-z]", t) and re.search("[0-9]", t)
    refused = lambda t: re.fullmatch(r"[pP]{1,2}[0-9]+|[vV][0-9]*", t) or (not code(t) and (len(t) < 3 or t[0].isdigit() or t.lower() in TAG_NAMES or t in GENERAL_WORDS))
    return {(t, len(ds), len(set(ds))) for t, ds in found.items() if not refused(t)}


def test_pattern_candidates(spark, duck):
    assert {tuple(r) for r in QUERIES["pattern_candidates"](spark, str(SF)).select("term", "n", "documents").collect()} == plain_patterns(duck)


def test_spelling_variants(spark, duck):
    names = sorted(r[0] for r in duck.sql("SELECT DISTINCT p_name FROM part").fetchall())
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
    want = {(a, b, ratio(a, b)) for a in names for b in names if a < b and 0.85 < ratio(a, b) < 0.98}
    assert {(r.a, r.b, r.ratio) for r in QUERIES["spelling_variants"](spark, str(SF)).collect()} == want


def test_merged_terms(spark, duck):
    rows = duck.sql("SELECT p_name, max(p_type), list(DISTINCT p_brand) FROM part GROUP BY 1").fetchall()
    got = {r.term: r.aliases for r in QUERIES["merged_terms"](spark, str(SF)).collect()}
    assert got == {t: a for t, (_, a) in plain_merge(rows).items()}


def test_chunk_markdown(spark, duck):
    normal = {r.doc_id: r.text or "" for r in QUERIES["normalized_text"](spark, str(SF)).collect()}
    want = {(d, i, len(c)) for d, t in duck.sql("SELECT doc_id, text FROM documents").fetchall() for i, (_, c) in enumerate(chunks_of(normal[d]))}
    assert {(r.doc_id, r.ordinal, r.n_chars) for r in QUERIES["chunk_markdown"](spark, str(SF)).collect()} == want


def test_normalized_text(spark, duck):
    def plain(text):
        out = re.sub(" *\n *", "\n", unicodedata.normalize("NFKC", text)).replace("\t", " ")
        out = re.sub("\n{3,}", "\n\n", re.sub(" +", " ", out))
        for mark in ("（(", ")）", "、。，．", ":"):
            out = re.sub(f" *([{mark}]) *", r"\1", out)
        return out.strip()

    want = {d: plain(t) for d, t in duck.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()}
    assert {r.doc_id: r.text for r in QUERIES["normalized_text"](spark, str(SF)).filter("text is not null").collect()} == want


def test_entry(spark):
    import __spark_entry__

    if not SF.exists():
        pytest.skip("no test tables")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
