"""Words by lattice against all paths, places against the texts, and the queries against plain versions."""

import random
import re
from collections import Counter, defaultdict
from math import log

import pyarrow as pa
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import lattice

SF = "/root/testdata/sf0.001"
LEXICON = [("東京", "noun", "general", 300), ("京都", "noun", "general", 300), ("東", "noun", "general", 700), ("都", "suffix", "general", 200), ("に", "particle", "general", 50), ("行く", "verb", "general", 200), ("燃料", "noun", "general", 250), ("燃料電池", "noun", "general", 400), ("電池", "noun", "general", 250), ("新", "prefix", "general", 150)]


def all_paths(analyser, text):
    """(cost, words) of the cheapest of all paths."""
    run = [next((j for j in range(i, len(text)) if lattice.kind(text[j]) != lattice.kind(text[i])), len(text)) for i in range(len(text))]

    def walk(at, before):
        if at == len(text):
            yield analyser.links.get((before, ""), 0), 0
            return
        for end, major, _, cost, _ in analyser.edges(text, at, run):
            for c, w in walk(end, major):
                yield analyser.links.get((before, major), 0) + cost + c, w + 1

    return min(walk(0, ""))


def test_the_cheapest_of_all_paths():
    r = random.Random(4)
    for _ in range(60):
        entries = [("".join(r.choice("ab1あ東") for _ in range(r.randrange(1, 4))), r.choice(("noun", "verb", "prefix")), "general", r.randrange(100, 3000)) for _ in range(12)]
        links = [(a, b, r.randrange(-300, 300)) for a in ("", "noun", "verb") for b in ("noun", "prefix", "") if a or b]
        analyser = lattice.Analyser(entries, links)
        text = "".join(r.choice("ab1あ東x") for _ in range(r.randrange(1, 9)))
        total, words = analyser.path(text)
        assert (total, len(words)) == all_paths(analyser, text)
        assert "".join(w for w, *_ in words) == text


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("1 as pos", "doc_id", "text", "'x' as surface")


def lexicon(spark, rows=LEXICON):
    return spark.createDataFrame(rows, "surface string, pos_major string, pos_sub string, cost int")


def test_tokens_have_their_places(spark):
    texts = ["東京都に行く。 新燃料電池！\n\n京都 x9", "", None, "a  b\tc\n", "。。", "東京都に" * 500]
    found = lattice.analysed(frame(spark, list(enumerate(texts))), lexicon(spark)).collect()
    for d, text in enumerate(texts):
        mine = sorted((r.sent_id, r.pos, r.start, r.end, r.surface) for r in found if r.doc_id == d)
        assert all(text[a:b] == w for _, _, a, b, w in mine)
        sentences = [x.strip() for x in re.split(T.SENTENCE_END, text or "") if x.strip()]
        for s, sentence in enumerate(sentences):
            assert "".join(w for i, *_, w in mine if i == s) == sentence
        assert {m[0] for m in mine} == set(range(len(sentences)))
    assert [(r.surface, r.pos_major, r.known) for r in sorted((r for r in found if r.doc_id == 0), key=lambda r: (r.sent_id, r.pos))] == [
        ("東京", "noun", True), ("都", "suffix", True), ("に", "particle", True), ("行く", "verb", True), ("新", "prefix", True), ("燃料電池", "noun", True),
        ("京都", "noun", True), (" ", "space", True), ("x", "noun", False), ("9", "noun", False),
    ]
    words = {r.doc_id: r.words for r in lattice.content_words(lattice.analysed(frame(spark, [(0, texts[0])]), lexicon(spark)), ("京都",)).collect()}
    assert words == {0: ["東京", "行く", "燃料電池", "x", "9"]}


def test_links_decide_between_words(spark):
    entries = [("ab", "noun", "general", 500), ("a", "prefix", "general", 100), ("b", "noun", "general", 400)]
    cut = lambda links: [r.surface for r in lattice.analysed(frame(spark, [(1, "ab")]), lexicon(spark, entries), spark.createDataFrame(links, "before string, after string, cost int")).orderBy("pos").collect()]
    assert cut([("x", "y", 1)]) == ["ab"]  # equal costs: fewer words
    assert cut([("prefix", "noun", -1)]) == ["a", "b"] and cut([("prefix", "noun", 1)]) == ["ab"]


def valid(spark, words):
    df = spark.createDataFrame([(w,) for w in words] or [("x",)], "w string")
    return {r.w for r in df.filter(T.is_valid_term(F.col("w"))).select("w").collect()}


def plain_noun_spans(analyser, text, good):
    found, offset = set(), 0
    for surface, major, *_ in analyser.tokens(text):
        if major == "noun" and len(surface) >= 2:
            if surface in good:
                start = text.find(surface, offset)
                if start != -1:
                    found.add((surface, start, start + len(surface)))
                    offset = start + len(surface)
                else:
                    offset += len(surface)
        else:
            offset += len(surface)
    return found


def plain_ngrams(analyser, text, good=None):
    out = set()
    for a, b in lattice.sentence_spans(text):
        run = []
        for surface, major, _, _, start, end in [*analyser.tokens(text[a:b]), ("", "end", "", True, 0, 0)]:
            if major in ("noun", "prefix"):
                run.append((surface, a + start, a + end))
                continue
            for n in range(2, min(6, len(run)) + 1):
                out |= {("".join(w for w, *_ in run[i : i + n]), run[i][1], run[i + n - 1][2]) for i in range(len(run) - n + 1)}
            run = []
    return out if good is None else {x for x in out if x[0] in good}


def test_places_of_nouns_and_runs(spark):
    texts = ["新燃料電池と燃料電池、燃料。12 12燃料電池 the the燃料", "東京東京 東京都東", None, "", "x" * 3000 + "燃料"]
    analyser = lattice.Analyser(LEXICON)
    nouns = valid(spark, {w for t in texts for w, major, *_ in analyser.tokens(t or "") if major == "noun"})
    got = Counter((r.doc_id, r.term, r.start, r.end) for r in lattice.noun_spans(frame(spark, list(enumerate(texts))), lexicon(spark)).collect())
    assert got == Counter((d, *s) for d, t in enumerate(texts) for s in plain_noun_spans(analyser, t or "", nouns))
    grams = valid(spark, {g for t in texts for g, *_ in plain_ngrams(analyser, t or "")})
    tokens = lattice.analysed(frame(spark, list(enumerate(texts))), lexicon(spark))
    got = Counter((r.doc_id, r.term, r.start, r.end) for r in lattice.ngram_spans(tokens).collect())
    want = Counter((d, *s) for d, t in enumerate(texts) for s in plain_ngrams(analyser, t or "", grams))
    assert got == want and all(texts[d][a:b] == w for d, w, a, b in got)


def test_queries_over_documents(spark):
    from termweave.deep_queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    java = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).groupBy("w").count().collect()
    counts = {r.w: r["count"] for r in java if r["count"] >= 5}
    total = sum(counts.values())
    number = lambda w: bool(re.fullmatch("[0-9]+", w))
    entries = [(w, "noun" if number(w) or len(w) > 3 else "particle", "general", int(round(-100 * log(n / total)))) for w, n in counts.items()]
    analyser = lattice.Analyser(entries)
    tokens = {d: [x for a, b in lattice.sentence_spans(t) for x in analyser.tokens(t[a:b])] for d, t in docs.items()}
    got = {r.doc_id: (r.tokens, r.unknown, r.content) for r in QUERIES["lattice_words"](spark, SF).collect()}
    content = lambda xs: sum(x[1] in lattice.CONTENT for x in xs) or None
    assert got == {d: (len(xs), sum(not x[3] for x in xs), content(xs)) for d, xs in tokens.items() if xs}

    def frequency(spans):
        each = defaultdict(Counter)
        for d in docs:
            each[d].update(term for term, *_ in spans(d))
        out = Counter()
        for c in each.values():
            out.update({t: n for t, n in c.items() if n >= 2})
        return out

    good = valid(spark, {w for t in docs.values() for w, major, *_ in analyser.tokens(t) if major == "noun" and len(w) > 1})
    assert {r.term: r.frequency for r in QUERIES["noun_places"](spark, SF).collect()} == frequency(lambda d: plain_noun_spans(analyser, docs[d], good))
    grams = valid(spark, {g for t in docs.values() for g, *_ in plain_ngrams(analyser, t)})
    assert {r.term: r.frequency for r in QUERIES["ngram_places"](spark, SF).collect()} == frequency(lambda d: plain_ngrams(analyser, docs[d], grams))


def test_terms_are_valid_by_their_classes(spark):
    entries = [*LEXICON, ("図", "noun", "general", 100), ("段", "suffix", "counter", 100), ("装置", "noun", "general", 200), ("もの", "noun", "dependent", 100), ("は", "particle", "general", 50), ("です", "auxiliary", "general", 50), ("性", "suffix", "general", 100), ("・", "symbol", "general", 10), ("＝", "symbol", "general", 10)]
    good = ["燃料電池装置", "新燃料", "東京・京都", "燃料性", "SFOC", "6DE-18"]
    bad = ["図燃料電池", "段燃料電池", "燃料は電池", "燃料もの", "東京に行く", "燃料です", "燃料＝電池", "ab cd燃料", "電池"]
    rows = [(t, i) for i, t in enumerate(good + bad[:-1] + ["ab"])]
    got = {(r.term, r.n) for r in lattice.valid_terms(spark.createDataFrame(rows, "term string, n int"), lexicon(spark, entries)).collect()}
    assert got == {(t, i) for t, i in rows if t in good}


def test_tokens_leave_a_task_as_they_come(spark):
    """A batch of texts is taken apart a few rows at a time, and all rows come; the lexicon is one table of words."""
    lexicon = spark.createDataFrame([("word", "noun", "general", 100), ("word", "verb", "general", 90), ("wo", "noun", "general", 200)], "surface string, pos_major string, pos_sub string, cost int")
    entries = lattice.shared(lexicon)
    assert entries.value[0] == {"word": (("noun", "general", 100), ("verb", "general", 90)), "wo": (("noun", "general", 200),)}
    texts = ["word word. word\nword"] * 300 + [None, "", "word " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sizes = [sum(len(t or "") for t in b.column(1).to_pylist()) for b in lattice._slices(pa.RecordBatch.from_pydict({"d": list(range(400)), "t": ["x" * 1000] * 399 + [None]}))]
    assert sum(sizes) == 399_000 and max(sizes) <= lattice.CHARACTERS
    got = lattice.analysed(docs, lexicon).groupBy("doc_id").count().collect()
    want = {i: sum(1 for _ in lattice._sentence_tokens(lattice.Analyser(*entries.value), t)) for i, t in enumerate(texts) if t}
    assert {r.doc_id: r["count"] for r in got} == want


def test_many_stretches_have_the_paths_of_each(spark):
    """All at once as one by one; a hash that stands for another word doesn't change a path, and long stretches and links go alone."""
    r = random.Random(9)
    for links in ([], [("noun", "verb", -40)]):
        for _ in range(12):
            entries = [("".join(r.choice("ab1あ東") for _ in range(r.randrange(1, 5))), r.choice(("noun", "verb", "prefix")), "general", r.randrange(-50, 4000)) for _ in range(r.randrange(25))]
            analyser = lattice.Analyser(entries, links)
            together = lattice.Together(analyser)
            if len(together.names) > 1 and not links:
                together.names[0], together.names[1] = together.names[1], together.names[0]
            stretches = sorted({"".join(r.choice("ab1あ東x・") for _ in range(r.randrange(1, r.choice((9, 80))))) for _ in range(40)} | {""})
            paths = together.paths(stretches)
            for s, a, b in zip(stretches, paths.first, paths.first[1:]):
                got = [(int(n), paths.classes[m], bool(k)) for n, m, k in zip(paths.size[a:b], paths.major[a:b], paths.known[a:b])]
                assert got == [(len(w), m, k) for w, m, _, k in analyser.path(s)[1]]


def test_counts_are_taken_where_a_document_stands(spark):
    """The sums of tokens, nouns and runs are those of the rows, also where a document comes in several; no token is shuffled."""
    from termweave.operators import terms

    texts = ["新燃料電池と燃料電池、燃料。12 12燃料電池 the the燃料", "東京東京 東京都東。東京都東 東京 x燃料電池x燃料電池", None, "", " \n", "x" * 300 + "燃料 燃料", "は。に"]
    for ids in (range(7), (1, 1, 2, 2, 3, 3, None)):
        docs = frame(spark, list(zip(ids, texts)))
        tokens = lattice.analysed(docs, lexicon(spark))
        rows = tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_if(~F.col("known")).alias("unknown"))
        want = rows.join(lattice.content_words(tokens).select("doc_id", F.size("words").cast("long").alias("content")), "doc_id", "left")
        assert sorted(map(str, lattice.token_counts(docs, lexicon(spark)).collect())) == sorted(map(str, want.collect()))
        nouns, runs = lattice.noun_frequency(docs, lexicon(spark)), lattice.ngram_frequency(docs, lexicon(spark))
        assert sorted(nouns.collect()) == sorted(terms.candidate_frequency(lattice.noun_spans(docs, lexicon(spark))).collect()) != []
        assert sorted(runs.collect()) == sorted(terms.candidate_frequency(lattice.ngram_spans(tokens)).collect()) != []
    docs = frame(spark, list(enumerate(texts)))
    for found in (lattice.noun_frequency(docs, lexicon(spark)), lattice.ngram_frequency(docs, lexicon(spark))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(term" in plan and "hashpartitioning(doc_id" not in plan
