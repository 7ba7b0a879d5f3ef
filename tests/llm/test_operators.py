"""Each operator against a plain version, and over awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from termweave.llm import components, decontamination, license_scan, ngram_join, packing, pii, quality_classifier, quality_rules, substring_dedup, toxicity, url_filter

WS = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(None, "null id"), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "same row"), (5, "same row"), (6, "MIT License " * 3), (7, "word " * 30_000), (8, "é" * 50), (9, "x" * 3_000)]


def frame(spark, rows):
    """doc_id and text, with columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("1 as chunk", "'a' as w", "doc_id", "2 as bucket", "text", "'b' as `seed`", "array(1) as spans", "3 as `left`", "'c' as kept", "4 as `row`", "5 as carried", "6 as t")


def corpus(n=160, seed=3):
    """Random texts with exact copies, near copies, shared passages and repeated windows."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "of", "and"]
    make = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, out = make(60), []
    for i in range(n):
        kind = i % 8
        if kind == 1 and out:
            words = list(out[r.randrange(len(out))])
        elif kind in (2, 3) and out:
            words = list(out[r.randrange(len(out))])
            for _ in range(max(1, len(words) // r.choice((15, 40, 90)))):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
        elif kind == 4:
            words = make(r.randrange(5, 60)) + passage[r.randrange(20) :] + make(r.randrange(40))
        elif kind == 5:
            words = make(12) * r.randrange(2, 5)
        elif kind == 6:
            words = make(r.randrange(0, 6))
        else:
            words = make(r.randrange(10, 200))
        out.append(words)
    return [(i, r.choice((" ", "\n", "  ")).join(w)) for i, w in enumerate(out)]


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# 1


def test_license_places_are_all_of_the_phrases(spark):
    rows = [(1, "The MIT License, mit license! Apache\nLicense"), (2, "general public general public license"), (3, "mitlicense mit-license mit_license"), *EDGES]
    found = license_scan.scan_licenses(frame(spark, rows)).select("doc_id", "n_words", F.transform("places", lambda x: F.struct(x["first"], x["label"])).alias("p"))
    got = Counter((r.doc_id, r.n_words, tuple(sorted(map(tuple, r.p)))) for r in found.collect())

    def plain(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), tuple(sorted((i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()))

    assert got == Counter((d, *plain(t)) for d, t in rows)


def test_license_templates_are_found_with_gaps_and_changes(spark):
    label, text = license_scan.TEMPLATES[3]
    changed = text.replace("source and binary", "source or object").upper()
    rows = [(1, "noise " * 20 + changed + " noise" * 20), (2, text[: len(text) // 4]), (3, "the of and this is to the following")]
    got = {r.doc_id: [s.label for s in r.spans] for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: [label], 2: [], 3: []}


@pytest.mark.parametrize("number", range(len(license_scan.TEMPLATES)))
def test_a_template_has_its_own_label(number):
    label, text = license_scan.TEMPLATES[number]
    automaton = license_scan.Automaton(license_scan.TEMPLATES, license_scan.PHRASES)
    (hit,) = automaton.scan(license_scan.words("x y " + text + " z"))[1]
    n = len(license_scan.words(text))
    assert (hit.label, hit.first, hit.last, hit.cover) == (label, 2, n + 1, 1.0)


def test_a_repeated_phrase_does_not_break_a_chain():
    phrase = "one two three four five"
    template = f"{phrase} alpha beta gamma delta {phrase} eta theta iota kappa {phrase} end"
    automaton = license_scan.Automaton([("t", template)])
    text = template.replace("gamma", "CHANGED").replace("iota", "other")
    (hit,) = automaton.scan(license_scan.words(text))[1]
    n = len(license_scan.words(text))
    assert (hit.first, hit.last) == (0, n - 1) and hit.cover >= 0.75


def test_matching_statistics_are_longest_matches():
    r = random.Random(1)
    templates = [("t", " ".join(r.choice("abc") for _ in range(30))) for _ in range(3)]
    automaton = license_scan.Automaton(templates)
    text = [r.choice("abcd").encode() for _ in range(300)]
    found = {i: n for i, n, _ in automaton.matches(text)}
    whole = [" " + t + " " for _, t in templates]
    for i in range(len(text)):
        longest = max((n for n in range(i + 2) if any(" " + b" ".join(text[i + 1 - n : i + 1]).decode() + " " in w for w in whole) or n == 0), default=0)
        assert found.get(i, 0) == longest


# 2


def test_url_rules(spark):
    urls = ["http://A.Org/x", "https://example.org/es/1", "http://x.example.org/en/12?q", "http://a.com/fr/", "http://com/de/1#x", "http://org", "no url", None, "http://b.net/en/1://c", "http://spam.net/de/1", "x://org/", "http://example.orgs/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("tokens", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judge(df).collect()}

    def plain(url):
        m = re.match(r"(?s)[^:]*(?::(?!//)[^:]*)*://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in url_filter.BASE_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        return host, path, best and best.name, best and best.verdict

    assert got == {i: plain(u) for i, u in enumerate(urls)}


def test_mined_url_rules(spark):
    labels = [(f"http://pills{i}.net/buy/{i}", "block") for i in range(40)] + [(f"http://site{i}.net/en/{i}", "allow") for i in range(60)]
    labels = spark.createDataFrame(labels, "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://new.net/buy/9"), (2, "http://new.net/en/9"), (3, None)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in url_filter.judge(pages, labels=labels).collect()}
    many = pages.union(pages.filter("page_id < 3")).union(spark.createDataFrame([(4, "http://new.net/buy/8"), (5, "x://q/" + "long" * 40 + "/a" * 50)], pages.schema))
    assert [rows_of(url_filter.judge(many, labels=labels, hot_share=n), "page_id", "verdict") for n in (1, 4, 10_000)] == [Counter({(1, "block"): 2, (2, "allow"): 2, (3, "allow"): 1, (4, "block"): 1, (5, "allow"): 1})] * 3
    assert got[1] == ("block", ["path=buy"]) and got[2][0] == "allow" and got[3] == ("allow", None)


def test_urls_that_share_many_tokens(spark):
    deep = "/".join("abcdefghij"[i % 10] * (i // 10 + 1) for i in range(30))
    labels = [(f"http://a{i}.net/{deep}/x{i % 2}", "block" if i % 10 else "allow") for i in range(40)] + [(f"http://b{i}.org/p/q{i}", "allow") for i in range(200)]
    labels = spark.createDataFrame(labels, "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://z.net/" + deep), (2, "http://z.net/aa"), (3, "http://z.org/p/r"), (4, "ftp://z.de")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in url_filter.judge(pages, rules=(), labels=labels).collect()}
    assert {i: v for i, (v, _) in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert set(got[2][1]) == {"host=net", "path=aa", "top=net"} and "path=jjj" in got[1][1]


def plain_rules(labels, support, confidence):
    """Token sets with their verdict, confidence and support: all subsets of all URLs' tokens, less those that a part makes needless."""
    rows = [(set(t), v) for t, v in labels]
    sets = {frozenset(c) for t, _ in rows for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    rules = {}
    for s in sets:
        inside = [v for t, v in rows if s <= t]
        for v in set(inside):
            if inside.count(v) >= support * len(rows) and inside.count(v) >= confidence * len(inside):
                rules[s, v] = (inside.count(v) / len(inside), inside.count(v) / len(rows))
    return {(s, v): x for (s, v), x in rules.items() if not any(p < s and w == v and y[0] >= x[0] for (p, w), y in rules.items())}


def test_mined_rules_are_all_rules(spark):
    r = random.Random(8)
    labels = [(sorted(r.sample("abcdefg", r.randrange(0, 6))), r.choice(("block", "allow", "allow"))) for _ in range(80)] + [(["a", "x", "y"], "block")] * 9
    tokens, rules = url_filter.mine(spark.createDataFrame(labels, "tokens array<string>, verdict string"), 0.1, 0.6)
    of = {}
    for x in tokens.collect():
        of.setdefault(x["class"], []).append(x.token)
    # A rule of classes is a rule for each choice of their tokens.
    got = {(frozenset(c), x.verdict): (round(x.confidence, 6), round(x.support, 6)) for x in rules.collect() for c in product(*(of[k] for k in x.classes))}
    labels = [(t, v) for t, v in labels if t]
    assert got == {k: (round(a, 6), round(b, 6)) for k, (a, b) in plain_rules(labels, 0.1, 0.6).items()} and got


def test_urls_without_labels_and_titles(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "<title>ab###</title>"), (2, "http://b.com/fr/", "<title>abc def ghi</title>"), (3, None, None), (4, "http://c.net", "<title></title>")], "page_id long, url string, html string")
    assert {tuple(r) for r in url_filter.by_title(pages).collect()} == {("http://a.net/x", "block"), ("http://b.com/fr/", "allow")}
    none = url_filter.by_title(pages.limit(0))
    for labels in (None, none):
        assert {(r.page_id, r.verdict, r.mined) for r in url_filter.judge(pages, labels=labels).collect()} == {(i, "allow", None) for i in (1, 2, 3, 4)}


# 3


def plain_dedup(rows, k):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        words = WS.findall(rows[i][1] or "")
        gone = set()
        for s in range(len(words) - k + 1):
            window = tuple(words[s : s + k])
            if window in seen:
                gone.update(range(s, s + k))
            seen.add(window)
        out.append((rows[i][0], len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return Counter(out)


@pytest.mark.parametrize(("k", "period", "size"), [(20, 13, 8_000_000), (20, 7, 2_000), (13, 13, 500)])
def test_substring_dedup(spark, k, period, size):
    rows = corpus() + [(1000 + (d or 0) if d is not None else None, t) for d, t in EDGES]
    got = substring_dedup.dedup(frame(spark, rows), k, period, chunk_bytes=size)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == plain_dedup(rows, k)


@pytest.mark.parametrize(("period", "cover"), substring_dedup.COVERS.items())
def test_covers_hold_every_distance(period, cover):
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# 4


def plain_overlaps(docs, items):
    words = lambda t: [w for w in re.split(decontamination.BREAK, (t or "").lower()) if w]
    span, out = decontamination.SPAN, {}
    for d, t in docs:
        dw = words(t)
        for i, u in items:
            iw = words(u)
            n = span if len(iw) >= span else len(iw)
            if n < decontamination.SHORT:
                continue
            for mask in decontamination.MASKS + decontamination.LIGHT if n == span else ["1" * n]:
                for p in range(len(dw) - n + 1):
                    for q in range(len(iw) - n + 1):
                        if all(dw[p + j] == iw[q + j] for j, c in enumerate(mask) if c == "1"):
                            before = min(p, q, decontamination.OVERLAP - n)
                            same = [a == b for a, b in zip(dw[p - before : p - before + before + decontamination.OVERLAP], iw[q - before : q + decontamination.OVERLAP])]
                            size = min(len(same), decontamination.OVERLAP)
                            shares = [sum(same[s : s + size]) * 100 // size for s in range(len(same) - size + 1)]
                            if max(shares) >= decontamination.MIN_SHARE:
                                begin = next(s for s, x in enumerate(shares) if x >= decontamination.MIN_SHARE)
                                k, best, first = out.get((d, i), (0, 0, 10**9))
                                out[d, i] = k + 1, max(best, *shares), min(first, p - before + begin)
    return {(d, i, *v) for (d, i), v in out.items()}


@pytest.mark.parametrize(("block", "bits"), [(200_000, 1 << 21), (40, 1 << 21), (40, 64)])
def test_decontamination(spark, block, bits):
    r = random.Random(5)
    make = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate((40, 25, 14, 12, 8, 5, 3))] + [(90, None), (91, ""), (92, "same item is here twice in the list and so it is found twice"), (93, "Same item is here twice: in the list and so it is found twice")]
    docs = []
    for i, t in items:
        w = (t or "").split()
        for changed in (0, 1, 3, 6):
            x = list(w)
            for j in r.sample(range(len(x)), min(changed, len(x))):
                x[j] = "CHANGED"
            docs.append((len(docs), " ".join(make(15) + x + make(9))))
        docs.append((len(docs), " ".join(make(5) + w[3:-3])))
    docs += [(None, None), (800, ""), (801, "too short")]
    # Repeated documents, a passage that many share, items with a common beginning and a very long text.
    docs += [*docs[-2:], *((1000 + k, docs[0][1]) for k in range(20)), (2000, " ".join([*make(4000), items[0][1], *make(4000)]))]
    items += [(94, items[0][1] + " one more end"), (95, items[0][1] + " another end")]
    got = decontamination.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=block, filter_seeds=bits)
    assert set(rows_of(got, "doc_id", "item_id", "n_hits", "share", "first_word")) == plain_overlaps(docs, items)


def allowed(size):
    return size * (100 - decontamination.MIN_SHARE) // 100


def test_no_stretch_is_without_a_seed():
    span, masks = decontamination.SPAN, decontamination.MASKS + decontamination.LIGHT
    assert all(len(m) == span for m in masks)
    for size in range(span, decontamination.OVERLAP + 1):
        places = [{o + i for i, c in enumerate(m) if c == "1"} for m in masks for o in range(size - span + 1)]
        for changed in combinations(range(size), allowed(size)):
            assert any(p.isdisjoint(changed) for p in places), (size, changed)


def plain_shares(docs, items):
    """Without seeds: the best share of each two texts, over all ways to lay them side by side."""
    out = {}
    for d, t in docs:
        for i, u in items:
            a, b = t.split(), u.split()
            for shift in range(-len(b), len(a)):
                same = [x == y for x, y in zip(a[max(shift, 0) :], b[max(-shift, 0) :])]
                size = min(len(same), decontamination.OVERLAP)
                if size >= decontamination.SPAN:
                    share = max(sum(same[s : s + size]) for s in range(len(same) - size + 1)) * 100 // size
                    if share >= decontamination.MIN_SHARE:
                        out[d, i] = max(share, out.get((d, i), 0))
    return out


def test_decontamination_finds_all_that_share_enough(spark):
    r = random.Random(11)
    make = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(n)]
    sizes = [*range(12, 21), 35]
    items = [(i, " ".join(make(n))) for i, n in enumerate(sizes)]
    docs = []
    for (_, t), n in zip(items, sizes):
        w = t.split()[:20]
        for k in [allowed(len(w))] * 12 + [allowed(len(w)) + 1] * 3:
            x = list(w)
            for j in r.sample(range(len(x)), k):
                x[j] = "changed"
            docs += [(len(docs), " ".join(make(13) + x + make(9))), (len(docs) + 1, " ".join(x))]
    want = plain_shares(docs, items)
    # What the three masks alone leave out is in the test.
    heavy = decontamination.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), light=())
    assert set(rows_of(heavy, "doc_id", "item_id")) < set(want)
    got = decontamination.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert set(rows_of(got, "doc_id", "item_id", "share")) == {(*pair, share) for pair, share in want.items()}


def test_decontamination_runs_no_python(spark):
    docs = frame(spark, corpus(8))
    plan = decontamination.overlaps(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5 and 7


def labelled(spark, n=600):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(20, 80))]
        toxic, bad = r.random() < 0.3, r.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(("scoundrel", "nitwit", "halfwit")))
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_classifiers_on_held_out_rows(spark, name):
    rows, labels = labelled(spark)
    docs = frame(spark, rows + [(10_000 + (d or 0) if d is not None else None, t) for d, t in EDGES])
    usable = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    if name == "toxic":
        scored = toxicity.score(docs, toxicity.train(docs, labels, usable))
    else:
        scored = quality_classifier.score(docs, quality_classifier.train(docs, labels, usable))
    got = scored.collect()
    assert len(got) == len(rows) + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [(r.score >= 0.3, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_classifiers_without_labels(spark):
    docs, labels = frame(spark, EDGES), spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels, every)).collect()} == {0.5}
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.train(docs, labels, every)).collect()} == {0.5}


def plain_ftrl(rows, dimensions, epochs):
    """One coordinate at a time, as published: z, n and the weight that follows from them."""
    z, n = [0.0] * dimensions, [0.0] * dimensions

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for at, label in rows:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - s * w[i]
                n[i] += g * g
    return [weight(i) for i in range(dimensions)]


def test_ftrl():
    r = random.Random(5)
    rows = [(np.array(sorted({0, *r.sample(range(1, 40), 6), *([40] if y else [])})), y) for y in (r.randrange(2) for _ in range(200))]
    got = toxicity.fit(rows, 50, 3)
    assert np.allclose(got, plain_ftrl(rows, 50, 3)) and got[40] > 0 and (got == 0).sum() > 5


def test_calibration_is_the_best_fit():
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(300), r.normal(size=(300, 2)) * (1, 9)])
    y = (x @ (0.3, 1.5, -0.1) + r.normal(size=300) > 0).astype(float)
    scale, w = quality_classifier.calibrate(x, y)

    def loss(v):
        p = 1 / (1 + np.exp(-(x / scale) @ v))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 0.005 * (v @ v)

    assert all(loss(w) < loss(w + d) for d in r.normal(size=(200, 3)) * 0.05)


def test_query_columns_of_classifiers(spark):
    from pathlib import Path

    from termweave.llm import queries

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    for name, rest, of in (("op5_toxicity", 2, 4), ("op7_quality_classifier", 0, 5)):
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert len(rows) == 200
        for x in rows:
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % of == rest) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)


# 6


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_pii_base_spans(spark):
    r = random.Random(4)
    parts = ["a.b@c.de", "x@y", "a@b.c-x@y.com", "@", "a@b.c_d@e.fr", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "++49 30 1234567", ".", "..", "-", " ", "é", "日本", "\n", "0", "007.0.0.1", "+4.5.6.7.8.9.0.1.2"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))) for i in range(500)] + EDGES + [(700, "9" * 2_000), (701, "1." * 20_000), (702, "a@" * 20_000), (703, "+1" * 9_000)]
    got = pii.scan(frame(spark, rows)).select("doc_id", F.filter("spans", lambda s: s["kind"].isin(*pii.BASE)).alias("s"))
    assert Counter((x.doc_id, tuple((s.kind, s.start, s.end) for s in x.s)) for x in got.collect()) == Counter((d, tuple(plain_spans(t or ""))) for d, t in rows)


def test_pii_checksums_context_and_masking(spark):
    text = "bank account DE89370400440532013000 and token = 0123456789abcdef0123456789abcdef, not DE89370400440532013001, mail a@b.com"
    (row,) = pii.scan(frame(spark, [(1, text)])).collect()
    assert [s.kind for s in row.spans] == ["email", "iban", "secret"]
    assert row.redacted == "bank account <IBAN> and token = <SECRET>, not DE89370400440532013001, mail <EMAIL>"
    assert pii.masked(frame(spark, EDGES)).select("doc_id", "chunk").count() == len(EDGES)


def test_ibans_end_where_their_country_says():
    found = lambda t: [(k, t[a:b]) for k, a, b, _ in pii.find_spans(t)]
    assert found("iban DE89 3704 0044 0532 0130 00 AND MORE") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("DE89370400440532013000 1234") == [("iban", "DE89370400440532013000")]
    assert found("GB82WEST12345698765432, NO9386011117947") == [("iban", "GB82WEST12345698765432"), ("iban", "NO9386011117947")]
    for text in ("DE8937040044053201300", "DE893704004405320130001", "XX89370400440532013000", "xDE89370400440532013000", "DE88370400440532013000"):
        assert found(text) == []


def test_context_is_whole_words():
    found = lambda t: [k for k, *_ in pii.find_spans(t)]
    number = "(555) 123-4567"
    assert found("call " + number) == found("Phones: " + number) == found("telephone " + number) == ["national_phone"]
    assert found("locally " + number) == found("recall " + number) == found("x" * 50 + "call " + number) == []
    assert found("m" * 3 + "phone" + "." * 34 + number) == []  # the window begins inside a word
    assert found("monkey " + "0123456789abcdef" * 2) == [] and found("api_key=" + "0123456789abcdef" * 2) == ["secret"]


def test_pii_is_linear_in_the_text():
    for text in ("x" * 1_000_000, "9" * 1_000_000, "a@" * 300_000, "+1" * 300_000, "1." * 300_000):
        pii.find_spans(text)


def test_pii_digest(spark):
    from termweave.llm.pii import digest

    (row,) = digest(frame(spark, [(1, "x 1.2.3.4 a@b.c")])).collect()
    assert (row.n_email, row.n_ip, row.base_sha256) == (1, 1, hashlib.sha256(b"email:10:15,ip:2:9").hexdigest())


# 8


@pytest.mark.parametrize("open_windows", [1, 32])
def test_packing_round_trip(spark, open_windows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t) for i, (_, t) in enumerate(corpus(60))] + [(500, None), (501, ""), (502, "a <|endoftext|> b"), (503, " " * 5000), (504, "word " * 4000), (505, "é日本\n")]
    got = packing.pack(frame(spark, rows).repartition(5, "doc_id"), path, open_windows=open_windows).collect()
    t = Tokenizer.from_file(path)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in rows}
    pieces, sequences = {}, {}
    for p in got:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        pieces.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, x in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at and length > 0
            at += length
        assert at == len(x)
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(sum(n for _, n in x) < 1024 for x in sequences.values()) <= 1


def test_both_encoders_give_the_same_ids(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("no test tables")
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        slow = encoder.slow.encode(row.text or "", add_special_tokens=False).ids
        assert encoder(row.text).tolist() == slow


# 9


def plain_measures(text):
    words = WS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WS.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_quality_measures(spark):
    rows = corpus() + EDGES + [(900, "a b\na b\n\n \x0b\x0c\r\na b\n#x|<>"), (901, "a b c d e f g h " * 2), (902, "the of and " * 30 + "!!")]
    got = quality_rules.apply_rules(frame(spark, rows))
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == Counter((d, *plain_measures(t)) for d, t in rows)
    assert all(not (r.base_failed and r.kept) for r in got.collect())
    kept = quality_rules.kept_rows(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == got.filter("kept").count()


# 10


def plain_join(rows, percent=85, k=4):
    sets = []
    for _, t in rows:
        w = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "hub_from", "named"), [(8_000_000, 12, 256), (3_000, 2, 0), (1_500, 1000, 256), (4_000, 4, 1)])
def test_ngram_join(spark, monkeypatch, size, hub_from, named):
    monkeypatch.setattr(ngram_join, "LINKED_BY_NAME", named)
    rows = [r for r in corpus(240, seed=9)] + [(1000 + (d or 0) if d is not None else None, t) for d, t in EDGES]
    got = ngram_join.join(frame(spark, rows), chunk_bytes=size, hub_from=hub_from)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == plain_join(rows)


def test_ngram_join_in_a_large_group_of_near_copies(spark):
    r = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(words)))
    got = ngram_join.join(frame(spark, rows), chunk_bytes=4_000, hub_from=3)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == plain_join(rows)


def shuffled_mb(spark, run) -> float:
    """What the stages of run() write for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    before = written()
    run()
    return sum(n for key, n in written().items() if key not in before) / 1e6


def test_ngram_join_sends_no_set_to_every_chunk_for_a_common_phrase(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RANKED", 1)  # as if there were so many phrases that most are outside the order
    r = random.Random(12)
    phrases = [" ".join(f"p{i}w{j}" for j in range(8)) for i in range(60)]
    rows = [(i, " ".join([*(f"w{r.randrange(10**9)}" for _ in range(60)), *r.sample(phrases, 4)])) for i in range(1200)]
    rows += [(2000 + i, rows[i][1]) for i in range(0, 40, 4)]
    df = frame(spark, rows)
    got = []
    mb = shuffled_mb(spark, lambda: got.append(rows_of(ngram_join.join(df, chunk_bytes=12_000), "doc_id", "n_shingles", "component_id")))
    assert got[0] == plain_join(rows)
    assert mb < 1.3 * sum(len(t) for _, t in rows) / 1e6


def test_prefix_tree_finds_every_link():
    r = random.Random(6)
    base = list(range(1, 300))
    sets = [np.array(sorted(r.sample(base, r.randrange(1, 40))), np.uint64) for _ in range(60)]
    sets += [np.unique(np.append(s[r.randrange(3) :], np.uint64(r.randrange(1, 300)))) for s in sets for _ in range(2)]
    tree = ngram_join.PrefixTree(sets, [s.astype(">u8").tobytes() for s in sets])
    for s in sets:
        linked = {i for i, x in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= 60 * len(np.union1d(s, x))}
        assert set(tree.probe(s, list(range(len(sets))), 60)) == linked


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (None, 7)]
    got = components.components(spark.createDataFrame(links, "node long, other long"))
    assert rows_of(got, "node", "component") == Counter([(i, 0) for i in range(41)] + [(i, 100) for i in (100, 101, 102)])


# All of them


def test_empty_tables(spark):
    docs = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    assert license_scan.scan_licenses(docs).count() == 0
    assert url_filter.judge(pages).count() == 0
    assert substring_dedup.dedup(docs).count() == 0
    assert decontamination.overlaps(docs, items).count() == 0
    assert decontamination.overlaps(frame(spark, EDGES), items).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).count() == 0
    assert pii.scan(docs).count() == 0
    assert quality_classifier.score(docs, quality_classifier.train(docs, labels, F.lit(True))).count() == 0
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert quality_rules.apply_rules(docs).count() == 0
    assert ngram_join.join(docs).count() == 0


def test_one_of_each_group(spark):
    text = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (None, text("a")), (3, text("c")), (3, text("c")), (4, text("c") + " end"), (None, text("d")), (None, text("d")), (5, None), (5, None), (6, ""), (6, ""), (None, None)]
    df = frame(spark, rows)
    got = ngram_join.one_of_each(df, 5, 80)
    assert got.columns == df.columns
    assert rows_of(got, "doc_id", "text") == Counter([(1, text("a")), (2, text("b")), (3, text("c")), (None, text("d")), (5, None), (5, None), (6, ""), (6, ""), (None, None)])
    assert ngram_join.one_of_each(frame(spark, []), 5, 80).count() == 0
