"""The two classifiers' queries as a whole against plain versions, over the smallest tables and over very long texts."""

import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from termweave.llm import license_scan, quality_classifier, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    return docs, labels


def remainder(d, of):
    return zlib.crc32(str(d).encode()) % of


# 5


def test_coordinates_stand_for_words_and_pairs():
    """A coordinate is that of one word, one beginning, one pair or one pair with a word between, whatever the text."""
    seen, texts = {}, ["Abcdef ghij, abcdefx kl.", "kl ghij abcdef", "x y x y z", "", "one", "ABCDEF!ghij"]
    for text in texts:
        w = license_scan.words(text)
        keys = [("word", x) for x in w] + [("stem", x[:4]) for x in w] + [("pair", *p) for p in zip(w, w[1:])] + [("skip", *p) for p in zip(w, w[2:])]
        at = toxicity.features(text).tolist()
        assert len(at) == len(keys)
        for k, a in zip(keys, at):
            assert seen.setdefault(k, a) == a and 0 < a < toxicity.DIMENSIONS
    assert len(set(seen.values())) == len(seen)


def test_op5_as_a_whole(spark, tables):
    docs, labels = tables
    known = {}
    for r in labels:
        if r.doc_id in docs and r.toxic is not None and remainder(r.doc_id, 4) != 2:
            known[r.doc_id] = max(known.get(r.doc_id, 0), int(r.toxic))
    rows = sorted((d, docs[d]) for d in known)
    z, n, p = {}, {}, toxicity

    def weight(i):
        if abs(z.get(i, 0.0)) <= p.L1:
            return 0.0
        return -(z[i] - math.copysign(p.L1, z[i])) / ((p.BETA + math.sqrt(n[i])) / p.ALPHA + p.L2)

    sets = [sorted({0, *p.features(docs[rows[i][0]]).tolist()}) for i in np.random.default_rng(0).permutation(len(rows))]
    marks = [known[rows[i][0]] for i in np.random.default_rng(0).permutation(len(rows))]
    for _ in range(p.EPOCHS):
        for at, y in zip(sets, marks):
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - y
            for i, wi in zip(at, w):
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - s * wi, n.get(i, 0.0) + g * g
    weights = {i: w for i in z if (w := weight(i))}
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        score = 1 / (1 + math.exp(-(weights.get(0, 0.0) + sum(weights.get(i, 0.0) for i in set(p.features(text).tolist())))))
        assert got[d].score == pytest.approx(score, abs=1e-5) and got[d].held_out == (remainder(d, 4) == 2) and got[d].predicted == (got[d].score >= 0.3)


# 7


def plain_features(data, good, bad):
    def size(dictionary):
        total = 0
        for i in range(0, len(data), 1500):
            made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
            packed = made.compress(data[i : i + 1500])
            assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(packed, max_output_size=1500) == data[i : i + 1500]
            total += len(packed)
        return total

    a, b = size(good), size(bad)
    d, r, k = (b - a) / max(1, a + b), min(a, b) / max(1, len(data)), math.log(1 + len(data))
    return [1.0, d, r, d * r, r * r, k, d * k]


def test_op7_as_a_whole(spark, tables):
    docs, labels = tables
    known = {}
    for r in labels:
        if docs.get(r.doc_id) is not None and r.quality is not None and remainder(r.doc_id, 5):
            known[r.doc_id] = min(known.get(r.doc_id, 1), int(r.quality))
    # Spark's hashes choose the rows and their order; what is done with them is done anew here.
    df = spark.createDataFrame([(d, docs[d]) for d in known], "doc_id long, text string")
    of = {r.doc_id: (r.half, r.key) for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"), F.xxhash64("text").alias("key")).collect()}
    made = {}
    for label in (0, 1):
        parts = [docs[d][i : i + 1500] for d in sorted(known) if known[d] == label and of[d][0] == 0 for i in range(0, max(1, len(docs[d])), 1500)]
        parts = [x.encode() for x in parts if x]
        try:
            made[label] = zstandard.train_dictionary(65_536, parts).as_bytes()
        except zstandard.ZstdError:
            made[label] = b"\n".join(parts)[:65_536]
    x = np.array([plain_features(docs[d].encode(), made[1], made[0]) for d in known if of[d][0] == 1])
    y = np.array([known[d] for d in known if of[d][0] == 1], float)
    scale, w = quality_classifier.calibrate(x, y)
    got = {r.doc_id: r for r in queries.op7_quality_classifier(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        f = np.array(plain_features((text or "").encode(), made[1], made[0]))
        assert got[d].difference == pytest.approx(f[1], abs=1e-12)
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-float(f / scale @ w))), abs=1e-4)
        assert got[d].held_out == (remainder(d, 5) == 0) and got[d].predicted == (got[d].score >= 0.3)


# Very long texts.


def test_very_long_texts(spark, tables):
    long = " ".join(f"word{i % 5000} idiot" if i % 7 == 0 else f"the{i % 300}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long + " MIT License"), (2, "x" * 3_000_000), (3, " \n" * 500_000)], "doc_id long, text string")
    weights = np.zeros(toxicity.DIMENSIONS, np.float32)
    weights[toxicity.features("idiot")[0]] = 2.0
    scores = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert scores[1] == pytest.approx(1 / (1 + math.exp(-2))) and scores[2] == scores[3] == 0.5
    model = {"good": b"word the idiot " * 200, "bad": b"zzz qqq " * 200, "scale": np.ones(7), "weights": np.array([0.0, 5, 0, 0, 0, 0, 0])}
    found = {r.doc_id: r.difference for r in quality_classifier.score(docs, model).collect()}
    assert found[1] == pytest.approx(plain_features((long + " MIT License").encode()[:30_000], model["good"], model["bad"])[1], abs=0.05)
    places = {r.doc_id: [p["label"] for p in r.places] for r in license_scan.scan_licenses(docs).collect()}
    assert places == {1: ["mit"], 2: [], 3: []}
    rules = {r.doc_id: (r.n_words, r.word_chars) for r in quality_rules.apply_rules(docs).collect()}
    assert rules[1][0] == len(long.split()) + 2 and rules[2] == (1, 3_000_000) and rules[3] == (0, 0)
