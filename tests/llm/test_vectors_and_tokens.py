"""Byte-level BPE against the tokenizer library, vector codes and whitening against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from termweave.llm import byte_bpe, compression, queries, vectors, whitening

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# 11


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Codec(RANKS)


def awkward():
    r = random.Random(7)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    return [
        None, "", " ", "\n\n \t x", "it's WE'LL don't", "Ärger über Straße 12½ ٣٤", "日本語のテキスト、東京都に行く。" * 20, "🙂👩‍👩‍👧 é \x00\x1c\x85 ", "same", "same",
        "a" * 70, "ab" * 500, some("etaoinshrdlu", 900), " " * 300, "=" * 200 + "-" * 99, some("abc é日\n", 4000), "word " * 2000, some(".,;:!?", 300), "<|endoftext|>",
    ]


def frame(spark, texts):
    rows = [(None if i == 1 else i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("1 as ids", "doc_id", "'x' as decoded", "2 as w", "text", "array(3) as ts")


@pytest.mark.parametrize("slice_size", [byte_bpe.SLICE, 1000])
def test_ids_and_bytes_are_those_of_the_library(coder, library, monkeypatch, slice_size):
    import regex

    monkeypatch.setattr(byte_bpe, "SLICE_WORDS", slice_size // 50)
    texts = [t or "" for t in awkward()]
    split = regex.compile(public_tokenizers.PATTERN)
    for a, b in byte_bpe.slices([t.encode() for t in texts], slice_size):
        lists, data = byte_bpe._recoded(coder, split, texts[a:b])
        assert lists.to_pylist() == [library.encode_ordinary(t) for t in texts[a:b]]
        assert data.to_pylist() == [t.encode() for t in texts[a:b]]


def test_recode_encode_and_decode(spark, library):
    texts = awkward()
    docs = frame(spark, texts)
    want = Counter((None if i == 1 else i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts))
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in byte_bpe.recode(docs, RANKS).collect()) == want
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((d, b) for d, _, b in want)
    assert byte_bpe.recode(docs.limit(0), RANKS).count() == 0


def test_decoding_of_any_ids(spark):
    rows = [(1, [1, 2, 3]), (2, []), (3, None), (4, [5, 999_999]), (5, [7, None]), (6, [0] * 500_000)]
    got = {r.doc_id: r.decoded and bytes(r.decoded) for r in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), RANKS).collect()}
    piece = {v: k for k, v in byte_bpe.ranks_of(RANKS).items()}
    assert got == {1: piece[1] + piece[2] + piece[3], 2: b"", 3: None, 4: None, 5: None, 6: piece[0] * 500_000}


def test_long_words_in_any_number_of_steps(coder, library, monkeypatch):
    r = random.Random(2)
    words = ["x" * 3001, "ab" * 700 + "a", "".join(r.choice("etaoinshr") for _ in range(700)), "日本" * 200, "a" * 100_000]
    want = [library._core_bpe.encode_single_piece(w.encode()) for w in words]
    got = lambda: [t for _, t in sorted(zip(*(coder.encode_words([w.encode() for w in words])[c].to_pylist() for c in ("w", "ts"))))]
    assert coder.rising and got() == want
    monkeypatch.setattr(byte_bpe, "GATHERED", 2000)  # a query begins again after four steps
    assert got() == want


def test_words_go_pair_by_pair_where_ranks_do_not_rise(tmp_path):
    import base64

    # "abc" has a lower rank than "ab", by which its bytes come to it: merges do not rise.
    items = [*(bytes([b]) for b in range(256)), b"abc", b"ab", b"bb", b"abb"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % i for i, x in enumerate(items)))
    coder = byte_bpe.Codec(str(path))
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(items)}, special_tokens={})
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(n)).encode() for n in (3, 9, 70, 150)] + [b"abbc" * 30]
    got = [t for _, t in sorted(zip(*(coder.encode_words(words)[c].to_pylist() for c in ("w", "ts"))))]
    assert not coder.rising and got == [library._core_bpe.encode_single_piece(w) for w in words]


def test_forgetting_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    for text in ("one two three four five six seven", "eight nine ten eleven twelve one two", "one"):
        ids, _, data, _ = coder.recode([*"abc", *(" " + w for w in text.split())])
        assert bytes(data).decode() == "abc " + text and ids.tolist()[3:] == library.encode_ordinary(" " + text)


def test_op11_digests(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {d: (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for d, t in texts.items() for ids in [library.encode_ordinary(t)]}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_byte_bpe(spark, SF).collect()} == want


# 12

AWKWARD = [(1, None, 0), (2, [1.0, None] * 8, 0), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, 1), (5, [float("-inf")] + [0.0] * 15, 1)]


def vector_rows(n, d=32, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 0.3, (n, d)), 2)
    x[n // 2 :] = x[0]  # half of all rows are one vector
    return [(i * 3 % 1009, [float(v) for v in row], None if i % 3 == 0 else i % 3) for i, row in enumerate(x)]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("'a' as x", "vec_id", "1 as codes", "embedding", "2 as sums", "label", "3 as error", "4 as place")


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i, np.floor(256 * np.float64(np.float32(v))).astype(np.int64).tolist(), lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    if not kept:
        return [], np.zeros((parts, 0, 0))
    d = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    x = np.array([v + [0] * (d - len(v)) for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        far = ((x[:, :, None] - books[None]) ** 2).sum(3)
        at, error = far.argmin(2), far.min(2).sum(1)
        for p in range(parts if k < rounds else 0):
            for e in range(books.shape[1]):
                if (at[:, p] == e).any():
                    books[p, e] = x[at[:, p] == e, p].sum(0) // (at[:, p] == e).sum()
    return [(i, bytes(a.tolist()), int(e), lab) for (i, _, lab), a, e in zip(kept, at, error)], books


@pytest.mark.parametrize("rows", [vector_rows(300) + AWKWARD, vector_rows(20, 17) + [(7, [0.5] * 3, 9), (7, [0.5] * 3, 9), (None, [1e30, -1e30], None), (8, [], 1)], [(8, [], 1), (9, [], 1)], AWKWARD, []], ids=["many", "few", "no components", "none fits", "empty"])
def test_codes_and_codebooks(spark, rows):
    if any(v and v[0] == 1e30 for _, v, _ in rows):
        held = [(10**9 if i is None else i, [max(-(2**19), min(2**19, x)) for x in v] if v else v, lab) for i, v, lab in rows]
    else:
        held = rows
    want, books = plain_codes(held)
    found = compression.compress(embeddings(spark, rows))
    got = Counter((10**9 if r.vec_id is None else r.vec_id, bytes(r.codes), r.error, r.label) for r in found.rows.collect())
    assert got == Counter(want)
    assert found.codebooks.tolist() == books.tolist() or not want


def test_bounds_rule_entries_out_and_change_nothing():
    r = np.random.default_rng(5)
    centres = r.integers(-300, 300, (16, 4, 4))
    x = (centres[:, r.integers(0, 4, 500)].transpose(1, 0, 2) + r.integers(-9, 9, (500, 16, 4))).astype(np.int64)
    books = x[:64].transpose(1, 0, 2).copy()
    known = moved = None
    for k in range(4):
        bounds, errors, counts = compression.assign(x, books, known, moved)
        far = ((x[:, :, None] - books[None]) ** 2).sum(3)
        assert (bounds.index == far.argmin(2)).all() and (errors == far.min(2)).all()
        assert (bounds.upper.astype(float) ** 2 >= far.min(2)).all()
        unit = bounds.upper.astype(float)[..., None] / compression.STEPS
        assert ((bounds.lower * unit) ** 2 <= far * (1 + 1e-9)).all()
        sums = compression.part_sums(x, bounds.index, 64)
        after = np.where(sums[..., :1] > 0, sums[..., 1:] // np.maximum(sums[..., :1], 1), books)
        moved, books, known = np.sqrt(((after - books) ** 2).sum(2)) * (1 + compression.SLACK), after, bounds
    assert counts.mean() < 0.3 * 16 * 64


def test_large_components_are_exact():
    x, c = np.array([[vectors.LARGEST, -vectors.LARGEST]]), np.array([[-vectors.LARGEST, vectors.LARGEST], [vectors.LARGEST - 1, -vectors.LARGEST]])
    assert compression.all_squares(x, c).tolist() == [[2 * (2 * vectors.LARGEST) ** 2, 1]]


@pytest.mark.parametrize("most", [compression.BROADCAST_LABELS, 1])
def test_label_errors(spark, monkeypatch, most):
    monkeypatch.setattr(compression, "BROADCAST_LABELS", most)
    want, _ = plain_codes(vector_rows(120))
    total = Counter()
    for _, _, e, lab in want:
        total[lab] += e
    rows = compression.with_label_error(compression.compress(embeddings(spark, vector_rows(120))).rows)
    assert Counter((r.vec_id, r.error, r.label_error) for r in rows.collect()) == Counter((i, e, total[lab]) for i, _, e, lab in want)


# 13


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_jacobi(d):
    r = np.random.default_rng(d)
    q, _ = np.linalg.qr(r.normal(size=(d, d)))
    values = 10.0 ** -np.arange(d) if d < 10 else np.sort(r.uniform(0, 9, d))[::-1]
    a = (q * values) @ q.T
    got, v = whitening.jacobi((a + a.T) / 2)
    np.testing.assert_allclose(got, values, rtol=1e-9, atol=1e-15)
    np.testing.assert_allclose(v @ v.T, np.eye(d), atol=1e-12)
    assert (np.diff(got) <= 0).all()


def test_jacobi_keeps_small_eigenvalues_of_scaled_matrices():
    # A strongly scaled positive matrix: small eigenvalues are right relative to themselves.
    scale = np.array([1e6, 1.0, 1e-6])
    core = np.array([[1, 0.3, 0.2], [0.3, 1, 0.1], [0.2, 0.1, 1]])
    values, _ = whitening.jacobi(core * np.outer(scale, scale))
    smallest = np.linalg.det(core) / np.linalg.det(core[:2, :2]) * 1e-12
    np.testing.assert_allclose(values[-1], smallest, rtol=1e-9)


@pytest.mark.parametrize("more", [[], [(None, [0.1] * 5, 1), (7, [0.2] * 13, 1), (7, [0.2] * 13, 1)]])
def test_whitening_against_a_plain_version(spark, more):
    rows = [(i, [*v[:6], 0.25, *v[6:12]], lab) for i, v, lab in vector_rows(250, 40, seed=4)] + AWKWARD + more
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([np.floor(64 * np.float64(np.float32([*v, *[0] * (13 - len(v))]))) + 1_000_000 for _, v in kept])
    n, v = len(x), np.cov((x - x.mean(0)).T, bias=True)
    e, q = np.linalg.eigh(v)
    keep = [k for k in range(12, -1, -1) if e[k] > 1e-9]
    size = len(keep)
    assert size == (13 if more else 12)  # one dimension is constant but for these rows
    white = (x - x.mean(0)) @ q[:, keep] / np.sqrt(e[keep])
    deviations = ((n * x.astype(np.int64) - x.astype(np.int64).sum(0)) ** 2).sum(1)
    found = whitening.components(embeddings(spark, rows)).collect()
    assert {r.n for r in found} == {n} and {r.component for r in found} == set(range(1, size + 1)) and len(found) == size * n
    assert max(r.identity_error for r in found) < 1e-10 and len({r.identity_error for r in found}) == 1
    explained = dict((r.component, r.explained) for r in found)
    np.testing.assert_allclose([explained[k + 1] for k in range(size)], e[keep] / np.trace(v), rtol=1e-9)
    sign = {}
    for (i, _), w, dev in zip(kept, white, deviations):
        mine = [r for r in found if r.vec_id == i and r.deviation == dev]
        for k in range(size):
            got = [r.whitened for r in mine if r.component == k + 1]
            assert any(abs(abs(g) - abs(w[k])) < 1e-7 for g in got)
            if len(mine) == size and abs(w[k]) > 1e-3:
                assert sign.setdefault(k, np.sign(got[0] * w[k])) == np.sign(got[0] * w[k])


def test_whitening_of_what_has_no_variance(spark):
    for rows in ([], AWKWARD, [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)], [(1, [], 0)]):
        assert whitening.components(embeddings(spark, rows)).count() == 0


def test_deviations_that_do_not_fit_are_null(spark):
    rows = [(1, [1e30], 0), (2, [-1e30], 0), *((i, [0.0], 0) for i in range(3, 60))]
    df = embeddings(spark, rows)
    w = whitening.fit(df)
    got = {r.vec_id: r.deviation for r in whitening.apply(df, w).collect()}
    x = {i: {1: vectors.LARGEST, 2: -vectors.LARGEST}.get(i, 0) for i, _, _ in rows}
    exact = {i: (len(rows) * v - sum(x.values())) ** 2 for i, v in x.items()}
    assert got == {i: v if v < 2**63 else None for i, v in exact.items()} and None in got.values()


def test_lists_as_rows():
    got = vectors.matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int32())), 3)
    assert got.tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
