"""What the comparison of a bucket holds: sketches stay in Arrow's memory until they are compared, and pairs that come again are one."""

import random

import numpy as np
import pyarrow as pa

from termweave.llm import ngram_join as J


def test_sketches_are_taken_from_buffers():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: r.integers(90, 120)], r.integers(0, 2**63, r.integers(0, 30), dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 5, 40, 300)]
    known, at = J.Sketched(), 0
    for n in (1, 20, 43):
        some = sets[at : at + n]
        nodes = np.arange(at, at + n)
        known.add(nodes, nodes % 7, np.array([len(s) for s in some]), pa.py_buffer(b"".join(map(J.sketch, some))))
        at += n
    known.close()
    compared = np.array([i for i in range(len(sets)) if i % 5], np.int32)
    known.hold(compared)
    assert sum(m.shape[0] for m in known.held.values()) == len(compared)
    got = {(min(a, b), max(a, b)) for x, y, _ in known.pairs(compared, 85) for a, b in zip(x.tolist(), y.tolist())}
    linked = {(a, b) for a in compared.tolist() for b in compared.tolist() if a < b and a % 7 != b % 7 and len(np.intersect1d(sets[a], sets[b])) >= J.needed(len(sets[a]), len(sets[b]))}
    assert linked and linked <= got and all(known.parts[a] != known.parts[b] for a, b in got)


def test_links_do_not_depend_on_how_many_pairs_are_held(spark, monkeypatch):
    """Pairs put together after each few of them, against all sets by themselves."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = [[r.choice(words) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        text = list(r.choice(texts))
        for _ in range(r.randrange(3)):
            text[r.randrange(60)] = r.choice(words)
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(J, "PAIRS", 3)
    monkeypatch.setattr(J, "COMPARED", 8)
    found = {x.doc_id: x.component_id for x in J.join(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=4000, hub_from=1000).collect()}
    shingles = [{tuple(t.split()[j : j + 4]) for j in range(57)} for _, t in rows]
    least = list(range(150))
    while True:
        new = [min([least[j] for j in range(150) if 100 * len(shingles[i] & shingles[j]) >= 85 * len(shingles[i] | shingles[j])]) for i in range(150)]
        if new == least:
            break
        least = new
    assert found == dict(enumerate(least)) and len(set(least)) < 150
