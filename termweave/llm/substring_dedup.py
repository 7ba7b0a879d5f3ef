"""Substring dedup: every run of min_words words that also starts earlier is removed, wherever it occurs.

Anchors are hashes of short windows at the positions of a difference cover modulo a period: whatever the offsets of
two equal runs, they share an anchor at one and the same distance from their starts. Anchors that occur twice select
the windows of min_words words that are compared in full, by 96 bits of hash; all others have no equal.

A chunk of documents sends each anchor, and of equal windows the first, once, so the most frequent passage costs as
many entries as there are chunks. Order is doc_id (null first), for one doc_id the chunk and the text, then the start.
Null and empty texts have no words and stay as they are. Repeated rows count as later copies; rows stay one to one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, bucket_of, chunk_rows, chunked, in_sorted, joined, runs, slices, unpack, window_hashes, word_hashes

MIN_WORDS = 20
#: Perfect difference sets; all distances modulo the period are differences of two members.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
PERIOD = 13
SECOND = 0xA24BAED4963EE407
NULL_ID = np.iinfo(np.int64).min
_ENTRIES = "bucket int, chunk int, hashes binary, more binary, owners binary"
_REPLY = "chunk int, hashes binary"


def _reply(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.binary())})


def _entries(chunk: int, n: int, hashes: np.ndarray, more: np.ndarray, owners: np.ndarray) -> pa.Table:
    """One row for each bucket with entries; hashes ascend."""
    starts, ends = runs(bucket_of(hashes, n))
    blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
    return pa.table({"bucket": pa.array(bucket_of(hashes, n)[starts], pa.int32()), "chunk": pa.array(np.full(len(starts), chunk), pa.int32()), "hashes": blobs(hashes), "more": blobs(more), "owners": blobs(owners)})


def _hashed(texts: list[bytes]):
    """Row, words and the words' hashes of each text."""
    for a, b in slices(texts):
        parts = [t.split() for t in texts[a:b]]
        hashes = word_hashes([w for p in parts for w in p])
        at = 0
        for i, p in enumerate(parts):
            yield a + i, p, hashes[at : at + len(p)]
            at += len(p)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, period: int = PERIOD, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id (long), n_words, n_removed and kept: the words that stay, joined by one space."""
    width = min_words - period + 1
    if width < 1:
        raise ValueError("min_words must be at least the period")
    is_anchor = np.isin(np.arange(period), COVERS[period])
    rows, n = chunked(docs, doc_id, text, chunk_bytes)

    def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = window_hashes(words, width)
        at = np.flatnonzero(np.resize(is_anchor, len(hashes)))
        return at, hashes[at]

    def send_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [anchors(h)[1] for _, _, h in _hashed(chunk_rows(table)[1]) if len(h) >= min_words]
        hashes, count = np.unique(joined(found, np.uint64), return_counts=True)
        return _entries(key[0].as_py(), n, hashes, (count > 1).astype(np.uint8), np.zeros(len(hashes), "S0"))

    def repeated(table: pa.Table) -> pa.Table:
        parts = unpack(table, "hashes", np.uint64)
        hashes, of = np.unique(joined(parts, np.uint64), return_inverse=True)
        weight = joined(unpack(table, "more", np.uint8), np.uint8).astype(np.int64) + 1
        twice = (np.bincount(of, weights=weight, minlength=len(hashes)) > 1)[of]
        out, at = [], 0
        for chunk, part in zip(table.column("chunk").to_pylist(), parts):
            if (keep := twice[at : at + len(part)]).any():
                out.append((chunk, part[keep].tobytes()))
            at += len(part)
        return _reply(out)

    def send_windows(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.sort(joined(unpack(right, "hashes", np.uint64), np.uint64))
        ids, texts = chunk_rows(left)
        first, second, owner = [], [], []
        for i, _, words in _hashed(texts) if len(known) else ():
            if len(words) < min_words:
                continue
            at, hashes = anchors(words)
            at = at[in_sorted(hashes, known)]
            if not len(at):
                continue
            count = len(words) - min_words + 1
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.maximum(at - period + 1, 0), 1)
            np.add.at(edge, at + 1, -1)
            take = np.flatnonzero(np.cumsum(edge)[:count])
            first.append(window_hashes(words, min_words)[take])
            second.append((window_hashes(words, min_words, SECOND)[take] >> np.uint64(32)).astype(np.uint32))
            owner.append(np.full(len(take), NULL_ID if ids[i] is None else ids[i], np.int64))
        first, second, owner = joined(first, np.uint64), joined(second, np.uint32), joined(owner, np.int64)
        order = np.lexsort((second, first))  # stable: of equal windows, the first of the chunk stays in front
        first, second, owner = first[order], second[order], owner[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        return _entries(key[0].as_py(), n, first[new], second[new], owner[new])

    def later(table: pa.Table) -> pa.Table:
        parts = unpack(table, "hashes", np.uint64)
        first, second = joined(parts, np.uint64), joined(unpack(table, "more", np.uint32), np.uint32)
        owner, names = joined(unpack(table, "owners", np.int64), np.int64), table.column("chunk").to_numpy()
        chunk = np.repeat(names, [len(p) for p in parts])
        order = np.lexsort((chunk, owner, second, first))
        again = np.zeros(len(first), bool)
        again[order[1:]] = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
        cut = np.cumsum([0, *map(len, parts)])
        return _reply([(int(c), p[again[a:b]].tobytes()) for c, p, a, b in zip(names, parts, cut, cut[1:]) if again[a:b].any()])

    def cut_out(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.sort(joined(unpack(right, "hashes", np.uint64), np.uint64))
        ids, texts = chunk_rows(left)
        sizes, first, second = np.zeros(len(texts), np.int64), [], []
        for i, _, words in _hashed(texts):
            sizes[i] = len(words)
            first.append(window_hashes(words, min_words))
            second.append(window_hashes(words, min_words, SECOND))
        first, second = joined(first, np.uint64), joined(second, np.uint64)
        order = np.argsort(first, kind="stable")
        again = in_sorted(first, known)
        same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
        again[order[1:][same]] = True
        removed, kept, at = np.zeros(len(texts), np.int64), [], 0
        for i, t in enumerate(texts):
            count = max(0, sizes[i] - min_words + 1)
            starts = np.flatnonzero(again[at : at + count])
            at += count
            words = t.split()
            if len(starts):
                edge = np.zeros(sizes[i] + 1, np.int64)
                edge[starts] += 1
                edge[starts + min_words] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist()) if s]
                removed[i] = sizes[i] - len(words)
            kept.append(b" ".join(words))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": sizes, "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    by_chunk = rows.groupBy("chunk")
    twice = by_chunk.applyInArrow(send_anchors, _ENTRIES).groupBy("bucket").applyInArrow(repeated, _REPLY)
    windows = by_chunk.cogroup(twice.groupBy("chunk")).applyInArrow(send_windows, _ENTRIES)
    known = windows.groupBy("bucket").applyInArrow(later, _REPLY)
    return by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(cut_out, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
