"""J4's index: vectors in inverted cells with product-quantised codes, exact scores for what the codes choose.

Centres and codebooks are fitted on a bounded sample, SAMPLE vectors drawn by a hash of their keys; every vector is coded and lies in its cell.
A search looks at the nearest cells of each query, ranks what lies there by codes, and scores the best of it exactly. With all
cells and all candidates it is exact. Cosine is asked of unit vectors, so both metrics are distances here. Null vectors, and
for cosine zero ones, are not indexed. A cell that holds much more than others is dealt over several tasks.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm, unit
from ..storage import written
from .retrieval import top_k

#: Vectors that centres and codebooks are fitted on; cells at most; entries of a codebook; rounds of fitting.
SAMPLE, CELLS, ENTRIES, ROUNDS = 20_000, 4096, 64, 8
#: Members of a cell that one task ranks for as many queries.
BLOCK = 16_384


class Index(NamedTuple):
    """rows: key, cell, part, code (a byte for each part of the vector) and v. centres and books (parts x entries x width) go to all tasks."""

    rows: DataFrame
    centres: np.ndarray
    books: np.ndarray
    parts: np.ndarray
    metric: str


def _lloyd(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of a sample, from every n/k-th row on; empty ones stay."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)[0]
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.concatenate([_squares(x[i : i + 4096], c) for i in range(0, len(x), 4096)]) if len(x) else np.zeros((0, len(c)))
    at = d.argmin(1)
    return at, d[np.arange(len(at)), at]


def _codes(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts, _, w = books.shape
    return np.stack([_nearest(rest[:, p * w : (p + 1) * w], books[p])[0] for p in range(parts)], 1).astype(np.uint8)


def _vectors(df: DataFrame, key: str, vector: str, metric: str) -> DataFrame:
    v = df.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("v is not null and key is not null")
    return v.filter(norm(F.col("v")) > 0).withColumn("v", unit(F.col("v"))) if metric == "cosine" else v


def build(vectors: DataFrame, cells: int | None = None, parts: int = 16, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> Index:
    """The index of all vectors. About the square root of their number of cells; `parts` must divide the components."""
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    v = written(_vectors(vectors, key, vector, metric), "indexed")
    n = v.count()
    drawn = np.array([r.v for r in v.orderBy(F.xxhash64("key", F.lit("sample")), "key").limit(sample).select("v").collect()], np.float64)
    if not len(drawn):
        return Index(v.select("key", F.lit(0).alias("cell"), F.lit(0).alias("part"), F.lit(b"").alias("code"), "v"), np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0, np.int64), metric)
    centres = _lloyd(drawn, min(CELLS, cells or max(1, int(n**0.5))))
    w = drawn.shape[1] // parts
    if w * parts != drawn.shape[1]:
        raise ValueError(f"{parts} parts of {drawn.shape[1]} components")
    rest = drawn - centres[_nearest(drawn, centres)[0]]
    books = [_lloyd(rest[:, p * w : (p + 1) * w], ENTRIES) for p in range(parts)]
    most = max(len(b) for b in books)
    books = np.stack([np.concatenate([b, np.repeat(b[-1:], most - len(b), 0)]) for b in books])

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist(), np.float64)
                cell = _nearest(x, centres)[0]
                code = _codes(x - centres[cell], books)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), b.column(1)], ["key", "cell", "code", "v"])

    rows = written(v.mapInArrow(place, "key bigint, cell int, code binary, v array<double>"), "cells")
    split = np.ones(len(centres), np.int64)
    for r in rows.groupBy("cell").count().collect():  # a row for each cell
        split[r.cell] = -(-r["count"] // BLOCK)
    of = F.get(F.array(*(F.lit(int(x)) for x in split)), F.col("cell"))
    return Index(rows.withColumn("part", F.pmod(F.xxhash64("key"), of).cast("int")), centres, books, split, metric)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 16, candidates: int = 200, query_id: str = "query_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, key, score (cosine, or the L2 distance) and rank of the k best among `candidates` that the codes of `probes` cells choose."""
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], "query_id bigint, key bigint, score double, rank bigint")
    q = written(_vectors(queries, query_id, vector, index.metric), "asked")
    centres, books = index.centres, index.books
    parts, entries, w = books.shape

    def route(batches):
        for b in batches:
            if b.num_rows:
                d = _squares(np.array(b.column(1).to_pylist(), np.float64), centres)
                near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(len(d)), near.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(near.ravel(), pa.int32()), b.column(1).take(pa.array(row))], ["query", "cell", "q"])

    asked = written(q.mapInArrow(route, "query bigint, cell int, q array<double>"), "probes")
    chunks = np.ones(len(centres), np.int64)
    for r in asked.groupBy("cell").count().collect():  # a row for each cell
        chunks[r.cell] = -(-r["count"] // BLOCK)
    of = lambda numbers: F.get(F.array(*(F.lit(int(x)) for x in numbers)), F.col("cell"))
    upto = lambda n, name: F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias(name)
    left = asked.select("*", F.pmod(F.xxhash64("query"), of(chunks)).cast("int").alias("chunk"), upto(of(index.parts), "part"))
    right = index.rows.select("key", "cell", "part", "code", upto(of(chunks), "chunk"))

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if a.num_rows and b.num_rows:
            centre, code = centres[a["cell"][0].as_py()], np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, parts)
            keys = b["key"].to_numpy()
            for query, v in zip(a["query"].to_pylist(), a["q"].to_pylist()):
                rest = (np.array(v) - centre).reshape(parts, 1, w)
                table = ((rest - books) ** 2).sum(2)  # parts x entries: what each code is away
                about = table[np.arange(parts), code].sum(1)
                best = np.argpartition(about, candidates - 1)[:candidates] if len(about) > candidates else np.arange(len(about))
                out[0].append(np.full(len(best), query)), out[1].append(keys[best]), out[2].append(about[best])
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query": pa.array(flat[0], pa.int64()), "key": pa.array(flat[1], pa.int64()), "about": pa.array(flat[2], pa.float64())})

    on = ["cell", "part", "chunk"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(rank, "query bigint, key bigint, about double")
    chosen = top_k(found, candidates, ["query"], "about", "key").select("query", "key")
    pairs = chosen.join(index.rows.select("key", "v"), "key").join(q.select(F.col("key").alias("query"), F.col("v").alias("q")), "query")
    dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    far = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    score = F.round(dot if index.metric == "cosine" else far, digits)
    order = F.desc("score") if index.metric == "cosine" else F.asc("score")
    return top_k(pairs.select(F.col("query").alias("query_id"), "key", score.alias("score")).distinct(), k, ["query_id"], order, "key")
