"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, their beginnings of STEM bytes (inflected forms share them), pairs of neighbours and
pairs with one word between of a whole text (A-Z lower-cased), hashed to DIMENSIONS. Each coordinate has its own rate, and L1 leaves few weights, so the model is a small table
of fixed greatest size that goes to every task, weights that are not zero alone. Models are fitted on parts of SHARD_ROWS labelled rows
and SHARD_BYTES of text on average, and averaged.

At most about TRAIN_ROWS labelled rows are fitted, chosen by a hash of doc_id. Null and empty texts have the bias alone.
Without labels every text scores 0.5: nothing is known, and a threshold below that calls all of them toxic.
Rows stay one to one; repeated rows score alike; several labels of one doc_id count as toxic if one says so. An empty table
gives an empty one; of labels, columns other than doc_id and toxic are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, mix, word_hashes, written
from .license_scan import words

DIMENSIONS = 1 << 20
TRAIN_ROWS = 16_000
SHARD_ROWS = 8_000
SHARD_BYTES = 64_000_000
STEM = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
EPOCHS = 6
_BIGRAM, _SKIP, _STEM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def features(text: str | bytes | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Coordinates of a text, with repeats; 0 is kept for the bias."""
    w = words(text)
    h = word_hashes(w)
    parts = [h, mix(word_hashes([x[:STEM] for x in w]) ^ _STEM), mix(h[:-1] * _BIGRAM + h[1:]), mix(h[:-2] * _SKIP + h[2:])]
    return 1 + (np.concatenate(parts) % np.uint64(dimensions - 1)).astype(np.int64)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, int]], dimensions: int = DIMENSIONS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after passes over (distinct coordinates, label)."""
    z, n = np.zeros(dimensions), np.zeros(dimensions)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            g = logistic(w.sum()) - label
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(dimensions))


def score_text(text: str | bytes | None, weights: np.ndarray) -> float:
    at = features(text, len(weights))
    at = np.unique(at[weights[at] != 0])  # few have a weight, so only these are made distinct
    return float(logistic(weights[0] + weights[at].sum()))


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Weights from the labelled rows for which the condition on doc_id holds; all zero without labels."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    total = known.count()
    share = min(1.0, rows / max(1, total))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # At most about `rows` labels: a size that a broadcast is safe with.
    picked = written(docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(known), "doc_id"), "toxicity-rows")
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-min(rows, total) // SHARD_ROWS), -(-size // SHARD_BYTES))
    picked = picked.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard"), "doc_id", "text", "label")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        order = np.random.default_rng(0).permutation(table.num_rows)
        texts, label = table.column("text"), table.column("label").to_pylist()
        data = [(np.unique(np.append(features(texts[int(i)].as_py(), dimensions), 0)), label[i]) for i in order]
        w = fit(data, dimensions)
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array(at, pa.int64()), "w": pa.array(w[at], pa.float64()), "rows": pa.array(np.full(len(at), len(data)), pa.int64())})

    found = picked.groupBy("shard").applyInArrow(one, "at bigint, w double, rows bigint")
    table = found.groupBy("at").agg(F.sum(F.col("w") / shards).alias("w")).orderBy("at").toArrow()  # at most `dimensions` rows
    weights = np.zeros(dimensions, np.float32)
    weights[table.column("at").to_numpy()] = table.column("w").to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score."""
    few = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((few, weights[few], len(weights)))

    def run(batches):
        at, w, size = shared.value
        own = np.zeros(size, np.float32)
        own[at] = w
        for batch in batches:
            scores = [score_text(t, own) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    picked = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")
