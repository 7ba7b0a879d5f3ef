"""Compression classifier: a text that the dictionary of good texts shortens more than that of bad ones is good.

Zstandard dictionaries are built from pieces of good and of bad labelled texts. A whole text is compressed piece by piece
with each; the difference of the sizes over their sum, and how far the text shortens at all, become a score by logistic
regression on labelled texts that are in neither dictionary.

At most about TRAIN_ROWS labelled rows are used, chosen by a hash of doc_id; half of them build the dictionaries, from at
most about DICTIONARY_INPUT bytes a class, as pieces chosen by a hash before a class meets in one task. Null and empty texts have sizes of zero, hence the score of the constants. If
there are no labels of a class, the score is the share of good labels (0.5 without any). Rows stay one to one; of
several labels of one doc_id the lowest counts. An empty table gives an empty one; of labels, columns other than doc_id and
quality are not looked at.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, encode, written
from .toxicity import logistic

TRAIN_ROWS = 12_000
DICTIONARY_BYTES = 65_536
DICTIONARY_INPUT = 8_000_000
PIECE = 1500
LEVEL = 3


def pieces(data: bytes, size: int = PIECE) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def build(parts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on pieces of texts; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(parts)[:size]


class Sizes:
    """Compressed sizes under the dictionaries of good and bad texts."""

    def __init__(self, good: bytes, bad: bytes):
        made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (good, bad)]
        self.good, self.bad = (m.compress for m in made)

    def features(self, data: bytes) -> list[float]:
        parts = pieces(data)
        good, bad = sum(len(self.good(p)) for p in parts), sum(len(self.bad(p)) for p in parts)
        d, r = (bad - good) / max(1, good + bad), min(good, bad) / max(1, len(data))
        return [1.0, d, r, d * r, r * r, float(np.log1p(len(data))), d * float(np.log1p(len(data)))]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Scale and weights of a logistic regression, by Newton steps."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = logistic(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return scale, w


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> dict:
    """The dictionaries, scale and weights, from the labelled rows for which the condition on doc_id holds."""
    known = labels.filter("doc_id is not null and quality is not null").filter(usable).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    total, good = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    constant = {"good": b"", "bad": b"", "scale": np.ones(7), "weights": np.zeros(7)}
    constant["weights"][0] = np.log((good + 1) / (total - good + 1))
    if not 0 < good < total:
        return constant
    share = min(1.0, rows / total)
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # At most about `rows` labels: a size that a broadcast is safe with.
    picked = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(known), "doc_id").filter("text is not null")
    picked = written(picked.select("label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"), "doc_id", "text"), "quality-rows")
    building = picked.filter("half = 0")
    size = {r["label"]: r["n"] or 0 for r in building.groupBy("label").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # two rows
    # Only what a dictionary is built from goes to its task.
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE))
    parts = building.select("label", "doc_id", "text", F.posexplode(starts).alias("number", "start"))
    parts = parts.select("label", "doc_id", "number", F.xxhash64("text").alias("key"), F.substr("text", "start", F.lit(PIECE)).alias("piece"))
    keep = F.coalesce(*(F.when(F.col("label") == x, F.lit(min(1.0, DICTIONARY_INPUT / max(1, n)))) for x, n in size.items()), F.lit(0.0))
    parts = parts.filter(F.pmod(F.xxhash64("doc_id", "key", "number"), F.lit(1_000_000)) < keep * 1_000_000)

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("key", "ascending"), ("number", "ascending")])
        made = build([encode(t) for t in table.column("piece").to_pylist() if t])
        return pa.table({"label": pa.array([key[0].as_py()], pa.int32()), "dictionary": pa.array([made], pa.binary())})

    made = {r["label"]: bytes(r["dictionary"]) for r in parts.groupBy("label").applyInArrow(one, "label int, dictionary binary").collect()}  # two rows
    if len(made) < 2:
        return constant
    both = made[1], made[0]

    def measure(batches):
        sizes = Sizes(*both)
        for batch in batches:
            x = [sizes.features(encode(t)) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    seen = picked.filter("half = 1").select("label", "text").mapInArrow(measure, "label int, x array<double>").toArrow()  # about `rows` / 2 rows
    if not seen.num_rows:
        return constant
    x, y = np.array(seen.column("x").to_pylist()), seen.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # sums come out alike whatever task was first
    scale, weights = calibrate(x[order], y[order])
    return {"good": both[0], "bad": both[1], "scale": scale, "weights": weights}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and difference: the sizes' difference over their sum."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        sizes = Sizes(m["good"], m["bad"])
        for batch in batches:
            x = np.array([sizes.features(encode(t)) for t in column(batch, "text")]).reshape(-1, 7)
            scores = logistic(x / m["scale"] @ m["weights"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(x[:, 1], pa.float64())], ["doc_id", "score", "difference"])

    picked = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double, difference double")
