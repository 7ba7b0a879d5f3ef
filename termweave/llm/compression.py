"""Vector codes: each of 16 parts of a vector becomes the index of its nearest codebook entry.

Codebooks come from Lloyd's rounds by Elkan's bounds. Beside each part's index a row keeps an upper bound of the distance to its
entry and a lower bound for every entry. When entries have moved, the bounds move by as much, and an entry is looked at only
where no bound proves it strictly farther than the part's own; what is looked at is compared in whole numbers, so equal
distances go to the lower index. The rows with their bounds are a table of the shared folder after each round, so a lost
executor costs one round; the codebooks alone (entries x components numbers) pass through the driver.

Rows whose vector is null or holds a null or non-finite component go. Shorter vectors count as followed by zeros up to the longest
one, and all up to a multiple of the parts. Components beyond 2**27 after scaling are held there. Repeated ids are rows of their own;
the codebooks start from the smallest (id, vector), null ids last, and have fewer entries where there are fewer rows. An empty
table gives no row. Columns other than the three named ones are not looked at.
"""

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, written
from .vectors import fixed_point, matrix, pieces, totals, width

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: A lower bound is a byte in units of the upper bound over this, so it reaches four times as far; what is farther counts as that.
STEPS = 64
#: What float arithmetic may have lost, as a share.
SLACK = 1e-9
#: Labels whose sums are broadcast at most; beyond, rows and sums meet in a shuffle of salted labels.
BROADCAST_LABELS, SALTS = 100_000, 64


class Bounds(NamedTuple):
    """For rows x parts: index, upper bound, unit of the lower bounds; for rows x parts x entries: lower bounds as bytes."""

    index: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


class Compressed(NamedTuple):
    """rows: vec_id, label, codes (a byte for each part), error, distances (how many were computed in the last assignment)."""

    rows: DataFrame
    codebooks: np.ndarray


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, exact."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def all_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: in doubles where they hold every sum, else in 64-bit integers."""
    largest = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0), 1)
    if 4 * int(largest) ** 2 * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return ((x[:, None] - c[None]) ** 2).sum(2)


def assign_part(x: np.ndarray, entries: np.ndarray, known: tuple | None, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one part of some rows: index, squared distance to the entry, lower bounds, number of distances computed."""
    n, k = len(x), len(entries)
    if known is None:
        d = all_squares(x, entries)
        index = d.argmin(1)
        return index, d[np.arange(n), index], np.sqrt(d) * (1 - SLACK), np.full(n, k)
    index, upper, lower = known
    index, lower = index.astype(np.int64), np.maximum(lower - moved[None], 0) * (1 - SLACK)
    upper = (upper + moved[index]) * (1 + SLACK)
    between = np.sqrt(all_squares(entries, entries)) * (1 - SLACK)
    np.fill_diagonal(between, np.inf)
    own = squares(x, entries[index])
    # An entry whose half distance to the nearest other exceeds the bound is nearer than all others: no look at any of them.
    rows = np.flatnonzero(~(upper < between.min(1, initial=np.inf)[index] / 2))
    upper[rows] = np.sqrt(own[rows]) * (1 + SLACK)
    a, u = index[rows], upper[rows, None]
    near = ~((u < lower[rows]) | (u < between[a] / 2))
    near[np.arange(len(rows)), a] = False
    i, j = np.nonzero(near)
    d = squares(x[rows[i]], entries[j])
    table = np.full((len(rows), k), np.iinfo(np.int64).max)
    table[i, j] = d
    table[np.arange(len(rows)), a] = own[rows]
    lower[rows[i], j] = np.sqrt(d) * (1 - SLACK)
    lower[np.arange(n), index] = np.sqrt(own) * (1 - SLACK)
    counts = np.ones(n, np.int64)
    counts[rows] += near.sum(1)
    best = table.argmin(1)
    index[rows], own[rows] = best, table[np.arange(len(rows)), best]
    return index, own, lower, counts


def assign(x: np.ndarray, codebooks: np.ndarray, known: Bounds | None, moved: np.ndarray | None):
    """Of some rows x parts x components: new bounds, squared distances (rows x parts), distances computed (rows)."""
    n, (parts, k, _) = len(x), codebooks.shape
    index, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts, k), np.uint8)
    errors, counts = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
    for p in range(parts):
        before = None
        if known is not None:
            unit = known.upper[:, p].astype(np.float64) / STEPS
            before = known.index[:, p], known.upper[:, p].astype(np.float64), known.lower[:, p] * unit[:, None]
        at, d, low, looked = assign_part(x[:, p], codebooks[p], before, None if moved is None else moved[p])
        # Rounded outwards: at least one, as bytes count in units of the upper bound.
        up = np.nextafter(np.maximum(np.sqrt(d) * (1 + SLACK), 1).astype(np.float32), np.float32(np.inf))
        index[:, p], upper[:, p], errors[:, p] = at, up, d
        lower[:, p] = np.minimum(np.floor(low * (1 - SLACK) / (up.astype(np.float64)[:, None] / STEPS)), 255)
        counts += looked
    return Bounds(index, upper, lower), errors, counts


def part_sums(x: np.ndarray, index: np.ndarray, k: int) -> np.ndarray:
    """For parts x entries: how many rows, and their sums by component."""
    parts, w = x.shape[1:]
    out = np.zeros((parts, k, w + 1), np.int64)
    for p in range(parts):
        np.add.at(out[p], index[:, p].astype(np.int64), np.concatenate([np.ones((len(x), 1), np.int64), x[:, p]], 1))
    return out


def _packed(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a], pa.binary())


def _unpacked(batch: pa.RecordBatch, name: str, kind, *shape: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(batch.num_rows, *shape)


def _sweep(codebooks: np.ndarray, moved: np.ndarray | None, last: bool):
    """The function that assigns the rows of a task; all but the last also keep bounds and end with a row of the task's sums."""
    parts, k, w = codebooks.shape

    def run(batches):
        total = np.zeros((parts, k, w + 1), np.int64)
        for batch in pieces(batches):
            n, known = batch.num_rows, None
            if moved is None:
                x = matrix(batch.column(2), parts * w).reshape(n, parts, w)
            else:
                x = _unpacked(batch, "x", "<i4", parts, w).astype(np.int64)
                known = Bounds(_unpacked(batch, "codes", np.uint8, parts), _unpacked(batch, "upper", "<f4", parts), _unpacked(batch, "lower", np.uint8, parts, k))
            bounds, errors, counts = assign(x, codebooks, known, moved)
            columns = {"vec_id": batch.column(0), "label": batch.column(1), "codes": _packed(bounds.index)}
            if last:
                columns |= {"error": pa.array(errors.sum(1)), "distances": pa.array(counts)}
            else:
                columns |= {"x": _packed(x.astype("<i4")), "upper": _packed(bounds.upper.astype("<f4")), "lower": _packed(bounds.lower), "sums": pa.nulls(n, pa.list_(pa.int64()))}
                total += part_sums(x, bounds.index, k)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        if not last and total.any():
            kinds = batch.schema.field(0).type, batch.schema.field(1).type
            columns = {"vec_id": pa.nulls(1, kinds[0]), "label": pa.nulls(1, kinds[1])} | {c: pa.nulls(1, pa.binary()) for c in ("codes", "x", "upper", "lower")}
            columns["sums"] = pa.array([total.ravel().tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        hand_back()

    return run


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Codes of all rows, and the codebooks: parts x entries x components. At most 256 entries, as a code is a byte."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = fixed_point(df.select(df[vec_id].alias("vec_id"), df[label].alias("label"), df[vector].alias("v")), "v", scale).select("vec_id", "label", "x")
    kinds = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, codes binary"
    w = -(-width(kept) // parts)
    if w > 64:
        raise ValueError("parts of more than 64 components")
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    codebooks = matrix(pa.array([r.x for r in start], pa.list_(pa.int32())), parts * w).reshape(len(start), parts, w).transpose(1, 0, 2)
    if not len(start):
        return Compressed(df.sparkSession.createDataFrame([], f"{kinds}, error bigint, distances bigint"), codebooks)
    rows, moved = kept, None
    for _ in range(rounds):
        state = written(rows.mapInArrow(_sweep(codebooks, moved, last=False), f"{kinds}, x binary, upper binary, lower binary, sums array<bigint>"), "codes")
        total = totals(state.filter("sums is not null"), "sums", parts * len(start) * (w + 1), np.int64).reshape(*codebooks.shape[:2], w + 1)
        counts = total[..., :1]
        after = np.where(counts > 0, total[..., 1:] // np.maximum(counts, 1), codebooks)
        moved = np.sqrt(((after - codebooks) ** 2).sum(2)) * (1 + SLACK)
        rows, codebooks = state.filter("sums is null").drop("sums"), after
    return Compressed(rows.mapInArrow(_sweep(codebooks, moved, last=True), f"{kinds}, error bigint, distances bigint"), codebooks)


def digest(codebooks: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows and label_error: error summed over the rows of the same label, nulls together. Rows are counted where they stand; sums
    of up to BROADCAST_LABELS labels go to the rows, more meet them in a shuffle in which a frequent label is split."""
    rows = written(rows, "coded")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    sums = sums.withColumn("of_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt"))
    return salted.join(sums, same, "left").drop("of", "of_salt", "salt")
