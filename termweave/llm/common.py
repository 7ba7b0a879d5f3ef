"""What the operators share: words as hashed numbers, bounded slices of a batch, tables in the shared folder."""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written  # noqa: F401  (operators of this folder take it from here)

#: Bytes of text that one step inside a task holds as words. A longer text is a slice of its own.
SLICE_BYTES = 1_000_000

_BYTE = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 2**64)


def lower_az(data: bytes) -> bytes:
    """A-Z in lower case; every other byte of the UTF-8 text stays."""
    return data.lower()


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; those of a usual slice are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES), base % 2**64, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= SLICE_BYTES:
            _POWERS[base] = known
    return known[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, equal on every machine."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_R, len(data)), out=sums[1:])
    inverse = powers(_R_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of each run of k words, from the words' hashes."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(base, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(pow(base, -1, 2**64), n - k + 1))


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes of text, a single row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def hand_back() -> None:
    """Returns free memory to the system. Python workers are kept between tasks, beside the executor's own heap, and what
    one task has freed would else stay with its worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: Bytes of text that a chunk of documents has on average: what one task of a chunked operator holds.
CHUNK_BYTES = 8_000_000
#: Smaller inputs are dealt over the shuffle partitions as long as a chunk has this much.
LEAST_CHUNK_BYTES = 250_000


def chunked(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """chunk, doc_id (long), text, and the number of chunks, which follows the bytes of text.

    A document's chunk comes from its id and text, so one source or one repeated id doesn't fill a chunk.
    """
    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-total // chunk_bytes), min(partitions, -(-total // LEAST_CHUNK_BYTES)))
    return picked.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text"), n


def chunk_rows(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of a chunk in the order of id (null first), then text: the same each time a chunk is read."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or b""))
    return [ids[i] for i in order], [texts[i] or b"" for i in order]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0..n-1 that ascend with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(sorted_values)]))


def in_sorted(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the ascending array."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def unpack(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]


def joined(arrays: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype)
