"""Strings that may be alike, met by pieces instead of any shared characters.

Of two strings with a ratio (M5) above `low`, M characters match in order, so n + m - 2M characters are put in or left out: fewer than
(1 - low) (n + m), say t at most. If the shorter one is cut in t + 1 pieces, one of them, the i-th, stands in the longer one unchanged
after at most i - 1 such changes and before at most t + 1 - i, so it begins within i - 1 of its own place, and within t + 1 - i of it
counted from the end. Strings meet where both lengths, the piece's number and the piece agree, and stay a pair where their edit distance
allows it.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread


def changes(n: int, m: int, low: float) -> int:
    """The most characters that two strings of these lengths may have put in or left out at a ratio above low; below 0: no such pair."""
    least = max(0, int(low * (n + m) / 2) - 1)
    while 2 * least / (n + m) <= low:
        least += 1
    return n + m - 2 * least if least <= min(n, m) else -1


def pieces(n: int, t: int) -> list[tuple[int, int]]:
    """Start and length of t + 1 pieces of nearly the same length, the shorter ones first."""
    short, longer = divmod(n, t + 1)
    out, at = [], 0
    for i in range(t + 1):
        size = short + (i >= t + 1 - longer)
        out.append((at, size))
        at += size
    return out


def partners(n: int, low: float, longer: bool) -> list[int]:
    """Lengths of strings that may be alike, from the own one on upwards or downwards."""
    out, m = [], n
    while m > 0 and changes(n, m, low) >= 0:
        out.append(m)
        m += 1 if longer else -1
    return out


def _own(term: str, low: float):
    """(n, m, i, piece) under which a string waits as the shorter one."""
    n = len(term)
    for m in partners(n, low, True):
        for i, (at, size) in enumerate(pieces(n, changes(n, m, low))):
            yield n, m, i, term[at : at + size]


def _asked(term: str, low: float):
    """(n, m, i, piece) at which a string looks for shorter ones, each once."""
    m = len(term)
    for n in partners(m, low, False):
        t = changes(n, m, low)
        for i, (at, size) in enumerate(pieces(n, t)):
            first = max(0, at - i, at + (m - n) - (t - i))
            last = min(m - size, at + i, at + (m - n) + (t - i))
            for piece in {term[s : s + size] for s in range(first, last + 1)}:
                yield n, m, i, piece


def _keyed(terms: DataFrame, name: str, keys, low: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [(term, *k) for term in batch.column(0).to_pylist() for k in keys(term, low)]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [name, "n", "m", "i", "piece"])

    return terms.mapInArrow(run, f"{name} string, n int, m int, i int, piece string")


def near_strings(terms: DataFrame, low: float, term: str = "term") -> DataFrame:
    """a < b: pairs among distinct strings that may have a ratio above low, with all that do. Null and empty ones go. A string of n
    characters has about n^2 / 10 keys at a low of 0.85, and one that looks n^3 / 200, so this is for terms, not texts."""
    if not 0.5 <= low < 1:
        raise ValueError("low is from 0.5 to below 1")
    t = spread(terms.filter(F.length(term) > 0).select(F.col(term).alias("term")).distinct())
    short, long = _keyed(t, "short", _own, low), _keyed(t, "long", _asked, low)
    met = short.join(long, ["n", "m", "i", "piece"]).filter((F.col("n") < F.col("m")) | (F.col("short") < F.col("long")))
    # A change of one character into another is two here and one to levenshtein, so no pair is lost by it.
    most = F.col("n") + F.col("m") - F.floor(F.lit(low) * (F.col("n") + F.col("m")))
    return met.filter(F.levenshtein("short", "long") <= most).select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
