"""Strings that hold others."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters at which a shorter and a longer string meet.
LEAD = 8


def held(shorts: DataFrame, short: str, longs: DataFrame, long: str) -> DataFrame:
    """Rows of the two tables of which the first one's string stands in the second one's, which is no shorter.

    They meet at the short one's first characters, up to LEAD, at any place of the long one, so nothing is compared that
    can't start alike; blocks that many share are split by adaptive execution."""
    size = F.least(F.length(short), F.lit(LEAD))
    lengths = sorted(r[0] for r in shorts.select(size.alias("n")).distinct().collect() if r[0])  # LEAD numbers at most
    starts = lambda n: F.when(F.length(long) >= n, F.transform(F.sequence(F.lit(1), F.length(long) - n + 1), lambda i: F.substr(long, i, F.lit(n))))
    empty = F.array().cast("array<string>")
    blocks = F.array_distinct(F.concat(empty, *(F.coalesce(starts(n), empty) for n in lengths)))
    left = shorts.filter(F.length(short) > 0).withColumn("_block", F.substr(short, F.lit(1), size))
    return left.join(longs.withColumn("_block", F.explode(blocks)), "_block").filter(F.contains(long, short)).drop("_block")
