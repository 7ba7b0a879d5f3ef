"""Term counts of chunks that keep arriving, late, repeated or changed.

A chunk's state is its newest version and what that counts for. A newer version takes back what the older one counted; an older or equal
one changes nothing, so any order of arrival ends in the same counts. Each batch adds its differences under its number, so a
batch that runs twice replaces itself, and the counts are the sum of all. The state lies in the query's checkpoint.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "chunk_id string, version long, text string"
#: A row without a term counts chunks.
_CHANGE = "term string, frequency long, documents long"


def runs(text: str, low: int = 1, high: int = 3) -> dict[str, int]:
    """How often each run of low..high words of a line stands in a text."""
    out: dict[str, int] = {}
    for line in (text or "").lower().split("\n"):
        words = line.split()
        for n in range(low, high + 1):
            for i in range(len(words) - n + 1):
                run = " ".join(words[i : i + n])
                out[run] = out.get(run, 0) + 1
    return out


def _changes(terms_of: Callable[[str], dict[str, int]]):
    def change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, text = state.get if state.exists else (None, "")
        newest = (known, text)
        for rows in batches:
            for version, new in zip(rows["version"], rows["text"]):
                if newest[0] is None or (version, new or "") > newest:
                    newest = (int(version), new or "")
        if newest == (known, text):
            return
        state.update(newest)
        old, new = terms_of(text) if known is not None else {}, terms_of(newest[1])
        rows = [(t, new.get(t, 0) - old.get(t, 0), (t in new) - (t in old)) for t in {*old, *new} if new.get(t, 0) != old.get(t, 0)]
        yield pd.DataFrame(rows + [(None, 0, 1)] * (known is None), columns=["term", "frequency", "documents"])

    return change


def stream_counts(spark: SparkSession, source: str, table: str, checkpoint: str, terms_of: Callable[[str], dict[str, int]] = runs, **trigger) -> StreamingQuery:
    """Reads Parquet files (chunk_id, version, text) as they come into `source` and adds the differences they make to `table`, a folder.
    Of equal versions of one chunk the greatest text counts."""

    def add(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("term").agg(F.sum("frequency").alias("frequency"), F.sum("documents").alias("documents")).withColumn("batch", F.lit(number))
        summed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    changes = stream.groupBy("chunk_id").applyInPandasWithState(_changes(terms_of), _CHANGE, "version long, text string", "append", GroupStateTimeout.NoTimeout)
    return changes.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts(spark: SparkSession, table: str) -> DataFrame:
    """term, frequency and documents so far; the row without a term has the number of chunks."""
    whole = spark.read.schema(f"{_CHANGE}, batch int").parquet(table).groupBy("term").agg(F.sum("frequency").alias("frequency"), F.sum("documents").alias("documents"))
    return whole.filter("documents <> 0")


def weights(spark: SparkSession, table: str) -> DataFrame:
    """A5 from the counts: term, documents and idf, ln((N + 1) / (documents + 1)) + 1 of N chunks."""
    c = counts(spark, table)
    n = c.filter("term is null").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"))
    return c.filter("term is not null").crossJoin(F.broadcast(n)).select("term", "frequency", "documents", F.round(F.log((F.col("n") + 1) / (F.col("documents") + 1)) + 1, 6).alias("idf"))  # n is one row
