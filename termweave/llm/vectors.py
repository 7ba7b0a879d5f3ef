"""Vectors as whole numbers, and sums of arrays over all tasks: what the two vector operators share."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this are held at it, so that squared distances of up to 1024 components fit 64 bits.
LARGEST = 1 << 27
#: Rows that one step inside a task works on.
ROWS = 4096


def fixed_point(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """df without the rows whose vector is null or holds a null or non-finite component, and x: floor(scale * component) each."""
    c = df[vector]
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = lambda v: v.cast("double") * scale
    whole = lambda v: F.when(F.abs(scaled(v)) < LARGEST, F.floor(scaled(v))).otherwise(F.signum(scaled(v)) * LARGEST)
    return df.filter(c.isNotNull() & finite).withColumn("x", F.transform(c, lambda v: whole(v).cast("int")))


def width(df: DataFrame) -> int:
    """Components of the longest x."""
    return df.agg(F.max(F.size("x"))).first()[0] or 0


def matrix(column: pa.Array, components: int) -> np.ndarray:
    """Lists as rows of int64; a shorter list is followed by zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == components).all():
        return flat.reshape(len(lengths), components)
    out = np.zeros((len(lengths), components), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def totals(df: DataFrame, name: str, length: int, kind) -> np.ndarray:
    """The sum, place by place, of an array column that has a row for each task: summed in Spark, `length` numbers come back."""
    out = np.zeros(length, kind)
    for r in df.select(F.posexplode(name).alias("place", "v")).groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[r.place] = r.v
    return out


def summed(df: DataFrame, components: int, of: Callable[[np.ndarray], np.ndarray], length: int, kind=np.int64) -> np.ndarray:
    """The sum of `of` (an array of `length`) over all rows of x: a partial sum in each task, then over the tasks."""

    def part(batches):
        total = np.zeros(length, kind)
        for batch in pieces(batches):
            total += of(matrix(batch.column(0), components))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(kind)))], ["v"])

    spark_kind = "bigint" if kind is np.int64 else "double"
    return totals(df.select("x").mapInArrow(part, f"v array<{spark_kind}>"), "v", length, kind)
