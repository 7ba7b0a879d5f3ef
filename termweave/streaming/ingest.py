"""Files that keep arriving: new texts become chunks, the last chunk of an id wins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import chunking, dictionary

SCHEMA = "doc_id long, text string"


def stream_chunks(spark: SparkSession, source: str, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Reads Parquet files (doc_id, text) as they come into `source` and appends their chunks to `table`, a folder.

    Each batch is written under its number, so a batch that runs twice replaces itself. latest() gives the upserted view."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunking.chunk_markdown(batch).withColumn("batch", F.lit(number))
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The chunk that was written last for each chunk_id."""
    return dictionary.latest(spark.read.parquet(table), ["chunk_id"], "batch")
