"""From raw documents to packed training sequences: rules, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, with whatever other columns came along. Null texts are empty: the rules reject them.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import decontamination, ngram_join, packing, pii, quality_rules
from termweave.llm.common import written

#: Names of documents of about 30 bytes that are broadcast at most.
BROADCAST_LEAKS = 200_000


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. The rules read each text in place, so no join follows."""
    return quality_rules.kept_rows(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 per cent of their runs of five words, the one with the smallest doc_id. The query
    op10_ngram_join has limits of its own: four words, 85 per cent."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Up to BROADCAST_LEAKS names of those that have one go to the documents."""
    leaks = decontamination.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "text_key").distinct()
    leaks = written(leaks, "leaks")
    if leaks.count() <= BROADCAST_LEAKS:
        leaks = F.broadcast(leaks)
    # A document is one column, so none of its own has a name of these. An id may be null, so it is compared as such; the text's
    # key carries the join.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.xxhash64(docs["text"]).alias("key"))
    same = (F.col("key") == F.col("text_key")) & F.col("doc.doc_id").eqNullSafe(F.col("leak_id"))
    return whole.join(leaks.withColumnRenamed("doc_id", "leak_id"), same, "left_anti").select("doc.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the text, and is put in where it is missing."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_by_rules),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Ids of a tokenizer have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
