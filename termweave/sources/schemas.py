"""The tables that the operators work on, and what a table at hand lacks of them or has beside."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "document_chunks": "collection_name string, document_id string, chunk_id string, content string, metadata map<string,string>, created_at timestamp",
    "jargon_dictionary": "collection_name string, term string, definition string, domain string, aliases array<string>, related_terms array<string>",
    "knowledge_nodes": "id string, node_type string, term string, definition string, properties map<string,string>",
    "knowledge_edges": "source_id string, target_id string, edge_type string, weight double, confidence double, properties map<string,string>",
}


def bootstrap(spark: SparkSession) -> list[str]:
    """Makes the tables that the catalog lacks; the names of all of them that are there then."""
    for name, schema in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    return [name for name in TABLES if spark.catalog.tableExists(name)]


def difference(spark: SparkSession, columns: list[str], expected: list[str]) -> DataFrame:
    """Column and change (add, drop) that bring a table's columns to those expected; one row for each."""
    rows = [(c, "drop") for c in sorted(set(columns) - set(expected))] + [(c, "add") for c in sorted(set(expected) - set(columns))]
    return spark.createDataFrame(rows, "column string, change string")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table with the columns of TABLES: others go, missing ones are null."""
    schema = df.sparkSession.createDataFrame([], TABLES[name]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
