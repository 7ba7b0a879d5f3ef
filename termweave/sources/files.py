"""Readers and writers of texts, tables and candidate lists. Everything goes through Spark's sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_TYPES = ("txt", "md")


def texts(spark: SparkSession, path: str | list[str], types: tuple[str, ...] = TEXT_TYPES) -> DataFrame:
    """Path and text of each file of these types below the folders; files that vanish are passed over.

    Fails on a blank file when read, and on a type that no reader is known for at once. A file of no bytes has no row, as
    Spark does not list it."""
    if unknown := set(types) - set(TEXT_TYPES):
        raise ValueError(f"no reader for {sorted(unknown)}")
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    return whole_texts(reader.option("pathGlobFilter", "*.{" + ",".join(types) + "}").text(path, wholetext=True))


def whole_texts(df: DataFrame) -> DataFrame:
    """path and text of a table of whole texts; a blank one is an error when read."""
    text = F.when(F.col("value").rlike(r"^\s*$"), F.raise_error(F.concat(F.lit("empty file: "), F.input_file_name())).cast("string")).otherwise(F.col("value"))
    return df.select(F.input_file_name().alias("path"), text.alias("text"))


def binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Path and content, for a page reader (see providers)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def questions(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """A CSV table with its file's stem; without header: question and the array of what is expected."""
    df = spark.read.csv(path, header=header, multiLine=True, escape='"')
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    if header:
        return df.withColumn("file", stem)
    rest = [F.trim(c) for c in df.columns[1:]]
    return df.select(F.col(df.columns[0]).alias("question"), F.filter(F.array(*rest) if rest else F.array().cast("array<string>"), lambda x: x.isNotNull() & (x != "")).alias("expected"))


def expected_long(df: DataFrame, question: str, label: str) -> DataFrame:
    """Question, position and value of all columns whose name holds the label; blanks go."""
    columns = [c for c in df.columns if label in c]
    return df.select(F.col(question).alias("question"), F.posexplode(F.array(*(F.trim(F.col(f"`{c}`")) for c in columns))).alias("position", "value")).filter("value is not null and value <> ''")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Term and score of a JSON file: a list of objects with term or headword, an object with terms or candidates
    that holds such a list, or a map from term to score."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    kind = F.when(F.ltrim("v").startswith("["), "list").when(F.get_json_object("v", "$.terms").isNotNull(), "terms").when(F.get_json_object("v", "$.candidates").isNotNull(), "candidates").otherwise("map")
    raw = raw.withColumn("kind", kind)
    item = "array<struct<term:string,headword:string,score:double,revised_score:double>>"
    inner = F.when(F.col("kind") == "list", F.col("v")).when(F.col("kind") == "terms", F.get_json_object("v", "$.terms")).otherwise(F.get_json_object("v", "$.candidates"))
    listed = raw.filter("kind <> 'map'").select(F.explode(F.from_json(inner, item)).alias("x")).select(F.coalesce("x.term", "x.headword").alias("term"), F.coalesce("x.score", "x.revised_score").alias("score"))
    mapped = raw.filter("kind = 'map'").select(F.explode(F.from_json("v", "map<string,double>")).alias("term", "score"))
    return listed.unionByName(mapped).filter("term is not null")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """The distinct true terms of a JSON object of lists: those of all_documents where it is there, else of all lists."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    lists = F.coalesce(F.try_element_at("m", F.lit("all_documents")), F.flatten(F.map_values("m")))
    return raw.select(F.explode(lists).alias("term")).filter("term is not null").distinct()


def cluster_rows(spark: SparkSession, path: str) -> DataFrame:
    """Category, cluster_id, term of a clustering result's categories."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "categories map<string,struct<terms:array<string>,cluster_id:int>>").alias("r"))
    return raw.select(F.explode("r.categories").alias("category", "c")).select("category", "c.cluster_id", F.explode("c.terms").alias("term"))


def flat_cells(cells: DataFrame, key: str) -> DataFrame:
    """Key, row, col, content of every place that a cell with spans covers; missing spans are 1, and where cells overlap
    the one that starts last wins. cells: key, row, col, row_span, col_span, content."""
    span = lambda at, n: F.sequence(F.col(at), F.col(at) + F.coalesce(n, F.lit(1)) - 1)
    placed = cells.filter("row is not null and col is not null").withColumn("r", F.explode(span("row", F.col("row_span")))).withColumn("c", F.explode(span("col", F.col("col_span"))))
    return placed.groupBy(key, "r", "c").agg(F.max_by("content", F.struct("row", "col")).alias("content")).select(key, F.col("r").alias("row"), F.col("c").alias("col"), "content")


def write_json(df: DataFrame, path: str) -> None:
    """A line for each row."""
    df.write.mode("overwrite").json(path)


def terms_layout(terms: DataFrame) -> DataFrame:
    """One row with the JSON object {"terms": [...]} of a term list, best score first; for lists that are a report, not a corpus."""
    return terms.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("score", "term", *(c for c in terms.columns if c not in ("score", "term")))), asc=False).alias("terms"))).alias("value"))


def dropout_layout(trace: DataFrame) -> DataFrame:
    """One row with the JSON object {"summary": ..., "dropout_by_stage": ..., "missed_terms": [...]} of a table term, stage_index,
    stage, present: what became of the true terms, which are a short list."""
    last = trace.groupBy("term").agg(F.max_by("present", "stage_index").alias("there"), F.min_by(F.when(~F.col("present"), F.col("stage")), F.when(~F.col("present"), F.col("stage_index"))).alias("lost_at"))
    n = last.agg(F.count("*").alias("total"), F.count_if("there").alias("extracted"), F.sort_array(F.collect_list(F.when(~F.col("there"), F.col("term")))).alias("missed_terms"))
    lost = last.filter("not there").groupBy("lost_at").agg(F.count("*").alias("n"))
    by_stage = lost.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lost_at", "n")))).alias("dropout_by_stage"))
    summary = F.struct(F.col("total").alias("total_ground_truth"), "extracted", (F.col("total") - F.col("extracted")).alias("missed"), F.round(F.try_divide("extracted", "total"), 6).alias("recall"))
    return n.crossJoin(by_stage).select(F.to_json(F.struct(summary.alias("summary"), "dropout_by_stage", "missed_terms")).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; arrays are joined by |, white space stays, an empty text is "" and null nothing."""
    flat = [F.array_join(F.col(f"`{c}`").cast("array<string>"), "|").alias(c) if kind.startswith("array") else F.col(f"`{c}`") for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""').csv(path)


def write_collection(chunks: DataFrame, path: str) -> None:
    """Chunks by collection; a collection that is written again is replaced, the others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_name").parquet(path)


def write_markdown(pages: DataFrame, path: str) -> None:
    """A file of text lines for each document, with a line that says where it comes from."""
    lines = pages.select("doc_id", F.concat(F.lit("<!-- source: "), "source", F.lit(" -->\n\n"), "text").alias("value"))
    lines.write.mode("overwrite").partitionBy("doc_id").text(path)


def report(title: str, tables: dict[str, DataFrame], rows: int = 100) -> str:
    """A markdown text of small result tables, the first rows of each."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(str(x) for x in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join(out)
