"""The files that results are kept in, written and read back; S5, S6, R14: which files a load takes.

A JSON layout is one object in one file, so its lists are reports: a term list, a run's log. Tables of any size go as lines or CSV, a
file for each partition.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import TEXT_TYPES, whole_texts

#: Types that a load knows, and those that another reader takes.
KNOWN, PAGES = (*TEXT_TYPES, "pdf"), ("pdf",)
#: Ranks down to which metrics are kept.
RANKS = (1, 3, 5, 10)
METRICS = ("recall", "precision", "ndcg", "hit_rate")


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, size and type (the ending, lower case) of all files below the paths; a path that isn't there is passed over. The
    names are listed by the file system of each path on the driver, as any reader does; contents are not looked at."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for name in [paths] if isinstance(paths, str) else paths:
        place = jvm.org.apache.hadoop.fs.Path(name)
        system = place.getFileSystem(conf)
        if not system.exists(place):
            continue
        found = system.listFiles(place, True)
        while found.hasNext():
            f = found.next()
            rows.append((f.getPath().toString(), f.getLen()))
    df = spark.createDataFrame(rows, "path string, size bigint")
    return df.withColumn("type", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))


def load(spark: SparkSession, paths: str | list[str], skip: bool = False) -> tuple[DataFrame, DataFrame]:
    """(path and text of the text files, path of the page files) below the paths. A file without a byte and one of an unknown type are
    errors, or with skip are left out; blank texts are errors when read."""
    files = listed(spark, paths)
    bad = files.filter((F.col("size") == 0) | ~F.col("type").isin(*KNOWN))
    if not skip and (first := bad.orderBy("path").first()):
        raise ValueError(f"{'empty file' if first.size == 0 else 'no reader for'}: {first.path}")
    good = files.join(bad.select("path"), "path", "left_anti")
    names = [r.path for r in good.filter(F.col("type").isin(*TEXT_TYPES)).select("path").collect()]  # names alone
    found = whole_texts(spark.read.text(names, wholetext=True)) if names else spark.createDataFrame([], "path string, text string")
    return found, good.filter(F.col("type").isin(*PAGES)).select("path")


def write_object(df: DataFrame, value: Column, path: str) -> None:
    """The only row's JSON object as one file of text."""
    df.select(value.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The object's fields as one row."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("o")).select("o.*")


def term_object(terms: DataFrame, name: str = "terms", order: str = "term") -> DataFrame:
    """{"terms": [...]}, or candidates: all columns of each row, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *(c for c in terms.columns if c != order))))
    return terms.agg(F.to_json(F.struct(rows.alias(name))).alias("value"))


def scored_object(terms: DataFrame) -> DataFrame:
    """[{"term", "score", "tfidf_score", "cvalue_score", "frequency", "metadata"}, ...], best first; metadata is a map."""
    item = F.struct("term", "score", "tfidf_score", "cvalue_score", "frequency", "metadata")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("term").alias("t"), F.to_json(item).alias("v"))))
    return terms.agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda x: x["v"]), ","), F.lit("]")).alias("value"))


def cluster_object(members: DataFrame, silhouette: DataFrame) -> DataFrame:
    """{"status", "total_terms", "clustering_stats", "categories"} of members (category, cluster_id, term; noise is -1) and a one-row
    table with the silhouette."""
    each = members.filter("cluster_id >= 0").groupBy("category", "cluster_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    entries = F.array_sort(F.collect_list(F.struct("category", F.struct("terms", "cluster_id").alias("c"))))
    categories = each.agg(F.map_from_entries(entries).alias("categories"), F.count("*").alias("n"))
    n = members.agg(F.count("*").alias("total"), F.count_if(F.col("cluster_id") < 0).alias("noise"))
    stats = F.struct(F.col("n").alias("n_clusters"), F.col("noise").alias("n_noise"), F.col("silhouette").alias("silhouette_score"))
    whole = F.struct(F.lit("success").alias("status"), F.col("total").alias("total_terms"), stats.alias("clustering_stats"), "categories")
    return categories.crossJoin(n).crossJoin(silhouette).select(F.to_json(whole).alias("value"))  # a row each


def log_object(stages: DataFrame) -> DataFrame:
    """{"stages": [...], "summary": {...}} of stages (stage_index, name, terms_before, terms_after: arrays): what each removed and added,
    with its counts, and the counts of all."""
    removed, added = F.array_sort(F.array_except("terms_before", "terms_after")), F.array_sort(F.array_except("terms_after", "terms_before"))
    s = stages.select("stage_index", "name", "terms_before", "terms_after", removed.alias("removed_terms"), added.alias("added_terms"))
    counts = F.struct(*(F.size(c).alias(n) for c, n in (("terms_before", "terms_before_count"), ("terms_after", "terms_after_count"), ("removed_terms", "removed_count"), ("added_terms", "added_count"))))
    rows = F.array_sort(F.collect_list(F.struct("stage_index", "name", "terms_before", "terms_after", "removed_terms", "added_terms", counts.alias("statistics"))))
    summary = F.struct(F.count("*").alias("total_stages"), F.min_by(F.size("terms_before"), "stage_index").alias("initial_terms"), F.max_by(F.size("terms_after"), "stage_index").alias("final_terms"), F.sum(F.size("removed_terms")).alias("removed"))
    return s.agg(rows.alias("stages"), summary.alias("summary")).select(F.to_json(F.struct("stages", "summary")).alias("value"))


def metric_rows(metrics: DataFrame, ranks: tuple[int, ...] = RANKS, report: bool = True) -> DataFrame:
    """A row for each question, from question, mrr, k and the metrics at k (and method, for the report): MRR, Recall@1, Precision@1, ...; the other
    form has lower case names and no method. A rank that a question lacks is 0."""
    name = (lambda m: {"recall": "Recall", "precision": "Precision", "ndcg": "nDCG", "hit_rate": "Hit_Rate"}[m]) if report else str
    at = [F.coalesce(F.max(F.when(F.col("k") == k, F.col(m))), F.lit(0.0)).alias(f"{name(m)}@{k}") for k in ranks for m in METRICS]
    return metrics.groupBy(*(["method"] if report else []), "question").agg(F.max("mrr").alias("MRR" if report else "mrr"), *at)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """question, mrr, k, metric and value of either form."""
    df = spark.read.csv(path, header=True, inferSchema=True, escape='"', multiLine=True)
    low = {c: c.lower() for c in df.columns}
    cells = F.array(*(F.struct(F.lit(int(c.split("@")[1])).alias("k"), F.lit(low[c].split("@")[0]).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in df.columns if "@" in c))
    mrr = next(c for c in df.columns if low[c] == "mrr")
    return df.select(*(["method"] if "method" in df.columns else []), "question", F.col(mrr).alias("mrr"), F.explode(cells).alias("x")).select("*", "x.*").drop("x")
