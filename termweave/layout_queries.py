"""Registered queries that write each layout from the given tables, read it back and return its rows, and of a stream; SQL for DuckDB."""

import uuid

from pyspark.sql import functions as F

from .deep_queries import QUERIES, SQL, query, table  # noqa: F401
from .sources import files, layouts
from .storage import shared_folder, spread
from .streaming import counts


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/termweave/{name}-{uuid.uuid4().hex}"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_type").alias("definition"), F.array_sort(F.collect_set("p_brand")).alias("aliases"), F.min("p_size").cast("int").alias("size"))


_PARTS = "SELECT p_name AS term, min(p_type) AS definition, list_sort(list_distinct(list(p_brand))) AS aliases, min(p_size)::INT AS size FROM part GROUP BY 1"


@query(f"SELECT term, definition, array_to_string(aliases, ',') AS aliases, size FROM ({_PARTS})")
def layout_terms(spark, sf_dir):
    """The object of terms."""
    path = _place(spark, "terms")
    layouts.write_object(layouts.term_object(_parts(spark, sf_dir)), F.col("value"), path)
    back = layouts.read_object(spark, path, "terms array<struct<term:string,definition:string,aliases:array<string>,size:int>>")
    return back.select(F.inline("terms")).withColumn("aliases", F.array_join("aliases", ","))


@query(f"SELECT term, size::DOUBLE AS score FROM ({_PARTS})")
def layout_candidates(spark, sf_dir):
    """The object of candidates, by the reader of any candidate list."""
    path = _place(spark, "candidates")
    layouts.write_object(layouts.term_object(_parts(spark, sf_dir).select("term", F.col("size").cast("double").alias("score")), "candidates"), F.col("value"), path)
    return files.candidates(spark, path)


@query(f"SELECT row_number() OVER (ORDER BY size DESC, term) - 1 AS place, term, size::DOUBLE AS score, size / 2.0::DOUBLE AS tfidf_score, len(aliases)::BIGINT AS frequency, definition AS kind FROM ({_PARTS})")
def layout_scored(spark, sf_dir):
    """The list of scored terms, best first."""
    path, p = _place(spark, "scored"), _parts(spark, sf_dir)
    scored = p.select("term", F.col("size").cast("double").alias("score"), (F.col("size") / 2).alias("tfidf_score"), F.lit(0.0).alias("cvalue_score"), F.size("aliases").cast("long").alias("frequency"), F.create_map(F.lit("kind"), "definition").alias("metadata"))
    layouts.write_object(layouts.scored_object(scored), F.col("value"), path)
    item = "array<struct<term:string,score:double,tfidf_score:double,cvalue_score:double,frequency:bigint,metadata:map<string,string>>>"
    back = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", item)).alias("place", "x"))
    return back.select(F.col("place").cast("long").alias("place"), "x.term", "x.score", "x.tfidf_score", "x.frequency", F.col("x.metadata")["kind"].alias("kind"))


@query(f"SELECT 'group ' || size % 5 AS category, size % 5 - 1 AS cluster_id, term FROM ({_PARTS}) WHERE size % 5 > 0")
def layout_clusters(spark, sf_dir):
    """The clustering result, by the reader of its rows; noise is in the counts alone."""
    path, p = _place(spark, "clusters"), _parts(spark, sf_dir)
    members = p.select(F.concat(F.lit("group "), F.col("size") % 5).alias("category"), (F.col("size") % 5 - 1).alias("cluster_id"), "term")
    layouts.write_object(layouts.cluster_object(members, spark.createDataFrame([(0.5,)], "silhouette double")), F.col("value"), path)
    return files.cluster_rows(spark, path)


_STEPS = "SELECT k AS stage_index, list_sort(list(s_name) FILTER (s_suppkey % (k + 1) = 0 OR k = 0)) AS terms_before, list_sort(list(s_name) FILTER (s_suppkey % (k + 2) = 0)) AS terms_after FROM supplier, range(4) AS g(k) GROUP BY 1"


@query(f"SELECT stage_index, len(terms_before)::BIGINT AS before, len(terms_after)::BIGINT AS after, len(list_filter(terms_before, lambda x: NOT list_contains(terms_after, x)))::BIGINT AS removed, len(list_filter(terms_after, lambda x: NOT list_contains(terms_before, x)))::BIGINT AS added, 4::BIGINT AS stages FROM ({_STEPS})")
def layout_log(spark, sf_dir):
    """The extraction log: the counts that it holds of each stage, and how many stages its summary says."""
    path, s = _place(spark, "log"), table(spark, sf_dir, "supplier").select("s_name", "s_suppkey", F.explode(F.array(*map(F.lit, range(4)))).alias("stage_index"))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("s_name"))))
    stages = s.groupBy("stage_index").agg(names((F.col("s_suppkey") % (F.col("stage_index") + 1) == 0) | (F.col("stage_index") == 0)).alias("terms_before"), names(F.col("s_suppkey") % (F.col("stage_index") + 2) == 0).alias("terms_after"))
    layouts.write_object(layouts.log_object(stages.withColumn("name", F.concat(F.lit("stage "), "stage_index"))), F.col("value"), path)
    counts = "struct<terms_before_count:bigint,terms_after_count:bigint,removed_count:bigint,added_count:bigint>"
    back = layouts.read_object(spark, path, f"stages array<struct<stage_index:bigint,statistics:{counts}>>, summary struct<total_stages:bigint>")
    rows = back.select(F.col("summary.total_stages").alias("stages"), F.explode("stages").alias("s")).select("stages", "s.stage_index", "s.statistics.*")
    return rows.select("stage_index", F.col("terms_before_count").alias("before"), F.col("terms_after_count").alias("after"), F.col("removed_count").alias("removed"), F.col("added_count").alias("added"), "stages")


@query("SELECT count(*) AS total, count(*) FILTER (s_suppkey % 5 <> 0) AS extracted, count(*) FILTER (s_suppkey % 5 = 0) AS missed, min(s_name) FILTER (s_suppkey % 5 = 0) AS first_missed FROM supplier")
def layout_dropout(spark, sf_dir):
    """The report of lost terms; a term is there after its last stage, the fourth, or not."""
    path, s = _place(spark, "dropout"), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("term"), "s_suppkey", F.explode(F.array(*map(F.lit, range(4)))).alias("stage_index"))
    trace = s.select("term", "stage_index", F.concat(F.lit("stage "), "stage_index").alias("stage"), (F.col("s_suppkey") % (F.col("stage_index") + 2) != 0).alias("present"))
    layouts.write_object(files.dropout_layout(trace), F.col("value"), path)
    back = layouts.read_object(spark, path, "summary struct<total_ground_truth:bigint,extracted:bigint,missed:bigint>, missed_terms array<string>")
    return back.select(F.col("summary.total_ground_truth").alias("total"), "summary.extracted", "summary.missed", F.get("missed_terms", F.lit(0)).alias("first_missed"))


_METRICS = "SELECT 'question ' || p_partkey AS question, round(1.0::DOUBLE / (1 + p_size), 6) AS mrr, k, m AS metric, round(((p_size + len(m)) % (k + 1))::DOUBLE / (k + 1), 6) AS value FROM part, (VALUES (1), (3), (5), (10)) AS a(k), (VALUES ('recall'), ('precision'), ('ndcg'), ('hit_rate')) AS b(m)"


def _metrics(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("question "), "p_partkey").alias("question"), F.round(1 / (1 + F.col("p_size")), 6).alias("mrr"), "p_size", F.explode(F.array(*map(F.lit, layouts.RANKS))).alias("k"))
    return p.select("question", "mrr", "k", *(F.round(((F.col("p_size") + len(m)) % (F.col("k") + 1)) / (F.col("k") + 1), 6).alias(m) for m in layouts.METRICS))


@query(f"SELECT 'own' AS method, * FROM ({_METRICS})")
def layout_metrics(spark, sf_dir):
    path = _place(spark, "metrics")
    files.write_csv(layouts.metric_rows(_metrics(spark, sf_dir).withColumn("method", F.lit("own"))), path)
    return layouts.read_metrics(spark, path)


@query(f"SELECT * FROM ({_METRICS}) WHERE k < 10")
def layout_metrics_lower(spark, sf_dir):
    path = _place(spark, "metrics")
    files.write_csv(layouts.metric_rows(_metrics(spark, sf_dir), layouts.RANKS[:3], report=False), path)
    return layouts.read_metrics(spark, path)


def _csv(spark, df, name: str, schema: str):
    path = _place(spark, name)
    files.write_csv(df, path)
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True, emptyValue="")


@query("SELECT conv_id || '_chunk_' || turn AS chunk_id, turn AS ordinal, text FROM conversations")
def layout_chunks(spark, sf_dir):
    """Chunks with their texts, whatever stands in them."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("_chunk_", "conv_id", "turn").alias("chunk_id"), F.col("turn").cast("long").alias("ordinal"), "text")
    return _csv(spark, spread(c), "chunks", "chunk_id string, ordinal long, text string").withColumn("ordinal", F.col("ordinal"))


@query(f"SELECT term, definition, array_to_string(aliases, '|') AS aliases FROM ({_PARTS})")
def layout_dictionary(spark, sf_dir):
    return _csv(spark, _parts(spark, sf_dir).select("term", "definition", "aliases"), "dictionary", "term string, definition string, aliases string")


@query("SELECT q.text AS question, min(a.text) AS answer FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' GROUP BY q.conv_id, q.turn, q.text")
def layout_answers(spark, sf_dir):
    """Questions and answers of a bulk run."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"])
    return _csv(spark, rows.groupBy("conv_id", "turn", "question").agg(F.min("answer").alias("answer")).select("question", "answer"), "answers", "question string, answer string")


@query(r"""WITH l AS (SELECT conv_id, turn, string_split(lower(text), chr(10)) AS ls FROM conversations),
w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(unnest(ls)), '\s+'), lambda x: x <> '') AS w FROM l),
r AS (SELECT conv_id, turn, n, w, unnest(range(len(w) - n + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS g(n) WHERE len(w) >= n)
SELECT array_to_string(list_slice(w, i + 1, i + n), ' ') AS term, count(*) AS frequency, count(DISTINCT (conv_id, turn)) AS documents FROM r GROUP BY 1""")
def stream_term_counts(spark, sf_dir):
    """Counts kept by a stream: a third of the turns comes first in an older version, which the newer one takes back."""
    source, out, state = (_place(spark, f"stream-{name}") for name in ("in", "counts", "state"))
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.lit(1).cast("long").alias("version"), "text", "turn")
    for part in (c.filter("turn % 3 = 0").withColumns({"version": F.lit(0).cast("long"), "text": F.concat(F.lit("old words "), "text")}), c):
        part.select("chunk_id", "version", "text").write.mode("append").parquet(source)
        counts.stream_counts(spark, source, out, state).awaitTermination()
    return counts.counts(spark, out).filter("term is not null")
