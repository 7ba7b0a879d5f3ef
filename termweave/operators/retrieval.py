"""Keyword and vector search for many queries at once, and their fusion."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written
from .blocks import held

#: The rarest tokens of a query, of which a text must have all before the others are looked for.
RAREST = 3
#: Numbers of eight bytes that are broadcast at most, to choose what is shuffled.
BROADCAST_ROWS = 2_000_000
#: Queries that a task holds at a time, as a matrix.
QUERY_BLOCK = 512
#: Vectors of one group that a task multiplies them with.
SLICE = 16_384


def postings(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """Key, token, tf. Counted within each task before the shuffle, so frequent words don't gather."""
    return docs.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def chosen(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The postings of the queries' tokens alone (column token). Tokens that fit a broadcast, as their table's size tells, choose before
    postings are counted, so what no query asks for is not shuffled."""
    return index.join(written(queries.select("token").filter("token is not null").distinct(), "asked"), "token", "left_semi")


def asked_for(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The chosen ones as a table, so that texts are read once however often it is used."""
    return written(chosen(index, queries), "asked-postings")


def _scored(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy("query_id", key).agg(F.round(F.sum(1 - 1 / (1 + F.col("tf"))), 6).alias("score"), F.count("*").alias("matched"))


def keyword_search(index: DataFrame, queries: DataFrame, k: int | None = None, match_all: bool = False, key: str = "doc_id") -> DataFrame:
    """Queries has query_id and token (distinct). score is the sum of 1 - 1 / (1 + tf), a substitute for a
    database's own rank; match_all keeps only texts with every token of the query. Ties go to the smaller key.

    With match_all, a text is looked at where it has all of a query's RAREST rarest tokens, and its others are looked for only then."""
    if match_all:
        df = index.join(queries.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
        rarest = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "token")
        of = queries.join(df, "token", "left").withColumns({"turn": F.row_number().over(rarest), "wanted": F.count("*").over(Window.partitionBy("query_id"))})
        texts = index.join(of.filter(F.col("turn") <= RAREST), "token").groupBy("query_id", key).agg(F.count("*").alias("n"), F.first("wanted").alias("wanted"))
        texts = texts.filter(F.col("n") == F.least("wanted", F.lit(RAREST))).select("query_id", key, "wanted")
        hits = _scored(texts.join(queries, "query_id").join(index, [key, "token"]), key)
        hits = hits.join(queries.groupBy("query_id").agg(F.count("*").alias("wanted")), "query_id").filter("matched = wanted").drop("wanted")
    else:
        hits = _scored(index.join(queries, "token"), key)
    return hits if k is None else top_k(hits, k, ["query_id"], F.desc("score"), key)


def _query_words(queries: DataFrame, first: int, shortest: int) -> DataFrame:
    q = queries.filter("query is not null").select("query_id", T.is_japanese(F.col("query")).alias("japanese"), T.tokens(F.col("query")).alias("t"))
    short = F.filter(F.slice("t", 1, first), lambda x: F.length(x) >= shortest)
    return q.select("query_id", "japanese", F.explode(F.array_distinct(F.when(F.col("japanese"), short).otherwise(F.col("t")))).alias("token"))


def _among(rows: DataFrame, few: DataFrame, *columns: str) -> DataFrame:
    """The rows whose columns have a hash among those of few, so that of the others none is shuffled. Another value with the same hash may stay."""
    hashes = written(few.select(F.xxhash64(*columns).alias("_hash")).distinct(), "asked-hashes")
    hashes = F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes
    return rows.withColumn("_hash", F.xxhash64(*columns)).join(hashes, "_hash", "left_semi").drop("_hash")


def keyword_queries_in(docs: DataFrame, tokens: Column, queries: DataFrame, k: int = 20, key: str = "doc_id", first: int = 5, shortest: int = 2) -> DataFrame:
    """What keyword_queries gives for the postings of docs, for many long queries: no word is shuffled that isn't among a query's
    rarest, and of a text only where it has all of these for some query.

    Rare is what few of the queries have, as these are read anyway; that choice changes the speed, not the result."""
    words = written(_query_words(queries, first, shortest), "asked-words")
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("query_id").orderBy("df", F.desc(F.length("token")), "token")
    of = words.filter("not japanese").join(df, "token").withColumns({"turn": F.row_number().over(rarest), "wanted": F.count("*").over(Window.partitionBy("query_id"))})
    rare = written(of.filter(F.col("turn") <= RAREST).select("query_id", "token", F.least("wanted", F.lit(RAREST)).alias("wanted")), "rarest")
    any_words = words.filter("japanese").select("query_id", "token")
    said = docs.select(key, F.explode(tokens).alias("token"))
    found = _among(said, rare.select("token").unionByName(any_words.select("token")), "token").groupBy(key, "token").agg(F.count("*").alias("tf"))
    found = written(found, "rare-postings")
    texts = found.join(rare, "token").groupBy("query_id", key).agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")).filter("n = wanted").select(key)
    whole = written(postings(_among(docs, texts, key), tokens, key), "asked-postings")
    any_of = keyword_search(found, any_words, key=key)
    all_of = keyword_search(whole, words.filter("not japanese").drop("japanese"), match_all=True, key=key)
    return top_k(any_of.unionByName(all_of), k, ["query_id"], F.desc("score"), key)


def keyword_queries(index: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", first: int = 5, shortest: int = 2) -> DataFrame:
    """J5 for texts as queries (query_id, query, its tokens between blanks): of a Japanese one any of its first tokens that
    have two characters and more, of any other all of its tokens, so one that a text lacks rules it out."""
    words = _query_words(queries, first, shortest)
    any_of = keyword_search(index, words.filter("japanese").drop("japanese"), key=key)
    all_of = keyword_search(index, words.filter("not japanese").drop("japanese"), match_all=True, key=key)
    return top_k(any_of.unionByName(all_of), k, ["query_id"], F.desc("score"), key)


def top_k(df: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first k rows of each group and their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def vector_search(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", chunks: int | None = None, minimum: float | None = None, digits: int = 6, group: str | None = None) -> DataFrame:
    """query_id, key, score and rank of the k best vectors for each query; zero vectors take no part in cosine. With group, a
    column of both tables, only vectors of the query's own group are looked at.

    Queries meet the corpus in blocks: each task multiplies a slice of the corpus with one block and keeps its k best,
    so no pair of a query and a vector becomes a row before it is among them. A group has as many slices and blocks as it
    needs, so a large one is spread. metric: cosine, inner, l2 (as -distance) or closeness, 1 / (1 + distance).
    """
    spark = corpus.sparkSession
    of = (lambda df: F.col(group)) if group else (lambda df: F.lit(0))
    q = queries.select(of(queries).alias("g"), F.col("query_id").cast("long").alias("query_id"), F.col(vector).alias("v")).filter("v is not null")
    c = corpus.select(of(corpus).alias("g"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).filter("v is not null")
    if group:
        n = c.groupBy("g").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("chunks")).join(q.groupBy("g").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")), "g")
        q, c = q.join(n, "g"), c.join(n, "g")
    else:
        blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        chunks = chunks or max(1, corpus.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
        q, c = (x.withColumn("chunks", F.lit(chunks)).withColumn("blocks", F.lit(blocks)) for x in (q, c))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("chunk", every("chunks")).drop("chunks", "blocks")
    c = c.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).withColumn("block", every("blocks")).drop("chunks", "blocks")

    def matrix(table: pa.Table) -> np.ndarray:
        return np.array(table.column("v").to_pylist(), np.float64)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, b = matrix(left), matrix(right)
            keys, ids = np.array(right.column("key").to_pylist()), left.column("query_id").to_pylist()
            if metric in ("l2", "closeness"):
                far = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
                scores = -far if metric == "l2" else 1 / (1 + far)
            else:
                scores = a @ b.T
                if metric == "cosine":
                    with np.errstate(divide="ignore", invalid="ignore"):
                        scores = scores / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
            scores = np.round(scores, digits)
            for i, row in zip(ids, scores):
                fine = np.flatnonzero(np.isfinite(row) & (row >= (-np.inf if minimum is None else minimum)))
                order = fine[np.lexsort((keys[fine], -row[fine]))][:k]
                out += [(i, int(keys[j]), float(row[j])) for j in order]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), key: pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    found = q.groupBy("g", "chunk", "block").cogroup(c.groupBy("g", "chunk", "block")).applyInArrow(best, f"query_id bigint, {key} bigint, score double")
    return top_k(found, k, ["query_id"], F.desc("score"), key)


def identity(key: Column, content: Column, characters: int | None = 100) -> Column:
    """M4: what tells chunks apart: the key, or for chunks without one the first characters of their content; with None, its hash."""
    return F.coalesce(key.cast("string"), F.sha2(content, 256) if characters is None else F.left(content, F.lit(characters)))


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, final_k: int | None = None, key: str = "doc_id") -> DataFrame:
    """Lists has query_id, list_id, key and rank. Ties: the first list that has the key, then its rank, then the key.
    Rows with a null key are one; identity() gives keys to chunks that have none."""
    fused = lists.groupBy("query_id", key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("list_id", "rank")).alias("seen"))
    ranked = fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "seen", key)).cast("long"))
    ranked = ranked if final_k is None else ranked.filter(F.col("fused_rank") <= final_k)
    return ranked.select("query_id", key, "rrf", "fused_rank")


#: X19, fixed values: what stands in a query, and the terms that it asks for.
PATTERN_TERMS = {
    "亜酸化窒素": ("N2O", "nitrous oxide"),
    "二酸化炭素": ("CO2", "carbon dioxide"),
    "一酸化炭素": ("CO", "carbon monoxide"),
    "窒素酸化物": ("NOx", "nitrogen oxides"),
    "硫黄酸化物": ("SOx", "sulfur oxides"),
    "温室効果ガス": ("GHG", "greenhouse gas"),
    "国際海事機関": ("IMO", "International Maritime Organization"),
    "アンモニア": ("NH3", "ammonia"),
    "水素": ("H2", "hydrogen"),
    "メタン": ("CH4", "methane"),
    "削減": ("reduction", "mitigation"),
    "排出": ("emission", "discharge"),
    "燃焼": ("combustion", "burning"),
    "効率": ("efficiency",),
    "環境影響": ("environmental impact",),
}


def pattern_terms(spark: SparkSession) -> DataFrame:
    """Pattern, term."""
    return spark.createDataFrame([(p, t) for p, ts in PATTERN_TERMS.items() for t in ts], "pattern string, term string")


def similar_terms(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, term and confidence of the k terms nearest to each query vector, 1 less the cosine distance d where d < 1,
    else 0. vectors: term, embedding; queries: query_id, embedding. Of terms equally far, a hash of the term decides."""
    numbered = vectors.withColumn("_n", F.xxhash64("term"))
    near = vector_search(numbered, queries, k, key="_n").join(numbered.select("_n", "term"), "_n")
    d = F.round(1 - F.col("score"), 6)
    return near.select("query_id", "term", F.when(d < 1, F.round(1 - d, 6)).otherwise(0.0).alias("confidence"))


def reverse_lookup(terms: DataFrame, queries: DataFrame, patterns: DataFrame | None = None, similar: DataFrame | None = None, k: int = 10) -> DataFrame:
    """query_id, term, branch, confidence, rank: terms for descriptions. terms has term and keys (phrases, array);
    queries has query_id and query; patterns pattern and term; similar query_id, term and confidence.

    Branches, of which the first that has a term decides: 0 a key equals the query, 1.0; 1 one holds the other, X18, by
    the key that gives most; 2 a pattern stands in the query, 0.8; 3 similar vectors. Keys and queries are compared in
    lower case, patterns as they are."""
    keys = terms.select("term", F.explode("keys").alias("key")).select("term", F.lower("key").alias("key")).filter("key <> ''").distinct()
    asked = queries.select("query_id", F.lower("query").alias("query")).filter("query <> ''")
    exact = keys.join(asked, F.col("key") == F.col("query")).select("query_id", "term", F.lit(0).alias("branch"), F.lit(1.0).alias("confidence"))
    both = held(keys, "key", asked, "query").unionByName(held(asked, "query", keys, "key")).filter("key <> query")
    near = both.groupBy("query_id", "term").agg(F.max(F.round(T.partial_confidence(F.col("key"), F.col("query")), 6)).alias("confidence"))
    found = exact.unionByName(near.select("query_id", "term", F.lit(1).alias("branch"), "confidence"))
    if patterns is not None:
        hit = held(patterns, "pattern", queries, "query")
        found = found.unionByName(hit.select("query_id", "term", F.lit(2).alias("branch"), F.lit(0.8).alias("confidence")))
    if similar is not None:
        found = found.unionByName(similar.select("query_id", "term", F.lit(3).alias("branch"), "confidence"))
    first = found.groupBy("query_id", "term").agg(F.min_by(F.struct("branch", "confidence"), F.struct("branch", -F.col("confidence"))).alias("b")).select("query_id", "term", "b.*")
    return top_k(first, k, ["query_id"], F.desc("confidence"), "branch", "term")
