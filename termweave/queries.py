"""The registered queries of the retrieval, mining, graph and evaluation operators, and their SQL for DuckDB.

Every query runs over its whole tables. Sums of doubles are rounded on both sides.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import dictionary as D
from .operators import evaluation as E
from .operators import graph as G
from .operators import retrieval as R
from .operators import similarity as S
from .operators import terms as M
from .storage import spread, written

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENS = r"list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda x: x <> '')"
QUERY_WORDS = {1: ("the", "tion"), 2: ("de", "la", "que"), 3: ("and", "idiot")}
_WORDS_SQL = "(VALUES " + ", ".join(f"({q}, '{w}')" for q, ws in QUERY_WORDS.items() for w in ws) + ") AS q(query_id, token)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _asked(spark):
    return F.broadcast(spark.createDataFrame([(q, w) for q, ws in QUERY_WORDS.items() for w in ws], "query_id int, token string"))


def _index(spark, sf_dir):
    return R.postings(_docs(spark, sf_dir).filter("text is not null"), T.tokens(F.lower("text")))


_POSTINGS = rf"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(trim(lower(text)), '\s+'), lambda x: x <> '')) AS token FROM documents) GROUP BY ALL"


def _pieces(ends: str, least: int) -> str:
    """SQL of X5: stripped pieces of text of at least so many characters."""
    return f"list_filter(list_transform(regexp_split_to_array(text, '{ends}'), lambda x: regexp_replace(x, '^[{T.BLANKS}]+|[{T.BLANKS}]+$', '', 'g')), lambda x: length(x) >= {least})"


def _split_sql(ends: str, least: int) -> str:
    return f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS ordinal, piece FROM (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT doc_id, {_pieces(ends, least)} AS p FROM documents))"


def _split(spark, sf_dir, strict):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"), strict)).alias("ordinal", "piece")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(_split_sql(T.SENTENCE_END, 1))
def chunk_split(spark, sf_dir):
    return _split(spark, sf_dir, False)


@query(_split_sql(T.STRICT_END, 3))
def sentence_split_strict(spark, sf_dir):
    return _split(spark, sf_dir, True)


@query(f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(list_distinct({TOKENS}))::BIGINT AS n_distinct FROM documents")
def token_fallback(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(_POSTINGS)
def postings(spark, sf_dir):
    return _index(spark, sf_dir)


@query(f"WITH p AS ({_POSTINGS}) SELECT query_id, doc_id, round(sum(1 - 1.0 / (1 + tf)), 6) AS score, count(*) AS matched FROM p JOIN {_WORDS_SQL} USING (token) GROUP BY ALL")
def keyword_or(spark, sf_dir):
    return R.keyword_search(_index(spark, sf_dir), _asked(spark))


@query(f"WITH p AS ({_POSTINGS}), s AS (SELECT query_id, doc_id, round(sum(1 - 1.0 / (1 + tf)), 6) AS score, count(*) AS matched FROM p JOIN {_WORDS_SQL} USING (token) GROUP BY ALL), n AS (SELECT query_id, count(*) AS n FROM {_WORDS_SQL} GROUP BY 1) SELECT query_id, doc_id, score, matched, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN n ON s.query_id = n.query_id AND matched = n) WHERE rank <= 20")
def keyword_and(spark, sf_dir):
    return R.keyword_search(R.asked_for(_index(spark, sf_dir), _asked(spark)), _asked(spark), k=20, match_all=True)


@query("SELECT source AS collection_name, count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1")
def collection_stats(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.col("source").alias("collection_name")).agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.sum("n_chars").alias("n_chars"))


@query("SELECT 'chat' AS collection_name, conv_id::VARCHAR AS document_id, count(*) AS n_chunks, max(turn)::BIGINT AS last_at FROM conversations GROUP BY conv_id")
def document_list(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("collection_name"), F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("created_at"))
    return D.collection_statistics(c)


@query("SELECT conv_id, chunk_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, chunk_id) - 1) AS ordinal FROM (SELECT conv_id, turn, conv_id || '_chunk_' || turn AS chunk_id FROM conversations)")
def chunks_ordered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("chunk_id", F.concat_ws("_chunk_", "conv_id", "turn"))
    return D.numbered(c.withColumn("n", T.chunk_number(F.col("chunk_id"))), "conv_id", ["n", "chunk_id"]).select("conv_id", "chunk_id", "ordinal")


def _dictionary(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("collection_name"), F.col("p_name").alias("term"), F.concat_ws(" ", "p_type", "p_size").alias("definition"), F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).when(F.col("p_size") % 3 == 1, "").otherwise(F.col("p_type")).alias("domain"), F.when(F.col("p_size") % 2 == 0, F.split("p_type", " ")).otherwise(F.array().cast("array<string>")).alias("aliases"), F.col("p_partkey").alias("id"))


_DICT = "SELECT p_brand AS collection_name, p_name AS term, p_type || ' ' || p_size AS definition, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END AS domain, CASE WHEN p_size % 2 = 0 THEN string_split(p_type, ' ') ELSE []::VARCHAR[] END AS aliases, p_partkey AS id FROM part"
_OLD = f"(SELECT DISTINCT ON (collection_name, term) * FROM ({_DICT}) WHERE id % 3 <> 0 ORDER BY collection_name, term, id DESC)"
_NEW = f"(SELECT collection_name, term, 'new ' || definition AS definition, domain, aliases, id FROM (SELECT DISTINCT ON (collection_name, term) * FROM ({_DICT}) WHERE id % 2 = 0 ORDER BY collection_name, term, id DESC))"


def _halves(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    old, new = (D.latest(d.filter(c), D.KEY, "id") for c in ("id % 3 <> 0", "id % 2 = 0"))
    return old, new.withColumn("definition", F.concat(F.lit("new "), "definition"))


@query(f"SELECT collection_name, term, id FROM ({_DICT}) WHERE contains(lower(term), 'ma') OR contains(lower(definition), 'ma') OR len(list_filter(aliases, lambda x: contains(lower(x), 'ma'))) > 0")
def dictionary_search(spark, sf_dir):
    return D.search(_dictionary(spark, sf_dir), "MA").select("collection_name", "term", "id")


@query(f"SELECT coalesce(a.collection_name, b.collection_name) AS collection_name, coalesce(a.term, b.term) AS term, coalesce(b.definition, a.definition) AS definition, CASE WHEN b.term IS NULL THEN a.domain WHEN a.term IS NULL THEN b.domain ELSE coalesce(b.domain, a.domain) END AS domain, array_to_string(CASE WHEN b.term IS NULL THEN a.aliases WHEN a.term IS NULL OR len(b.aliases) > 0 THEN b.aliases ELSE a.aliases END, '|') AS aliases FROM {_OLD} a FULL JOIN {_NEW} b ON a.collection_name = b.collection_name AND a.term = b.term")
def dictionary_upsert_keep_old(spark, sf_dir):
    return D.upsert_keeping(*_halves(spark, sf_dir)).select("collection_name", "term", "definition", "domain", F.array_join("aliases", "|").alias("aliases"))


@query(f"SELECT coalesce(a.collection_name, b.collection_name) AS collection_name, coalesce(a.term, b.term) AS term, coalesce(b.definition, a.definition) AS definition, CASE WHEN b.term IS NULL THEN a.domain WHEN a.term IS NULL THEN b.domain ELSE coalesce(nullif(b.domain, ''), a.domain) END AS domain, array_to_string(CASE WHEN b.term IS NULL THEN a.aliases ELSE b.aliases END, '|') AS aliases FROM {_OLD} a FULL JOIN {_NEW} b ON a.collection_name = b.collection_name AND a.term = b.term")
def dictionary_upsert(spark, sf_dir):
    return D.upsert_replacing(*_halves(spark, sf_dir)).select("collection_name", "term", "definition", "domain", F.array_join("aliases", "|").alias("aliases"))


@query(f"SELECT a.collection_name, a.term, a.id FROM {_OLD} a ANTI JOIN {_NEW} b ON a.collection_name = b.collection_name AND a.term = b.term")
def dictionary_delete(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return D.delete(old, new).select("collection_name", "term", "id")


@query(f"SELECT collection_name, count(*) AS n_terms, count(domain) AS n_domain, count(*) FILTER (len(aliases) > 0) AS n_with_aliases, round(avg(CASE WHEN len(aliases) > 0 THEN len(aliases) END), 6) AS avg_aliases FROM ({_DICT}) GROUP BY 1")
def dictionary_stats(spark, sf_dir):
    return D.statistics(_dictionary(spark, sf_dir))


@query(f"SELECT count(*) AS n_terms, sum(len(aliases))::BIGINT AS n_aliases FROM ({_DICT})")
def dictionary_totals(spark, sf_dir):
    return D.totals(_dictionary(spark, sf_dir))


@query(f"SELECT domain, count(*) AS n FROM ({_DICT}) GROUP BY 1")
def category_counts(spark, sf_dir):
    return D.category_counts(_dictionary(spark, sf_dir))


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


_COSINE = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"SELECT query_id, vec_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round({_COSINE}, 5) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 5) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10")
def vector_knn(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return R.vector_search(e, e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10, digits=5)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round({_COSINE}, 5) >= 0.3")
def pair_similarity(spark, sf_dir):
    return S.similar_pairs(_embeddings(spark, sf_dir), 0.3, digits=5)


_PAIRS6 = f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query(f"WITH p AS (SELECT * FROM ({_PAIRS6}) WHERE s >= 0.25), t AS (SELECT a AS src, b AS dst, s FROM p UNION ALL SELECT b, a, s FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM t) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, s AS similarity FROM r WHERE r <= greatest(1, floor((SELECT count(*) FROM embeddings) * 0.15))")
def semantic_graph(spark, sf_dir):
    return S.semantic_graph(_embeddings(spark, sf_dir), 0.25)


def _two_lists(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal is not null")
    by = lambda order, i: R.top_k(c.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("doc_id"), "c_acctbal", "c_mktsegment"), 50, ["query_id"], *order).select("query_id", F.lit(i).alias("list_id"), "doc_id", "rank")
    return by([F.desc("c_acctbal"), "doc_id"], 0).unionByName(by(["c_mktsegment", "doc_id"], 1))


@query("WITH l AS (SELECT c_nationkey AS query_id, 0 AS list_id, c_custkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE c_acctbal IS NOT NULL UNION ALL SELECT c_nationkey, 1, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) FROM customer WHERE c_acctbal IS NOT NULL), f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(list_id * 1000 + rank) AS seen FROM l WHERE rank <= 50 GROUP BY ALL) SELECT query_id, doc_id, rrf, fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, doc_id) AS fused_rank FROM f) WHERE fused_rank <= 20")
def rrf_fusion(spark, sf_dir):
    return R.reciprocal_rank_fusion(_two_lists(spark, sf_dir), final_k=20)


_HYBRID = f"""
WITH p AS ({_POSTINGS}), q AS (SELECT doc_id AS query_id, token FROM p WHERE doc_id % 100 = 0), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
r AS (SELECT query_id, token FROM (SELECT q.*, row_number() OVER (PARTITION BY query_id ORDER BY df, token) AS r FROM q JOIN (SELECT token, count(*) AS df FROM p GROUP BY 1) USING (token)) WHERE r = 1),
c AS (SELECT query_id, doc_id FROM p JOIN r USING (token)),
s AS (SELECT query_id, doc_id, round(sum(1 - 1.0 / (1 + tf)), 6) AS score, count(*) AS matched FROM c JOIN q USING (query_id) JOIN p USING (doc_id, token) GROUP BY ALL),
k AS (SELECT query_id, 1 AS list_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (query_id) WHERE matched = n),
v AS (SELECT a.vec_id AS query_id, 0 AS list_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(list_id * 1000 + rank) AS seen FROM (FROM k UNION ALL FROM v) WHERE rank <= 20 GROUP BY ALL)
SELECT query_id, doc_id, rrf, fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, doc_id) AS fused_rank FROM f) WHERE fused_rank <= 5"""


@query(_HYBRID)
def hybrid_retrieval(spark, sf_dir):
    """The flagship: every hundredth document as a query, all its words, against words and vectors, fused. Documents and
    vectors meet by their number."""
    docs, e = _docs(spark, sf_dir), _embeddings(spark, sf_dir)
    asked = docs.filter("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.lower("text").alias("query"))
    keyword = R.keyword_queries_in(docs.filter("text is not null"), T.tokens(F.lower("text")), asked, k=20).select("query_id", F.lit(1).alias("list_id"), "doc_id", "rank")
    vector = R.vector_search(e, e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 20).select("query_id", F.lit(0).alias("list_id"), F.col("vec_id").alias("doc_id"), "rank")
    return R.reciprocal_rank_fusion(vector.unionByName(keyword), final_k=5)


_JAPANESE = "(VALUES (1, '東京 駅 の 近く に ある 店'), (2, 'は 水素 燃料'), (3, '駅')) AS q(query_id, query)"


@query(f"WITH d AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' 東京 駅' WHEN 1 THEN ' 燃料 の 近く' ELSE ' に ある 店' END AS text FROM documents), p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM d) GROUP BY ALL), w AS (SELECT DISTINCT query_id, unnest(list_filter(list_slice(string_split(query, ' '), 1, 5), lambda x: length(x) >= 2)) AS token FROM {_JAPANESE}), s AS (SELECT query_id, doc_id, round(sum(1 - 1.0 / (1 + tf)), 6) AS score, count(*) AS matched FROM p JOIN w USING (token) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20")
def keyword_japanese(spark, sf_dir):
    """Japanese queries: the first five tokens, those of two characters and more, any of them. A phrase is added to each text."""
    phrase = F.when(F.col("doc_id") % 3 == 0, " 東京 駅").when(F.col("doc_id") % 3 == 1, " 燃料 の 近く").otherwise(" に ある 店")
    index = R.postings(_docs(spark, sf_dir), T.tokens(F.concat("text", phrase)))
    asked = spark.createDataFrame([(1, "東京 駅 の 近く に ある 店"), (2, "は 水素 燃料"), (3, "駅")], "query_id int, query string")
    return R.keyword_queries(R.asked_for(index, asked.select(F.explode(T.tokens(F.col("query"))).alias("token"))), asked, k=20)


# Term mining: runs of two to six words of documents.
LOW, HIGH, LEAST = 2, 6, 2


def _said(strict=False):
    """The tokens of each sentence of a text."""
    return F.transform(T.sentences(F.lower("text"), strict), T.tokens)


def _mined(spark, sf_dir, low=LOW, high=HIGH):
    return M.mined(_docs(spark, sf_dir), _said(strict=True), low, high, LEAST)


def _candidates(spark, sf_dir, low=LOW, high=HIGH):
    return written(_mined(spark, sf_dir, low, high).filter(T.is_valid_term(F.col("term"))), "candidates")


_WORDS_OF = r"list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')"


def _sentence_sql(name: str, ends: str, least: int) -> str:
    return f"{name} AS (SELECT doc_id, i AS sentence, {_WORDS_OF} AS tokens FROM (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT doc_id, {_pieces(ends, least).replace('text', 'lower(text)', 1)} AS p FROM documents)))"


def _runs_sql(name: str, source: str, low: int, high: int) -> str:
    sizes = ", ".join(f"({n})" for n in range(low, high + 1))
    return f"{name} AS (SELECT doc_id, sentence, n, array_to_string(list_slice(tokens, i + 1, i + n), ' ') AS term FROM (SELECT doc_id, sentence, tokens, n, unnest(range(len(tokens) - n + 1)) AS i FROM {source}, (VALUES {sizes}) v(n) WHERE len(tokens) >= n))"


def _freq_sql(low: int, high: int) -> str:
    return f"{_sentence_sql('strict', T.STRICT_END, 3)}, {_runs_sql('runs', 'strict', low, high)}, freq AS MATERIALIZED (SELECT term, sum(c)::BIGINT AS frequency, n AS size FROM (SELECT doc_id, term, n, count(*) AS c FROM runs GROUP BY ALL HAVING c >= {LEAST}) GROUP BY term, n)"


_in = lambda words: ", ".join(f"'{w}'" for w in words)
#: F6 in SQL.
VALID = (
    f"CASE WHEN term = '' OR {' OR '.join(f"regexp_matches(term, '{p}')" for p in T.NUMBERED)} THEN false"
    r" WHEN regexp_matches(term, '^[A-Za-z0-9._-]{2,15}$') AND regexp_matches(term, '[A-Za-z]') AND regexp_matches(term, '[0-9]') THEN true"
    f" WHEN length(term) < 3 OR term IN ({_in(T.PARTICLES)}) OR lower(term) IN ({_in(T.TAG_NAMES)}) OR {' OR '.join(f"regexp_matches(term, '{p}')" for p in T.REFUSED)} OR term IN ({_in(T.GENERAL_WORDS)}) THEN false ELSE true END"
)
_CAND = f"{_freq_sql(LOW, HIGH)}, cand AS MATERIALIZED (SELECT * FROM freq WHERE {VALID})"
_TFIDF = f"{_CAND}, {_sentence_sql('loose', T.SENTENCE_END, 1)}, {_runs_sql('grams', 'loose', LOW, HIGH)}, t AS (SELECT term, doc_id, sentence, 1 + ln(count(*)) AS tf FROM grams JOIN cand USING (term) WHERE n = size GROUP BY ALL), u AS (SELECT term, count(DISTINCT doc_id) AS df, sum(tf) AS tf FROM t GROUP BY 1), tfidf AS (SELECT term, coalesce(df, 0) AS df, round(coalesce(tf, 0) * (ln(((SELECT count(DISTINCT doc_id) FROM loose) + 1.0) / (coalesce(df, 0) + 1.0)) + 1), 6) AS tfidf FROM cand LEFT JOIN u USING (term))"
_INSIDE = "pairs AS MATERIALIZED (SELECT a.term AS short, b.term AS long, b.frequency AS f FROM cand a JOIN cand b ON length(b.term) > length(a.term) AND contains(b.term, a.term))"
_RATIO = "tx AS (SELECT lower(text) AS t FROM documents), o AS MATERIALIZED (SELECT term, sum(((length(t) - length(replace(t, term, ''))) / length(term)))::BIGINT AS total FROM tx, cand WHERE contains(t, term) GROUP BY 1), i AS (SELECT short AS term, sum(total) AS inside FROM pairs JOIN o ON o.term = long GROUP BY 1), ratio AS (SELECT term, coalesce(total, 0)::BIGINT AS total, round(greatest(0.0, coalesce((total - coalesce(inside, 0)) / total, 0.0)), 6) AS ratio FROM cand LEFT JOIN o USING (term) LEFT JOIN i USING (term))"
_CVALUE = f"{_INSIDE}, {_RATIO}, inc AS (SELECT short AS term, avg(f) AS mean FROM pairs GROUP BY 1), cv AS (SELECT term, size, round(CASE WHEN mean IS NOT NULL AND ratio < 0.3 THEN 0.0 ELSE greatest(0.0, log2(size + 1.0) * frequency - coalesce(mean, 0.0)) END, 6) AS cvalue FROM cand LEFT JOIN inc USING (term) LEFT JOIN ratio USING (term))"


@query(f"WITH {_freq_sql(LOW, HIGH)} SELECT term, frequency, size FROM freq")
def candidate_frequency(spark, sf_dir):
    return _mined(spark, sf_dir)


@query(f"WITH {_TFIDF} SELECT term, df, tfidf FROM tfidf")
def tfidf(spark, sf_dir):
    return M.tfidf(_docs(spark, sf_dir), _said(), _candidates(spark, sf_dir))


def _texts(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.lower("text").alias("text"))


def _valued(spark, sf_dir):
    """Candidates, the pairs of which one holds the other, and C-values with the share of independent occurrences."""
    c = _candidates(spark, sf_dir)
    pairs = written(M.containment(c.select("term")), "pairs")
    return c, pairs, M.cvalue(c, M.independent_ratio(_texts(spark, sf_dir), c, pairs=pairs), pairs=pairs)


@query(f"WITH {_CAND}, {_CVALUE} SELECT term, cvalue FROM cv")
def cvalue(spark, sf_dir):
    return _valued(spark, sf_dir)[2]


@query(f"WITH {_CAND}, {_INSIDE}, {_RATIO} SELECT * FROM ratio")
def independent_ratio(spark, sf_dir):
    return M.independent_ratio(_texts(spark, sf_dir), _candidates(spark, sf_dir))


def _scored(spark, sf_dir):
    c, _, values = _valued(spark, sf_dir)
    return c.join(M.tfidf(_docs(spark, sf_dir), _said(), c), "term").join(values, "term")


def _combined_sql(a: float, b: float) -> str:
    return f"WITH {_TFIDF}, {_CVALUE}, k AS (SELECT term, size, tfidf, cvalue FROM tfidf JOIN cv USING (term) WHERE cvalue > 0), b AS (SELECT min(tfidf) a1, max(tfidf) a2, min(cvalue) c1, max(cvalue) c2 FROM k), n AS (SELECT term, size, round(CASE WHEN a2 - a1 < 1e-10 THEN 0.5 ELSE (tfidf - a1) / (a2 - a1) END, 6) AS t, round(CASE WHEN c2 - c1 < 1e-10 THEN 0.5 ELSE (cvalue - c1) / (c2 - c1) END, 6) AS c FROM k, b) SELECT term, round(({a}::DOUBLE * t + {b}::DOUBLE * c) * (CASE WHEN size >= 2 THEN least(1 + 0.15::DOUBLE * (size - 1), 1.5) ELSE 1.0 END), 6) AS score FROM n"


@query(_combined_sql(0.4, 0.6))
def combined_score(spark, sf_dir):
    return M.combined_score(_scored(spark, sf_dir))


@query(_combined_sql(0.3, 0.7))
def combined_score_seed(spark, sf_dir):
    return M.combined_score(_scored(spark, sf_dir), "seed")


@query(f"WITH {_CAND}, {_INSIDE} SELECT short, long FROM pairs")
def containment_pairs(spark, sf_dir):
    return M.containment(_candidates(spark, sf_dir).select("term"))


@query()
def nested_terms(spark, sf_dir):
    _, pairs, values = _valued(spark, sf_dir)
    return M.nested_filter(values, pairs=pairs)


@query(r"SELECT code, count(*) AS n, CASE WHEN regexp_matches(code, '^[A-Z]{2,5}[0-9x]?$') THEN true ELSE false END AS abbreviation FROM (SELECT unnest(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) AS code FROM documents) WHERE (regexp_matches(code, '^[A-Za-z0-9._-]{2,15}$') AND regexp_matches(code, '[A-Za-z]') AND regexp_matches(code, '[0-9]')) OR regexp_matches(code, '^[A-Z]{2,5}[0-9x]?$') GROUP BY ALL")
def regex_terms(spark, sf_dir):
    w = _docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("code"))
    return w.filter(T.is_code(F.col("code")) | T.is_abbreviation(F.col("code"))).groupBy("code").agg(F.count("*").alias("n")).withColumn("abbreviation", T.is_abbreviation(F.col("code")))


_SET = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


@query(f"WITH a AS (SELECT doc_id, {_SET} AS w FROM documents), b AS (SELECT item_id, {_SET} AS w FROM benchmark), i AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM a) JOIN (SELECT item_id, unnest(w) AS x FROM b) USING (x) GROUP BY ALL) SELECT doc_id, item_id, round(n / (len(a.w) + len(b.w) - n), 6) AS jaccard FROM i JOIN a USING (doc_id) JOIN b USING (item_id) WHERE n / (len(a.w) + len(b.w) - n) >= 0.2")
def jaccard_pairs(spark, sf_dir):
    """X6 of documents and benchmark items."""
    a = written(spread(_docs(spark, sf_dir)).select(F.col("doc_id").alias("a"), T.word_set(F.col("text")).alias("words")), "words")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("b"), T.word_set(F.col("text")).alias("words"))
    return S.overlapping(a, b, 0.2).withColumnsRenamed({"a": "doc_id", "b": "item_id"})


@query(f"WITH {_freq_sql(1, 1)}, cand AS (SELECT term FROM freq WHERE {VALID}), t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda x: x <> '') AS w FROM documents)), v AS (SELECT * FROM t SEMI JOIN cand USING (term)), p AS (SELECT least(x.term, y.term) AS a, greatest(x.term, y.term) AS b, count(*) AS together FROM v x JOIN v y ON x.doc_id = y.doc_id AND y.pos > x.pos AND y.pos - x.pos <= 10 AND x.term <> y.term GROUP BY ALL), c AS (SELECT term, count(*) AS n FROM v GROUP BY 1) SELECT a, b, together, pmi FROM (SELECT a, b, together, round(log2(together * (SELECT count(*) FROM t)::DOUBLE / (x.n * y.n)), 6) AS pmi FROM p JOIN c x ON x.term = a JOIN c y ON y.term = b WHERE together >= 3) WHERE pmi >= 2")
def cooccurrence_pmi(spark, sf_dir):
    """Of the mined candidates of one word, as a token has to be a candidate by itself."""
    t = spread(_docs(spark, sf_dir)).select("doc_id", F.posexplode(T.tokens(F.lower("text"))).alias("pos", "term"))
    v = written(t.join(_candidates(spark, sf_dir, 1, 1).select("term"), "term", "left_semi"), "tokens")
    return S.pmi(S.cooccurrence(v), v.groupBy("term").agg(F.count("*").alias("n")), t.count())


@query()
def spelling_variants(spark, sf_dir):
    return S.variants(table(spark, sf_dir, "part").select(F.col("p_name").alias("term")))


# The graph of parts and suppliers: an edge for each lineitem.
def _nodes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.lit("Term").alias("node_type"), F.col("p_name").alias("term"))
    return p.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "Term").otherwise("Category").alias("node_type"), F.col("s_name").alias("term")))


_TYPE = {"A": "SYNONYM", "N": "RELATED_TO", "R": "IS_A"}


def _edges(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "SYNONYM").when(F.col("l_returnflag") == "N", "RELATED_TO").otherwise("IS_A")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("source_id"), F.concat(F.lit("S"), "l_suppkey").alias("target_id"), kind.alias("edge_type"), F.round(1 - F.col("l_discount") * 5, 4).alias("weight"), F.round(1 - F.col("l_tax"), 4).alias("confidence"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))


_NODES = "nodes AS (SELECT 'P' || p_partkey AS id, 'Term' AS node_type, p_name AS term FROM part UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'Term' ELSE 'Category' END, s_name FROM supplier)"
_EDGES = "edges AS MATERIALIZED (SELECT 'P' || l_partkey AS source_id, 'S' || l_suppkey AS target_id, CASE l_returnflag WHEN 'A' THEN 'SYNONYM' WHEN 'N' THEN 'RELATED_TO' ELSE 'IS_A' END AS edge_type, round(1 - l_discount * 5, 4) AS weight, round(1 - l_tax, 4) AS confidence, l_orderkey || '-' || l_linenumber AS id FROM lineitem)"


@query(f"WITH {_NODES}, {_EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT node_type) FROM nodes) AS node_types, (SELECT count(*) FROM nodes WHERE node_type = 'Term') AS terms, count(*) AS edges, count(DISTINCT edge_type) AS edge_types, sum(weight::DECIMAL(28, 12))::DOUBLE / count(weight) AS avg_weight, sum(confidence::DECIMAL(28, 12))::DOUBLE / count(confidence) AS avg_confidence FROM edges")
def graph_stats(spark, sf_dir):
    return G.statistics(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_NODES}, {_EDGES} SELECT a.term AS source_term, b.term AS target_term, edge_type, weight, confidence FROM edges JOIN nodes a ON a.id = source_id AND a.node_type = 'Term' JOIN nodes b ON b.id = target_id AND b.node_type = 'Term'")
def term_relationships(spark, sf_dir):
    return G.relationships(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT source_id AS src, target_id AS dst, edge_type, weight FROM edges WHERE source_id = 'S1' UNION ALL SELECT target_id, source_id, edge_type, weight FROM edges WHERE target_id = 'S1'")
def incident_edges(spark, sf_dir):
    return G.both_ways(_edges(spark, sf_dir).drop("id", "confidence")).filter("src = 'S1'")


@query(f"WITH RECURSIVE {_EDGES}, e AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges UNION SELECT DISTINCT target_id, source_id FROM edges), b AS (SELECT 'S1' AS id, 0 AS depth UNION SELECT t, depth + 1 FROM b JOIN e ON s = id WHERE depth < 2) SELECT id, min(depth)::INT AS depth FROM b GROUP BY 1")
def graph_bfs(spark, sf_dir):
    return G.bfs(_edges(spark, sf_dir), spark.createDataFrame([("S1",)], "id string"), 2)


_PASSES = "e AS (SELECT src, dst, max(p) AS p FROM (SELECT source_id AS src, target_id AS dst, CASE edge_type WHEN 'SYNONYM' THEN 0.95::DOUBLE WHEN 'IS_A' THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END * weight * confidence AS p FROM edges UNION ALL SELECT target_id, source_id, CASE edge_type WHEN 'SYNONYM' THEN 0.95::DOUBLE WHEN 'IS_A' THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END * weight * confidence FROM edges) JOIN nodes ON nodes.id = dst AND node_type = 'Term' GROUP BY ALL)"


@query(f"WITH {_NODES}, {_EDGES}, {_PASSES}, s AS (SELECT 'P' || p_partkey AS seed FROM part WHERE p_partkey % 100 = 0), f1 AS (SELECT seed, dst AS id, max(p * 0.7::DOUBLE) AS w FROM s JOIN e ON src = seed WHERE dst <> seed GROUP BY ALL HAVING max(p * 0.7::DOUBLE) >= 0.3), n AS (SELECT seed FROM f1 GROUP BY 1 HAVING count(*) >= 19), f2 AS (SELECT seed, dst AS id, max(w * p * 0.7::DOUBLE * 0.7::DOUBLE) AS w FROM f1 JOIN e ON src = f1.id WHERE seed NOT IN (FROM n) GROUP BY ALL HAVING max(w * p * 0.7::DOUBLE * 0.7::DOUBLE) >= 0.3), a AS (SELECT seed, seed AS id, 1.0::DOUBLE AS w, 0 AS depth FROM s UNION ALL SELECT seed, id, w, 1 FROM f1 UNION ALL SELECT seed, id, w, 2 FROM f2 WHERE id <> seed AND NOT EXISTS (FROM f1 WHERE f1.seed = f2.seed AND f1.id = f2.id)) SELECT seed, id, round(w, 6) AS weight, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(w, 6) DESC, depth, id) AS r FROM a) WHERE r <= 20")
def graph_expand(spark, sf_dir):
    """Every hundredth part is a query term."""
    seeds = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("id"))
    return G.expand(_edges(spark, sf_dir), _nodes(spark, sf_dir), seeds)


@query(f"WITH {_EDGES} SELECT source_id, target_id, edge_type, max(weight) AS weight, max(confidence) AS confidence FROM edges WHERE source_id <> target_id GROUP BY ALL")
def edge_upsert(spark, sf_dir):
    e = _edges(spark, sf_dir).drop("id")
    return G.upsert_edges(e.filter("edge_type <> 'IS_A'"), e.filter("edge_type = 'IS_A'"))


@query(f"WITH {_EDGES} SELECT * FROM edges ORDER BY weight DESC NULLS LAST, id LIMIT 200")
def global_top_edges(spark, sf_dir):
    return G.top_edges(_edges(spark, sf_dir))


@query(f"WITH {_NODES}, {_EDGES}, f AS (SELECT * FROM edges WHERE coalesce(weight, 0) >= 0.9 AND edge_type IN ('SYNONYM', 'IS_A')), v AS (SELECT * FROM nodes WHERE id IN (SELECT source_id FROM f UNION SELECT target_id FROM f) AND node_type = 'Term') SELECT source_id, target_id, edge_type, weight FROM f WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)")
def subgraph_filter(spark, sf_dir):
    return G.subgraph(_nodes(spark, sf_dir), _edges(spark, sf_dir), types=["SYNONYM", "IS_A"], least=0.9, node_type="Term")[1].select("source_id", "target_id", "edge_type", "weight")


_RANKS = "".join(f", r{i} AS MATERIALIZED (SELECT h.id, 0.85::DOUBLE * coalesce(m.x, 0) + 0.15::DOUBLE * h.home AS rank FROM h LEFT JOIN (SELECT dst AS id, sum(rank * share) AS x FROM e JOIN r{i - 1} ON r{i - 1}.id = src GROUP BY 1) m USING (id))" for i in range(1, 11))


@query(f"WITH {_EDGES}, d AS (SELECT source_id AS src, target_id AS dst, weight + 0.01 AS weight FROM edges UNION ALL SELECT target_id, source_id, weight + 0.01 FROM edges), o AS (SELECT src, sum(weight) AS o FROM d GROUP BY 1), e AS MATERIALIZED (SELECT src, dst, sum(weight) / any_value(o) AS share FROM d JOIN o USING (src) GROUP BY ALL), k AS (SELECT count(DISTINCT src) AS n FROM e WHERE src[1] = 'S'), h AS MATERIALIZED (SELECT DISTINCT src AS id, CASE WHEN src[1] = 'S' THEN 1.0::DOUBLE / n ELSE 0 END AS home FROM e, k), r0 AS (SELECT id, home AS rank FROM h){_RANKS} SELECT id, round(rank, 8) AS rank FROM r10")
def pagerank_fixed_iter(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("weight", F.col("weight") + 0.01)
    seeds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"))
    return G.pagerank(e, seeds, iterations=10, tolerance=None).select("id", F.round("rank", 8).alias("rank"))


# Evaluation: orders of a customer as the ranked answers of a question, urgent ones relevant.
def _ranked(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = R.top_k(o.select(F.col("o_custkey").alias("query_id"), "o_orderkey", "o_totalprice", "o_orderpriority"), 10, ["query_id"], F.desc("o_totalprice"), "o_orderkey")
    return r.select("query_id", "rank", F.round(F.least(F.col("o_totalprice") / 400000, F.lit(1.0)), 6).alias("score"), F.substring("o_orderpriority", 1, 1).isin("1", "2").alias("relevant"))


def _expected(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.count_if(F.substring("o_orderpriority", 1, 1).isin("1", "2")).alias("n_sources"))


def _metrics_sql(graded: bool) -> str:
    gain = "score" if graded else "1.0"
    ideal = "ideal" if graded else "coalesce(list_sum(list_transform(range(least(k, n_relevant, s)), lambda i: 1 / log2(i + 2.0))), 0)"
    return f"""
WITH r AS (SELECT query_id, rank, round(least(p / 400000, 1.0), 6) AS score, pr IN ('1', '2') AS relevant FROM (SELECT o_custkey AS query_id, o_totalprice AS p, o_orderpriority[1] AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10),
e AS (SELECT o_custkey AS query_id, count(*) FILTER (o_orderpriority[1] IN ('1', '2')) AS n_sources FROM orders GROUP BY 1),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS ideal_rank FROM (SELECT *, CASE WHEN relevant THEN {gain} ELSE 0.0 END AS gain FROM r)),
f AS (SELECT query_id, min(rank) FILTER (relevant) AS first, count(*) FILTER (relevant) AS n_relevant FROM r GROUP BY 1),
m AS (SELECT query_id, k, any_value(n_sources) AS s, any_value(first) AS first, count(*) FILTER (relevant AND rank <= k) AS h, sum(CASE WHEN rank <= k THEN gain / log2(rank + 1.0) ELSE 0 END) AS d, sum(CASE WHEN ideal_rank <= k THEN gain / log2(ideal_rank + 1.0) ELSE 0 END) AS ideal, any_value(n_relevant) AS n_relevant FROM g JOIN e USING (query_id) JOIN f USING (query_id), (VALUES (1), (3), (5), (10)) v(k) GROUP BY ALL)
SELECT query_id, k, round(CASE WHEN s > 0 THEN least(h / s, 1.0) ELSE 0 END, 5) AS recall, round(h / k, 5) AS precision, CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, round(CASE WHEN {ideal} > 0 THEN least(d / {ideal}, 1.0) ELSE 0 END, 5) AS ndcg, round(coalesce(1.0 / first, 0), 5) AS mrr FROM m"""


@query(_metrics_sql(True))
def retrieval_metrics(spark, sf_dir):
    return E.retrieval_metrics(_ranked(spark, sf_dir), _expected(spark, sf_dir), digits=5)


@query(_metrics_sql(False))
def retrieval_metrics_binary(spark, sf_dir):
    return E.retrieval_metrics(_ranked(spark, sf_dir), _expected(spark, sf_dir), graded=False, digits=5)


def _long_sql(graded: bool) -> str:
    m = _metrics_sql(graded)
    return f"SELECT query_id, metric || '@' || k AS metric, value FROM (UNPIVOT (SELECT query_id, k, recall::DOUBLE AS recall, precision::DOUBLE AS precision, hit_rate::DOUBLE AS hit_rate, ndcg::DOUBLE AS ndcg FROM ({m})) ON recall, precision, hit_rate, ndcg INTO NAME metric VALUE value) UNION ALL SELECT query_id, 'mrr', any_value(mrr)::DOUBLE FROM ({m}) GROUP BY 1"


def _long(spark, sf_dir, graded=True):
    return E.long_form(E.retrieval_metrics(_ranked(spark, sf_dir), _expected(spark, sf_dir), graded=graded, digits=5))


@query(f"SELECT metric, round(avg(value), 4) AS mean FROM ({_long_sql(True)}) GROUP BY 1")
def metric_average(spark, sf_dir):
    return E.averages(_long(spark, sf_dir), 4)


@query(f"SELECT metric, base, target, round((target - base) / base * 100, 4) AS percent FROM (SELECT metric, round(avg(value), 4) AS base FROM ({_long_sql(False)}) GROUP BY 1) JOIN (SELECT metric, round(avg(value), 4) AS target FROM ({_long_sql(True)}) GROUP BY 1) USING (metric) WHERE base <> 0")
def metric_improvement(spark, sf_dir):
    return E.improvement(_long(spark, sf_dir, False), _long(spark, sf_dir, True), 4)


@query(f"SELECT query_id, metric, value, sum(value::DECIMAL(18,6)) OVER (PARTITION BY metric ORDER BY query_id ROWS UNBOUNDED PRECEDING)::DOUBLE / count(value) OVER (PARTITION BY metric ORDER BY query_id ROWS UNBOUNDED PRECEDING) AS mean FROM ({_long_sql(True)}) WHERE metric LIKE '%@3'")
def expanding_mean(spark, sf_dir):
    return E.expanding_mean(_long(spark, sf_dir).filter("metric like '%@3'"))


@query(f"SELECT metric, least(floor(value * 10) + 1, 10)::BIGINT AS bucket, count(*) AS n FROM ({_long_sql(True)}) GROUP BY ALL")
def metric_histogram(spark, sf_dir):
    return E.histogram(_long(spark, sf_dir))


@query(f"SELECT query_id, coalesce(max(value) FILTER (metric = 'mrr'), 0) AS mrr, coalesce(max(value) FILTER (metric = 'ndcg@5'), 0) AS \"ndcg@5\" FROM ({_long_sql(True)}) GROUP BY 1")
def metric_heatmap(spark, sf_dir):
    return E.heatmap(_long(spark, sf_dir), ["mrr", "ndcg@5"])


# Extraction: words of the benchmark as truth, words of documents that come five times and more as found.
_TRUTH = r"truth AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(trim(lower(text)), '\s+'), lambda x: x <> '')) AS term FROM benchmark)"
_COUNTS_SQL = f"counts AS (SELECT token AS term, sum(tf)::BIGINT AS frequency FROM ({_POSTINGS}) GROUP BY 1)"
_FOUND = f"{_COUNTS_SQL}, found AS (SELECT term FROM counts WHERE frequency >= 5)"
_FLAGS = f"{_TRUTH}, {_FOUND}, flags AS (SELECT term, t.term IS NOT NULL AS in_truth, f.term IS NOT NULL AS in_found FROM truth t FULL JOIN found f USING (term))"
_CLASS = r"CASE WHEN regexp_matches(term, '^[A-Z]{2,5}$') THEN 'acronym' WHEN regexp_matches(term, '\p{Nd}') THEN 'numeric' WHEN length(term) = 1 THEN 'single_char' WHEN length(term) <= 3 THEN 'short_compound' WHEN length(term) <= 6 THEN 'medium_compound' ELSE 'long_compound' END"


def _truth(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.lower("text"))).alias("term")).distinct()


def _counts(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode(T.tokens(F.lower("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("frequency"))


def _found(spark, sf_dir):
    return _counts(spark, sf_dir).filter("frequency >= 5").select("term")


@query(f"WITH {_FLAGS}, n AS (SELECT count(*) FILTER (in_truth AND in_found) AS hits, count(*) FILTER (in_truth) AS n_truth, count(*) FILTER (in_found) AS n_found FROM flags) SELECT hits, n_truth, n_found, round(hits / n_found, 6) AS precision, round(hits / n_truth, 6) AS recall, round(2 * hits / (n_found + n_truth), 6) AS f1 FROM n")
def term_prf(spark, sf_dir):
    return E.term_scores(_truth(spark, sf_dir), _found(spark, sf_dir))


@query(f"WITH {_FLAGS} SELECT {_CLASS} AS class, count(*) AS n, count(*) FILTER (in_found) AS hits, round(count(*) FILTER (in_found) / count(*), 6) AS recall, array_to_string(list_slice(list_sort(list(term)), 1, 10), '|') AS sample FROM flags WHERE in_truth GROUP BY 1")
def recall_by_category(spark, sf_dir):
    f = E.flags(_truth(spark, sf_dir), _found(spark, sf_dir)).withColumn("class", T.morphology(F.col("term")))
    return E.recall_by(f, "class").withColumn("sample", F.array_join("sample", "|"))


@query(f"WITH {_FLAGS} SELECT CASE WHEN frequency = 1 THEN '1' WHEN frequency = 2 THEN '2' WHEN frequency BETWEEN 3 AND 5 THEN '3-5' WHEN frequency BETWEEN 6 AND 10 THEN '6-10' WHEN frequency >= 11 THEN '11+' END AS bin, count(*) AS n, count(*) FILTER (in_found) AS hits, round(count(*) FILTER (in_found) / count(*), 6) AS recall FROM flags LEFT JOIN counts USING (term) WHERE in_truth GROUP BY 1")
def recall_by_frequency(spark, sf_dir):
    f = E.flags(_truth(spark, sf_dir), _found(spark, sf_dir)).join(_counts(spark, sf_dir), "term", "left").withColumn("bin", E.frequency_bin(F.col("frequency")))
    return E.recall_by(f, "bin").drop("sample")


@query(f"WITH {_FLAGS} SELECT term FROM truth ANTI JOIN found USING (term)")
def missed_terms(spark, sf_dir):
    return E.flags(_truth(spark, sf_dir), _found(spark, sf_dir)).filter("in_truth and not in_found").select("term")


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, round(stddev_pop(p_retailprice), 6) AS std, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def score_stats(spark, sf_dir):
    return E.score_statistics(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean, max(p_retailprice) FILTER (i = n // 2) AS median FROM (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_retailprice IS NOT NULL) GROUP BY 1")
def upper_median(spark, sf_dir):
    return E.upper_median(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])


_STAGES = "stages AS (SELECT p_name AS term, i AS stage_index, 'stage ' || i AS stage, bool_or(p_size > 8 * i) AS present FROM part, range(6) r(i) GROUP BY ALL)"


def _stages(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("stage_index", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return p.groupBy(F.col("p_name").alias("term"), "stage_index").agg(F.bool_or(F.col("p_size") > 8 * F.col("stage_index")).alias("present")).withColumn("stage", F.concat(F.lit("stage "), "stage_index"))


@query(f"WITH {_STAGES}, n AS (SELECT stage_index, stage, count(*) FILTER (present) AS remaining FROM stages GROUP BY ALL) SELECT stage_index::INT AS stage_index, stage, remaining, coalesce(lag(remaining) OVER (ORDER BY stage_index), (SELECT count(DISTINCT term) FROM stages)) - remaining AS dropped FROM n")
def dropout_funnel(spark, sf_dir):
    return M.funnel(_stages(spark, sf_dir))


@query(f"WITH {_STAGES} SELECT term, min(stage_index) FILTER (NOT present AND was)::INT AS lost_at FROM (SELECT *, coalesce(lag(present) OVER (PARTITION BY term ORDER BY stage_index), true) AS was FROM stages) GROUP BY 1")
def dropout_stage(spark, sf_dir):
    return M.dropout_stage(_stages(spark, sf_dir))


@query(f"WITH p AS (SELECT a, b, s AS similarity FROM ({_PAIRS6}) WHERE s >= 0.3) SELECT a, b, max(similarity) AS similarity FROM (FROM p UNION ALL SELECT b, a, similarity FROM p) GROUP BY ALL")
def synonym_symmetric(spark, sf_dir):
    return S.both_directions(_embeddings(spark, sf_dir), 0.3)


_LAMBDA = "SELECT p_brand || p_type AS part_group, p_partkey, p_retailprice / 500 AS v FROM part"


@query(f"SELECT a.part_group, a.p_partkey AS child, b.p_partkey AS parent, round(greatest(0.5, 1 - round(b.v - a.v, 9)), 6) AS weight FROM ({_LAMBDA}) a JOIN ({_LAMBDA}) b ON a.part_group = b.part_group AND round(b.v - a.v, 9) > 0.1 AND round(b.v - a.v, 9) < 0.5")
def lambda_hierarchy(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("part_group"), "p_partkey", (F.col("p_retailprice") / 500).alias("v"))
    return S.interval_pairs(p, "p_partkey", "v", 0.1, 0.5, "part_group")


@query("SELECT a.label AS cluster, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.label >= 0")
def same_cluster_pairs(spark, sf_dir):
    return S.same_cluster_pairs(_embeddings(spark, sf_dir), "vec_id", "label")


@query(r"SELECT event_id, regexp_extract('note ' || props || ' end', '\{[^{}]*\}', 0) AS found FROM events")
def parse_json_prose(spark, sf_dir):
    text = F.concat(F.lit("note "), "props", F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", T.json_in_prose(text).alias("found"))


@query(r"SELECT conv_id, turn, coalesce(try_cast(regexp_extract(conv_id || '. ' || turn || ': ' || text, '^\s*[0-9]+\.\s*([^:]+):', 1) AS INT), -1) AS term FROM conversations")
def parse_numbered_list(spark, sf_dir):
    line = F.concat("conv_id", F.lit(". "), "turn", F.lit(": "), "text")
    first = F.get(T.numbered_lines(line), F.lit(0))["term"]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(first.try_cast("int"), F.lit(-1)).alias("term"))


@query("SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def table_markdown(spark, sf_dir):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(rows.alias("rows"))
    return n.select("r_regionkey", T.markdown_table(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), "rows")).alias("markdown"))


_REVERSE = f"""
WITH k AS (SELECT DISTINCT p_name AS term, lower(unnest([p_name, p_type])) AS key FROM part),
a AS (SELECT p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN p_type || ' 水素の燃焼' WHEN 1 THEN p_type ELSE 'the ' || p_name || ' plated' END AS query FROM part WHERE p_partkey % 100 = 0),
q AS (SELECT query_id, query, lower(query) AS l FROM a),
p AS (SELECT query_id, term, CASE WHEN contains(l, key) THEN length(key) ELSE length(l) END / greatest(length(key), length(l)) AS r, contains(l, key) AND regexp_matches(l, '\\b' || regexp_escape(key) || '\\b') AS whole, key = l AS same FROM q JOIN k ON contains(l, key) OR contains(key, l)),
f AS (SELECT query_id, term, 0 AS branch, 1.0::DOUBLE AS confidence FROM p WHERE same
UNION ALL SELECT query_id, term, 1, round(0.7::DOUBLE * CASE WHEN whole THEN least(r * 1.2::DOUBLE, 0.95::DOUBLE) ELSE r END, 6) FROM p WHERE NOT same
UNION ALL SELECT query_id, term, 2, 0.8::DOUBLE FROM q JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, bs in R.PATTERN_TERMS.items() for b in bs)}) AS d(pattern, term) ON contains(query, pattern)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, term ORDER BY branch, confidence DESC) AS n FROM f) WHERE n = 1)
SELECT query_id, term, branch, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, branch, term) AS rank FROM o) WHERE rank <= 10"""


def _reverse_asked(spark, sf_dir):
    p, n = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0"), F.col("p_partkey") % 3
    text = F.when(n == 0, F.concat("p_type", F.lit(" 水素の燃焼"))).when(n == 1, F.col("p_type")).otherwise(F.concat(F.lit("the "), "p_name", F.lit(" plated")))
    return p.select(F.col("p_partkey").alias("query_id"), text.alias("query"))


@query(_REVERSE)
def reverse_lookup(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.array("p_name", "p_type").alias("keys"))
    return R.reverse_lookup(terms, _reverse_asked(spark, sf_dir), R.pattern_terms(spark))


@query(f"WITH t AS (SELECT DISTINCT ON (term) term, embedding FROM (SELECT p_name AS term, p_partkey, embedding FROM part JOIN embeddings ON vec_id = p_partkey) ORDER BY term, p_partkey), s AS (SELECT a.vec_id AS query_id, b.term, round({_COSINE}, 6) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 6) DESC, b.term) AS r FROM embeddings a, t b WHERE a.vec_id % 100 = 0) SELECT query_id, term, CASE WHEN round(1 - c, 6) < 1 THEN round(1 - round(1 - c, 6), 6) ELSE 0 END::DOUBLE AS confidence FROM s WHERE r <= 10")
def reverse_similarity(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    named = table(spark, sf_dir, "part").join(e, F.col("p_partkey") == F.col("vec_id")).groupBy(F.col("p_name").alias("term")).agg(F.min_by("embedding", "p_partkey").alias("embedding"))
    return R.similar_terms(named, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS self FROM embeddings")
def vector_norms(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(V.cosine(F.col("embedding"), F.col("embedding")), 5).alias("self"))


@query("SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN 'the: ' || substr(text, greatest(strpos(text, 'the') - 100, 1), strpos(text, 'the') - greatest(strpos(text, 'the') - 100, 1) + 103) END AS context FROM documents")
def term_context(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.context(F.col("text"), F.lit("the")).alias("context"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'on', ''))) // 2)::BIGINT AS n FROM documents")
def substring_frequency(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.occurrences(F.col("text"), F.lit("on")).alias("n"))


@query()
def chunk_markdown(spark, sf_dir):
    from .operators.chunking import chunk_markdown as chunk

    return chunk(_docs(spark, sf_dir)).select("doc_id", "ordinal", "chunk_id", F.length("content").alias("n_chars"))


@query(f"WITH RECURSIVE p AS MATERIALIZED (SELECT a, b FROM ({_PAIRS6}) WHERE s >= 0.35), e AS (FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a), c AS (SELECT id, min(seen) AS label FROM r GROUP BY 1), n AS (SELECT label, count(*) AS n FROM c GROUP BY 1) SELECT id AS vec_id, CASE WHEN n >= 2 THEN label ELSE -1 END AS cluster FROM c JOIN n USING (label)")
def clusters_substitute(spark, sf_dir):
    from .operators.clustering import threshold_clusters

    return threshold_clusters(_embeddings(spark, sf_dir), 0.35)


@query(r"SELECT doc_id, regexp_matches(text, '[\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}]') AS japanese FROM documents")
def japanese_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.is_japanese(F.col("text")).alias("japanese"))
