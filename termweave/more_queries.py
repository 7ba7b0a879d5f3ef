"""Registered queries of the upkeep of chunks, dictionary and graph, of term selection, reports and text parsers; SQL for DuckDB.

Every query runs over its whole tables. Conversations stand for chunks of documents, parts for dictionary entries.
"""

from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import clustering as C
from .operators import dictionary as D
from .operators import evaluation as E
from .operators import graph as G
from .operators import similarity as S
from .operators import terms as M
from .providers import cached_vectors
from .queries import QUERIES, SQL, TOKENS, VALID, _CAND, _COSINE, _COUNTS_SQL, _DICT, _EDGES, _FLAGS, _NODES, _PAIRS6, _PASSES, _REVERSE, _SET, _STAGES, _TRUTH, _candidates, _counts, _dictionary, _docs, _edges, _embeddings, _found, _long, _long_sql, _nodes, _reverse_asked, _stages, _truth, query, table  # noqa: F401
from .operators import retrieval as R
from .sources import files, schemas
from .storage import written

# Chunks.
_CHUNKS = "SELECT CASE role WHEN 'user' THEN 'questions' ELSE 'answers' END AS collection_name, conv_id::VARCHAR AS document_id, conv_id || '_chunk_' || turn AS chunk_id, turn AS ordinal, text FROM conversations"


def _chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.when(F.col("role") == "user", "questions").otherwise("answers").alias("collection_name"), F.col("conv_id").cast("string").alias("document_id"), F.concat_ws("_chunk_", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("ordinal"), "text")


@query(f"WITH c AS ({_CHUNKS}), o AS (SELECT * FROM c WHERE ordinal % 3 <> 0), n AS (SELECT * REPLACE ('new ' || text AS text) FROM c WHERE ordinal % 2 = 0) SELECT chunk_id, coalesce(n.text, o.text) AS text FROM o FULL JOIN n USING (chunk_id)")
def chunk_upsert(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    new = c.filter("ordinal % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return D.upsert_chunks(c.filter("ordinal % 3 <> 0"), new).select("chunk_id", "text")


@query(f"SELECT chunk_id FROM ({_CHUNKS}) WHERE document_id <> '3'")
def document_delete(spark, sf_dir):
    return D.deleted(_chunks(spark, sf_dir), document_id="3")[0].select("chunk_id")


@query(f"SELECT count(DISTINCT document_id) AS n_documents, count(*) AS n_chunks FROM ({_CHUNKS}) WHERE collection_name = 'answers'")
def collection_delete_counts(spark, sf_dir):
    return D.deleted(_chunks(spark, sf_dir), collection_name="answers")[1]


@query(f"SELECT DISTINCT collection_name FROM ({_CHUNKS})")
def collection_list(spark, sf_dir):
    return D.collections(_chunks(spark, sf_dir))


@query(f"SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal, text) AS text FROM ({_CHUNKS}) GROUP BY 1")
def document_texts(spark, sf_dir):
    return D.document_texts(_chunks(spark, sf_dir))


@query(f"SELECT term, rank, document_id, ordinal FROM (SELECT term, document_id, ordinal, row_number() OVER (PARTITION BY term ORDER BY document_id, ordinal) AS rank FROM ({_CHUNKS}), (VALUES ('the'), ('tion'), ('de la')) t(term) WHERE contains(text, term)) WHERE rank <= 3")
def relevant_chunks(spark, sf_dir):
    return D.relevant_chunks(_chunks(spark, sf_dir), ["the", "tion", "de la"])


@query(r"SELECT doc_id, CASE WHEN strpos(text, '---') > 0 THEN trim(substr(text, strpos(text, '---') + 3), ' ') ELSE text END AS body, trim(regexp_replace(text, '(?m)^#{1,6}\s.*$', '', 'g'), ' ') <> '' AS has_body FROM documents")
def chunk_bodies(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.chunk_body(F.col("text")).alias("body"), T.has_body(F.col("text")).alias("has_body"))


# Dictionary.
@query(f"SELECT collection_name, term, term || ': ' || definition AS described FROM ({_DICT}) WHERE definition <> ''")
def described_terms(spark, sf_dir):
    return D.described(_dictionary(spark, sf_dir))


@query(f"SELECT collection_name, term, id FROM ({_DICT}) WHERE lower(term) IN (SELECT lower(p_name) FROM part WHERE p_partkey % 100 = 0)")
def dictionary_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.upper("p_name").alias("term"))
    return D.lookup(_dictionary(spark, sf_dir), asked).select("collection_name", "term", "id")


@query(f"SELECT id, term, domain FROM (SELECT id, term, definition FROM ({_DICT})) LEFT JOIN (SELECT p_name AS term, min(CASE WHEN p_type <> 'SMALL' THEN p_type END) AS domain FROM part GROUP BY 1) USING (term) WHERE definition <> ''")
def category_load(spark, sf_dir):
    of = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.when(F.col("p_type") == "SMALL", "unclassified").otherwise(F.col("p_type")).alias("category"))
    return D.load_with_categories(_dictionary(spark, sf_dir).drop("domain"), of).select("id", "term", "domain")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'unclassified' WHEN p_size % 5 < 3 THEN 'group ' || p_size % 5 ELSE 'cluster ' || p_size % 5 END AS domain FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_partkey % 4 = 0")
def cluster_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    term = F.col("p_partkey").cast("string").alias("term")
    of = p.filter("p_partkey % 4 <> 0").select(term, F.when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size") % 5).alias("cluster"))
    names = spark.createDataFrame([(1, "group 1"), (2, "group 2")], "cluster int, name string")
    return D.label_clusters(p.select(term, F.col("p_type").alias("domain")), of, names).select(F.col("term").cast("long").alias("id"), "domain")


# Texts with brackets, commas and multiples stand for definitions.
_SAID = "p_name || '（' || p_brand || '）は、' || p_type || ' (' || p_size || ') ' || p_size || '倍 ' || p_size || '%'"
_PHRASES = r"list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(said, '（[^）]+）|\([^)]+\)'), lambda x: substr(x, 2, length(x) - 2)), lambda x: length(x) > 1), list_filter([regexp_replace(regexp_replace(regexp_extract(said, '^([^、。，]+)[、。，]', 1), '^[BLANKS]+|[BLANKS]+$', '', 'g'), '(とは|は|です|である)$', '')], lambda x: length(x) > 2), regexp_extract_all(said, '\p{Nd}+[倍％%]')))".replace("BLANKS", T.BLANKS)


def _said():
    c = F.col
    return F.concat("p_name", F.lit("（"), "p_brand", F.lit("）は、"), "p_type", F.lit(" ("), c("p_size").cast("string"), F.lit(") "), c("p_size").cast("string"), F.lit("倍 "), c("p_size").cast("string"), F.lit("%"))


@query(f"SELECT p_partkey, unnest({_PHRASES}) AS phrase FROM (SELECT p_partkey, {_SAID} AS said FROM part)")
def definition_phrases(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.key_phrases(_said())).alias("phrase"))


@query(f"SELECT doc_id, unnest({_PHRASES.replace('said', 'text')}) AS phrase FROM documents")
def key_phrases(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.key_phrases(F.col("text"))).alias("phrase"))


@query(f"SELECT DISTINCT lower(trim(k, ' ')) AS key, term FROM (SELECT d.p_name AS term, unnest(list_concat(CASE WHEN p_size % 2 = 0 THEN string_split(p_type, ' ') ELSE []::VARCHAR[] END, {_PHRASES})) AS k FROM (SELECT *, {_SAID} AS said FROM part) d) WHERE trim(k, ' ') <> ''")
def reverse_index(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("said", _said())
    return D.reverse_index(_dictionary(spark, sf_dir).drop("definition").join(p.select(F.col("p_partkey").alias("id"), F.col("said").alias("definition")), "id"))


@query("WITH a AS (SELECT DISTINCT p_name AS term FROM part WHERE p_size > 47), b AS (SELECT DISTINCT p_name AS term FROM part WHERE p_size < 4) SELECT term, 'removed' AS change FROM a ANTI JOIN b USING (term) UNION ALL SELECT term, 'added' FROM b ANTI JOIN a USING (term)")
def stage_changes(spark, sf_dir):
    """Names of the largest parts before, of the smallest after."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_name", "term")
    return E.stage_diff(p.filter("p_size > 47"), p.filter("p_size < 4"))


# Terms: classes, validity, selection.
@query(f"WITH {_COUNTS_SQL} SELECT term, CASE WHEN regexp_matches(term, '^[A-Z]{{2,5}}$') THEN 'acronym' WHEN regexp_matches(term, '\\p{{Nd}}') THEN 'numeric' WHEN length(term) = 1 THEN 'single_char' WHEN frequency >= 3 THEN 'high_freq_compound' ELSE 'low_freq_compound' END AS category FROM counts")
def term_categories(spark, sf_dir):
    return _counts(spark, sf_dir).select("term", T.category(F.col("term"), F.col("frequency")).alias("category"))


@query(f"WITH {_COUNTS_SQL} SELECT term, {VALID} AS valid FROM counts")
def term_validity(spark, sf_dir):
    return _counts(spark, sf_dir).select("term", T.is_valid_term(F.col("term")).alias("valid"))


@query(f"WITH {_FLAGS} SELECT term FROM found ANTI JOIN truth USING (term)")
def false_positives(spark, sf_dir):
    return E.flags(_truth(spark, sf_dir), _found(spark, sf_dir)).filter("in_found and not in_truth").select("term")


@query(f"WITH {_TRUTH}, {_COUNTS_SQL.replace('AS (', 'AS MATERIALIZED (', 1)} SELECT t.term, coalesce(frequency, 0) >= 5 AS in_found, coalesce(frequency, 0)::BIGINT AS frequency FROM truth t LEFT JOIN counts USING (term)")
def term_details(spark, sf_dir):
    return E.term_details(_truth(spark, sf_dir), _found(spark, sf_dir), _counts(spark, sf_dir))


_BEST = f"best AS (SELECT term, frequency AS score FROM counts ORDER BY frequency DESC, term LIMIT 1500)"


def _best(spark, sf_dir):
    return M.best(_counts(spark, sf_dir).select("term", F.col("frequency").alias("score")))


@query(f"WITH {_COUNTS_SQL}, {_BEST} SELECT * FROM best")
def candidate_cap(spark, sf_dir):
    return _best(spark, sf_dir)


@query(f"WITH {_COUNTS_SQL}, {_BEST} SELECT term, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, term) AS r, count(*) OVER () AS n FROM best) WHERE r <= greatest(1, floor(n * 0.15))")
def seed_terms(spark, sf_dir):
    return M.seeds(_best(spark, sf_dir))


_UPPER = "upper_best AS (SELECT CASE WHEN regexp_matches(term, '^[a-z]{3}$') THEN upper(term) ELSE term END AS term, score FROM best), flagged AS (SELECT *, regexp_matches(term, '^[A-Z]{2,5}[0-9x]?$') AS abbr FROM upper_best)"


@query(f"WITH {_COUNTS_SQL}, {_BEST}, {_UPPER} SELECT term, score FROM flagged WHERE abbr UNION ALL SELECT term, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, term) AS r, count(*) OVER () AS n FROM flagged WHERE NOT abbr) WHERE r <= floor(n * 0.5)")
def terms_to_define(spark, sf_dir):
    b = _best(spark, sf_dir)
    return M.to_define(b.withColumn("term", F.when(F.col("term").rlike("^[a-z]{3}$"), F.upper("term")).otherwise(F.col("term"))))


@query("WITH s AS (SELECT p_partkey, p_retailprice - 950 AS v FROM part), b AS (SELECT min(v) AS lo, max(v) AS hi FROM s WHERE v > 0) SELECT p_partkey, round(coalesce(CASE WHEN v <= 0 THEN 0.0 WHEN hi - lo < 1e-10 THEN 0.5 ELSE (v - lo) / (hi - lo) END, 0.0), 6) AS scaled FROM s, b")
def positive_scaling(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") - 950).alias("v"))
    return M.positive_min_max(s, "v", "scaled").select("p_partkey", "scaled")


_T = r"t AS (SELECT *, CASE WHEN length(surface) >= 4 OR regexp_matches(surface, '^[0-9]+$') THEN 'noun' WHEN surface IN ('non', 'pre', 'un') THEN 'prefix' ELSE 'other' END AS major, CASE WHEN regexp_matches(surface, '^[0-9]+$') THEN 'number' WHEN length(surface) = 5 THEN 'counter' ELSE 'general' END AS sub FROM (SELECT conv_id AS doc_id, turn AS sent_id, i AS pos, w[i + 1] AS surface FROM (SELECT conv_id, turn, w, unnest(range(len(w))) AS i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(regexp_replace(text, '\p{P}', '', 'g')), '\s+'), lambda x: x <> '') AS w FROM conversations))))"


def _islands_sql(joins: str) -> str:
    return f"{_T}, j AS (SELECT *, {joins} AS joins FROM (SELECT *, lead(sub) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS nxt FROM t)), m AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS island FROM j), g AS (SELECT doc_id, sent_id, min(pos) AS start, list(surface ORDER BY pos) AS parts FROM m WHERE joins GROUP BY doc_id, sent_id, island)"


_SUBRUNS = "SELECT doc_id, sent_id, start + i AS start, n::BIGINT AS size, array_to_string(list_slice(parts, i + 1, i + n), '') AS term FROM (SELECT *, unnest(range(len(parts) - n + 1)) AS i FROM g, (VALUES {0}) v(n) WHERE len(parts) >= n)"


def _tagged(spark, sf_dir):
    """Words of conversations: those of four letters and more stand for nouns, digits for numbers, five letters for counters."""
    words = T.tokens(F.regexp_replace("text", r"\p{P}", ""))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), F.posexplode(words).alias("pos", "surface")).withColumn("pos", F.col("pos").cast("long"))
    number = F.col("surface").rlike("^[0-9]+$")
    major = F.when((F.length("surface") >= 4) | number, "noun").when(F.col("surface").isin("non", "pre", "un"), "prefix").otherwise("other")
    return c.withColumns({"pos_major": major, "pos_sub": F.when(number, "number").when(F.length("surface") == 5, "counter").otherwise("general"), "normalized": F.lower("surface")})


@query(f"WITH {_islands_sql("major IN ('noun', 'prefix') AND (sub <> 'number' OR coalesce(nxt = 'counter', false))")} SELECT doc_id, sent_id, start, len(parts)::BIGINT AS size, array_to_string(parts, '') AS term FROM g WHERE len(parts) >= 2 AND length(array_to_string(parts, '')) <= 15")
def noun_runs(spark, sf_dir):
    return M.noun_runs(_tagged(spark, sf_dir))


@query(f"WITH {_islands_sql("major IN ('noun', 'prefix')")}, r AS ({_SUBRUNS.format('(2), (3), (4), (5), (6)')}) SELECT * FROM r WHERE {VALID}")
def noun_ngrams(spark, sf_dir):
    return M.noun_ngrams(_tagged(spark, sf_dir))


@query(f"WITH {_T} SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, surface AS term FROM t WHERE major = 'noun' AND length(surface) >= 2) WHERE {VALID} GROUP BY ALL")
def single_nouns(spark, sf_dir):
    return M.single_nouns(_tagged(spark, sf_dir))


@query(f"WITH {_islands_sql("major = 'noun'")}, r AS ({_SUBRUNS.format('(1), (2), (3), (4)')}) SELECT term, count(*) AS frequency FROM r WHERE length(term) BETWEEN 2 AND 20 GROUP BY 1 HAVING count(*) >= 2")
def noun_subruns(spark, sf_dir):
    return M.noun_subruns(_tagged(spark, sf_dir))


@query(f"WITH {_islands_sql("major = 'noun'")} SELECT doc_id, sent_id, start, array_to_string(parts, '') AS phrase FROM g WHERE len(parts) >= 2")
def noun_phrases(spark, sf_dir):
    return M.noun_phrases(_tagged(spark, sf_dir))


@query(f"WITH {_islands_sql("major = 'noun'").replace('list(surface ORDER', 'list(lower(surface) ORDER')} SELECT DISTINCT doc_id, keyword FROM (SELECT doc_id, unnest(list_concat(list_filter(parts, lambda x: length(x) >= 2), CASE WHEN len(parts) > 1 AND length(array_to_string(parts, '')) <= 10 THEN [array_to_string(parts, '')] ELSE [] END)) AS keyword FROM g)")
def keywords(spark, sf_dir):
    return M.keywords(_tagged(spark, sf_dir))


@query()
def pattern_candidates(spark, sf_dir):
    """X8 over whole documents. Word bounds of Unicode and looking behind have no SQL."""
    return M.pattern_terms(_docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(f"WITH {_FLAGS.replace('counts AS (', 'counts AS MATERIALIZED (', 1)} SELECT term, coalesce(frequency, 0)::BIGINT AS frequency FROM flags LEFT JOIN counts USING (term) WHERE in_truth AND NOT in_found ORDER BY 2 DESC, 1")
def missed_terms_ordered(spark, sf_dir):
    return E.ordered_misses(E.flags(_truth(spark, sf_dir), _found(spark, sf_dir)), _counts(spark, sf_dir))


@query(f"WITH {_FLAGS.replace('counts AS (', 'counts AS MATERIALIZED (', 1)} SELECT term, coalesce(frequency / 2, 0)::DOUBLE AS score FROM flags LEFT JOIN counts USING (term) WHERE in_found AND NOT in_truth ORDER BY 2 DESC, 1")
def false_positives_ordered(spark, sf_dir):
    scores = _counts(spark, sf_dir).select("term", (F.col("frequency") / 2).alias("score"))
    return E.ordered_false_positives(E.flags(_truth(spark, sf_dir), _found(spark, sf_dir)), scores)


_BIN = "CASE WHEN frequency = 1 THEN '1' WHEN frequency = 2 THEN '2' WHEN frequency BETWEEN 3 AND 5 THEN '3-5' WHEN frequency BETWEEN 6 AND 10 THEN '6-10' WHEN frequency >= 11 THEN '11+' END"


@query(f"WITH {_TRUTH}, {_COUNTS_SQL} SELECT {_BIN} AS bin, count(*) AS n FROM truth LEFT JOIN counts USING (term) GROUP BY 1")
def truth_frequencies(spark, sf_dir):
    return E.truth_frequencies(_truth(spark, sf_dir), _counts(spark, sf_dir))


# Reports.
@query(f"SELECT split_part(metric, '@', 1) AS metric, split_part(metric, '@', 2)::INT AS k, round(avg(value), 4) AS mean FROM ({_long_sql(True)}) WHERE metric LIKE '%@%' GROUP BY 1, 2")
def metric_by_k(spark, sf_dir):
    return E.by_k(_long(spark, sf_dir), 4)


@query(f"SELECT metric, CASE WHEN m >= 0.9 THEN 'excellent' WHEN m >= 0.8 THEN 'good' WHEN m >= 0.7 THEN 'fair' WHEN m >= 0.6 THEN 'weak' ELSE 'poor' END AS rating FROM (SELECT metric, round(avg(value), 4) AS m FROM ({_long_sql(True)}) GROUP BY 1)")
def metric_rating(spark, sf_dir):
    return E.averages(_long(spark, sf_dir), 4).select("metric", E.rating(F.col("mean")).alias("rating"))


@query("WITH s AS (SELECT CASE WHEN p_size = 1 THEN '1' WHEN p_size = 2 THEN '2' WHEN p_size BETWEEN 3 AND 5 THEN '3-5' WHEN p_size BETWEEN 6 AND 10 THEN '6-10' WHEN p_size >= 11 THEN '11+' END AS bin, (p_retailprice * (1 + p_size / 64)) / p_retailprice AS r FROM part WHERE p_retailprice > 0), g AS (SELECT bin, count(*) AS n, avg(r) AS a, median(r) AS m FROM s GROUP BY 1) SELECT bin, coalesce(n, 0) AS n, round(coalesce(a, 1.0), 5) AS mean_ratio, round(coalesce(m, 1.0), 5) AS median_ratio FROM (VALUES ('1'), ('2'), ('3-5'), ('6-10'), ('11+')) b(bin) LEFT JOIN g USING (bin)")
def rerank_impact(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("frequency"), F.col("p_retailprice").alias("base"), (F.col("p_retailprice") * (1 + F.col("p_size") / 64)).alias("revised"))
    r = E.rerank_impact(p)
    return r.select("bin", "n", *(F.round(c, 5).alias(c) for c in ("mean_ratio", "median_ratio")))


@query(f"WITH {_STAGES} SELECT term, arg_max(stage, stage_index) AS last_stage, arg_max(present, stage_index) AS extracted FROM stages GROUP BY 1")
def dropout_report(spark, sf_dir):
    return E.dropout_report(_stages(spark, sf_dir))


@query("SELECT p_partkey AS question, position, value FROM (SELECT p_partkey, unnest([0, 1])::INT AS position, unnest([trim(p_brand), CASE WHEN p_size > 25 THEN '' ELSE trim(p_type) END]) AS value FROM part) WHERE value <> ''")
def expected_sources(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("expected 1"), F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_type")).alias("expected 2"))
    return files.expected_long(p, "p_partkey", "expected")


@query("WITH f AS (SELECT p_brand, p_partkey * 3 % 4 AS r0, p_partkey * 7 % 3 AS c, arg_min(p_name, p_partkey) AS content, arg_min(p_size, p_partkey) % 2 AS extra FROM part GROUP BY ALL), e AS (SELECT p_brand, r0, c, content, unnest(range(r0, r0 + 1 + extra)) AS r FROM f) SELECT p_brand, r AS row, c AS col, arg_max(content, r0) AS content FROM e GROUP BY p_brand, r, c")
def flat_table(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"row": F.col("p_partkey") * 3 % 4, "col": F.col("p_partkey") * 7 % 3})
    first = p.groupBy("p_brand", "row", "col").agg(F.min_by(F.struct("p_name", "p_size"), "p_partkey").alias("f"))
    cells = first.select("p_brand", "row", "col", (1 + F.col("f.p_size") % 2).alias("row_span"), F.lit(None).cast("int").alias("col_span"), F.col("f.p_name").alias("content"))
    return files.flat_cells(cells, "p_brand")


# Graph and clusters.
@query("WITH t AS (SELECT p_name, min(p_partkey) AS id, arg_min(p_type, p_partkey) AS ty FROM part GROUP BY 1), o AS (SELECT * FROM t WHERE id % 3 <> 0), n AS (SELECT * FROM t WHERE id % 2 = 0) SELECT coalesce(o.id, n.id) AS id, p_name AS term, coalesce(n.ty, CASE WHEN o.id % 5 <> 0 THEN o.ty END) AS definition, CASE WHEN n.id IS NOT NULL THEN 'new' ELSE 'old' END AS side, o.id AS old_id FROM o FULL JOIN n USING (p_name)")
def node_upsert(spark, sf_dir):
    t = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("id"), F.min_by("p_type", "p_partkey").alias("definition")).withColumn("node_type", F.lit("Term"))
    old = t.filter("id % 3 <> 0").withColumn("definition", F.when(F.col("id") % 5 != 0, F.col("definition"))).withColumn("properties", F.create_map(F.lit("side"), F.lit("old"), F.lit("old_id"), F.col("id").cast("string")))
    new = t.filter("id % 2 = 0").withColumn("properties", F.create_map(F.lit("side"), F.lit("new")))
    return G.upsert_nodes(old, new).select("id", "term", "definition", F.try_element_at("properties", F.lit("side")).alias("side"), F.try_element_at("properties", F.lit("old_id")).cast("long").alias("old_id"))


_TERMS = "SELECT p_name AS term, any_value(p_name) AS definition, list_distinct(list(p_brand)) AS synonyms, min(CASE WHEN p_type <> 'SMALL' THEN p_type ELSE 'unclassified' END) AS category FROM part GROUP BY 1"


def _built(spark, sf_dir):
    kind = F.when(F.col("p_type") == "SMALL", "unclassified").otherwise(F.col("p_type"))
    return G.from_terms(table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.col("p_name").alias("definition"), F.collect_set("p_brand").alias("synonyms"), F.min(kind).alias("category")))


@query(f"WITH t AS ({_TERMS}) SELECT DISTINCT sha256('Term#' || term) AS source_id, sha256('Term#' || s) AS target_id, 'SYNONYM' AS edge_type, 0.95::DOUBLE AS weight FROM (SELECT term, unnest(synonyms) AS s FROM t) WHERE s <> term UNION ALL SELECT sha256('Term#' || term), sha256('Category#' || category), 'BELONGS_TO', 1.0 FROM t WHERE category <> 'unclassified'")
def graph_edges_of_terms(spark, sf_dir):
    return _built(spark, sf_dir)[1].select("source_id", "target_id", "edge_type", "weight")


@query(f"WITH t AS ({_TERMS}) SELECT sha256('Term#' || term) AS id, 'Term' AS node_type, term, definition FROM t UNION ALL SELECT sha256('Term#' || s), 'Term', s, NULL FROM (SELECT DISTINCT unnest(synonyms) AS s FROM t) WHERE s NOT IN (SELECT term FROM t) UNION ALL SELECT DISTINCT sha256('Category#' || category), 'Category', category, NULL FROM t WHERE category <> 'unclassified'")
def graph_nodes_of_terms(spark, sf_dir):
    return _built(spark, sf_dir)[0]


@query(f"WITH {_NODES} SELECT id, term FROM nodes WHERE node_type = 'Term'")
def node_listing(spark, sf_dir):
    return G.listing(_nodes(spark, sf_dir))


@query("SELECT l_suppkey AS id, round(least(sum(round(1 - l_discount * 5, 4)::DECIMAL(28, 12))::DOUBLE, 1.0), 4) AS weight FROM lineitem GROUP BY 1")
def expansion_merge(spark, sf_dir):
    e = _edges(spark, sf_dir).select(F.substring("target_id", 2, 20).cast("long").alias("id"), "weight")
    return G.merge_expansions(e, "sum").withColumn("weight", F.round("weight", 4))


@query(f"""WITH {_EDGES} SELECT '"' || source_id || '" -> "' || target_id || '" [label="' || edge_type || '", style=' || CASE WHEN weight > 0.7 THEN 'solid' ELSE 'dashed' END || '];' AS line FROM edges""")
def graph_dot(spark, sf_dir):
    return G.to_dot(_edges(spark, sf_dir))


@query("SELECT p_partkey AS child, CASE WHEN p_partkey = 0 THEN 0 ELSE 1 + (p_partkey > 4)::INT + (p_partkey > 20)::INT + (p_partkey > 84)::INT + (p_partkey > 340)::INT + (p_partkey > 1364)::INT + (p_partkey > 5460)::INT + (p_partkey > 21844)::INT + (p_partkey > 87380)::INT END AS depth FROM part")
def tree_depths(spark, sf_dir):
    return C.depths(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"), F.when(F.col("p_partkey") > 0, F.floor((F.col("p_partkey") - 1) / 4)).alias("parent")))


@query("SELECT p_partkey, CASE WHEN p_retailprice / 1000 > 0.99 THEN 3 WHEN p_retailprice / 1000 > 0.95 THEN 2 WHEN p_size > 10 THEN 1 ELSE 0 END AS level FROM part")
def tree_levels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("lambda"), (F.col("p_size") - 10).alias("depth"))
    return C.levels(p, 0.99, 0.95).select("p_partkey", "level")


@query("SELECT label AS cluster, count(*) AS n, array_to_string(list_slice(list_sort(list(vec_id)), 1, 10), ',') AS members FROM embeddings GROUP BY 1")
def cluster_groups(spark, sf_dir):
    g = C.groups(_embeddings(spark, sf_dir).select("vec_id", F.col("label").alias("cluster")), "vec_id")
    return g.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)) AS s, count(*) AS n FROM embeddings a, embeddings b WHERE a.label >= 0 AND b.label >= 0 GROUP BY ALL), o AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM o")
def cluster_silhouette(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return C.silhouette(e, e.select("vec_id", F.col("label").alias("cluster"))).select(F.round("silhouette", 5).alias("silhouette"))


# Similarity.
@query("SELECT a, b, similarity, rank FROM (SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(1 / (1 + list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[])), 5) AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0 AND x.label >= 0)) WHERE rank <= 5")
def related_in_cluster(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return S.related_in_cluster(e, e.filter("vec_id % 100 = 0"), digits=5)


@query(f"WITH p AS (SELECT a, b, s AS similarity FROM ({_PAIRS6}) WHERE s >= 0.25) SELECT a, b, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM (FROM p UNION ALL SELECT b, a, similarity FROM p)) WHERE rank <= 5")
def strongest_synonyms(spark, sf_dir):
    return S.nearest_pairs(_embeddings(spark, sf_dir), 0.25, 5)


@query(f"WITH e AS (SELECT vec_id, embedding, {_SET} AS w FROM embeddings JOIN documents ON vec_id = doc_id) SELECT a.vec_id AS a, b.vec_id AS b, round(0.7 * {_COSINE} + 0.3 * CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 5) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def hybrid_similarity(spark, sf_dir):
    """Each document with the next one."""
    e = _embeddings(spark, sf_dir).join(_docs(spark, sf_dir), F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding", T.word_set(F.col("text")).alias("w"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"), F.col("w").alias("w2"))
    value = S.hybrid(V.cosine(F.col("embedding"), F.col("e2")), T.jaccard(F.col("w"), F.col("w2")))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(value, 5).alias("similarity"))


@query("SELECT DISTINCT p_name AS term, 64 AS size FROM part")
def cached_embeddings(spark, sf_dir):
    """Vectors of a substitute; those of every third term come from the cache."""
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    cache = cached_vectors(terms.filter(F.pmod(F.crc32("term"), F.lit(3)) == 0), terms.limit(0).withColumn("embedding", F.lit(None).cast("array<float>")))[1]
    return cached_vectors(terms, cache)[0].select("term", F.size("embedding").alias("size"))


# Parsers of loosely formatted answers, and text clean-up.
_FLAG = "list_transform([x % 2 = 1, x % 4 > 1, x % 8 > 3], lambda b: CASE WHEN b THEN 'true' ELSE 'false' END)"


@query(f"SELECT event_id, array_to_string(CASE x % 5 WHEN 3 THEN ['false', 'false', 'false'] WHEN 4 THEN ['true', 'true', 'false'] ELSE {_FLAG} END, ',') AS bits, k || ',0' AS numbers, CASE WHEN x % 7 = 0 THEN '' WHEN k BETWEEN 1 AND 50 THEN (k - 1) || CASE WHEN x % 2 = 0 THEN ',' || (k - 1) ELSE '' END ELSE '' END AS indices, 'event^' || format('{{:.1f}}', round(k / 100.0, 1)) AS boosted FROM (SELECT event_id, event_id % 1000 AS x, json_extract(props, '$.k')::INT AS k FROM events)")
def answer_parsers(spark, sf_dir):
    """Answers as a list, as a list with other numbers than 1, as bare digits, with too few of them and with no number between commas."""
    e = table(spark, sf_dir, "events").withColumn("x", F.col("event_id") % 1000)
    x, k = F.col("x"), F.get_json_object("props", "$.k").cast("int")
    a, b, c = ((x % n / (n // 2)).cast("int").cast("string") for n in (2, 4, 8))
    listed = lambda by: F.concat(F.lit("Result: ["), *(y for d in (a, b, c) for y in (F.when(d == "1", by).otherwise("0"), F.lit(", "))), F.lit("]"))
    answer = F.when(x % 5 == 0, listed("1")).when(x % 5 == 1, listed("7")).when(x % 5 == 2, F.concat(F.lit("is "), a, F.lit(" then "), b, F.lit(" and "), c, F.lit(" 1 0"))).when(x % 5 == 3, F.lit("only 1, and [0")).otherwise("[1 1, 0], or 1, 1, 0")
    answer = F.when(x % 5 == 4, F.lit("1 and 1 and 0")).otherwise(answer)
    chosen = F.when(x % 7 == 0, F.lit(" なし\n")).when(x % 2 == 0, F.concat("props", F.lit(" and "), k.cast("string"))).otherwise(F.col("props"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return e.select("event_id", joined(T.bits(answer, 3)).alias("bits"), joined(T.numbers(F.col("props"), 2)).alias("numbers"), joined(T.chosen_indices(chosen, 50)).alias("indices"), T.boosted(F.lit("event"), k / 100).alias("boosted"))


@query("SELECT p_partkey, array_to_string(CASE WHEN p_size % 3 = 0 THEN ['x=second'] WHEN p_size % 3 = 1 THEN [p_brand || '=' || p_type] ELSE [] END, '|') AS found FROM part")
def answer_definitions(spark, sf_dir):
    """Lines "n. term: definition" for the asked terms: the later of two lines counts, a longer name answers the asked one."""
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 3 == 0, "1. x: first\nno line\n 2. x: second ").when(F.col("p_size") % 3 == 1, F.concat(F.lit("intro:\n1. the "), "p_brand", F.lit(" brand: "), "p_type")).otherwise("1. other: thing\n2. x")
    found = T.asked_definitions(text, F.array(F.lit("x"), F.col("p_brand")))
    return p.select("p_partkey", F.array_join(F.transform(found, lambda d: F.concat_ws("=", d["term"], d["definition"])), "|").alias("found"))


@query(r"SELECT conv_id, turn, array_to_string(list_slice(regexp_extract_all(text, '[ぁ-んァ-ヴー一-龠a-zA-Z0-9]+'), 1, 5), '|') AS runs FROM conversations")
def jargon_runs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.jargon_runs(F.col("text")), "|").alias("runs"))


@query(f"WITH x AS ({_REVERSE.replace('rank <= 10', 'rank <= 5')}), f AS (SELECT query_id, list(term ORDER BY rank) AS terms, list(confidence ORDER BY rank) AS sure FROM x GROUP BY 1) SELECT p_partkey AS query_id, CASE WHEN len(w) > 0 THEN p_name || ' ' || array_to_string(w, ' ') END AS weighted, array_to_string(list_sort(list_distinct(list_concat([p_name], list_filter(terms, lambda t, i: sure[i] > 0.5)))), '|') AS combined FROM (SELECT p_partkey, p_name, terms, sure, list_transform(list_filter(range(1, least(3, len(terms)) + 1), lambda i: sure[i] > 0.7), lambda i: terms[i] || '^' || format('{{:.1f}}', sure[i])) AS w FROM part JOIN f ON query_id = p_partkey)")
def query_augmentation(spark, sf_dir):
    """Each query's found terms as a weighted query, and with the query's own term."""
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.array("p_name", "p_type").alias("keys"))
    found = R.reverse_lookup(terms, _reverse_asked(spark, sf_dir), R.pattern_terms(spark), k=5)
    found = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "confidence"))), lambda x: F.struct(x["term"].alias("term"), x["confidence"].alias("confidence"))).alias("found"))
    p = table(spark, sf_dir, "part").join(found, F.col("p_partkey") == F.col("query_id"))
    return p.select("query_id", T.weighted_query(F.col("p_name"), F.col("found")).alias("weighted"), F.array_join(T.combined_terms(F.array("p_name"), F.col("found")), "|").alias("combined"))


@query(r"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '^[" + T.BLANKS + "]+|[" + T.BLANKS + r"]+$', '', 'g') WHEN 1 THEN 'rest ' || doc_id ELSE 'plain ' || doc_id END AS body FROM documents")
def chunk_cells(spark, sf_dir):
    """F14 of cells of a result table."""
    d, n = _docs(spark, sf_dir), F.col("doc_id").cast("string")
    cell = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Source: a, Chunk ID: "), n, F.lit("\n---\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Source: a\n rest "), n)).otherwise(F.concat(F.lit(" plain "), n))
    return d.select("doc_id", T.chunk_cell_body(cell).alias("body"))


@query("SELECT conv_id, string_agg('[ソース ' || r || ' ChunkID: ' || coalesce(c, 'N/A') || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY r) AS context, array_to_string(list_sort(list_distinct(list(coalesce(c, '不明')))), ', ') AS sources FROM (SELECT conv_id, text, CASE WHEN turn % 3 <> 0 THEN conv_id || '_' || turn END AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations) GROUP BY 1")
def answer_context(spark, sf_dir):
    """The turns of a conversation as chunks of a question's context, and the list of their sources."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 3 != 0, F.concat_ws("_", "conv_id", "turn")).alias("chunk_id"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "chunk_id"))).alias("c"))
    chunks = F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("content")))
    return g.select("conv_id", T.context_block(chunks).alias("context"), T.source_list(F.transform("c", lambda x: x["chunk_id"])).alias("sources"))


@query(r"SELECT conv_id, turn, array_to_string(list_slice(regexp_extract_all(regexp_replace(text, '\n', chr(10) || '1. ', 'g'), '[0-9]+\.\s*(.+)', 1), 1, 4), '|') AS items FROM conversations")
def answer_items(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(T.numbered_items(F.regexp_replace("text", "\n", "\n1. ")), "|").alias("items"))


_LAYOUT = f"regexp_replace(regexp_replace(regexp_replace({{0}}, ' *\n *', chr(10), 'g'), ' +([{T.LAYOUT_JAPANESE}])', '\\1', 'g'), '([{T.LAYOUT_JAPANESE}]) +', '\\1', 'g')"


@query(f"SELECT doc_id, sha256({_LAYOUT.format("replace(text, 'the', ' 削 減 ')")}) AS cleaned FROM documents")
def cleaned_layout(spark, sf_dir):
    """Each "the" is made Japanese with blanks, as a page reader leaves them."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.cleaned_layout(F.replace("text", F.lit("the"), F.lit(" 削 減 "))), 256).alias("cleaned"))


@query()
def normalized_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalized(F.col("text")).alias("text"))


# Stages of an extraction: words of documents, dropped by length and by frequency.
_FLOW = f"{_COUNTS_SQL.replace('counts AS (', 'counts AS MATERIALIZED (', 1)}, stages(stage_index, stage) AS (VALUES (0, 'all'), (1, 'long'), (2, 'frequent')), now AS (SELECT stage_index, term, frequency FROM counts, stages WHERE stage_index = 0 OR (length(term) >= 4 AND (stage_index = 1 OR frequency >= 3))), gone AS (SELECT 1 AS stage_index, term, CASE WHEN length(term) < 3 THEN 'short' END AS reason FROM counts WHERE length(term) < 4 UNION ALL SELECT 2, term, 'rare' FROM counts WHERE length(term) >= 4 AND frequency < 3)"


def _flow(spark, sf_dir):
    c, n = _counts(spark, sf_dir), F.length("term")
    stages = spark.createDataFrame([(0, "all"), (1, "long"), (2, "frequent")], "stage_index int, stage string")
    c = written(c, "flow")
    at = c.crossJoin(F.broadcast(stages)).filter((F.col("stage_index") == 0) | ((n >= 4) & ((F.col("stage_index") == 1) | (F.col("frequency") >= 3)))).select("stage_index", "term", "frequency")
    gone = c.filter(n < 4).select(F.lit(1).alias("stage_index"), "term", F.when(n < 3, "short").alias("reason")).unionByName(c.filter((n >= 4) & (F.col("frequency") < 3)).select(F.lit(2).alias("stage_index"), "term", F.lit("rare").alias("reason")))
    return stages, at, gone


def _sides(stages, at):
    """What is there before a stage is what was there after the one before."""
    after = at.join(stages, "stage_index").select("stage_index", "stage", F.lit("after").alias("side"), "term")
    before = at.select((F.col("stage_index") + 1).alias("stage_index"), "term").join(stages, "stage_index").select("stage_index", "stage", F.lit("before").alias("side"), "term")
    return after.unionByName(before).filter("stage_index > 0")


@query(f"WITH {_TRUTH}, {_FLOW} SELECT truth.term, stages.stage_index, stage, CASE WHEN now.term IS NOT NULL THEN 'present' ELSE 'absent' END AS status, now.frequency, CASE WHEN now.term IS NULL THEN gone.reason END AS reason FROM truth CROSS JOIN stages LEFT JOIN now ON now.term = truth.term AND now.stage_index = stages.stage_index LEFT JOIN gone ON gone.term = truth.term AND gone.stage_index = stages.stage_index")
def stage_tracking(spark, sf_dir):
    stages, at, gone = _flow(spark, sf_dir)
    return E.track(_truth(spark, sf_dir), stages, at, gone)


@query(f"WITH {_FLOW} SELECT s.stage_index, stage, (SELECT count(*) FROM now WHERE now.stage_index = s.stage_index - 1) AS terms_before, (SELECT count(*) FROM now WHERE now.stage_index = s.stage_index) AS terms_after, (SELECT count(*) FROM now WHERE now.stage_index = s.stage_index - 1) - (SELECT count(*) FROM now WHERE now.stage_index = s.stage_index) AS removed, 0::BIGINT AS added FROM stages s WHERE s.stage_index > 0")
def stage_log(spark, sf_dir):
    stages, at, _ = _flow(spark, sf_dir)
    return E.stage_log(_sides(stages, at))


@query(f"WITH {_FLOW} SELECT (SELECT count(*) FROM now WHERE stage_index = 0) AS initial, (SELECT count(*) FROM now WHERE stage_index = 2) AS final, (SELECT count(*) FROM now WHERE stage_index = 0) - (SELECT count(*) FROM now WHERE stage_index = 2) AS removed, 2::BIGINT AS stages")
def stage_summary(spark, sf_dir):
    stages, at, _ = _flow(spark, sf_dir)
    return E.stage_summary(_sides(stages, at))


@query(f"WITH {_FLOW} SELECT stage_index, reason, count(*) AS n, array_to_string(list_slice(list_sort(list(term)), 1, 20), ' ') AS terms FROM (SELECT stage_index, term, coalesce(reason, '理由不明') AS reason FROM gone) GROUP BY 1, 2")
def stage_removals(spark, sf_dir):
    _, _, gone = _flow(spark, sf_dir)
    return E.removals(gone, gone.filter("reason is not null")).withColumn("terms", F.array_join("terms", " "))


@query("WITH e AS (SELECT event_type AS phase, sum(value) AS duration FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY duration DESC, phase) AS r FROM e) SELECT phase, round(duration, 4) AS duration, round(duration * 100 / (SELECT sum(duration) FROM e), 4) AS percent, CASE WHEN r <= 3 THEN r END::INT AS rank FROM r")
def phase_profile(spark, sf_dir):
    return E.profile(table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("duration"))).withColumn("duration", F.round("duration", 4))


@query(f"SELECT metric, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM ({_long_sql(True)}) GROUP BY 1")
def metric_centres(spark, sf_dir):
    return E.centres(_long(spark, sf_dir), 4)


@query(f"WITH r AS (SELECT 'graded' AS file, metric, value FROM ({_long_sql(True)}) UNION ALL SELECT 'binary', metric, value FROM ({_long_sql(False)}) WHERE metric <> 'mrr') SELECT f.file, m.metric, coalesce(round(avg(value), 4), 0)::DOUBLE AS mean FROM (SELECT DISTINCT file FROM r) f CROSS JOIN (SELECT DISTINCT metric FROM r) m LEFT JOIN r ON r.file = f.file AND r.metric = m.metric GROUP BY 1, 2")
def metric_comparison(spark, sf_dir):
    a, b = _long(spark, sf_dir).withColumn("file", F.lit("graded")), _long(spark, sf_dir, False).filter("metric <> 'mrr'").withColumn("file", F.lit("binary"))
    return E.compared(a.unionByName(b), 4)


@query("SELECT conv_id, turn, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS label FROM conversations")
def question_labels(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.short_label(F.col("text")).alias("label"))


# Dictionary, schema and search beside.
@query(f"SELECT collection_name, term, id FROM ({_DICT}) WHERE collection_name = (SELECT min(p_brand) FROM part) ORDER BY term")
def dictionary_scan(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    return D.all_terms(d, d.agg(F.min("collection_name")).first()[0]).select("collection_name", "term", "id")


@query(f"SELECT (SELECT count(DISTINCT p_name || p_brand) FROM part WHERE p_partkey % 7 = 0) AS deleted, (SELECT count(DISTINCT s_name) FROM supplier) AS errors")
def dictionary_delete_counts(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    keys = d.filter("id % 7 = 0").select("collection_name", "term").unionByName(table(spark, sf_dir, "supplier").select(F.lit("none").alias("collection_name"), F.col("s_name").alias("term")))
    return D.delete_counts(d, keys)


@query("SELECT c AS collection, c IN (SELECT source FROM documents) OR c = 'questions' AND (SELECT count(*) FROM conversations) > 0 AS has_rows FROM (VALUES ('questions'), ('nowhere')) v(c)")
def collection_probe(spark, sf_dir):
    docs, chunks = _docs(spark, sf_dir).withColumnRenamed("source", "collection_name"), _chunks(spark, sf_dir)
    return spark.createDataFrame([(c, D.has_rows(docs, chunks, c)) for c in ("questions", "nowhere")], "collection string, has_rows boolean")


@query("WITH e AS (SELECT unnest(['doc_id', 'text', 'title']) AS c), d AS (SELECT column_name AS c FROM (DESCRIBE documents)) SELECT c AS column, 'drop' AS change FROM d ANTI JOIN e USING (c) UNION ALL SELECT c, 'add' FROM e ANTI JOIN d USING (c)")
def schema_difference(spark, sf_dir):
    return schemas.difference(spark, _docs(spark, sf_dir).columns, ["doc_id", "text", "title"])


@query()
def merged_terms(spark, sf_dir):
    """F16 over the names of all parts; difflib's ratio has no SQL."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.max("p_type").alias("definition"), F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    return D.merge_similar(p)


_NEAREST = "SELECT query_id, vec_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {0} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {0} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10"


def _nearest(spark, sf_dir, metric):
    e = _embeddings(spark, sf_dir)
    return R.vector_search(e, e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10, metric, digits=5)


@query(_NEAREST.format("round(-list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5)"))
def vector_l2(spark, sf_dir):
    return _nearest(spark, sf_dir, "l2")


@query(_NEAREST.format("round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5)"))
def vector_inner(spark, sf_dir):
    return _nearest(spark, sf_dir, "inner")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: 3 * x)) / (3 * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS total FROM embeddings")
def unit_vectors(spark, sf_dir):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return _embeddings(spark, sf_dir).select("vec_id", F.round(F.aggregate(V.unit(tripled), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"SELECT a.label AS cluster, a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.label >= 0 AND b.vec_id <> a.vec_id + 1 AND b.vec_id <> a.vec_id + 3")
def same_cluster_similarity(spark, sf_dir):
    """A vector's next and next but two are its related ones."""
    e = _embeddings(spark, sf_dir).withColumn("related", F.array(F.col("vec_id") + 1, F.col("vec_id") + 3))
    return S.same_cluster_pairs(e, "vec_id", "label", "related", "embedding", digits=5)


# Graph beside.
def _merge_sql(how: str) -> str:
    return f"SELECT l_suppkey AS id, round({how}(round(1 - l_discount * 5, 4)), 4) AS weight FROM lineitem GROUP BY 1"


def _merge(spark, sf_dir, how):
    e = _edges(spark, sf_dir).select(F.substring("target_id", 2, 20).cast("long").alias("id"), "weight")
    return G.merge_expansions(e, how).withColumn("weight", F.round("weight", 4))


@query(_merge_sql("max"))
def expansion_merge_max(spark, sf_dir):
    return _merge(spark, sf_dir, "max")


@query(_merge_sql("avg"))
def expansion_merge_mean(spark, sf_dir):
    return _merge(spark, sf_dir, "mean")


@query(f"WITH {_NODES}, {_EDGES}, {_PASSES}, q AS (SELECT n_nationkey AS query_id, unnest([s1, s2, 'nothing']) AS term FROM (SELECT s_nationkey AS n_nationkey, min(s_name) AS s1, max(s_name) AS s2 FROM supplier GROUP BY 1)), k AS (SELECT DISTINCT query_id, seed FROM q JOIN (SELECT term, min(id) AS seed FROM nodes GROUP BY 1) USING (term)), s AS (SELECT DISTINCT seed FROM k), f1 AS (SELECT seed, dst AS id, max(p * 0.7::DOUBLE) AS w FROM s JOIN e ON src = seed WHERE dst <> seed GROUP BY ALL HAVING max(p * 0.7::DOUBLE) >= 0.3), n AS (SELECT seed FROM f1 GROUP BY 1 HAVING count(*) >= 19), f2 AS (SELECT seed, dst AS id, max(w * p * 0.7::DOUBLE * 0.7::DOUBLE) AS w FROM f1 JOIN e ON src = f1.id WHERE seed NOT IN (FROM n) GROUP BY ALL HAVING max(w * p * 0.7::DOUBLE * 0.7::DOUBLE) >= 0.3), a AS (SELECT seed, seed AS id, 1.0::DOUBLE AS w, 0 AS depth FROM s UNION ALL SELECT seed, id, w, 1 FROM f1 UNION ALL SELECT seed, id, w, 2 FROM f2 WHERE id <> seed AND NOT EXISTS (FROM f1 WHERE f1.seed = f2.seed AND f1.id = f2.id)), x AS (SELECT seed, id, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(w, 6) DESC, depth, id) AS r FROM a) WHERE r <= 20) SELECT query_id, id, round(max(weight), 6) AS weight FROM k JOIN x USING (seed) GROUP BY ALL")
def expansion_of_queries(spark, sf_dir):
    """The first and the last supplier of a nation, and a word that is no term."""
    asked = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("query_id")).agg(F.concat_ws(" ", F.min("s_name"), F.max("s_name"), F.lit("nothing")).alias("query"))
    return G.expand_queries(_edges(spark, sf_dir), _nodes(spark, sf_dir), asked)


@query(f"WITH {_NODES} SELECT t AS term, min(id) AS id FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'no ' || p_name END AS t FROM part WHERE p_partkey % 50 < 2) LEFT JOIN nodes ON term = t AND node_type = 'Term' GROUP BY 1")
def node_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "part").filter("p_partkey % 50 < 2").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("no "), "p_name")).alias("term"))
    return G.find_nodes(_nodes(spark, sf_dir), asked)


@query("SELECT l_suppkey AS id, least(sum(round(1 - l_discount * 5, 4)::DECIMAL(28, 12))::DOUBLE, 1.0) AS weight FROM lineitem GROUP BY 1 HAVING least(sum(round(1 - l_discount * 5, 4)::DECIMAL(28, 12))::DOUBLE, 1.0) >= 0.95")
def weighted_terms(spark, sf_dir):
    return G.weighted_terms(_merge(spark, sf_dir, "sum"), 0.95)


@query(f"WITH {_NODES}, {_EDGES}, f AS (SELECT * FROM edges WHERE coalesce(weight, 0) >= 0.9 AND edge_type IN ('SYNONYM', 'IS_A')) SELECT id, node_type, term FROM nodes WHERE id IN (SELECT source_id FROM f UNION SELECT target_id FROM f) AND node_type = 'Term' OR id = 'S1'")
def subgraph_nodes(spark, sf_dir):
    """the nodes that the filters leave, and the centre, which stays in any case."""
    return G.subgraph(_nodes(spark, sf_dir), _edges(spark, sf_dir), centre="S1", types=["SYNONYM", "IS_A"], least=0.9, node_type="Term")[0].select("id", "node_type", "term")


@query(f"""WITH {_NODES}, {_EDGES} SELECT '{{"data":{{"id":"' || id || '","label":"' || term || '","type":"' || node_type || '"}}}}' AS element FROM nodes UNION ALL SELECT '{{"data":{{"id":"' || source_id || '-' || target_id || '-' || edge_type || '","source":"' || source_id || '","target":"' || target_id || '","label":"' || edge_type || '","weight":' || weight || '}}}}' FROM edges""")
def graph_json(spark, sf_dir):
    return G.to_json(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query("SELECT p_name AS term, round(avg(p_retailprice) * (1 + CASE WHEN min(p_partkey) % 2 = 0 THEN min(p_size) / 64 ELSE 0 END), 6) AS score FROM part GROUP BY 1")
def revised_scores(spark, sf_dir):
    """Half of the terms are in the graph."""
    t = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.avg("p_retailprice").alias("score"), F.min("p_partkey").alias("k"), F.min("p_size").alias("s"))
    return G.revised(t.select("term", "score"), t.filter("k % 2 = 0").select("term", (F.col("s") / 64).alias("importance"))).select("term", "score")


@query(f"WITH {_EDGES}, s AS (SELECT source_id, target_id, edge_type, CASE WHEN edge_type = 'IS_A' THEN 'late' ELSE 'early' END AS side, weight, confidence, id FROM edges) SELECT source_id, target_id, edge_type, max(weight) AS weight, max(confidence) AS confidence, max(id) AS last, any_value(side) AS side FROM s WHERE source_id <> target_id GROUP BY ALL")
def edge_properties(spark, sf_dir):
    """S29 with properties."""
    e = _edges(spark, sf_dir)
    with_map = lambda df, side: df.withColumn("properties", F.create_map(F.lit("last"), F.col("id"), F.lit("side"), F.lit(side))).drop("id")
    merged = G.upsert_edges(with_map(e.filter("edge_type <> 'IS_A'"), "early"), with_map(e.filter("edge_type = 'IS_A'"), "late"))
    return merged.select("source_id", "target_id", "edge_type", "weight", "confidence", F.col("properties")["last"].alias("last"), F.col("properties")["side"].alias("side"))


_STEPS = 70
_TURNS = "".join(f", r{i} AS MATERIALIZED (SELECT h.id, 0.85::DOUBLE * coalesce(m.x, 0) + 0.15::DOUBLE * h.home AS rank FROM h LEFT JOIN (SELECT dst AS id, sum(rank * share) AS x FROM e JOIN r{i - 1} ON r{i - 1}.id = src GROUP BY 1) m USING (id)), c{i} AS (SELECT {i} AS i, sum(abs(a.rank - b.rank)) AS d FROM r{i} a JOIN r{i - 1} b USING (id))" for i in range(1, _STEPS + 1))


@query(f"WITH {_EDGES}, d AS (SELECT source_id AS src, target_id AS dst, weight + 0.01 AS weight FROM edges UNION ALL SELECT target_id, source_id, weight + 0.01 FROM edges), o AS (SELECT src, sum(weight) AS o FROM d GROUP BY 1), e AS MATERIALIZED (SELECT src, dst, sum(weight) / any_value(o) AS share FROM d JOIN o USING (src) GROUP BY ALL), h AS MATERIALIZED (SELECT DISTINCT src AS id, 1.0::DOUBLE / (SELECT count(DISTINCT src) FROM e) AS home FROM e), r0 AS (SELECT id, home AS rank FROM h){_TURNS}, c AS ({' UNION ALL '.join(f'FROM c{i}' for i in range(1, _STEPS + 1))}), stop AS (SELECT min(i) AS i FROM c WHERE d < (SELECT count(*) FROM h) * 1e-5) SELECT id, round(rank, 8) AS rank FROM ({' UNION ALL '.join(f'SELECT {i} AS i, id, rank FROM r{i}' for i in range(1, _STEPS + 1))}) JOIN stop USING (i)")
def pagerank_until_stable(spark, sf_dir):
    """G4 without seeds, until ranks change by less than 1e-5 a node in sum."""
    e = _edges(spark, sf_dir).withColumn("weight", F.col("weight") + 0.01)
    return G.pagerank(e, iterations=_STEPS, tolerance=1e-5).select("id", F.round("rank", 8).alias("rank"))
