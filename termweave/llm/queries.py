"""The registered queries of this subpackage and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, compression, decontamination, license_scan, ngram_join, packing, pii, quality_classifier, quality_rules, substring_dedup, toxicity, url_filter, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    names = lambda c, f: F.transform(c, lambda x: x[f])
    text = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    cover = F.coalesce(F.array_max(names("spans", "cover")), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(names("places", "first")).alias("first_word"), F.array_max(names("places", "first")).alias("last_word"),
        text(names("places", "label")).alias("base_labels"), text(F.concat(names("places", "label"), names("spans", "label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(cover).alias("score"),
        F.size("spans").cast("long").alias("n_spans"), F.array_min(names("spans", "first")).alias("span_first"), F.array_max(names("spans", "last")).alias("span_last"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    df = url_filter.judge(pages, labels=url_filter.by_title(pages))
    return df.withColumn("mined", F.array_join("mined", " "))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 20), ' ') AS x FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(20) AS g(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def _remainder(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def _judged(df: DataFrame, held_out) -> DataFrame:
    return df.withColumns({"held_out": F.coalesce(held_out, F.lit(False)), "predicted": (F.col("score") >= 0.3).cast("int")})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.train(docs, labels, _remainder(4) != 2)
    return _judged(toxicity.score(docs, weights), _remainder(4) == 2).select("doc_id", "held_out", "score", "predicted")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, _remainder(5) != 0)
    return _judged(quality_classifier.score(docs, model), _remainder(5) == 0).select("doc_id", "held_out", "score", "predicted", "difference")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP9 = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select(*OP9)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)"""

def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.recode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compression.compress(table(spark, sf_dir, "embeddings"))
    rows = compression.with_label_error(found.rows)
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(compression.digest(found.codebooks)).alias("codebooks_sha256"))


def _op12_round(n: int, last: bool) -> str:
    """The assignment a{n} by codebooks b{n}, and what replaces these."""
    distance = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assigned = f"""
a{n} AS MATERIALIZED (SELECT vec_id, label, p, v, arg_min(e, 64 * d + e) AS e, min(d) AS d FROM (
  SELECT p.*, b.e, {distance} AS d FROM p JOIN b{n} b ON p.p = b.p) GROUP BY vec_id, label, p, v),"""
    replaced = f"""
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM b{n} b LEFT JOIN (
  SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS v FROM (
    SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY p, e, i) GROUP BY p, e) u ON b.p = u.p AND b.e = u.e),"""
    return assigned + ("" if last else replaced)


#: Vectors cut into parts p; codebooks b0 to b2 have a row for each part and entry.
OP12_SQL = f"""
WITH x AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, p, list_slice(x, p * (len(x) // 16) + 1, (p + 1) * (len(x) // 16)) AS v FROM x, range(16) AS g(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < 64),
{"".join(_op12_round(n, n == 2) for n in range(3))}
codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM codes"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))



QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_join": op10_ngram_join,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op4_decontamination": decontamination.sql(),
    "op10_ngram_join": OP10_SQL,
    "op12_vector_codes": OP12_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op9_quality_rules": f"SELECT {', '.join(OP9)} FROM ({quality_rules.sql()})",
}
