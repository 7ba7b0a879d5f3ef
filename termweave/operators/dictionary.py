"""The term dictionary: collection_name, term, definition, domain, aliases, related_terms; and the chunk table's upkeep.

An upsert gives the whole new table; the caller writes it. Keys are collection_name and term, or chunk_id.
"""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_phrases
from ..storage import written
from .retrieval import top_k
from .segments import near_strings
from .similarity import string_ratio

KEY = ["collection_name", "term"]


def _both(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in old.columns if c not in key]
    a, b = (df.select(*key, F.struct(*rest).alias(n)) for df, n in ((old, "a"), (new, "b")))
    return a.join(b, key, "full")


def _merged(old: DataFrame, new: DataFrame, rules: dict[str, Column], key: list[str] = KEY) -> DataFrame:
    """Rows of one side stay; for rows of both, the rule of a column, else the new value."""
    rest = [c for c in old.columns if c not in key]
    pick = lambda c: F.when(F.col("b").isNull(), F.col(f"a.{c}")).when(F.col("a").isNull(), F.col(f"b.{c}")).otherwise(rules.get(c, F.col(f"b.{c}")))
    return _both(old, new, key).select(*key, *(pick(c).alias(c) for c in rest))


def upsert_keeping(old: DataFrame, new: DataFrame) -> DataFrame:
    """An old domain stays where the new one is null, old aliases where the new ones are empty."""
    return _merged(old, new, {"domain": F.coalesce("b.domain", "a.domain"), "aliases": F.when(F.size("b.aliases") > 0, F.col("b.aliases")).otherwise(F.col("a.aliases"))})


def upsert_replacing(old: DataFrame, new: DataFrame) -> DataFrame:
    """An old domain stays where the new one is null or empty; all else is new."""
    return _merged(old, new, {"domain": F.coalesce(F.nullif("b.domain", F.lit("")), "a.domain")})


def delete_counts(table: DataFrame, keys: DataFrame, on: list[str] = KEY) -> DataFrame:
    """One row: how many of the asked keys (distinct) are rows of the table, so go, and how many are not."""
    there = table.select(*on).distinct().withColumn("_there", F.lit(True))
    found = keys.select(*on).distinct().join(there, on, "left")
    return found.agg(F.count("_there").alias("deleted"), F.count_if(F.col("_there").isNull()).alias("errors"))


def delete(table: DataFrame, keys: DataFrame, on: list[str] = KEY) -> DataFrame:
    """The table without the rows of these keys."""
    return table.join(keys.select(*on), on, "left_anti")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key, the last written."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*key, "r.*")


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks by chunk_id; those of new replace old ones whole."""
    return _merged(old, new, {}, ["chunk_id"])


def deleted(chunks: DataFrame, **where: str) -> tuple[DataFrame, DataFrame]:
    """(the table without the rows that have these values, how many documents and chunks go). No value fits null."""
    hit = F.lit(True)
    for column, value in where.items():
        hit = hit & F.col(column).eqNullSafe(F.lit(value))
    return chunks.filter(~hit), chunks.filter(hit).agg(F.countDistinct("document_id").alias("n_documents"), F.count("*").alias("n_chunks"))


def collection_name(name: str) -> str:
    """The name, if it is one that a new collection may have; else a ValueError."""
    if not re.fullmatch("[a-zA-Z0-9_]+", name):
        raise ValueError(f"not a name of letters, digits and underscores: {name!r}")
    return name


def has_rows(vectors: DataFrame, chunks: DataFrame, collection: str | None = None) -> bool:
    """whether either table has a row (of a collection); one row is looked for, not all counted."""
    of = lambda df: df if collection is None else df.filter(F.col("collection_name") == collection)
    return not of(vectors).isEmpty() or not of(chunks).isEmpty()


def all_terms(table: DataFrame, collection: str) -> DataFrame:
    """The terms of a collection, in order."""
    return table.filter(F.col("collection_name") == collection).orderBy("term")


def collections(chunks: DataFrame) -> DataFrame:
    """S17."""
    return chunks.select("collection_name").distinct()


def document_texts(chunks: DataFrame) -> DataFrame:
    """The chunks of each document in order, with an empty line between; order: ordinal, then text. Null texts go."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return chunks.filter("text is not null").groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def described(table: DataFrame) -> DataFrame:
    """Terms with a definition, as "term: definition"."""
    return table.filter("definition is not null and definition <> ''").select("collection_name", "term", F.concat_ws(": ", "term", "definition").alias("described"))


def reverse_index(table: DataFrame) -> DataFrame:
    """Key, term for each alias and each key phrase of a definition, in lower case. Rows, not lists: one key may have many terms."""
    keys = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce(key_phrases(F.col("definition")), F.array().cast("array<string>")))
    return table.select(F.explode(keys).alias("key"), "term").select(F.lower(F.trim("key")).alias("key"), "term").filter("key <> ''").distinct()


def relevant_chunks(chunks: DataFrame, terms: list[str], most: int = 3) -> DataFrame:
    """the first chunks (by document, then ordinal) that hold each of the asked terms; terms are a short list."""
    asked = F.array(*map(F.lit, dict.fromkeys(terms))) if terms else F.array().cast("array<string>")
    hits = chunks.withColumn("term", F.explode(F.filter(asked, lambda t: F.contains("text", t))))
    return top_k(hits, most, ["term"], "document_id", "ordinal").select("term", "rank", "document_id", "ordinal")


def load_with_categories(terms: DataFrame, categories: DataFrame) -> DataFrame:
    """Terms with a definition and their category, null for the unclassified."""
    c = categories.select("term", F.when(F.col("category") != "unclassified", F.col("category")).alias("category")).groupBy("term").agg(F.min("category").alias("domain"))
    return terms.filter("definition is not null and definition <> ''").join(c, "term", "left")


def label_clusters(terms: DataFrame, clusters: DataFrame, names: DataFrame) -> DataFrame:
    """The domain of clustered terms: the cluster's name, unclassified for noise; other terms keep theirs."""
    named = clusters.join(names, "cluster", "left").select("term", F.when(F.col("cluster") < 0, "unclassified").otherwise(F.coalesce("name", F.concat(F.lit("cluster "), "cluster"))).alias("_d"))
    return terms.join(named, "term", "left").withColumn("domain", F.coalesce("_d", "domain")).drop("_d")


def search(table: DataFrame, keyword: str) -> DataFrame:
    """Rows with the keyword in term, definition or an alias, in any case; % and _ are plain characters."""
    k = keyword.lower()
    hit = lambda c: F.contains(F.lower(c), F.lit(k))
    return table.filter(F.coalesce(hit("term"), F.lit(False)) | F.coalesce(hit("definition"), F.lit(False)) | F.coalesce(F.exists("aliases", hit), F.lit(False)))


def lookup(table: DataFrame, terms: DataFrame) -> DataFrame:
    """rows whose term is one of those asked for, in any case."""
    asked = terms.select(F.lower("term").alias("_k")).distinct()
    return table.join(asked, F.lower(table["term"]) == F.col("_k"), "left_semi")


def statistics(table: DataFrame) -> DataFrame:
    """A4: counts for each collection; the mean number of aliases is of terms that have some."""
    n = F.size("aliases")
    return table.groupBy("collection_name").agg(F.count("*").alias("n_terms"), F.count("domain").alias("n_domain"), F.count_if(n > 0).alias("n_with_aliases"), F.round(F.avg(F.when(n > 0, n)), 6).alias("avg_aliases"))


def totals(table: DataFrame) -> DataFrame:
    """A28."""
    return table.agg(F.count("*").alias("n_terms"), F.sum(F.greatest(F.size("aliases"), F.lit(0))).cast("long").alias("n_aliases"))


def category_counts(table: DataFrame) -> DataFrame:
    """A27."""
    return table.groupBy("domain").agg(F.count("*").alias("n"))


def merge_similar(terms: DataFrame, least: float = 0.8) -> DataFrame:
    """Terms in their order, each of which becomes part of the kept one that it is most like (M5 above `least`; of
    equals the first), or is kept. term, definition, aliases: a kept term has the aliases and the names of those that
    became part of it, sorted, without its own name, and the longest definition, of equals the first.

    Rows of one term are one: all aliases, the longest definition. Null and empty terms go. Two terms are compared where
    a piece of one stands in the other near its place. Who is kept is settled in rounds, all terms at a
    time that no open one before them can still take in."""
    empty = F.array().cast("array<string>")
    rows = terms.filter("term <> ''").select("term", "definition", F.coalesce("aliases", empty).alias("aliases"))
    rows = written(rows.groupBy("term").agg(F.max_by("definition", F.struct(F.length(F.coalesce("definition", F.lit(""))), "definition")).alias("definition"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases")), "terms")
    near = near_strings(rows, least).select(F.col("b").alias("term"), F.col("a").alias("by"))
    near = written(near.withColumn("ratio", string_ratio("term", "by")).filter(F.col("ratio") > least), "alike")
    kept = fresh = written(rows.select("term").join(near, "term", "left_anti"), "kept")
    open_ = near.select("term", "by")
    while not open_.isEmpty():
        gone = written(open_.join(fresh.withColumnRenamed("term", "by"), "by", "left_semi").select("term").distinct(), "gone")
        left = open_.join(gone, "term", "left_anti").join(gone.withColumnRenamed("term", "by"), "by", "left_anti")
        # With no one before them left, terms that were open are kept.
        free = open_.select("term").distinct().join(gone, "term", "left_anti").join(left, "term", "left_anti")
        fresh = written(free, "kept")
        kept, open_ = kept.unionByName(fresh), written(left, "open")
    into = near.join(kept.withColumnRenamed("term", "by"), "by", "left_semi").join(kept, "term", "left_anti").groupBy("term").agg(F.min_by("by", F.struct(-F.col("ratio"), "by")).alias("by"))
    placed = rows.join(into, "term", "left").select(F.coalesce("by", "term").alias("head"), "term", "definition", "aliases")
    first = F.min_by("definition", F.struct(-F.length(F.coalesce("definition", F.lit(""))), "term"))
    names = F.array_distinct(F.flatten(F.collect_list(F.array_append("aliases", F.col("term")))))
    merged = placed.groupBy("head").agg(first.alias("definition"), names.alias("aliases"))
    return merged.select(F.col("head").alias("term"), "definition", F.array_sort(F.filter("aliases", lambda a: (a != "") & (a != F.col("head")))).alias("aliases"))


def collection_statistics(chunks: DataFrame) -> DataFrame:
    """A1, A2: chunks, and when the last was made, for each document of each collection."""
    return chunks.groupBy("collection_name", "document_id").agg(F.count("*").alias("n_chunks"), F.max("created_at").alias("last_at"))


def numbered(chunks: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Ordinal of each chunk of a document, from 0."""
    return chunks.withColumn("ordinal", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))
