"""Whole jobs: texts to a searchable store, questions to ranked chunks, texts to scored terms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..functions import text as T
from ..operators import chunking, graph, retrieval, similarity, terms


def ingest(docs: DataFrame, collection: str, doc_id: str = "doc_id", text: str = "text", embed=providers.hashed_vectors) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, their postings and their vectors."""
    chunks = chunking.chunk_markdown(docs, doc_id, text).withColumn("collection_name", F.lit(collection))
    index = retrieval.postings(chunks, T.tokens(F.lower("content")), "chunk_id")
    vectors = providers.apply(chunks.select("chunk_id", "content"), "content", "embedding", embed, "array<float>").select("chunk_id", "embedding")
    return chunks, index, vectors


def search(index: DataFrame, vectors: DataFrame, questions: DataFrame, keyword_k: int = 3, vector_k: int = 3, final_k: int = 5, embed=providers.hashed_vectors) -> DataFrame:
    """query_id, chunk_id, rrf, fused_rank for all questions (query_id, query) at once."""
    words = questions.select("query_id", F.explode(F.array_distinct(T.tokens(F.lower("query")))).alias("token"))
    keyword = retrieval.keyword_search(index, words, keyword_k, key="chunk_id").select("query_id", F.lit(1).alias("list_id"), "chunk_id", "rank")
    asked = providers.apply(questions, "query", "embedding", embed, "array<float>")
    numbered = vectors.withColumn("n", F.xxhash64("chunk_id"))
    near = retrieval.vector_search(numbered, asked, vector_k, key="n").join(numbered.select("n", "chunk_id"), "n")
    vector = near.select("query_id", F.lit(0).alias("list_id"), "chunk_id", "rank")
    return retrieval.reciprocal_rank_fusion(vector.unionByName(keyword), final_k=final_k, key="chunk_id")


def mine(docs: DataFrame, low: int = 2, high: int = 6, least: int = 2, most: int = 1500, embed=providers.hashed_vectors) -> DataFrame:
    """term and score: candidates, TF-IDF and C-value, nested terms, the best `most`, re-ranked on the graph of similar terms.

    docs: doc_id, text. The cut comes before the only step that compares terms with each other, and is the operator's own."""
    strict = F.transform(T.sentences(F.lower("text"), strict=True), T.tokens)
    found = terms.written(terms.mined(docs, strict, low, high, least).filter(T.is_valid_term(F.col("term"))), "mined")
    pairs = terms.written(terms.containment(found.select("term")), "mined-pairs")
    c = terms.cvalue(found, terms.independent_ratio(docs.select(F.lower("text").alias("text")), found, pairs=pairs), pairs=pairs)
    kept = terms.nested_filter(c, pairs=pairs)
    loose = F.transform(T.sentences(F.lower("text")), T.tokens)
    scores = terms.combined_score(found.join(terms.tfidf(docs, loose, found), "term").join(kept, "term"))
    top = terms.written(terms.best(scores, most), "mined-top")
    vectors = providers.apply(top.select("term"), "term", "embedding", embed, "array<float>")
    return enhanced(top, terms.written(vectors, "mined-vectors"), terms.seeds(top).select("term"))


def enhanced(scores: DataFrame, vectors: DataFrame, seeds: DataFrame, least: float = 0.5, share: float = 0.15, alpha: float = 0.85) -> DataFrame:
    """Scores (term, score) revised by rank on the graph of similar terms, which begins at the seeds (term). vectors: term, embedding. The
    base scores come back where fewer than two terms have a vector, where no two of them are similar, and where there is no seed. Terms
    are told apart by a 64-bit hash of theirs."""
    known = vectors.filter("embedding is not null").join(scores.select("term"), "term", "left_semi").withColumn("vec_id", F.xxhash64("term"))
    if known.limit(2).count() < 2 or seeds.isEmpty():
        return scores
    edges = terms.written(similarity.semantic_graph(known, least, share), "enhanced-edges")
    if edges.isEmpty():
        return scores
    at = seeds.select(F.xxhash64("term").alias("id"))
    ranks = graph.pagerank(edges.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("similarity").alias("weight")), at, alpha)
    importance = scores.select("term", F.xxhash64("term").alias("id")).join(ranks, "id").select("term", F.col("rank").alias("importance"))
    return graph.revised(scores, importance)
