"""The term graph: nodes (id, node_type, term, definition, properties), edges (source_id, target_id, edge_type, weight, confidence)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import written

#: What an edge type passes on of a term's weight; any other type passes 0.2.
RELATION_WEIGHTS = {"SYNONYM": 0.95, "IS_A": 0.8, "PART_OF": 0.7, "SIMILAR_TO": 0.6, "BELONGS_TO": 0.5, "RELATED_TO": 0.4, "CO_OCCURS_WITH": 0.3}
OTHER_RELATION, DECAY = 0.2, 0.7
#: Edges of one node that a row holds, about.
EDGES_A_ROW = 10_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end, as src and dst."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    return edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), *rest).unionByName(edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), *rest))


def bfs(edges: DataFrame, centres: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """Id and least depth of all nodes that up to `depth` edges of either direction reach. centres has id.

    One round for each level; a round's frontier is what was not reached before, and is written, so lineage stays short."""
    e = both_ways(edges if types is None else edges.filter(F.col("edge_type").isin(types))).select("src", "dst").distinct()
    seen = written(centres.select("id", F.lit(0).alias("depth")).distinct(), "bfs")
    frontier = seen
    for level in range(1, depth + 1):
        new = frontier.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id")).distinct()
        frontier = written(new.join(seen, "id", "left_anti").select("id", F.lit(level).alias("depth")), "bfs")
        seen = seen.unionByName(frontier)
    return seen


def expand(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 2, least: float = 0.3, most: int = 20) -> DataFrame:
    """Seed, id, weight, depth of terms round the seeds (column id), at most `most` for each seed, of which the seed
    itself (weight 1, depth 0) is one.

    weight = parent's * relation * edge weight * confidence * 0.7 ** depth. A node is visited once, at its first level,
    by the edge that gives most. A seed with enough terms after a level goes no deeper."""
    relation = F.coalesce(*(F.when(F.col("edge_type") == t, F.lit(w)) for t, w in RELATION_WEIGHTS.items()), F.lit(OTHER_RELATION))
    terms = nodes.filter("node_type = 'Term'").select(F.col("id").alias("dst"))
    e = both_ways(edges).withColumn("passes", relation * F.col("weight") * F.col("confidence")).groupBy("src", "dst").agg(F.max("passes").alias("passes")).join(terms, "dst", "left_semi")
    frontier = written(seeds.select(F.col("id").alias("seed"), "id", F.lit(1.0).alias("weight"), F.lit(0).alias("depth")).distinct(), "expand")
    seen = frontier
    for level in range(1, depth + 1):
        enough = seen.groupBy("seed").count().filter(F.col("count") >= most).select("seed")
        new = frontier.join(enough, "seed", "left_anti").withColumnRenamed("id", "src").join(e, "src")
        new = new.groupBy("seed", F.col("dst").alias("id")).agg(F.max(F.col("weight") * F.col("passes") * DECAY**level).alias("weight")).filter(F.col("weight") >= least)
        frontier = written(new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(level)), "expand")
        seen = seen.unionByName(frontier)
    from .retrieval import top_k

    return top_k(seen.withColumn("weight", F.round("weight", 6)), most, ["seed"], F.desc("weight"), "depth", "id").select("seed", "id", "weight", "depth")


def expand_queries(edges: DataFrame, nodes: DataFrame, queries: DataFrame, how: str = "max", **limits) -> DataFrame:
    """query_id, id, weight: the expansions of all words between blanks of each query that are terms (of several nodes with
    one term, the least id), merged by A25. queries: query_id, query."""
    words = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).distinct()
    named = nodes.groupBy("term").agg(F.min("id").alias("seed"))
    asked = words.join(named, "term").select("query_id", "seed")
    found = expand(edges, nodes, asked.select(F.col("seed").alias("id")), **limits)
    return merge_expansions(asked.join(found, "seed"), how, ["query_id"])


def merge_expansions(expanded: DataFrame, how: str = "max", by: list[str] | None = None) -> DataFrame:
    """One weight for each id over all seeds (of each group): max, mean, or sum up to 1."""
    merged = {"max": F.max("weight"), "mean": F.avg("weight"), "sum": F.least(F.sum("weight"), F.lit(1.0))}[how]
    return expanded.groupBy(*(by or []), "id").agg(F.round(merged, 6).alias("weight"))


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """Id and rank of personalised PageRank over undirected weighted edges (source_id, target_id, weight).

    Rank starts at and returns to the seeds (column id), evenly; to all nodes if none of them is in the graph. Every node
    has an edge here, so no rank is lost. Stops when ranks change by less than n * tolerance in sum, or after `iterations`.
    Each tenth round is written. A row holds edges of one node, so a round meets ranks with as many rows as there are nodes (more
    for a node of very many edges) and sorts no edges: each task holds its part of the ranks, one row a node, as a hash table."""
    e = both_ways(edges.select("source_id", "target_id", "weight")).filter("src is not null")
    nodes = written(e.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out"), F.ceil(F.count("*") / EDGES_A_ROW).alias("rows")), "pagerank-nodes")
    # Hashes stand for ids where no two nodes share one.
    n, hashes = nodes.agg(F.count("*"), F.countDistinct(F.xxhash64("id"))).first()
    key = (lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))) if hashes == n else F.col
    e = e.select(key("src").alias("src"), key("dst").alias("dst"), "weight").join(nodes.select(key("id").alias("src"), "out", "rows").hint("shuffle_hash"), "src")
    e = e.groupBy("src", "dst").agg((F.sum("weight") / F.first("out")).alias("share"), F.first("rows").alias("rows"))
    e = e.groupBy("src", F.pmod(F.xxhash64("dst"), "rows").alias("row")).agg(F.collect_list(F.struct("dst", "share")).alias("edges"))
    e = written(e.select("src", "edges"), "pagerank-edges")
    marked = nodes.select("id", F.lit(1.0).alias("seed")) if seeds is None else nodes.select("id").join(seeds.select("id").distinct().withColumn("seed", F.lit(1.0)), "id", "left")
    marked = written(marked, "pagerank-seeds")
    hits = marked.agg(F.count("seed")).first()[0]
    start = F.coalesce("seed", F.lit(0.0)) / hits if hits else F.lit(1.0 / max(1, n))
    base = written(marked.select("id", key("id").alias("key"), start.alias("home")), "pagerank-home")
    ranks = base.select("id", "key", F.col("home").alias("rank"))
    for i in range(1, iterations + 1):
        moved = e.join(ranks.select(F.col("key").alias("src"), "rank").hint("shuffle_hash"), "src").select("rank", F.inline("edges"))
        moved = moved.groupBy(F.col("dst").alias("key")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        new = base.join(moved.hint("shuffle_hash"), "key", "left").select("id", "key", (alpha * F.coalesce("in", F.lit(0.0)) + (1 - alpha) * F.col("home")).alias("rank"))
        if tolerance is not None or i % 10 == 0:
            new = written(new, "pagerank")
        if tolerance is not None and (new.join(ranks.select("key", F.col("rank").alias("old")), "key").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0) < n * tolerance:
            return new.drop("key")
        ranks = new
    return ranks.drop("key")


def revised(scores: DataFrame, importance: DataFrame) -> DataFrame:
    """Score * (1 + importance), 0 for terms outside the graph."""
    return scores.join(importance, "term", "left").withColumn("score", F.round(F.col("score") * (1 + F.coalesce("importance", F.lit(0.0))), 6)).drop("importance")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """No self loops; of equal (source, target, type), the greatest weight and confidence; where both tables have properties
    (a map), those of both, the new value where a name is in both."""
    key = ["source_id", "target_id", "edge_type"]
    greatest = [F.max("weight").alias("weight"), F.max("confidence").alias("confidence")]
    both = old.unionByName(new, allowMissingColumns=True).filter("source_id <> target_id").groupBy(*key).agg(*greatest)
    if "properties" not in old.columns or "properties" not in new.columns:
        return both
    sides = old.select(*key, "properties", F.lit(0).alias("side")).unionByName(new.select(*key, "properties", F.lit(1).alias("side")))
    named = sides.select(*key, "side", F.explode("properties")).groupBy(*key, "key").agg(F.max_by("value", F.struct("side", "value")).alias("value"))
    merged = named.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    return both.join(merged, key, "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Terms are unique; a new definition fills a missing one, new properties win over old ones. Nodes of other types add up."""
    a, b = old.filter("node_type = 'Term'").alias("a"), new.filter("node_type = 'Term'").alias("b")
    empty = F.create_map().cast("map<string,string>")
    keep = F.map_filter(F.coalesce("a.properties", empty), lambda k, v: ~F.map_contains_key(F.coalesce("b.properties", empty), k))
    merged = a.join(b, F.col("a.term") == F.col("b.term"), "full").select(F.coalesce("a.id", "b.id").alias("id"), F.lit("Term").alias("node_type"), F.coalesce("a.term", "b.term").alias("term"), F.coalesce("b.definition", "a.definition").alias("definition"), F.map_concat(keep, F.coalesce("b.properties", empty)).alias("properties"))
    rest = old.unionByName(new).filter("node_type <> 'Term'").select("id", "node_type", "term", "definition", "properties")
    return merged.unionByName(rest)


def top_edges(edges: DataFrame, n: int = 200) -> DataFrame:
    """Heaviest first, missing weights last."""
    return edges.orderBy(F.desc_nulls_last("weight"), "id").limit(n)


def subgraph(nodes: DataFrame, edges: DataFrame, centre: str | None = None, types: list[str] | None = None, least: float = 0.0, node_type: str | None = None, include: str | None = None, exclude: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after filters on edges, then on nodes. A node without an edge left goes, the centre
    stays; that is judged on the edges before nodes are filtered. Edges between nodes that stay are kept."""
    e = edges.filter(F.coalesce("weight", F.lit(0.0)) >= least)
    e = e if types is None else e.filter(F.col("edge_type").isin(types))
    ends = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct()
    v = nodes.join(ends, "id", "left_semi")
    if centre is not None:
        v = v.unionByName(nodes.filter(F.col("id") == centre).join(ends, "id", "left_anti"))
    keep = F.lit(True)
    if node_type is not None:
        keep = keep & (F.col("node_type") == node_type)
    if include:
        keep = keep & F.contains(F.lower("term"), F.lit(include.lower()))
    if exclude:
        keep = keep & ~F.contains(F.lower("term"), F.lit(exclude.lower()))
    v = v.filter(F.coalesce(keep, F.lit(False)) | (F.col("id") == (centre if centre is not None else "")))
    ids = v.select("id")
    closed = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return v, closed


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A3: one row; each side is one aggregate. Means are of exact sums (12 decimals), so no order of rows changes them."""
    mean = lambda c: F.try_divide(F.sum(F.col(c).cast("decimal(28,12)")).cast("double"), F.count(c)).alias(f"avg_{c}")
    v = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("node_type").alias("node_types"), F.count_if(F.col("node_type") == "Term").alias("terms"))
    e = edges.agg(F.count("*").alias("edges"), F.countDistinct("edge_type").alias("edge_types"), mean("weight"), mean("confidence"))
    return v.crossJoin(e)


def listing(nodes: DataFrame) -> DataFrame:
    """Names of the terms."""
    return nodes.filter("node_type = 'Term'").select("id", "term")


def weighted_terms(expanded: DataFrame, least: float = 0.0) -> DataFrame:
    """Of expanded terms, those of at least this weight."""
    return expanded.filter(F.col("weight") >= least)


def find_nodes(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """Term and id for the asked terms, null where the graph lacks one; of several nodes, the least id."""
    known = nodes.filter("node_type = 'Term'").groupBy("term").agg(F.min("id").alias("id"))
    return terms.select("term").distinct().join(known, "term", "left")


def relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between terms, by name."""
    t = nodes.filter("node_type = 'Term'").select("id", "term")
    return edges.join(t.select(F.col("id").alias("source_id"), F.col("term").alias("source_term")), "source_id").join(t.select(F.col("id").alias("target_id"), F.col("term").alias("target_term")), "target_id").select("source_term", "target_term", "edge_type", "weight", "confidence")


def from_terms(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a table term, definition, synonyms (array), category: a node for each term, synonym
    and category (none for the unclassified), with ids from their content."""
    ident = lambda kind, c: F.sha2(F.concat_ws("#", F.lit(kind), c), 256)
    own = terms.select("term", "definition", F.lit(0).alias("o"))
    pairs = terms.select("term", F.explode("synonyms").alias("synonym")).filter("synonym <> '' and synonym <> term")
    named = own.unionByName(pairs.select(F.col("synonym").alias("term"), F.lit(None).cast("string").alias("definition"), F.lit(1).alias("o"))).groupBy("term").agg(F.min_by("definition", "o").alias("definition"))
    nodes = named.select(ident("Term", F.col("term")).alias("id"), F.lit("Term").alias("node_type"), "term", "definition")
    of = terms.filter("category is not null and category not in ('', 'unclassified')")
    nodes = nodes.unionByName(of.select("category").distinct().select(ident("Category", F.col("category")).alias("id"), F.lit("Category").alias("node_type"), F.col("category").alias("term"), F.lit(None).cast("string").alias("definition")))
    edge = lambda df, a, b, kind, w: df.select(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(w).alias("weight"), F.lit(1.0).alias("confidence"))
    edges = edge(pairs.distinct(), ident("Term", F.col("term")), ident("Term", F.col("synonym")), "SYNONYM", 0.95)
    return nodes, edges.unionByName(edge(of, ident("Term", F.col("term")), ident("Category", F.col("category")), "BELONGS_TO", 1.0))


def to_dot(edges: DataFrame) -> DataFrame:
    """A line of DOT for each edge, solid above a weight of 0.7."""
    style = F.when(F.col("weight") > 0.7, "solid").otherwise("dashed")
    return edges.select(F.format_string('"%s" -> "%s" [label="%s", style=%s];', "source_id", "target_id", "edge_type", style).alias("line"))


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An element of a graph file for each node and edge."""
    v = nodes.select(F.to_json(F.struct(F.struct("id", F.col("term").alias("label"), F.col("node_type").alias("type")).alias("data"))).alias("element"))
    e = edges.select(F.to_json(F.struct(F.struct(F.concat_ws("-", "source_id", "target_id", "edge_type").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("edge_type").alias("label"), "weight").alias("data"))).alias("element"))
    return v.unionByName(e)
