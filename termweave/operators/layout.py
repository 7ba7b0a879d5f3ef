"""G7's reduction: neighbour graph with fuzzy weights, and a layout of few dimensions that keeps neighbours together.

Vectors are compared by cosine; zero vectors and null ones have no place. Equal directions are one point. Each point sees its
nearest as close as can be and widens its view until its neighbours weigh log2(k) together; both views of a pair unite. The
layout starts from principal components and moves points by sampled gradients: along edges together, from sampled
points apart. Points lie in parts; a task moves those of its own part for some epochs while the others stand still, then all meet
again, written to the shared folder. Numbers are drawn from fixed seeds.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm, unit
from ..storage import written
from .density import BLOCK, Cells, distinct_points, neighbours, ranked

#: Neighbours of a point, itself counted; closeness in the layout; dimensions.
NEIGHBOURS, MIN_DISTANCE, DIMENSIONS = 15, 0.1, 10
#: Points of a part; rounds, and epochs of each; points that push, for each edge drawn and in all.
PART, ROUNDS, EPOCHS, PUSHES, SAMPLE = 20_000, 20, 10, 5, 2_000
#: Shares of the mean distance below which a view isn't narrowed.
NARROWEST = 1e-3
SEED = 42


def view(distances: np.ndarray, k: int) -> tuple[float, float]:
    """rho, the nearest distance above 0, and sigma, at which the weights of ascending distances to the others sum to log2(k)."""
    near = distances[distances > 0]
    rho = float(near[0]) if len(near) else 0.0
    beyond, target = np.maximum(distances - rho, 0), np.log2(k)
    low, high, mid = 0.0, np.inf, 1.0
    for _ in range(64):
        total = np.exp(-beyond / mid).sum()
        if abs(total - target) < 1e-5:
            break
        if total > target:
            high = mid
            mid = (low + high) / 2
        else:
            low = mid
            mid = mid * 2 if high == np.inf else (low + high) / 2
    # The point itself, at distance 0, counts in the mean.
    return rho, max(mid, NARROWEST * float(distances.sum()) / (len(distances) + 1))


def fuzzy_graph(near: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """a < b and weight of points that are neighbours. near: point, near (array of distance and other, the nearest first), k - 1 of them."""

    def weigh(batches):
        for batch in batches:
            out = ([], [], [])
            for point, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d = np.array([x["distance"] for x in found])
                rho, sigma = view(d, k)
                out[0].extend([point] * len(d))
                out[1].extend(x["other"] for x in found)
                out[2].extend(np.exp(-np.maximum(d - rho, 0) / sigma).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["point", "other", "w"])

    one = near.select("point", "near").mapInArrow(weigh, "point bigint, other bigint, w double")
    # Both views of a pair: w + v - w v; a view that is missing is 0.
    each = one.groupBy(F.least("point", "other").alias("a"), F.greatest("point", "other").alias("b")).agg(F.sum("w").alias("s"), F.when(F.count("*") == 2, F.product("w")).otherwise(0.0).alias("p"))
    return each.select("a", "b", (F.col("s") - F.col("p")).alias("weight")).filter("weight > 0")


def curve(min_distance: float = MIN_DISTANCE, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a x^2b) is nearest to 1 up to min_distance and exp(-(x - min_distance) / spread) beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_distance, 1.0, np.exp(-(x - min_distance) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(200):
        power = x ** (2 * p[1])
        f = 1 / (1 + p[0] * power)
        j = np.stack([-(f**2) * power, -(f**2) * p[0] * power * 2 * np.log(x)], 1)
        step = np.linalg.solve(j.T @ j + 1e-9 * np.eye(2), j.T @ (want - f))
        p = np.maximum(p + step, 1e-3)
        if np.abs(step).max() < 1e-12:
            break
    return float(p[0]), float(p[1])


def moved(y: np.ndarray, heads: np.ndarray, tails: np.ndarray, others: np.ndarray, chance: np.ndarray, crowd: np.ndarray, a: float, b: float, rate: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """y after an epoch for each rate: each edge is drawn by its chance; a point goes by the mean of what its drawn edges and as many
    pushes from the crowd say. tails: rows of y, or, below 0, rows -1, -2, ... of others."""
    y = y.copy()
    for step in rate:
        drawn = np.flatnonzero(draw.random(len(heads)) < chance)
        h, t = heads[drawn], tails[drawn]
        to = np.where((t >= 0)[:, None], y[np.maximum(t, 0)], others[np.maximum(-t - 1, 0)] if len(others) else 0.0)
        diff = y[h] - to
        d2 = (diff**2).sum(1)[:, None]
        power = np.maximum(d2, 1e-12) ** b
        pull = np.where(d2 > 0, -2 * a * b * power / np.maximum(d2, 1e-12) / (1 + a * power), 0) * diff
        force = np.clip(pull, -4, 4)
        for _ in range(PUSHES):
            diff = y[h] - crowd[draw.integers(0, len(crowd), len(h))]
            d2 = (diff**2).sum(1)[:, None]
            force += np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * diff, -4, 4) * (d2 > 0)
        total, n = np.zeros_like(y), np.bincount(h, minlength=len(y))
        np.add.at(total, h, force)
        y += step * total / np.maximum(n, 1)[:, None]
    return y


def _round(k: int, crowd: np.ndarray, rate: np.ndarray, a: float, b: float):
    """The function that moves the points of one part."""

    def move(key, edges: pa.Table, own: pa.Table) -> pa.Table:
        own, edges = own.sort_by("point"), edges.sort_by([("a", "ascending"), ("b", "ascending")])
        points, y = own["point"].to_numpy(), np.array(own["y"].to_pylist(), np.float64)
        heads, ends = np.searchsorted(points, edges["a"].to_numpy()), edges["b"].to_numpy()
        tails = np.where(np.isin(ends, points), np.searchsorted(points, ends), -1 - np.arange(len(ends)))
        others = np.array(edges["far"].to_pylist(), np.float64).reshape(len(ends), y.shape[1])
        y = moved(y, heads, tails, others, edges["chance"].to_numpy(), crowd, a, b, rate, np.random.default_rng([SEED, k, key[0].as_py()]))
        return pa.table({"point": own["point"], "y": pa.array(y.tolist(), pa.list_(pa.float64()))})

    return move


def laid_out(start: DataFrame, graph: DataFrame, rounds: int = ROUNDS, epochs: int = EPOCHS, part: int = PART, min_distance: float = MIN_DISTANCE) -> DataFrame:
    """point and y. start: point and y; graph: a, b, weight. A round is a step of every part; the crowd is SAMPLE points drawn anew."""
    parts, top = max(1, -(-start.count() // part)), graph.agg(F.max("weight")).first()[0] or 1.0
    part_of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = written(both.withColumns({"part": part_of("a"), "chance": F.col("weight") / F.lit(top)}).drop("weight"), "layout-edges")
    a, b = curve(min_distance)
    now = written(start.select("point", "y"), "layout")
    for k in range(rounds):
        crowd = np.array([r.y for r in now.orderBy(F.xxhash64("point", F.lit(k)), "point").limit(SAMPLE).select("y").collect()])
        rate = 1 - (k * epochs + np.arange(epochs)) / (rounds * epochs)

        ends = both.join(now.select(F.col("point").alias("b"), F.col("y").alias("far")), "b")
        placed = now.withColumn("part", part_of("point"))
        now = written(ends.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(_round(k, crowd, rate, a, b), "point bigint, y array<double>"), "layout")
    return now


def reduced(vectors: DataFrame, dimensions: int = DIMENSIONS, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, **how) -> DataFrame:
    """key and y: min(dimensions, points - 1), two at least, coordinates of each vector that has a direction."""
    keyed = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    keyed = keyed.filter(norm(F.col("v")) > 0).withColumn("v", unit(F.col("v")))
    keyed = written(ranked(keyed, ["key", "v"], "place"), "directions")
    points = written(distinct_points(keyed, "v"), "points")
    n = points.count()
    size = max(2, min(dimensions, n - 1))
    if n < 3:
        return keyed.select(F.col("key").alias(key), F.array(*[(F.col("place") if i == 0 else F.lit(0)).cast("double") for i in range(size)]).alias("y"))
    cells = Cells(points, block)
    others = min(k, n) - 1
    # Of unit vectors half the squared distance is 1 - cosine.
    near = neighbours(cells, others).withColumn("near", F.transform("near", lambda x: F.struct((x["distance"] * x["distance"] / 2).alias("distance"), x["other"].alias("other"))))
    graph = written(fuzzy_graph(written(near, "near"), others + 1), "fuzzy")
    wide = points.select("point", array_to_vector("v").alias("v"))
    model = PCA(k=min(size, len(points.first().v)), inputCol="v", outputCol="p").fit(wide)
    start = model.transform(wide).select("point", vector_to_array("p").alias("p"))
    largest = start.agg(F.max(F.array_max(F.transform("p", F.abs)))).first()[0] or 1.0
    noise = lambda i: F.pmod(F.xxhash64("point", F.lit(i), F.lit(SEED)), F.lit(10_007)) / 10_007 * 1e-4
    start = start.select("point", F.array(*[F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)) * (10 / largest) + noise(i) for i in range(size)]).alias("y"))
    y = laid_out(start, graph, **how)
    return keyed.join(points.select("v", "point"), "v").join(y, "point").select(F.col("key").alias(key), "y")


def term_clusters(vectors: DataFrame, least: int = 3, key: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """G7 as a whole: key and cluster of vectors that were reduced first, with the clusters' fixed parameters: two members, one
    neighbour for the core, leaves, epsilon 0.3. Below `least` vectors, as without a direction, all is noise."""
    from .density import density_clusters

    y = written(reduced(vectors, key=key, vector=vector, **how), "reduced")
    if y.limit(least).count() < least:
        return vectors.select(key, F.lit(-1).cast("long").alias("cluster"))
    found = density_clusters(y, key=key, vector="y")
    return vectors.select(key).join(found, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
