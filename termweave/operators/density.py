"""Density clusters of vectors: spanning tree of mutual reachability, merges, condensed tree, leaves.

Vectors have places 0..n-1 in the order of their keys; merges are nodes n..2n-2 in the order of their weights, so the root is
2n-2. Everything between steps is a table of the shared folder. Equal vectors are one point with copies: a third of all rows
may be the same. What the driver holds is bounded by CELLS and by the number of partitions.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Points that are compared with as many others at a time; cells at most, whose centres and radii go to all tasks; and tiles of such blocks
#: at most, one for each task: a vector is copied for each tile that it asks.
BLOCK, CELLS, TILES = 4096, 1024, 16
#: Distances that a task holds at a time.
HELD = 1 << 21
#: Neighbours that are kept of each point.
NEIGHBOURS = 10
#: Edges of a spanning tree that one task merges.
EDGES = 500_000
#: Shares of a distance by which a product of matrices may be wrong; what is that near is computed again term by term.
NEAR = 1e-6


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with `name`: 0, 1, ... in an order without ties. Sorted by ranges; only the number of rows of each partition is collected."""
    t = written(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    sizes = {r[0]: (r[1], r[2]) for r in t.groupBy("_part").agg(F.count("*"), F.min("_at")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total - sizes[part][1], total + sizes[part][0]
    first = t.sparkSession.createDataFrame(list(starts.items()), "_part int, _first bigint")
    return t.join(F.broadcast(first), "_part").withColumn(name, F.col("_at") + F.col("_first")).drop("_part", "_at", "_first")


def _array(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, term by term: the same for (x, y) and (y, x)."""
    d = np.ascontiguousarray(x - y)
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _about(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, by one product of matrices."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0))


def distinct_points(vectors: DataFrame, vector: str) -> DataFrame:
    """point, v, copies: one row for each different vector, the least place being the point. vectors: place and the vector."""
    whole = F.transform(F.col(vector), lambda x: x.cast("double") + 0.0)  # -0.0 is 0.0
    return vectors.filter(F.col(vector).isNotNull()).groupBy(whole.alias("v")).agg(F.min("place").alias("point"), F.count("*").alias("copies")).select("point", "v", "copies")


class Cells:
    """Points in the cell of the nearest of some centres, a cell in parts of about BLOCK points, and parts in tiles."""

    def __init__(self, points: DataFrame, block: int = BLOCK, cells: int = CELLS):
        n = points.count()
        rows = points.orderBy(F.xxhash64("point", F.lit("centre")), "point").limit(max(1, min(cells, -(-n // block)))).select("v").collect()
        self.centres = centres = np.array([r.v for r in rows], np.float64) if rows else np.zeros((1, 1))
        kind = "point bigint, v array<double>, copies bigint, cell int, far double"

        def place(batches):
            for b in batches:
                d = _about(_array(b.column(1)), centres) if b.num_rows else np.zeros((0, 1))
                cell = d.argmin(1)
                far = pa.array(d[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), far], ["point", "v", "copies", "cell", "far"])

        placed = written(points.mapInArrow(place, kind), "cells")
        found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each cell
        self.radius = np.full(len(centres), -np.inf)
        self.parts = np.ones(len(centres), np.int64)
        for r in found:
            self.radius[r.cell], self.parts[r.cell] = r.far * (1 + NEAR) + NEAR, -(-r.n // block)
        parts = F.get(F.array(*(F.lit(int(x)) for x in self.parts)), F.col("cell"))
        units = np.cumsum(self.parts) - self.parts
        self.size = max(1, -(-int(self.parts.sum()) // TILES))
        self.first, self.last = units // self.size, (units + self.parts - 1) // self.size  # the tiles of a cell
        self.tile = F.floor((F.get(F.array(*(F.lit(int(x)) for x in units)), F.col("cell")) + F.col("part")) / self.size).cast("int")
        self.points, self.block = placed.drop("far").withColumn("part", F.pmod(F.xxhash64("point"), parts).cast("int")), block

    def meet(self, queries: DataFrame, points: DataFrame, work, schema: str, own: bool | None = None, whole: np.ndarray | None = None) -> DataFrame:
        """What `work` gives for the (queries, points) of each tile: every query with every cell's points that may hold one as near as its bound.

        queries: point, v, cell, core, bound, component; points besides: part. own: its own cell alone, or all but that; whole: for each
        cell the component of all its points, -1 where there are several. A tile that many ask is copied for each as many of them."""
        centres, radius, first, last = self.centres, self.radius, self.first, self.last
        names = ["point", "v", "cell", "core", "bound", "component"]
        tiles = np.arange(last[-1] + 1)
        holds = ((first[:, None] <= tiles) & (last[:, None] >= tiles)).astype(np.float32)

        def asking(x, cell, core, bound, component, to: np.ndarray) -> np.ndarray:
            """Which of the cells `to` each query asks."""
            if own:
                return cell[:, None] == to
            low = np.maximum(_about(x, centres[to]) - radius[to], core[:, None])
            ask = (low <= bound[:, None] * (1 + NEAR) + NEAR) & np.isfinite(radius[to])
            if own is not None:
                ask &= cell[:, None] != to
            if whole is not None:
                ask &= whole[to] != component[:, None]
            return ask

        def about(t) -> list:
            return [_array(t.column(1)), *(t.column(i).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(i).to_numpy() for i in (2, 3, 4, 5))]

        def route(batches):
            for b in batches:
                if b.num_rows:
                    row, to = np.nonzero(asking(*about(b), np.arange(len(radius))).astype(np.float32) @ holds)
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(to, pa.int32())], [*names, "tile"])

        asked = written(queries.select(*names).mapInArrow(route, "point bigint, v array<double>, cell int, core double, bound double, component bigint, tile int"), "asked")
        chunks = np.ones(len(tiles), np.int64)
        for r in asked.groupBy("tile").count().collect():  # a row for each tile
            chunks[r.tile] = -(-r["count"] // (self.block * self.size))
        of = F.get(F.array(*(F.lit(int(x)) for x in chunks)), F.col("tile"))
        left = asked.withColumn("chunk", F.pmod(F.xxhash64("point"), of).cast("int"))
        right = points.withColumn("tile", self.tile).select("point", "v", "core", "component", "copies", "cell", "tile")
        right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), of.cast("int") - 1)))

        def met(q: pa.Table, p: pa.Table) -> pa.Table:
            def blocks():
                if q.num_rows and p.num_rows:
                    home = p["cell"].to_numpy()
                    order = np.argsort(home, kind="stable")
                    some, at = np.unique(home[order], return_index=True)
                    ask = asking(*about(q), some)
                    for i, (a, b) in enumerate(zip(at, np.append(at[1:], len(home)))):
                        if ask[:, i].any():
                            yield q.filter(pa.array(ask[:, i])), p.take(pa.array(order[a:b]))

            return work(blocks())

        return left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInArrow(met, schema)


_NEAREST = "point bigint, other bigint, distance double, copies bigint"


def _squares(x: np.ndarray, y: np.ndarray):
    """Squared distances as one product of matrices (a function of a slice of x), and by how much they may be wrong."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    most = max(xx.max(initial=0), yy.max(initial=0))
    single = 1e-20 < most < 1e30 and x.shape[1] <= 1024
    kind, one = (np.float32, 1e-5) if single else (np.float64, NEAR)
    left = np.concatenate([x, xx[:, None], np.ones((len(x), 1))], axis=1).astype(kind)
    right = np.concatenate([-2 * y, np.ones((len(y), 1)), yy[:, None]], axis=1).astype(kind).T.copy()
    return (lambda s: left[s] @ right), 4 * one * most


def _nearest(k: int):
    """The k nearest others of each query in a tile, by distance and place."""

    def first(rows: np.ndarray, they: np.ndarray, distance: np.ndarray, copies: np.ndarray) -> tuple:
        order = np.lexsort((they, distance, rows))
        rows = rows[order]
        order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
        return rows[np.arange(len(rows)) - np.searchsorted(rows, rows) < k], they[order], distance[order], copies[order]

    def work(blocks) -> pa.Table:
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))
        for q, p in blocks:
            x, y, me, they, copies, bound = _array(q["v"]), _array(p["v"]), *(t[c].to_numpy() for t, c in ((q, "point"), (p, "point"), (p, "copies"), (q, "bound")))
            # The k-th of those found before bounds what is looked for.
            some, at, n = np.unique(best[0], return_index=True, return_counts=True)
            full = np.flatnonzero(n == k)
            where = np.searchsorted(some[full], me)
            if len(full):
                hit = np.minimum(where, len(full) - 1)
                bound = np.where(some[full][hit] == me, np.minimum(bound, best[2][at[full] + k - 1][hit]), bound)
            squares, slack = _squares(x, y)
            found = [best]
            step = max(1, HELD // len(y))
            for a in range(0, len(x), step):
                d = squares(slice(a, a + step))
                b = bound[a : a + step]
                far = (b * b) * (1 + NEAR) + slack
                if d.shape[1] > k + 1 and not np.isfinite(far).all():  # one of k + 1 may be the query itself
                    far = np.minimum(far, np.partition(d, k, axis=1)[:, k].astype(np.float64) + 2 * slack)
                i, j = np.divmod(np.flatnonzero(d <= np.minimum(far, np.finfo(d.dtype).max)[:, None].astype(d.dtype)), d.shape[1])
                other = me[a + i] != they[j]
                i, j = i[other], j[other]
                found.append(first(me[a + i], they[j], _apart(x[a + i], y[j]), copies[j]))
            best = first(*(np.concatenate(c) for c in zip(*found)))
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("point", "other", "distance", "copies"), best, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))})

    return work


def _best(found: DataFrame, k: int) -> DataFrame:
    """point, near: the k nearest as an array of structs (distance, other, copies), the nearest first."""
    row = F.row_number().over(Window.partitionBy("point").orderBy("distance", "other"))
    return found.withColumn("r", row).filter(F.col("r") <= k).groupBy("point").agg(F.array_sort(F.collect_list(F.struct("distance", "other", "copies"))).alias("near"))


def neighbours(cells: Cells, k: int = NEIGHBOURS) -> DataFrame:
    """point, near: its k nearest other points, exact. The own cell bounds how far the others are asked."""
    p = cells.points.withColumns({"core": F.lit(0.0), "component": F.lit(-1).cast("long"), "bound": F.lit(float("inf"))})
    mine = written(cells.meet(p, p, _nearest(k), _NEAREST, own=True), "own-cell")
    bound = _best(mine, k).select("point", F.when(F.size("near") == k, F.get("near", F.lit(k - 1))["distance"]).alias("b"))
    asked = p.join(bound, "point", "left").withColumn("bound", F.coalesce("b", "bound"))
    return _best(mine.unionByName(cells.meet(asked, p, _nearest(k), _NEAREST, own=False)), k)


def cores(cells: Cells, near: DataFrame, samples: int) -> DataFrame:
    """cells.points with core, the distance to the samples-th other vector, copies counted; near; and beyond, a distance
    below which no other point is missing from near."""
    count = F.aggregate(F.col("near"), F.struct((F.col("copies") - 1).alias("n"), F.lit(0.0).alias("d")), lambda s, x: F.struct((s["n"] + x["copies"]).alias("n"), F.when(s["n"] >= samples, s["d"]).otherwise(x["distance"]).alias("d")))
    p = cells.points.join(near, "point", "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<distance:double,other:bigint,copies:bigint>>")))
    return p.withColumns({"core": F.when(F.col("copies") > samples, 0.0).otherwise(count["d"]), "beyond": F.try_element_at("near", F.lit(-1))["distance"]})


_EDGE = "component bigint, weight double, a bigint, b bigint, other bigint"


def _leaving(blocks) -> pa.Table:
    """For each component among the queries its least edge (weight, a, b) to a point of another one in the tile."""
    best: dict[int, tuple] = {}
    for q, p in blocks:
        x, y = _array(q["v"]), _array(p["v"])
        me, they, cx, cy, kx, ky, bound = (t[n].to_numpy() for t, n in ((q, "point"), (p, "point"), (q, "component"), (p, "component"), (q, "core"), (p, "core"), (q, "bound")))
        step = max(1, HELD // len(y))
        for at in range(0, len(x), step):
            s = slice(at, at + step)
            w = np.maximum(np.maximum(_about(x[s], y), kx[s, None]), ky[None])
            w[cx[s, None] == cy[None]] = np.inf
            groups, group = np.unique(cx[s], return_inverse=True)
            least = np.full(len(groups), np.inf)
            np.minimum.at(least, group, np.minimum(w.min(1), bound[s]))
            size = 1 + np.abs(x[s]).max(initial=0) + np.abs(y).max(initial=0)
            i, j = np.nonzero((w <= least[group][:, None] + NEAR * size) & np.isfinite(w))
            exact = np.maximum(np.maximum(_apart(x[at + i], y[j]), kx[at + i]), ky[j])
            a, b = np.minimum(me[at + i], they[j]), np.maximum(me[at + i], they[j])
            order = np.lexsort((b, a, exact, group[i]))
            for o in order[np.unique(group[i][order], return_index=True)[1]]:
                c, edge = int(groups[group[i[o]]]), (float(exact[o]), int(a[o]), int(b[o]), int(cy[j[o]]))
                best[c] = min(best.get(c, edge), edge)
    rows = [(c, *e) for c, e in best.items()]
    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("component", "weight", "a", "b", "other"), kinds))})


def _roots(links: DataFrame) -> DataFrame:
    """component, root: links lead from each component to another (component, other), and of two that lead to each other the smaller
    is the root. Each round looks twice as far."""
    back = links.select(F.col("component").alias("other"), F.col("other").alias("again"))
    top = (F.col("again") == F.col("component")) & (F.col("component") < F.col("other"))
    now = written(links.join(back, "other").select("component", F.when(top, F.col("component")).otherwise(F.col("other")).alias("root")), "roots")
    while True:
        far = now.select(F.col("component").alias("root"), F.col("root").alias("next"))
        step = written(now.join(far, "root").select("component", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def spanning_tree(vectors: DataFrame, samples: int = 1, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, k: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """Two tables: place, key; and the edges a < b (places) and weight of the least spanning tree, where two vectors are as far as
    the largest of their distance and both core distances. Rows with a null vector have no place.

    Boruvka's rounds: each component takes its least edge to another, of equal ones that of the least places. A point's known
    neighbours answer for it where they are nearer than what isn't among them; the others ask the cells within their component's best."""
    keyed = ranked(vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v")), ["key", "v"], "place")
    keyed = written(keyed, "places")
    points = distinct_points(keyed, "v")
    cells = Cells(written(points, "points"), block)
    p = written(cores(cells, neighbours(cells, max(k, samples)), samples), "cores")
    labels = written(p.select("point", F.col("point").alias("component")), "components")
    parts = []
    while labels.select("component").distinct().limit(2).count() > 1:
        now = written(p.join(labels, "point"), "round")
        theirs = now.select(F.col("point").alias("other"), F.col("component").alias("to"), F.col("core").alias("far"))
        near = now.select("point", "component", "core", F.explode("near").alias("n")).select("point", "component", "core", "n.distance", "n.other").join(theirs, "other").filter("component <> to")
        edge = F.struct(F.greatest("distance", "core", "far").alias("weight"), F.least("point", "other").alias("a"), F.greatest("point", "other").alias("b"), F.col("to").alias("other"))
        known = written(near.groupBy("component").agg(F.min(edge).alias("e")), "known")
        asked = now.join(known.select("component", F.col("e.weight").alias("best")), "component", "left").withColumn("bound", F.coalesce("best", F.lit(float("inf"))))
        asked = asked.filter(F.greatest(F.coalesce("beyond", F.lit(0.0)), "core") <= F.col("bound") * (1 + NEAR) + NEAR)
        whole = np.full(len(cells.radius), -1)
        for r in now.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).collect():  # a row for each cell
            whole[r.cell] = r.lo if r.lo == r.hi else -1
        found = cells.meet(asked, now, _leaving, _EDGE, whole=whole).select("component", F.struct("weight", "a", "b", "other").alias("e"))
        chosen = written(known.unionByName(found).groupBy("component").agg(F.min("e").alias("e")).select("component", "e.*"), "chosen")
        parts.append(chosen.select("a", "b", "weight").distinct())
        roots = _roots(chosen.select("component", "other"))
        labels = written(labels.join(roots, "component").select("point", F.col("root").alias("component")), "components")
    # Copies hang on their point, as far as its core distance.
    whole = F.transform(F.col("v"), lambda x: x.cast("double") + 0.0)
    copies = keyed.select("place", whole.alias("v")).join(p.filter("copies > 1").select("v", "point", "core"), "v").filter("place <> point")
    edges = copies.select(F.col("point").alias("a"), F.col("place").alias("b"), F.col("core").alias("weight"))
    for part in parts:
        edges = edges.unionByName(part)
    return keyed.select("place", "key"), written(edges, "spanning-tree")


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id that links reach) of all ids of links (src, dst): the least label of the neighbours,
    then that label's own, so paths halve in each round."""
    both = written(links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "links")
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.min(F.least("src", "dst")).alias("component")), "labels")
    while True:
        near = labels.join(both.withColumnRenamed("dst", "id"), "id").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = written(step.join(up, "component").select("id", F.col("root").alias("component"), (F.col("root") != F.col("old")).alias("moved")), "labels")
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            return labels


_MERGE = "node bigint, left bigint, right bigint, left_size bigint, right_size bigint, weight double"


def _merge(e: pd.DataFrame) -> pd.DataFrame:
    """Union of some edges in their order; u and v are nodes with sizes."""
    e = e.sort_values("node")
    ends, at = np.unique(np.concatenate([e.u, e.v]), return_inverse=True)
    sizes = np.zeros(len(ends), np.int64)
    sizes[at] = np.concatenate([e.u_size, e.v_size])
    up, top, size, out = list(range(len(ends))), ends.tolist(), sizes.tolist(), np.empty((len(e), 4), np.int64)

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, (node, u, v) in enumerate(zip(e.node, at[: len(e)], at[len(e) :])):
        x, y = find(int(u)), find(int(v))
        out[i] = top[x], top[y], size[x], size[y]
        if size[x] < size[y]:
            x, y = y, x
        up[y], size[x], top[x] = x, size[x] + size[y], node
    return pd.DataFrame({"node": e.node.to_numpy(), **dict(zip(("left", "right", "left_size", "right_size"), out.T)), "weight": e.weight.to_numpy()})


def merges(edges: DataFrame, n: int, most: int = EDGES) -> DataFrame:
    """node, left, right, their sizes and weight: what the edges (a, b, weight) of a spanning tree of n places join, in order of weight.

    Trees of more than `most` edges are cut: their lighter half falls into trees of its own, which the heavier half sees as one node
    each, so every tree halves in a round and each goes to one task in the end."""
    edge = ranked(edges, ["weight", "a", "b"], "node").select((F.col("node") + n).alias("node"), "weight", F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).cast("long").alias("u_size"), F.lit(1).cast("long").alias("v_size"), F.lit(-1).cast("long").alias("tree"))
    rest, ready = written(edge, "tree-edges"), []
    while True:
        sizes = rest.groupBy("tree").agg(F.count("*").alias("size"), F.percentile_approx("node", 0.5, 10_000).alias("middle"))
        sized = written(rest.join(sizes, "tree"), "tree-edges")
        ready.append(sized.filter(F.col("size") <= most).drop("size", "middle"))
        large = sized.filter(F.col("size") > most)
        if large.isEmpty():
            break
        light, heavy = large.filter("node <= middle").drop("size", "middle"), large.filter("node > middle").drop("size", "middle")
        label = components(light.select(F.col("u").alias("src"), F.col("v").alias("dst")))
        light = light.join(label.withColumnRenamed("id", "u"), "u")
        ends = light.select("component", F.col("u").alias("id"), F.col("u_size").alias("s")).unionByName(light.select("component", F.col("v").alias("id"), F.col("v_size").alias("s"))).distinct()
        top = light.groupBy("component").agg(F.max("node").alias("top")).join(ends.groupBy("component").agg(F.sum("s").alias("top_size")), "component")
        top = written(top, "tops")
        inside = light.join(top.select("component", "top"), "component").drop("tree", "component").withColumnRenamed("top", "tree")
        within = label.join(top, "component").select("id", "top", "top_size")
        for c in ("u", "v"):
            heavy = heavy.join(within.withColumnRenamed("id", c), c, "left").withColumns({c: F.coalesce("top", c), f"{c}_size": F.coalesce("top_size", f"{c}_size")}).drop("top", "top_size")
        rest = inside.unionByName(heavy.select(inside.columns))
    all_edges = ready[0]
    for r in ready[1:]:
        all_edges = all_edges.unionByName(r)
    return all_edges.groupBy("tree").applyInPandas(_merge, _MERGE)


def _climbed(up: DataFrame) -> DataFrame:
    """id, up, stop with `up` the first of the chain id -> up -> ... that is a stop; ids that stop are their own. Each round looks twice as far."""
    now = written(up.select("id", F.when(F.col("stop"), F.col("id")).otherwise(F.col("up")).alias("up")), "climb")
    while True:
        far = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        step = written(now.join(far, "up").select("id", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "climb")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def condensed(merged: DataFrame, smallest: int = 2) -> DataFrame:
    """Parent, child, lambda (1 / weight), size: clusters that split off in two of at least `smallest`, and the places that fall out
    of a cluster on the way. Clusters are named by their topmost node; the root has no row as a child."""
    m = written(merged.withColumn("size", F.col("left_size") + F.col("right_size")), "merges")
    lam = F.when(F.col("weight") > 0, 1 / F.col("weight")).otherwise(F.lit(float("inf")))
    child = lambda c: m.select(F.col(c).alias("id"), F.col(f"{c}_size").alias("id_size"), F.col("node").alias("up"), F.col("size").alias("up_size"), lam.alias("lambda"), (F.least("left_size", "right_size") >= smallest).alias("split"))
    links = written(child("left").unionByName(child("right")), "tree-links")
    root = m.agg(F.max("node").alias("id")).select("id", F.col("id").alias("up"), F.lit(True).alias("stop"))
    # The cluster of a large node is the nearest node above, itself included, that a split has made.
    head = _climbed(links.filter(F.col("id_size") >= smallest).select("id", "up", F.col("split").alias("stop")).unionByName(root)).select(F.col("id").alias("up"), F.col("up").alias("parent"))
    clusters = links.filter("split").join(head, "up").select("parent", F.col("id").alias("child"), "lambda", F.col("id_size").alias("size"))
    # A place falls out where it first is in a node that is large enough.
    small = links.filter(F.col("id_size") < smallest)
    first = _climbed(small.select("id", "up", F.lit(False).alias("stop")).unionByName(m.filter(F.col("size") >= smallest).select(F.col("node").alias("id"), F.col("node").alias("up"), F.lit(True).alias("stop"))))
    places = links.filter("id_size = 1").select("id").join(first, "id").join(m.select(F.col("node").alias("up"), lam.alias("lambda")), "up").join(head, "up")
    return clusters.unionByName(places.select("parent", F.col("id").alias("child"), "lambda", F.lit(1).cast("long").alias("size")))


def stability(tree: DataFrame) -> DataFrame:
    """cluster and the sum, over what leaves it, of size times how much larger lambda is there than where the cluster began."""
    birth = tree.filter("size > 1").select(F.col("child").alias("parent"), F.col("lambda").alias("birth"))
    return tree.join(birth, "parent", "left").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.col("size") * (F.col("lambda") - F.coalesce("birth", F.lit(0.0)))).alias("stability"))


def leaf_labels(tree: DataFrame, epsilon: float = 0.3, single: bool = True) -> DataFrame:
    """place, node: the chosen cluster of each place, -1 for noise. Chosen are the leaves of the condensed tree; a leaf born below epsilon gives
    way to the first cluster above it born beyond epsilon, or, with single, to the root (without, to the root's child). Where the root alone is
    chosen, places that leave it beyond epsilon (at epsilon 0: before the last) are noise."""
    tree = written(tree, "condensed")
    c = tree.filter("size > 1").select(F.col("child").alias("id"), F.col("parent").alias("up"), (F.lit(1.0) / F.col("lambda")).alias("eps"))
    root = tree.select(F.col("parent").alias("id")).subtract(c.select("id")).withColumn("up", F.col("id"))
    root = written(root, "root")
    under = F.lit(False) if single else F.col("top").isNotNull()
    stops = c.join(root.select(F.col("id").alias("up"), F.lit(1).alias("top")), "up", "left").select("id", "up", (under | (F.col("eps") > epsilon)).alias("stop")).unionByName(root.withColumn("stop", F.lit(True)))
    target = _climbed(stops).select(F.col("id").alias("up"), F.col("up").alias("chosen"))
    leaves = written(c.join(c.select(F.col("up").alias("id")).distinct(), "id", "left_anti"), "leaves")
    near = leaves.filter(F.col("eps") < epsilon)
    above = near.join(target, "up").select(F.col("chosen").alias("id"))
    if not single:  # a leaf right below the root stays
        above = near.join(root.select(F.col("id").alias("up")), "up", "left_semi").select("id").unionByName(above.join(root, "id", "left_anti"))
    chosen = leaves.filter(F.col("eps") >= epsilon).select("id").unionByName(above).distinct()
    chosen = written(chosen if not leaves.isEmpty() else root.select("id"), "chosen")
    alone = chosen.limit(2).count() == 1
    near_root = 1 / epsilon if epsilon else tree.join(root.select(F.col("id").alias("parent")), "parent", "left_semi").agg(F.max("lambda")).first()[0] or 0.0
    isolated = F.col("top").isNotNull() & (F.lit(not alone) | (F.col("lambda") < near_root))
    marked = F.broadcast(chosen.withColumn("mine", F.lit(True))) if chosen.count() <= 100_000 else chosen.withColumn("mine", F.lit(True))
    all_clusters = c.select("id", "up").unionByName(root.select("id", "up")).join(marked, "id", "left").join(root.select("id", F.lit(1).alias("top")), "id", "left")
    home = _climbed(all_clusters.select("id", "up", (F.col("mine").isNotNull() | F.col("top").isNotNull()).alias("stop")))
    home = home.select(F.col("id").alias("parent"), F.col("up").alias("node")).join(all_clusters.select(F.col("id").alias("node"), "mine", "top"), "node")
    placed = tree.filter("size = 1").join(home, "parent")
    return placed.select(F.col("child").alias("place"), F.when(F.col("mine").isNull() | isolated, F.lit(-1)).otherwise(F.col("node")).alias("node"))


def density_clusters(vectors: DataFrame, smallest: int = 2, samples: int = 1, epsilon: float = 0.3, single: bool = True, key: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """Key and cluster, the least key of its members; -1 for noise. A single vector is noise."""
    places, edges = spanning_tree(vectors, samples, key, vector, **how)
    tree = condensed(merges(edges, places.count()), smallest)
    labels = written(leaf_labels(tree, epsilon, single).join(places, "place"), "labels")
    names = labels.filter("node >= 0").groupBy("node").agg(F.min("key").alias("cluster"))
    found = labels.join(names, "node", "left").select("place", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return places.join(found, "place", "left").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
