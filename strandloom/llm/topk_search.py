"""Exact top-k inner-product search by dual-tree traversal of cover trees.

* Rows are routed to the nearest of some centres, which are picked farthest-first from a bounded sample, so that what lies
  together is searched together; a region with many rows is dealt into blocks of a fixed size. Every block, of queries or
  of data, becomes one cover tree: a node covers its points within its radius, its children's centres lie more than half
  that radius apart and cover its points within it, however many children that takes. A node of few points, or one whose
  children would hold hardly more than themselves, is a leaf.
* A pair of nodes can score at most <q, c> + |q| R + |c| r + r R. The roots of all blocks (centre and radius, no tree) are
  paired first. Each query block searches the data block with the largest bound; afterwards a pair of blocks is searched
  only if its bound reaches the worst k-th score of the query block so far. Trees of queries travel to the data blocks that
  they still need in bounded groups, and a data tree travels once for each group.
* Within a pair of trees both are descended together, the most promising data nodes first, and a pair of nodes is pruned
  once its bound is below the worst k-th score of the query group.

The queries are a stated set; pairing the roots of their blocks with those of all data blocks is the search itself, not a
join of all rows. The sample only decides what lies in which block: radii come from all rows, so the result is exact.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; queries see vectors
of their own dimension only; each query row has its own list, of all rows but itself (another row of its id is a
candidate like any other); ties go to the smaller id; null ids take no part; fewer than k candidates give all of them;
empty tables give an empty result. Scores must fit a 64-bit integer, else the search raises OverflowError.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

DATA_LEAF, QUERY_LEAF = 192, 64
SAMPLE = 4096  # rows from which centres are picked, a quarter of them at most
TOGETHER = 32  # query blocks that travel to a data block at a time
ROOTS = 256  # roots of data blocks that are paired in one group
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, of each row of a to each of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def cover(points: np.ndarray, first: int, reach: float, batch: int = 256) -> tuple[list[int], np.ndarray]:
    """Places of centres, `first` one of them, more than `reach` apart, that cover all points within it; each point's nearest."""
    limit = reach * reach
    centres, to = [first], np.zeros(len(points), np.int64)
    nearest = _squares(points, points[[first]])[:, 0]
    left = np.flatnonzero(nearest > limit)
    while len(left):
        some = left[:batch]
        apart, free, new = _squares(points[some], points[some]) > limit, np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                new.append(i)
                free &= apart[i]
        d = _squares(points, points[some[new]])
        best = d.argmin(axis=1)
        d = d[np.arange(len(points)), best]
        closer = d < nearest
        nearest[closer], to[closer] = d[closer], best[closer] + len(centres)
        own = some[new]
        nearest[own], to[own] = 0.0, np.arange(len(new)) + len(centres)
        centres += own.tolist()
        left = np.flatnonzero(nearest > limit)
    return centres, to


class Tree:
    """A cover tree over the rows of `points`, which are reordered so that each node has a slice of them, and its children follow each other."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray, leaf: int = QUERY_LEAF):
        leaf = max(8, min(leaf, len(ids) // 16))  # few rows still make groups
        order, floats = np.arange(len(ids)), points.astype(np.float64)
        middle = int(np.argmin(((floats - floats.mean(axis=0)) ** 2).sum(axis=1)))
        nodes = [[0, len(ids), middle, 0.0, 0, 0]]  # slice, centre's place in the old order, radius, first child, children
        at = 0
        while at < len(nodes):
            a, b, centre, *_ = nodes[at]
            own = order[a:b].copy()
            radius = float(np.sqrt(((floats[own] - floats[centre]) ** 2).sum(axis=1).max())) * (1 + 1e-9)
            nodes[at][3] = radius
            if b - a > leaf and radius > 0:
                centres, to = cover(floats[own], int(np.flatnonzero(own == centre)[0]), radius / 2)
                if 4 * len(centres) <= b - a:
                    sort = np.argsort(to, kind="stable")
                    order[a:b] = own[sort]
                    ends = a + np.cumsum(np.bincount(to, minlength=len(centres)))
                    nodes[at][4:] = [len(nodes), len(centres)]
                    nodes += [[low, high, int(own[c]), 0.0, 0, 0] for low, high, c in zip([a, *ends[:-1].tolist()], ends.tolist(), centres, strict=True)]
            at += 1
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        columns = list(zip(*nodes, strict=True))
        self.low, self.high, centre, self.first, self.kids = (np.array(columns[k], np.int64) for k in (0, 1, 2, 4, 5))
        self.radius, self.centre = np.array(columns[3]), place[centre]
        self.ids, self.rows = ids[order], rows[order]
        small = next((t for t in (np.int16, np.int32) if np.abs(points).max(initial=0) <= np.iinfo(t).max), np.int64)
        self.points = points[order].astype(small)

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of all these nodes."""
        n = self.kids[nodes]
        return np.repeat(self.first[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """Where the points of these nodes are."""
        n = self.high[nodes] - self.low[nodes]
        return np.repeat(self.low[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _products(q: np.ndarray, c: np.ndarray, exact_floats: bool) -> np.ndarray:
    if exact_floats:
        return (q @ c.T).astype(np.int64)
    return np.array([[int(x) for x in row] for row in q.astype(object) @ c.T.astype(object)], dtype=np.int64).reshape(len(q), len(c))


class Search:
    """One tree of queries against one of data. `floor`: a score for each query that k rows elsewhere reach, if known."""

    def __init__(self, queries: Tree, data: Tree, k: int, floor: np.ndarray | None = None):
        self.queries, self.data, self.k = queries, data, k
        most = lambda x: int(np.abs(x.points.astype(np.int64)).max(initial=0))
        self.exact = most(queries) * most(data) * queries.points.shape[1] < 1 << 52
        self.q, self.c = (x.points.astype(np.float64 if self.exact else np.int64) for x in (queries, data))
        self.q_centre, self.c_centre = (x.points[x.centre].astype(np.float64) for x in (queries, data))
        self.q_norm, self.c_norm = (np.sqrt((x**2).sum(axis=1)) for x in (self.q_centre, self.c_centre))
        n = len(queries.ids)
        self.scores, self.ids = np.full((n, k), _NONE), np.full((n, k), _LAST)
        self.floor = np.full(n, _NONE) if floor is None else floor
        self.worst = np.full(len(queries.low), _NONE)  # of each query node: its queries' worst k-th score
        if len(data.ids):
            self.visit(0, np.zeros(1, np.int64), _NONE)

    def bounds(self, u: int, nodes: np.ndarray) -> np.ndarray:
        r, s, q, c = self.queries.radius[u], self.data.radius[nodes], self.q_norm[u], self.c_norm[nodes]
        slack = q * s + c * r + r * s
        return self.c_centre[nodes] @ self.q_centre[u] + slack + 1e-9 * (q * c + slack) + 1e-6

    def visit(self, u: int, nodes: np.ndarray, known: int) -> None:
        queries, data = self.queries, self.data
        self.worst[u] = max(self.worst[u], known)
        bound = self.bounds(u, nodes)
        nodes, bound = self.pruned(u, nodes, bound)
        while (wide := (data.kids[nodes] > 0) & (data.radius[nodes] > queries.radius[u])).any():  # wider than this group of queries
            more = data.below(nodes[wide])
            nodes, bound = self.pruned(u, np.concatenate([nodes[~wide], more]), np.concatenate([bound[~wide], self.bounds(u, more)]))
        if not queries.kids[u]:
            self.compare(u, nodes, bound)
            return
        children, step = range(queries.first[u], queries.first[u] + queries.kids[u]), 16
        while len(nodes):
            for x in children:
                self.visit(x, nodes[:step], self.worst[u])
            self.worst[u] = max(self.worst[u], min(self.worst[x] for x in children))
            nodes, bound = self.pruned(u, nodes[step:], bound[step:])
            step *= 4

    def pruned(self, u: int, nodes: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that may hold one of the best k, the most promising first."""
        keep = np.flatnonzero(bound >= self.worst[u])
        keep = keep[np.argsort(-bound[keep], kind="stable")]
        return nodes[keep], bound[keep]

    def compare(self, u: int, nodes: np.ndarray, bound: np.ndarray) -> None:
        """A leaf of queries: data nodes give way to their children, and leaves are compared point by point."""
        data, size = self.data, 64
        while len(nodes):
            points = np.where(data.kids[nodes] > 0, 0, data.high[nodes] - data.low[nodes])
            head = max(1, int(np.searchsorted(np.cumsum(points), size, side="right")))
            now, inner = nodes[:head], data.kids[nodes[:head]] > 0
            more = data.below(now[inner])
            nodes, bound = np.concatenate([nodes[head:], more]), np.concatenate([bound[head:], self.bounds(u, more)])
            places = data.places(now[~inner])
            at = 0
            while at < len(places):
                self.base(u, places[at : at + size])
                at += size
                size = min(2048, 2 * size)  # the first few raise the k-th scores
            nodes, bound = self.pruned(u, nodes, bound)

    def base(self, u: int, places: np.ndarray) -> None:
        a, b = int(self.queries.low[u]), int(self.queries.high[u])
        got = _products(self.q[a:b], self.c[places], self.exact)
        good = got >= np.maximum(self.scores[a:b, -1], self.floor[a:b])[:, None]
        good &= self.queries.rows[a:b, None] != self.data.rows[None, places]
        row, column = np.nonzero(good)
        if len(row):
            touched = np.unique(row)
            old = np.repeat(touched, self.k)
            who, score = np.concatenate([row, old]), np.concatenate([got[row, column], self.scores[a + touched].ravel()])
            name = np.concatenate([self.data.ids[places[column]], self.ids[a + touched].ravel()])
            found = np.concatenate([np.ones(len(row), bool), self.ids[a + touched].ravel() < _LAST])
            order = np.lexsort((name, -np.maximum(score, _NONE + 1), ~found, who))
            ends = np.cumsum(np.bincount(who, minlength=b - a))
            first = np.concatenate([[0], ends[:-1]])[touched]
            best = order[first[:, None] + np.arange(self.k)]
            self.scores[a + touched], self.ids[a + touched] = score[best], name[best]
        self.worst[u] = max(self.worst[u], int(np.maximum(self.scores[a:b, -1], self.floor[a:b]).min()))


def search(queries: Tree, data: Tree, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per query, ids and scores of its best k rows of data, best first; missing ones have id -1 at the least score."""
    done = Search(queries, data, k, floor)
    return np.where(done.scores == _NONE, -1, done.ids), done.scores


def centres_of(points: DataFrame, blocks: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """By dimension, centres picked farthest-first from the `sample` rows with the smallest hashes; no more than blocks are needed."""
    picked = points.select("v", F.xxhash64("row").alias("h")).orderBy("h").limit(sample).collect()
    by_size: dict[int, list] = {}
    for r in picked:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for size, rows in by_size.items():
        own = np.array(rows, np.float64)
        chosen = [0]
        nearest = _squares(own, own[[0]])[:, 0]
        while len(chosen) < min(blocks, -(-len(own) // 4)) and nearest.max() > 0:
            chosen.append(int(np.argmax(nearest)))
            nearest = np.minimum(nearest, _squares(own, own[chosen[-1:]])[:, 0])
        out[size] = own[chosen]
    return out


def routed(points: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds dim and region: the nearest centre of the dimension."""
    shared = points.sparkSession.sparkContext.broadcast(centres)  # at most SAMPLE / 4 vectors
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(names.index("v"))
            sizes = np.diff(vectors.offsets.to_numpy())
            region = np.zeros(len(sizes), np.int32)
            flat, ends = vectors.flatten().to_numpy(), np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                if len(known := shared.value.get(size, ())) > 1:
                    for at in range(0, len(own), 4096):
                        some = own[at : at + 4096]
                        rows = flat[(ends[some] - size)[:, None] + np.arange(size)].astype(np.float64)
                        region[some] = ((known * known).sum(axis=1)[None, :] - 2 * (rows @ known.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(region)], names=[*names, "dim", "region"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{kinds}, dim int, region int")


def _build(rows: DataFrame, block_rows: int, leaf: int) -> DataFrame:
    """dim, block, n, radius, centre and tree (pickled): one row for each block, its size fixed by block_rows."""

    def run(table: pa.Table) -> pa.Table:
        points = np.stack([np.array(x, np.int64) for x in table.column("v").to_pylist()])
        tree = Tree(table.column("id").to_numpy(), table.column("row").to_numpy(), points, leaf)
        block = f"{table.column('region')[0].as_py()}.{table.column('salt')[0].as_py()}"
        own = [[points.shape[1]], [block], [len(points)], [float(tree.radius[0])], [tree.points[tree.centre[0]].astype(float).tolist()], [pickle.dumps(tree)]]
        return pa.table([pa.array(x, t) for x, t in zip(own, (pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.binary()), strict=True)], names=["dim", "block", "n", "radius", "centre", "tree"])

    many = rows.groupBy("dim", "region").agg(F.ceil(F.count("*") / block_rows).alias("salts"))
    dealt = rows.join(many, ["dim", "region"]).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).select("dim", "region", "salt", "id", "row", "v")
    return dealt.groupBy("dim", "region", "salt").applyInArrow(run, "dim int, block string, n long, radius double, centre array<double>, tree binary")


def root_pairs(queries: DataFrame, data: DataFrame) -> DataFrame:
    """dim, query_block, n, block, bound for all pairs of roots of one dimension."""
    groups = max(1, -(-data.count() // ROOTS))
    left = queries.select("dim", F.col("block").alias("query_block"), "n", F.col("radius").alias("r"), F.col("centre").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    right = data.select("dim", "block", F.col("radius").alias("s"), F.col("centre").alias("c"), F.pmod(F.hash("block"), F.lit(groups)).alias("group"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = lambda x: F.sqrt(dot(x, x))
    pairs = left.withColumn("qn", norm(F.col("q"))).join(right.withColumn("cn", norm(F.col("c"))), ["dim", "group"])
    slack = F.col("qn") * F.col("s") + F.col("cn") * F.col("r") + F.col("r") * F.col("s")
    return pairs.select("dim", "query_block", "n", "block", (dot(F.col("q"), F.col("c")) + slack + 1e-9 * (F.col("qn") * F.col("cn") + slack) + 1e-6).alias("bound"))


def _searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """query_row, query_id, query_block, vec_id, score: the k best that these pairs (dim, query_block, block) of blocks hold.

    Keys are a data block and a group of at most TOGETHER query blocks."""
    groups = max(1, -(-queries.count() // TOGETHER))
    wanted = pairs.select("dim", "query_block", "block", F.pmod(F.hash("query_block"), F.lit(groups)).alias("group"))
    trees = queries.select("dim", F.col("block").alias("query_block"), F.col("tree").alias("query_tree"))
    if floors is not None:
        trees = trees.join(floors, ["dim", "query_block"], "left")
    else:
        trees = trees.withColumn("floors", F.lit(None).cast("array<struct<row:long,score:long>>"))
    left = wanted.join(trees, ["dim", "query_block"])
    places = wanted.select(F.col("dim").alias("own_dim"), F.col("block").alias("own_block"), F.col("group").alias("own_group")).distinct()
    right = places.join(data.select(F.col("dim").alias("own_dim"), F.col("block").alias("own_block"), "tree"), ["own_dim", "own_block"])
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("query_block", pa.string()), ("dim", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        known = pickle.loads(two.column("tree")[0].as_py())
        out = []
        for block, packed, floors in zip(one.column("query_block").to_pylist(), one.column("query_tree").to_pylist(), one.column("floors").to_pylist(), strict=True):
            asked = pickle.loads(packed)
            floor = np.full(len(asked.ids), _NONE)
            if floors:
                reached = {f["row"]: f["score"] for f in floors}
                floor = np.array([reached.get(r, _NONE) for r in asked.rows.tolist()], np.int64)
            ids, scores = search(asked, known, k, floor)
            good = (scores > _NONE).ravel()
            names, rows = np.repeat(asked.ids, k)[good], np.repeat(asked.rows, k)[good]
            out.append(pa.table([pa.array(rows), pa.array(names), pa.array([block] * len(rows), pa.string()), pa.array(np.full(len(rows), known.points.shape[1], np.int32)), pa.array(ids.ravel()[good]), pa.array(scores.ravel()[good])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return left.groupBy("dim", "block", "group").cogroup(right.groupBy("own_dim", "own_block", "own_group")).applyInArrow(run, "query_row long, query_id long, query_block string, dim int, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", query_rows: int = 4096, data_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by inner product of floor(scale * x)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vectors = rows.filter(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite))
    whole = vectors.select(F.col(vec_id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).cast("array<long>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    points = materialise(whole.withColumn("row", F.monotonically_increasing_id()), "points")
    placed = materialise(routed(points, centres_of(points, max(1, -(-points.count() // data_rows)))), "routed")
    data = materialise(_build(placed, data_rows, DATA_LEAF), "trees")
    queries = materialise(_build(placed.filter("is_query"), query_rows, QUERY_LEAF), "trees")

    pairs = materialise(root_pairs(queries, data), "root-pairs")
    seeds = pairs.groupBy("dim", "query_block").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    found = materialise(_searched(seeds, queries, data, None, k), "found")
    kth = found.groupBy("dim", "query_block", "query_row").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k)
    floors = kth.groupBy("dim", "query_block").agg(F.collect_list(F.struct(F.col("query_row").alias("row"), "score")).alias("floors"))  # at most query_rows each
    floors = materialise(floors, "floors")
    worst = floors.select("dim", "query_block", F.size("floors").alias("known"), F.array_min(F.transform("floors", lambda f: f["score"])).alias("worst"))
    rest = pairs.join(worst, ["dim", "query_block"], "left").filter(F.col("worst").isNull() | (F.col("known") < F.col("n")) | (F.col("bound") >= F.col("worst")))
    rest = rest.join(seeds, ["dim", "query_block", "block"], "left_anti")
    more = materialise(_searched(rest, queries, data, floors, k), "found")
    discard(points, placed, data, queries, pairs, floors)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
