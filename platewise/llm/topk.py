"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data share a top level: a net of pivots, and every vector belongs
to the cell of its nearest pivot.  Cells are cut into blocks of bounded size;
below, each block has a cover tree of its own (children cover their parent's
points within a shrunken radius).  A task takes a block of queries and a block
of data, and visits pairs of nodes from the best bound down: a pair is pruned
when no inner product between its balls can reach the worst k-th score of the
node's queries.  Queries first meet a block of their own cell, which gives
their k-th scores; then the same bound, over the balls of whole blocks, drops
pairs of blocks before any row is shipped to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.store import Scratch

#: rows that the pivots are chosen from, and the most pivots; there is about one for each block of data
SAMPLE, PIVOTS = 8192, 2048
QUERY_BLOCK, DATA_BLOCK = 2048, 8192
LEAF = 128
_SHRINK = (0.5, 0.7, 0.85)
_MOST_CHILDREN = 12


class CoverTree:
    """Nodes over the rows of a matrix: centre, covering radius, largest norm, children or points."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre, self.radius, self.norm, self.children, self.rows = [], [], [], [], []
        self.root = self._node(np.arange(len(points)))

    def _node(self, rows: np.ndarray) -> int:
        centre = self.points[rows[0]]
        away = np.sqrt(((self.points[rows] - centre) ** 2).sum(1))
        node = len(self.radius)
        self.centre.append(centre)
        self.radius.append(away.max())
        self.norm.append(np.sqrt((self.points[rows] ** 2).sum(1).max()))
        self.children.append([])
        self.rows.append(rows)
        if len(rows) > LEAF and away.max() > 0:
            self.children[node] = [self._node(part) for part in self._cover(rows, away)]
        return node

    def _cover(self, rows: np.ndarray, away: np.ndarray) -> list[np.ndarray]:
        """The rows in few balls of a smaller radius, or else in shells around the centre."""
        for shrink in _SHRINK:
            reach, rest, parts = shrink * away.max(), rows, []
            while len(rest) and len(parts) < _MOST_CHILDREN:
                near = ((self.points[rest] - self.points[rest[0]]) ** 2).sum(1) <= reach * reach
                parts.append(rest[near])
                rest = rest[~near]
            if not len(rest) and max(map(len, parts)) <= 0.9 * len(rows):
                return parts
        order = rows[np.argsort(away, kind="stable")]
        return [order[at:at + LEAF] for at in range(0, len(order), LEAF)]


def bound(centre, radius, norm, other, other_radius, other_norm):
    """No inner product between two balls (centre, radius, largest norm) is larger; ``other`` may be several balls."""
    away = np.maximum(0.0, np.sqrt(((other - centre) ** 2).sum(-1)) - radius - other_radius)
    largest = norm * other_norm
    balls = other @ centre + np.sqrt(centre @ centre) * other_radius + np.sqrt((other * other).sum(-1)) * radius + radius * other_radius
    apart = (norm ** 2 + other_norm ** 2 - away * away) / 2
    return np.minimum(np.minimum(largest, balls), apart) + 1e-9 * largest + 1e-6


class _Search:
    """Top k of each query among the data, given a score each has reached."""

    def __init__(self, queries, query_ids, data, data_ids, k, reached):
        self.q, self.d, self.k = CoverTree(queries), CoverTree(data), k
        self.query_ids, self.data_ids = query_ids, data_ids
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.worst = reached.copy()  # the k-th score of each query so far
        # a whole number below 2^53 is exact in a double; beyond, whole-number arithmetic
        self.exact = self.q.norm[0] * self.d.norm[0] < 2 ** 52
        self._visit(self.q.root, self.d.root)

    def _bound(self, a: int, b: int) -> float:
        q, d = self.q, self.d
        return bound(q.centre[a], q.radius[a], q.norm[a], d.centre[b], d.radius[b], d.norm[b])

    def _visit(self, a: int, b: int) -> None:
        pairs = [(self._bound(a, b), a, b)]
        while pairs:
            bound, a, b = pairs.pop()
            if bound < self.worst[self.q.rows[a]].min():
                continue
            deeper_q, deeper_d = self.q.children[a], self.d.children[b]
            if deeper_q and (not deeper_d or self.q.radius[a] > self.d.radius[b]):
                pairs += sorted((self._bound(x, b), x, b) for x in deeper_q)
            elif deeper_d:
                pairs += sorted((self._bound(a, x), a, x) for x in deeper_d)  # the best bound is taken next
            else:
                self._compare(self.q.rows[a], self.d.rows[b])

    def _compare(self, queries: np.ndarray, data: np.ndarray) -> None:
        left, right = self.q.points[queries], self.d.points[data]
        found = left @ right.T if self.exact else (left.astype(object) @ right.astype(object).T).astype(float)
        found = np.where(self.query_ids[queries][:, None] == self.data_ids[data][None, :], -np.inf, found)
        better = (found >= self.worst[queries][:, None]).any(1)
        if not better.any():
            return
        queries, found = queries[better], found[better]
        scores = np.concatenate([self.scores[queries], found], 1)
        ids = np.concatenate([self.ids[queries], np.broadcast_to(self.data_ids[data], found.shape)], 1)
        order = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.scores[queries] = np.take_along_axis(scores, order, 1)
        self.ids[queries] = np.take_along_axis(ids, order, 1)
        self.worst[queries] = np.maximum(self.worst[queries], self.scores[queries][:, -1])


def _matrix(table: pa.Table, width: int, column: str = "vector") -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    lists = table.column(column).combine_chunks()
    lens = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = lists.flatten().to_numpy()
    return out


def quantized(vectors: DataFrame, key: str, column: str, scale: int = 64) -> DataFrame:
    """id and vector (floor(scale * x) of every component), of the usable rows.

    Rows without key, null vectors, and vectors with null or non-finite
    components take no part; equal rows are one.
    """
    usable = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(column, lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return vectors.where(F.col(key).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), whole.alias("vector")).distinct()


def _net(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots: each is the row farthest from those before."""
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def top_k(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k largest inner
    products with whole-number vectors of other ids, ties to the smaller id.

    ``vectors`` has id and vector (array of long), ``is_query`` is a condition
    on id.  Vectors of different lengths are compared as if ended by zeros.
    Every row is a candidate: an id with several vectors may be listed for each
    of them, and as a query it asks with all of them together.  Inner products
    that could reach 2^63 are a ValueError.  An empty table, or no query, gives
    no rows.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = scratch.write(vectors, "rows")
    nothing = "query_id long, rank int, vec_id long, score long"
    total, width, largest = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(F.greatest(
        F.abs(F.array_max("vector").cast("double")), F.abs(F.array_min("vector").cast("double"))))).first()
    if not total or not width:
        return vectors.sparkSession.createDataFrame([], nothing)
    if width * float(largest) ** 2 >= 2.0 ** 63:
        raise ValueError(f"components up to {largest:g} in {width} places: inner products may pass 2^63")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    pivots = _net(_matrix(sample, width), max(1, min(PIVOTS, -(-total // DATA_BLOCK))))

    def cell(batches):
        for batch in batches:
            points = _matrix(pa.Table.from_batches([batch]), width)
            away = np.array([((points - p) ** 2).sum(1) for p in pivots])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(away.argmin(0).astype(np.int32)), pa.array(np.sqrt(away.min(0))), pa.array(np.sqrt((points ** 2).sum(1)))],
                names=["id", "vector", "cell", "away", "norm"])

    placed = scratch.write(rows.mapInArrow(cell, "id long, vector array<long>, cell int, away double, norm double"), "placed")

    def in_blocks(of: DataFrame, size: int, name: str) -> DataFrame:
        """Rows with the block of their cell: cells of more than ``size`` rows have several."""
        parts = of.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))  # at most PIVOTS rows
        part = F.pmod(F.xxhash64("id"), F.col("parts"))
        return of.join(F.broadcast(parts), "cell").withColumn(name, F.col("cell").cast("long") * (1 << 32) + part).drop("parts")

    def balls(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy(name, "cell").agg(F.max("away").alias("radius"), F.max("norm").alias("norm"))

    data = scratch.write(in_blocks(placed, DATA_BLOCK, "block"), "data")
    asks = scratch.write(in_blocks(placed.where(is_query), QUERY_BLOCK, "ask_block"), "asks").withColumn("home", F.col("cell").cast("long") * (1 << 32))
    if asks.isEmpty():
        return vectors.sparkSession.createDataFrame([], nothing)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        ids = asked.column("asked_id").to_numpy()
        reached = asked.column("asked_reached").to_numpy().astype(float)
        reached = np.where(np.isnan(reached), -np.inf, reached)
        found = _Search(_matrix(asked, width, "asked_vector"), ids, _matrix(held, width), held.column("id").to_numpy(), k, reached)
        hit = (found.scores >= reached[:, None]) & (found.scores > -np.inf)
        return pa.table([np.repeat(ids, hit.sum(1)), found.ids[hit], found.scores[hit].astype(np.int64)], schema=schema)

    def run(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """Search the pairs of blocks (ask_block, block)."""
        asked = asking.join(pairs, "ask_block").select("ask_block", "block", "id", "vector", "reached")
        asked = asked.toDF(*(f"asked_{c}" for c in asked.columns))  # both come from one table
        held = data.join(pairs, "block").select("ask_block", "block", "id", "vector")
        return asked.groupBy("asked_ask_block", "asked_block").cogroup(held.groupBy("ask_block", "block")) \
            .applyInArrow(search, "query_id long, vec_id long, score long")

    # first the block at home, for a score that the k-th of each query reaches
    home = asks.select("ask_block", F.col("home").alias("block")).distinct().join(data.select("block").distinct(), "block")
    at_home = scratch.write(run(home, asks.withColumn("reached", F.lit(None).cast("double"))), "home")
    reached = at_home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("reached")).where(F.col("n") >= k)
    asks = scratch.write(asks.join(reached.select(F.col("query_id").alias("id"), F.col("reached").cast("double")), "id", "left"), "reached")

    # then the blocks whose balls may hold a better score: a row a block of data, in every task
    of_data = balls(data, "block").toPandas()
    centres, radii, norms = pivots[of_data["cell"].to_numpy()], of_data["radius"].to_numpy(), of_data["norm"].to_numpy()
    numbers = of_data["block"].to_numpy()

    def prune(batches):
        for batch in batches:
            for row in batch.to_pylist():
                least = -np.inf if row["open"] else row["least"]
                near = bound(pivots[row["cell"]], row["radius"], row["norm"], centres, radii, norms) >= least
                near &= numbers != row["home"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(near.sum(), row["ask_block"])), pa.array(numbers[near])], names=["ask_block", "block"])

    of_asks = asks.groupBy("ask_block", "cell", "home").agg(
        F.max("away").alias("radius"), F.max("norm").alias("norm"), F.min("reached").alias("least"), F.max(F.col("reached").isNull()).alias("open"))
    pairs = scratch.write(of_asks.mapInArrow(prune, "ask_block long, block long"), "pairs")
    elsewhere = run(pairs, asks)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return at_home.union(elsewhere).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
