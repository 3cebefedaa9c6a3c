"""Approximate nearest neighbours by multi-index hashing.

``fit`` learns rotated binary codes on a bounded sample: principal directions,
each group of them turned by iterative quantisation (the rotation and the
signs are improved in turn).  A code is cut into ``PARTS`` substrings, and each
substring is an index of its own: codes that differ in at most ``radius`` bits
agree, in at least one substring, up to ``radius / PARTS`` bits (the
pigeonhole), so probing every substring up to its share of the radius meets
every code within the radius.

The index is dealt over tasks by (substring, leading bits, slice): a cell.
Cells hold about as many rows as there are queries (within ``CELL_ROWS``), so
the queries sent to cells are no more than the rows; more rows with equal
leading bits are cut into slices.  A query goes to the cells whose leading bits
lie within its share of the radius, and a cell that no query probes is not
shipped.  In a cell a query probes the keys, checks whole codes, and ranks what
is left by the distance of the original vectors; a pair that several
substrings find counts in the first of them.

The radius is calibrated: ``CALIBRATION`` vectors are compared with all
others (a pass of fixed queries over the rows), and the radius covers ``COVER``
of their true neighbours.  Queries that find too few are searched again over
all codes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.store import Scratch, fields

#: rows that the codes are learned from, and rows whose true neighbours set the radius
SAMPLE, CALIBRATION = 4096, 128
#: share of true neighbours that the radius must cover on the calibration rows
COVER = 0.98
BITS, PARTS = 256, 4
PART_BITS = BITS // PARTS
#: least and most rows of a cell, about, and queries of a block
CELL_ROWS, QUERY_ROWS = (8192, 65_536), 8192
#: at most so many leading bits name a cell: PARTS * 2^MOST_LEAD entries at most describe all cells
MOST_LEAD = 14
ROUNDS = 30
#: keys of a ball are listed up to so many, beyond that the cell's keys are compared
_MOST_MASKS = 2048
#: candidate pairs that are ranked at once
_PAIRS = 1 << 16


def usable(column: str) -> Column:
    """Not null, without null or non-finite components, not zero."""
    x = F.col(column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda e: e != 0), F.lit(False))


def distances(point: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; squares are added one after the other, in double precision."""
    return np.sqrt(np.cumsum((others - point) ** 2, axis=1)[:, -1])


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(lens) and (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def fit(sample: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Centre and directions: bit j of a vector is the sign of (x - centre) @ directions[:, j]."""
    centre = sample.mean(0)
    x = sample - centre
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    random, parts = np.random.default_rng(11), []
    while sum(p.shape[1] for p in parts) < bits:
        chosen = axes[:, :min(axes.shape[1], bits - sum(p.shape[1] for p in parts))]
        flat = x @ chosen
        turn = np.linalg.qr(random.normal(size=(chosen.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        parts.append(chosen @ turn)
    return centre, np.hstack(parts)


def codes(points: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The substrings of every row's code (PARTS unsigned 64-bit numbers)."""
    signs = (points - model[0]) @ model[1] > 0
    return np.packbits(signs, axis=1).view(">u8").astype(np.uint64).reshape(len(points), -1)


def shares(radius: int, parts: int = PARTS) -> list[int]:
    """Bits that each substring is probed up to (-1: not at all): a code within
    ``radius`` is within the share of at least one substring."""
    if radius >= BITS:
        return [PART_BITS, *[-1] * (parts - 1)]
    each, rest = divmod(radius, parts)
    return [each if i <= rest else each - 1 for i in range(parts)]


def _bits(codes_: pa.Array) -> np.ndarray:
    return codes_.flatten().to_numpy().view(np.uint64).reshape(-1, PARTS)


def _masks(share: int) -> np.ndarray | None:
    """All differences of at most ``share`` bits, if they are few."""
    total, size = 0, 1
    for r in range(share + 1):
        total += size
        size = size * (PART_BITS - r) // (r + 1)
    if total > _MOST_MASKS:
        return None
    return np.array([sum(1 << b for b in at) for r in range(share + 1) for at in itertools.combinations(range(PART_BITS), r)], np.uint64)


class Substring:
    """A hash index of one substring: its keys in order and the rows of each key."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[self.order], return_index=True)
        self.stop = np.append(self.first[1:], len(keys))

    def probe(self, key: np.uint64, share: int, masks: np.ndarray | None) -> np.ndarray:
        """The rows whose substring differs from ``key`` in at most ``share`` bits."""
        if masks is not None and len(masks) < len(self.keys):
            wanted = masks ^ key
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            at = at[self.keys[at] == wanted]
        else:
            at = np.flatnonzero(np.bitwise_count(self.keys ^ key) <= share)
        if not len(at):
            return self.order[:0]
        n = self.stop[at] - self.first[at]
        return self.order[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def search_cell(part: int, radius: int, ask_codes, ask_points, codes_, points, lows, k: int):
    """For each query in turn: the k nearest of the cell's rows (their places, and distances; ties to the smaller
    ``lows``) within the radius, of those that no earlier substring finds."""
    share = shares(radius)
    index, masks = Substring(codes_[:, part]), _masks(share[part])
    for code, point in zip(ask_codes, ask_points, strict=True):
        rows = index.probe(code[part], share[part], masks)
        away = np.bitwise_count(codes_[rows] ^ code)
        found = away.sum(1, dtype=np.int64) <= radius
        for earlier in range(part):
            found &= away[:, earlier] > share[earlier]
        rows = rows[found]
        best, which = np.zeros(0), np.zeros(0, np.int64)
        for at in range(0, len(rows), _PAIRS):
            some = rows[at:at + _PAIRS]
            best = np.concatenate([best, distances(point, points[some])])
            which = np.concatenate([which, some])
            order = np.lexsort((lows[which], best))[:k]
            best, which = best[order], which[order]
        yield which, best


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """node (a number), low (its smallest id), vector and ids (the k smallest), a row for every distinct vector.

    Only the k smallest ids of equal vectors can be among any k nearest; the
    window keeps k rows a vector before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("vector") \
        .agg(F.min("id").alias("low"), F.sort_array(F.collect_list("id")).alias("ids")) \
        .select(F.monotonically_increasing_id().alias("node"), "low", "vector", "ids")


def nearest(vectors: DataFrame, key: str, column: str, is_query: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance), nearest first, ties to the smaller id.

    ``is_query`` is a condition on ``id``.  Rows without key and vectors that
    are null, zero or hold null or non-finite components take no part; equal
    rows are one; an id with several vectors has a row for each, and never
    finds itself.  Shorter vectors are compared as if ended by zeros.  Each
    query gets k rows, or all candidates if there are fewer.  No query or an
    empty table: no rows.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = scratch.write(vectors.where(usable(column) & F.col(key).isNotNull())
                         .select(F.col(key).cast("long").alias("id"), F.col(column).alias("vector")).distinct(), "rows")
    nothing = "query_id long, rank int, vec_id long, score double"
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return vectors.sparkSession.createDataFrame([], nothing)
    more = k + 1  # a query's own id may be among them
    nodes = scratch.write(_nodes(rows, more), "nodes")
    sample = nodes.orderBy(F.xxhash64("low"), "low", "node").limit(SAMPLE).select("node", "vector").toArrow()
    points = matrix(sample.column("vector").combine_chunks(), width)
    model = fit(points)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = codes(matrix(batch.column("vector"), width), model).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * PARTS, pa.array(found.reshape(-1)))],
                names=["node", "low", "vector", "code"])

    plain = nodes.select("node", "low", "vector")
    coded = scratch.write(plain.mapInArrow(encode, fields(plain, plain.columns, "code array<long>")), "coded")
    tests = np.arange(min(CALIBRATION, len(points)))
    radius = _calibrated(coded, points[tests], sample.column("node").to_numpy()[tests], codes(points[tests], model), width, k)

    asking = rows.where(is_query).select(F.col("id").alias("query_id"), "vector") \
        .join(nodes.select("vector", "node"), "vector").select("query_id", "node")
    asking = scratch.write(asking, "asking")
    asks = coded.join(asking.select("node").distinct(), "node", "left_semi")
    found = scratch.write(_probe(coded, asks, width, radius, more, scratch, "near"), "near")

    def answers(found: DataFrame) -> DataFrame:
        """query_id, vec_id and score: nodes' ids instead of nodes, without the query's own."""
        best = F.row_number().over(Window.partitionBy("ask").orderBy("distance", "low", "node"))
        return found.withColumn("rank", best).where(F.col("rank") <= more) \
            .join(nodes.select("node", F.explode("ids").alias("vec_id")), "node") \
            .join(asking.withColumnRenamed("node", "ask"), "ask").where("vec_id <> query_id") \
            .groupBy("query_id", "vec_id").agg(F.min("distance").alias("score"))

    first = scratch.write(answers(found), "first")
    short = asking.join(first.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left") \
        .where(F.coalesce("n", F.lit(0)) < k).select("query_id", "node")
    short = scratch.write(short, "short")
    if not short.isEmpty():
        wide = _probe(coded, coded.join(short.select("node").distinct(), "node", "left_semi"), width, BITS, more, scratch, "wide")
        again = answers(scratch.write(wide, "wide")).join(short.select("query_id").distinct(), "query_id", "left_semi")
        first = first.join(short.select("query_id").distinct(), "query_id", "left_anti").union(again)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(coded: DataFrame, points: np.ndarray, nodes: np.ndarray, own: np.ndarray, width: int, k: int) -> int:
    """The radius that covers COVER of the k nearest of the given rows, among all rows."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in points]
        for batch in batches:
            other, ids = matrix(batch.column("vector"), width), batch.column("node").to_numpy()
            bits = _bits(batch.column("code"))
            squares = (other ** 2).sum(1)
            for i, point in enumerate(points):
                away = squares - 2 * (other @ point)  # in the order of the distances
                away[ids == nodes[i]] = np.inf
                near = np.argpartition(away, k)[:k] if len(away) > k else np.arange(len(away))
                near = near[np.isfinite(away[near])]
                apart = np.bitwise_count(bits[near] ^ own[i]).sum(1, dtype=np.int64)
                best[i] = sorted(best[i] + list(zip(away[near].tolist(), apart.tolist(), strict=True)))[:k]
        flat = [(i, d, h) for i, each in enumerate(best) for d, h in each]
        columns = list(zip(*flat, strict=True)) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())],
                                         names=["test", "away", "apart"])

    rank = F.row_number().over(Window.partitionBy("test").orderBy("away", "apart"))
    near = coded.mapInArrow(compare, "test int, away double, apart long").withColumn("rank", rank).where(F.col("rank") <= k)
    apart = sorted(r["apart"] for r in near.select("apart").collect())  # k rows a calibration vector
    return apart[min(len(apart) - 1, int(COVER * len(apart)))] if apart else BITS


def _probe(coded: DataFrame, asks: DataFrame, width: int, radius: int, k: int, scratch: Scratch, name: str) -> DataFrame:
    """ask, node, low and distance: each asking node's k nearest nodes of every cell, of those within ``radius`` bits."""
    cell_rows = min(CELL_ROWS[1], max(CELL_ROWS[0], asks.count()))
    lead = min(MOST_LEAD, (coded.count() // cell_rows).bit_length())
    shift, share = np.uint64(PART_BITS - lead), shares(radius)

    def leads(code: np.ndarray) -> np.ndarray:
        """Of every substring, its leading bits."""
        return (code >> shift).astype(np.int64) if lead else np.zeros(code.shape, np.int64)

    spread = coded.select(F.posexplode("code").alias("part", "key")) \
        .withColumn("lead", F.shiftrightunsigned("key", PART_BITS - lead) if lead else F.lit(0).cast("long"))
    slices = np.zeros((PARTS, 1 << lead), np.int64)
    for part, at, n in spread.groupBy("part", "lead").count().collect():  # PARTS << lead rows at most
        slices[part, at] = -(-n // cell_rows)
    first = np.concatenate([[0], np.cumsum(slices.reshape(-1))])[:-1].reshape(slices.shape)
    every = np.arange(1 << lead, dtype=np.uint64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell that a query probes."""
        for whole, at in ((b, i) for b in batches for i in range(0, len(b), 256)):
            batch = whole.slice(at, 256)
            begin = leads(_bits(batch.column("code"))).astype(np.uint64)
            for part in range(PARTS):
                near = (np.bitwise_count(every ^ begin[:, part, None]) <= share[part]) & (slices[part] > 0)
                row, which = np.nonzero(near if share[part] >= 0 else near[:, :0])
                n = slices[part, which]
                cells = np.repeat(first[part, which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row = np.repeat(row, n)
                for some in range(0, len(row), 4096):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[some:some + 4096]), pa.array(np.full(len(cells[some:some + 4096]), part, np.int32)),
                         *(batch.column(c).take(pa.array(row[some:some + 4096])) for c in ("node", "vector", "code"))],
                        names=["cell", "part", "ask", "ask_vector", "ask_code"])

    asks = asks.select("node", "vector", "code")
    schema = T.StructType([*T.StructType.fromDDL("cell long, part int").fields, *(
        T.StructField(f"ask_{f.name}" if f.name != "node" else "ask", f.dataType) for f in asks.schema)])
    # the queries of a cell come in blocks, so that no group is unbounded
    routed = scratch.write(asks.mapInArrow(route, schema), f"{name}-routed")
    asked = routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
    routed = routed.join(asked, "cell").withColumn("block", F.pmod(F.xxhash64("ask"), F.col("blocks")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each substring, with its cell."""
        for batch in batches:
            begin, node = leads(_bits(batch.column("code"))), batch.column("node").to_numpy()
            for part in range(PARTS):
                n = slices[part, begin[:, part]]
                slice_ = (node * 0x9E3779B1 >> 7) % n
                yield pa.RecordBatch.from_arrays([pa.array(first[part, begin[:, part]] + slice_), *batch.columns],
                                                 names=["cell", *batch.schema.names])

    dealt = coded.mapInArrow(deal, T.StructType([T.StructField("cell", T.LongType()), *coded.schema.fields]))
    dealt = dealt.join(asked, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def search(asked_: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("ask", pa.int64()), ("node", pa.int64()), ("low", pa.int64()), ("distance", pa.float64())])
        if not asked_.num_rows or not held.num_rows:
            return schema.empty_table()
        ask, *asking = (asked_.column(c).combine_chunks() for c in ("ask", "ask_code", "ask_vector"))
        node, low, code, vector = (held.column(c).combine_chunks() for c in ("node", "low", "code", "vector"))
        found = list(search_cell(asked_.column("part")[0].as_py(), radius, _bits(asking[0]), matrix(asking[1], width),
                                 _bits(code), matrix(vector, width), low.to_numpy(), k))
        rows = pa.array(np.concatenate([w for w, _ in found]))
        return pa.table([np.repeat(ask.to_numpy(), [len(w) for w, _ in found]), node.take(rows), low.take(rows),
                         np.concatenate([d for _, d in found])], schema=schema)

    return routed.drop("blocks").groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")) \
        .applyInArrow(search, "ask long, node long, low long, distance double")
