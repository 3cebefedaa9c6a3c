"""Best-fit packing of tokenised documents by minimum bin slack.

``cut_documents`` turns texts into pieces of at most ``capacity`` ids,
``pack_pieces`` gives every piece a sequence and an offset.

The packing itself depends only on how many pieces have each length, a table
of at most ``capacity`` rows however large the corpus is.  ``min_slack_plan``
packs that table: each bin takes the longest piece that is left, and a bitset
subset-sum over the available lengths, from the longest down, finds the fullest
combination that goes with it; the combination is used as often as the counts
allow, then removed.  The search for a bin may end at a slack that is allowed
(relaxed minimum bin slack), which keeps short pieces for bins that need them;
of several allowed slacks the plan with the fewest sequences counts.
Pieces are numbered within their length (per task, plus the offset of the
task), and the plan maps (length, number) to (sequence, offset).  No piece
passes through the driver and no length is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm import bpe
from platewise.llm.store import Scratch, fields, text_slices, texts

CAPACITY = 1024
END_ID = 2
#: slacks that a bin's search may end at; the best plan counts
SLACKS = (0, 1, 2, 4, 6, 8, 12, 16, 24, 32)


def cut_documents(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32 bit) of every document.

    A document is the ids that the library gives its text (strings of added
    tokens are those tokens), then ``end_id`` (null and empty texts:
    that id alone).  Documents over ``capacity`` are cut into pieces of that
    length, of which the first is the shorter one.  Repeated rows give
    repeated pieces; a null doc_id stays null; other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with bpe.encoder(tokenizer_json) as encoder:
            for part in (p for batch in batches for p in text_slices(batch, "text")):
                ids, ends = encoder.encode(texts(part))
                count = np.diff(ends) + 1
                stops = np.cumsum(count)
                full = np.empty(stops[-1], "<u4")
                is_end = np.zeros(len(full), bool)
                is_end[stops - 1] = True
                full[is_end], full[~is_end] = end_id, ids
                pieces = -(-count // capacity)
                row = np.repeat(np.arange(len(count)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (count - capacity * (pieces - 1))[row]
                start = np.where(number == 0, 0, first + capacity * (number - 1))
                length = np.where(number == 0, first, capacity)
                at = np.concatenate([[0], np.cumsum(length)]) * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(full)])],
                    names=["doc_id", "piece", "start", "length", "ids"])

    schema = fields(docs, ["doc_id"], "piece int, start long, length long, ids binary")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def min_slack_plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Slots for pieces given how many there are of each length.

    Slot i takes the pieces of ``length[i]`` numbered from ``start[i]`` on (up
    to the next slot of that length) at ``offset[i]`` of the sequences from
    ``sequence[i]`` on, one each.
    """
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best, fewest = [], None
    for slack in SLACKS:
        found = _combinations(counts, capacity, slack)
        size = sum(bins for _, bins in found)
        if fewest is None or size < fewest:
            best, fewest = found, size
        if fewest == least:
            break
    taken: dict[int, int] = {}
    slots, sequences = [], 0
    for combination, bins in best:
        offset = 0
        for n, k in combination.items():
            for _ in range(k):
                slots.append((n, taken.get(n, 0), sequences, offset))
                taken[n] = taken.get(n, 0) + bins
                offset += n
        sequences += bins
    columns = zip(*sorted(slots), strict=True) if slots else ([], [], [], [])
    return dict(zip(("length", "start", "sequence", "offset"), (np.array(c, np.int64) for c in columns), strict=True))


def _combinations(counts: dict[int, int], capacity: int, slack: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths (how many of each) and in how many bins each is used."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    out = []
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        combination = {longest: 1}
        for n, k in fullest(left, capacity - longest, slack).items():
            combination[n] = combination.get(n, 0) + k
        left[longest] += 1
        bins = min(left[n] // k for n, k in combination.items())
        for n, k in combination.items():
            left[n] -= k * bins
            if not left[n]:
                del left[n]
        out.append((combination, bins))
    return out


def fullest(left: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """The fullest combination of available lengths (from the longest down) within ``room``.

    The search ends as soon as the lengths so far can fill the room up to
    ``slack``, so long pieces go first.
    """
    sums, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n, count in left.items():
        if n > room or not count:
            continue
        steps.append((n, sums))
        count, step = min(count, room // n), 1
        while count:
            step = min(step, count)
            sums |= (sums << (step * n)) & mask
            count, step = count - step, step * 2
        if sums >> max(0, room - slack):
            break
    total, found = sums.bit_length() - 1, {}
    for n, before in reversed(steps):
        while not before >> total & 1:
            found[n] = found.get(n, 0) + 1
            total -= n
    return found


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset (its other columns stay).

    Offsets in a sequence are gapless from 0.  A piece whose length is null or
    not within 1..capacity cannot be packed: null sequence_id and offset.
    Equal pieces are packed one by one; an empty table gives an empty result.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    fits = F.col("__row.length").between(1, capacity)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task, and the running number within each length."""
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            n = np.array(batch.column("__n").to_numpy(zero_copy_only=False), np.int64)
            order = np.argsort(n, kind="stable")
            size = np.bincount(n, minlength=capacity + 1)
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), batch.column("__n"), pa.array(np.full(len(n), part), pa.int32()), pa.array(rank + seen[n])],
                names=["__row", "__n", "__part", "__rank"])
            seen += size

    rows = pieces.select(F.struct("*").alias("__row")).withColumn("__n", F.when(fits, F.col("__row.length").cast("long")).otherwise(0))
    schema = fields(rows, rows.columns, "__part int, __rank long")
    rows = scratch.write(rows.mapInArrow(number, schema), "numbered")

    by_task = scratch.write(rows.groupBy("__n", "__part").agg(F.count("*").alias("count")), "counts")
    counts = {r["__n"]: r["count"] for r in by_task.groupBy("__n").agg(F.sum("count").alias("count")).collect()}  # at most capacity + 1 rows
    counts.pop(0, None)
    plan = min_slack_plan(counts, capacity)
    # a length's numbers: those of earlier tasks come first
    earlier = Window.partitionBy("__n").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.write(
        by_task.select("__n", "__part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__base")), "bases")
    starts = (plan["length"] << 40) + plan["start"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        slot = np.searchsorted(starts, (n.to_numpy() << 40) + rank.to_numpy(), side="right") - 1
        found = n.to_numpy() > 0
        slot = np.where(found, slot, 0)
        if not len(starts):
            return pd.DataFrame({"sequence_id": pd.array([None] * len(n), "Int64"), "offset": pd.array([None] * len(n), "Int64")})
        return pd.DataFrame({
            "sequence_id": pd.Series(plan["sequence"][slot] + rank.to_numpy() - plan["start"][slot]).astype("Int64").where(found),
            "offset": pd.Series(plan["offset"][slot]).astype("Int64").where(found)})

    # a row per task and length: it grows with the corpus, so it is not broadcast
    placed = rows.join(bases.hint("merge"), ["__n", "__part"]).withColumn("__at", place("__n", F.col("__rank") + F.col("__base")))
    keep = [F.col("__row")[c].alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*keep, "__at.sequence_id", "__at.offset")
