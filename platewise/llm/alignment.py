"""Cross-tokenizer alignment by merge paths.

Two tokenizers cut the same bytes; both lists of token ends, merged, say which
tokens overlap and where both have a boundary.  The merge of a batch of texts
(texts in a row: their ends grow from text to text) is cut into pieces of equal
work: on every ``PIECE``-th diagonal of the merge grid a binary search finds
where the merge path crosses it.  A piece merges its own tokens only, knowing
nothing of the others, and emits its overlaps and its common ends; a group of
tokens that a cut divides is put together again when the pieces are stitched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import bpe
from platewise.llm.store import Scratch, fields, text_slices, texts

#: tokens of both lists in a piece
PIECE = 1 << 16
#: tables of at most so many id pairs (17 bytes a pair) are held by every task, larger ones are joined by shuffle
BROADCAST_PAIRS = 2_000_000
#: shares of a frequent pair's rows in the shuffled join
SALTS = 32
_SPACE = "▁"


def diagonal_cuts(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two sorted lists crosses each ``piece``-th diagonal (equal ends: a's first).

    Returns how many of ``a`` and of ``b`` lie before each cut, the two ends included.
    """
    total = len(a) + len(b)
    diagonal = np.unique(np.append(np.arange(0, total, piece), total))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        # the path has a[middle] before the cut if it is no larger than the last of b that would be
        other = diagonal - 1 - middle
        inside = (low < high) & (other >= 0)
        before = np.zeros(len(diagonal), bool)
        before[inside] = a[middle[inside]] <= b[other[inside]]
        low, high = np.where((low < high) & before, middle + 1, low), np.where((low < high) & ~before, middle, high)
    return low, diagonal - low


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the merge of a[i0:i1] and b[j0:j1] emits: the overlaps (token of a, token of b), and the common ends
    (by the place in b) that it passes.

    Taking an end emits the pair of tokens that both lists stand at, but for an end of b that equals the end of a
    taken just before: there both tokens are behind, and a common end is passed.
    """
    mine, other = a[i0:i1], b[j0:j1]
    beside = j0 + np.searchsorted(other, mine, side="left")  # b's token when a's end is taken
    over = i0 + np.searchsorted(mine, other, side="right")   # a's token when b's end is taken
    last = over - 1
    common = np.zeros(len(other), bool)
    common[last >= 0] = a[last[last >= 0]] == other[last >= 0]
    left = np.concatenate([np.arange(i0, i1), over[~common]])
    right = np.concatenate([beside, np.arange(j0, j1)[~common]])
    return left, right, j0 + np.flatnonzero(common)


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens (two arrays), and for the groups between common ends how many tokens of a and of b lie
    before each group's end.  Both lists must end at the same place."""
    i, j = diagonal_cuts(a, b, piece)
    pieces = [merge_piece(a, b, *bounds) for bounds in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    if not pieces:
        return (np.zeros(0, np.int64),) * 4
    left, right, common = (np.concatenate(x) for x in zip(*pieces, strict=True))
    # stitching: a group reaches from one common end to the next, however many cuts lie between
    return left, right, np.searchsorted(a, b[common], side="right"), common + 1


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, tokenizer_json: str, model: bytes):
        import sentencepiece

        self.encoder = bpe.ChunkEncoder(tokenizer_json, added=False)
        self.a_bytes = [t or b"" for t in bpe.token_bytes(tokenizer_json)]
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        # no piece goes on past a space: words can be encoded one by one
        self.by_word = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(t), np.uint8) for t in (self.a_bytes, self.b_bytes))
        # what each token adds to the groups' text: its id, and what follows it
        words = [f"{i}{mark}".encode() for marks, n in ((",|", len(self.a_bytes)), (",;", len(pieces))) for mark in marks for i in range(n)]
        self.word_size = np.array(list(map(len, words)), np.int64)
        self.words = np.zeros((len(words), self.word_size.max()), np.uint8)
        self.words[np.arange(self.words.shape[1]) < self.word_size[:, None]] = np.frombuffer(b"".join(words), np.uint8)

    def _pieces(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of b, and how many a text has.  Distinct words are encoded once; texts with other than single
        spaces between words are encoded as they are."""
        whole = pc.or_(pc.match_substring_regex(text, "  |^ | $"), pc.invert(pa.scalar(self.by_word)))
        split = pc.split_pattern(pc.if_else(whole, "", text), " ")
        firsts = split.offsets.to_numpy()
        firsts, words = firsts - firsts[0], split.flatten().dictionary_encode()
        lists = self.processor.encode(words.dictionary.to_pylist(), num_threads=1)
        index = words.indices.to_numpy().copy()
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        index[firsts[alone]] = len(lists) + np.arange(len(alone))
        lists += self.processor.encode(text.take(pa.array(alone)).to_pylist(), num_threads=1)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.int64, sizes.sum())
        lens = sizes[index]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], lens) + np.arange(ends[-1])]
        return ids, np.diff(ends[firsts])

    def tokens(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of a, how many a text has, ids of b, how many; a text whose tokens do not give its bytes has none."""
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string()))
        a_ids, ends = self.encoder.encode(spaced)
        a_ids, a_count = a_ids.astype(np.int64), np.diff(ends)
        b_ids, b_count = self._pieces(text)
        stops = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset:spaced.offset + len(spaced) + 1]
        data, size = np.frombuffer(spaced.buffers()[2], np.uint8), np.diff(stops)
        good = size > 1
        for ids, count, flat, sizes in ((a_ids, a_count, self.a_flat, self.a_size), (b_ids, b_count, self.b_flat, self.b_size)):
            good &= _sums(sizes[ids], count) == size
            kept = ids[np.repeat(good, count)]
            same = _gather(flat, (np.cumsum(sizes) - sizes)[kept], sizes[kept]) == _gather(data, stops[:-1][good], size[good])
            good[np.flatnonzero(good)[_sums(same, size[good]) < size[good]]] = False
        return a_ids[np.repeat(good, a_count)], a_count * good, b_ids[np.repeat(good, b_count)], b_count * good

    def groups_text(self, a_ids: np.ndarray, b_ids: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The tokens in the order of their groups, a's before b's, each with the mark that follows it; and how far
        this text has come after each token."""
        a_last, b_last = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        a_last[a_stop - 1] = b_last[b_stop - 1] = 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out = np.empty(len(a_ids) + len(b_ids), np.int64)
        out[np.arange(len(a_ids)) + np.concatenate([[0], b_stop])[a_group]] = a_ids + len(self.a_bytes) * a_last
        out[np.arange(len(b_ids)) + a_stop[b_group]] = b_ids + 2 * len(self.a_bytes) + len(self.b_bytes) * b_last
        size = self.word_size[out]
        return self.words[out][np.arange(self.words.shape[1]) < size[:, None]].tobytes(), np.concatenate([[0], np.cumsum(size)])


_PAIRS: dict[tuple[int, int], Pair] = {}


def _pair(tokenizer_json: str, model: bytes) -> Pair:
    """The Python worker's pair of tokenizers; what an earlier task remembered is forgotten."""
    key = hash(tokenizer_json), hash(model)
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(tokenizer_json, model)
    _PAIRS[key].encoder.forget()
    return _PAIRS[key]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    total = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(counts)
    return total[stops] - total[stops - counts]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` in a row."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _runs(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def links(docs: DataFrame, tokenizer_json: str, model: bytes, piece: int = PIECE) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the id pairs of a document:
    pairs (a's id * 2^32 + b's) and times (links of each), a row for every document.

    Null and empty texts, and texts whose tokens do not give their bytes
    again, have no tokens: zeros and an empty groups_sha256.  Rows stay one by
    one, also repeated ones and those without doc_id; other columns are not read.
    """
    schema = fields(docs, ["doc_id"], "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, seen = _pair(tokenizer_json, model), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                a_ids, n_a, b_ids, n_b = both.tokens(texts(part))
                a_end, b_end = np.cumsum(both.a_size[a_ids]), np.cumsum(both.b_size[b_ids])
                left, right, a_stop, b_stop = align(a_end, b_end, piece)
                # texts end at common ends
                group_of = np.searchsorted(a_stop, np.cumsum(n_a), side="right")
                n_groups = np.diff(group_of, prepend=0)
                words, places = both.groups_text(a_ids, b_ids, a_stop, b_stop)
                stops = places[np.concatenate([[0], np.cumsum(n_a + n_b)])]
                digests = [hashlib.sha256(words[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(stops[:-1], stops[1:], strict=True)]
                del words, places
                row = np.repeat(np.arange(len(part)), n_a)[left]
                n_links = np.bincount(row, minlength=len(part)).astype(np.int64)
                # a number for the text and the pair: rows of a batch times pairs of ids stay below 2^63
                found, times = np.unique((row * len(both.a_bytes) + a_ids[left]) * len(both.b_bytes) + b_ids[right], return_counts=True)
                pair, other = np.divmod(found, len(both.b_bytes))
                row, pair = np.divmod(pair, len(both.a_bytes))
                distinct = np.bincount(row, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.arange(seen, seen + len(part))), pa.array(n_a), pa.array(n_b), pa.array(n_groups, pa.int64()),
                     pa.array(n_links), pa.array(digests, pa.string()), _runs((pair << 32) + other, distinct, pa.int64()),
                     _runs(times, distinct, pa.int32())], names=schema.names)
                seen += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs and their times of all rows, and how many pairs a row has."""
    pairs, times = batch.column("pairs"), batch.column("times")
    return pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), pc.list_value_length(pairs).to_numpy().astype(np.int64)


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair and count: its links in all documents.  A batch's pairs are summed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, _ = _lists(batch)
            pair, at = np.unique(pairs, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(at, times, len(pair)).astype(np.int64))], names=["pair", "count"])

    return linked.select("pairs", "times").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def _rate_here(linked: DataFrame, rated: DataFrame) -> DataFrame:
    """row, n_best and count_sum, by looking the pairs up in a table that every task holds."""
    table = rated.orderBy("pair").toArrow()  # at most ``broadcast_pairs`` rows
    held = linked.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "count", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = held.value
        for batch in batches:
            pairs, times, size = _lists(batch)
            at = np.searchsorted(known, pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(_sums(times * best[at], size)), pa.array(_sums(times * count[at], size))], names=["row", "n_best", "count_sum"])

    return linked.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long")


def _rate_by_shuffle(linked: DataFrame, rated: DataFrame) -> DataFrame:
    """The same by a join; a pair that a third of the documents hold is dealt over all salts."""
    each = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")) \
        .select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"), F.pmod("row", F.lit(SALTS)).alias("salt"))
    salted = rated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return each.hint("merge").join(salted, ["pair", "salt"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def compare(docs: DataFrame, tokenizer_json: str, model: bytes, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row for every document.

    n_best counts the links whose pair is, over all documents, the most
    frequent of its b (ties included), count_sum sums the links' pair counts.
    For null, empty and otherwise tokenless texts see ``links``.  An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    linked = scratch.write(links(docs, tokenizer_json, model), "links")
    counts = scratch.write(pair_counts(linked).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    rated = scratch.write(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "rated")
    sums = (_rate_here if rated.count() <= broadcast_pairs else _rate_by_shuffle)(linked, rated)
    return linked.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
