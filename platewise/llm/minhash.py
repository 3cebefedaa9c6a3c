"""Near duplicates by one-permutation hashing.

``shingle_sets`` gives the distinct word shingles of whole texts as sorted
64-bit hashes.  ``sketches`` puts each set's hashes into bins by their leading
bits and keeps the smallest of every bin (one permutation); empty bins borrow
from a non-empty bin chosen by a universal hash of (bin, attempt), the optimal
densification; ``rows`` bins make a band.  ``near_duplicates`` collapses equal
sets, links every member of a band bucket to the bucket's first member only (a
star), confirms the links on full sets, and takes connected components.

Two sets in one bucket that are both unlike its first member are not lost:
buckets that still hold several components have rounds with other centres, as
long as they find links, and if that leaves any, the last round is exact.  It
compares what is left of different components, in small buckets pair by pair;
members of large buckets meet on the rarest of the shingles that set them apart
from one member of the bucket (linked sets share one, or differ so little that
one member is linked to both), so neither a passage that thousands of documents
hold nor the shingles of a large group of near copies bring them together.
Pairs that exact sizes rule out are not compared, nor those whose differences
are too large for what they can share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.store import Scratch, fields, sieved, small, text_slices, texts

WORDS = 5
#: links: 100 * intersection >= PERCENT * union
PERCENT = 85
#: a pair at 0.85 shares no band with probability (1 - 0.85^6)^32 = 3e-7
BANDS, ROWS = 32, 6
#: star rounds with other centres, as long as they find links, before the round that compares what is left
STAR_ROUNDS = 1
#: larger buckets are compared by what sets their members apart from one of them in the last round
SMALL_BUCKET = 16
#: at most as many sets are broadcast to find their texts (tens of bytes each)
FEW_SETS = 500_000

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15  # odd: invertible modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_BLOCK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _byte_values() -> np.ndarray:
    """A random value per byte, the same for A-Z and a-z, 0 for white space."""
    values = np.random.default_rng(85).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values[0x41:0x5B] = values[0x61:0x7B]
    values[list(_SPACES)] = 0
    return values


_VALUES = _byte_values()
_COEFFICIENTS = _mix(np.arange(1, 65, dtype=np.uint64))
_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_BASE_INVERSE, _BLOCK)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie in a row in ``data`` and begin at
    ``starts``, and the number of words before each text (and after the last).

    A word's hash is the polynomial of its bytes' values; words are runs
    between white space, and a text's start begins a word.
    """
    values = _VALUES[data]
    begins = np.empty(len(data), bool)
    begins[:1] = True
    np.equal(values[:-1], 0, out=begins[1:])
    begins[starts[starts < len(data)]] = True
    begins &= values != 0
    at = np.flatnonzero(begins)
    counts = np.searchsorted(at, np.append(starts, len(data)))
    if not len(at):
        return np.zeros(0, np.uint64), counts
    # powers repeat every block: a word's bytes are brought to its own start, block by block
    place = np.arange(len(data)) if len(data) <= _BLOCK else np.arange(len(data)) % _BLOCK
    values *= _UP[place]
    cuts = np.arange(_BLOCK, len(data), _BLOCK)
    pieces = np.union1d(at, cuts[cuts > at[0]])
    sums = np.add.reduceat(values, pieces)
    word = np.searchsorted(at, pieces, side="right") - 1
    away = pieces - at[word]  # a piece cut off by a block's start lies that far from its word's start
    far = np.fromiter((pow(_BASE, int(d), 1 << 64) for d in away[away > 0]), np.uint64)
    sums *= _DOWN[place[pieces]]
    sums[away > 0] *= far
    hashes = np.zeros(len(at), np.uint64)
    np.add.at(hashes, word, sums) if len(pieces) > len(at) else hashes.__iadd__(sums)
    return _mix(hashes), counts


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes of one text, sorted; fewer than ``n`` words: all of them as one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, _COEFFICIENTS[-n])
    for k in range(n):
        total += words[k:len(words) - n + 1 + k] * _COEFFICIENTS[k]
    return np.unique(_mix(total))


def _text_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in text_slices(batch, "text", 2 << 20):
        text = texts(part)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        words, counts = word_hashes(data, offsets[:-1] - offsets[0])
        yield part, [shingle_hashes(words[a:b], n) for a, b in zip(counts[:-1], counts[1:], strict=True)]


def one_permutation(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """The densified bin minima (a row per set; empty sets get zeros)."""
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, hashes in enumerate(sets):
        place = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # by the leading bits: sorted
        first = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1))
        out[i, place[first]] = hashes[first]
        full[i, place[first]] = True
    row, bin_ = np.nonzero(~full & full.any(1, keepdims=True))
    attempt = np.uint64(0)
    while len(row):
        source = (_mix(bin_.astype(np.uint64) * np.uint64(0x100000001) + (attempt << np.uint64(40))) % np.uint64(bins)).astype(np.int64)
        found = full[row, source]
        out[row[found], bin_[found]] = out[row[found], source[found]]
        row, bin_ = row[~found], bin_[~found]
        attempt += np.uint64(1)
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band (a row per set)."""
    cut = minima.reshape(len(minima), bands, rows)
    total = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), cut.shape[:2]).copy()
    for k in range(rows):
        total += cut[:, :, k] * _COEFFICIENTS[k]
    return _mix(total).view(np.int64)


def _long_lists(rows: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1)))


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits of the set, as two longs) and bands (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _text_sets(batch, words):
                size = np.array([len(s) for s in sets], np.int64)
                keys = band_keys(one_permutation(sets, bands * rows), bands, rows)
                low = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
                high = np.array([_mix(s ^ np.uint64(_BASE)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                     _long_lists(keys, bands)], names=schema.names)

    schema = fields(docs, ["doc_id"], "n_shingles long, set_low long, set_high long, bands array<long>")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shingle_sets(texts_: DataFrame, words: int = WORDS) -> DataFrame:
    """rep and its distinct shingles' hashes, sorted (array of long), of (rep, set_low, text): the rows whose text has
    the set that ``set_low`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _text_sets(batch, words):
                wanted = part.column("set_low").to_numpy().view(np.uint64)
                own = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64) == wanted
                sets = [s for s, mine in zip(sets, own, strict=True) if mine]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep").filter(pa.array(own)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))],
                    names=["rep", "shingles"])

    return texts_.select("rep", "set_low", "text").mapInArrow(run, "rep long, shingles array<long>")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and label (its component's smallest node) of undirected links (a, b), for nodes with a link.

    Every round takes the smallest label among a node and its neighbours, then
    the label's label, until nothing changes.
    """
    both = scratch.write(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = scratch.write(both.groupBy("a").agg(F.min("b").alias("m"))
                           .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    step, changed = 0, not labels.isEmpty()
    while changed:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = scratch.write(lower.join(jump, "label").select("node", "before", F.col("beyond").alias("label")), f"{name}-{step}")
        changed = not after.where("label <> before").isEmpty()
        scratch.drop(f"{name}-{step - 1}")
        labels = after.select("node", "label")
    scratch.drop(f"{name}-links")
    return labels


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable, kept says
    whether it is the document's own.  Null, empty and wordless texts have no
    shingles and stand alone.  A doc_id that comes more than once is one node
    (linked by any of its texts, a row for each); a row without doc_id takes
    no part, has no component and is kept.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    sketch = scratch.write(sketches(docs, words, bands, rows), "sketches")
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one node from here on, named by a number
    sets = scratch.write(usable.groupBy("set_low", "set_high").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("rep", F.monotonically_increasing_id()), "sets")
    each = sets.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("bucket")
    members = scratch.write(each.join(shared, "bucket"), "members")
    # written first: where few are chosen, no text is shuffled, else those the sieve leaves
    chosen = scratch.write(sets.join(members.select("rep").distinct(), "rep").select("rep", "set_low", F.col("doc").alias("doc_id")), "chosen")
    wanted = docs.select("doc_id", "text")
    if chosen.limit(FEW_SETS + 1).count() > FEW_SETS:
        wanted, _ = sieved(wanted, chosen, "doc_id")
    full = scratch.write(shingle_sets(wanted.join(small(chosen, FEW_SETS), "doc_id"), words), "full")
    scratch.drop("chosen")
    # sets of one doc_id belong together
    named = usable.join(sets, ["set_low", "set_high"]).select("doc_id", "rep")
    same = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    same = named.join(same, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()

    centre = _commonest(members).select("bucket", F.col("rep").alias("a"), F.col("n").alias("na"))
    stars = members.join(centre, "bucket").where("rep <> a")
    tested = _confirmed(_in_order(stars), full, percent, scratch, "stars")
    labels = components(tested.where("linked").select("a", "b").union(same), scratch, "labels")
    mixed = scratch.write(_mixed(_labelled(members, labels)), "mixed")
    for turn in range(1, STAR_ROUNDS + 1):
        centre = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n", "label")).alias("c")
        again = mixed.join(mixed.groupBy("bucket").agg(centre), "bucket").where("label <> c.label") \
            .select("rep", "n", F.col("c.rep").alias("a"), F.col("c.n").alias("na"))
        more = _confirmed(_in_order(again), full, percent, scratch, f"stars-{turn}", tested)
        tested = tested.union(more)
        labels, grown = _joined(labels, more, scratch, f"labels-{turn}")
        if not grown:
            break
        mixed = scratch.write(_mixed(_labelled(mixed.drop("label"), labels)), f"mixed-{turn}")
    if not mixed.isEmpty():
        large = mixed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > SMALL_BUCKET)
        few = mixed.join(large, "bucket", "left_anti")
        crowd = mixed.join(large, "bucket", "left_semi")
        found = _confirmed(_in_order(_across(few)).union(_in_order(_close(crowd, full, percent, scratch))),
                           full, percent, scratch, "left", tested)
        labels, _ = _joined(labels, found, scratch, "labels-last")
    scratch.drop("full")

    node = sets.select("set_low", "set_high", "rep", "doc").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left") \
        .withColumn("label", F.coalesce("label", "rep"))
    node = scratch.write(node, "nodes")
    scratch.drop("sets")
    component = node.groupBy("label").agg(F.min("doc").alias("component_id"))
    component = node.join(component, "label").select("set_low", "set_high", "component_id")
    out = sketch.select("doc_id", "n_shingles", "set_low", "set_high").join(component, ["set_low", "set_high"], "left") \
        .withColumn("component_id", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).alias("kept"))


def _commonest(members: DataFrame) -> DataFrame:
    """bucket, rep and n: every bucket's member that is in the most of the buckets.

    Buckets of like sets so have few such members between them, and these lie
    in the midst of their groups.
    """
    held = members.groupBy("rep").agg(F.count("*").alias("held"))
    most = F.max(F.struct("held", F.xxhash64("rep").alias("h"), "rep", "n")).alias("most")
    return members.join(held, "rep").groupBy("bucket").agg(most).select("bucket", "most.rep", "most.n")


def _joined(labels: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, bool]:
    """The labels after the links among ``found``, and whether there are any."""
    more = found.where("linked").select("a", "b")
    if more.isEmpty():
        return labels, False
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
    return components(known.union(more), scratch, name), True


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, rep, n and the component's label (a set without links: its own)."""
    return members.select("bucket", "rep", "n").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left") \
        .withColumn("label", F.coalesce("label", "rep"))


def _mixed(labelled: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    several = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return labelled.join(several.select("bucket"), "bucket")


def _across(mixed: DataFrame, *more: str) -> DataFrame:
    """a, na with rep, n (and each column of ``more``, for a with ``_a``): the pairs of members of one bucket in
    different components, once a bucket.  Each has a member outside the bucket's largest component."""
    size = mixed.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    main = size.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("main"))
    placed = mixed.join(main, "bucket").withColumn("outside", F.col("label") != F.col("main.label")).drop("main")
    others = placed.where("outside").select("bucket", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"),
                                            *(F.col(c).alias(f"{c}_a") for c in more))
    return placed.join(others, "bucket").where((F.col("label") != F.col("la")) & (~F.col("outside") | (F.col("a") < F.col("rep"))))


def _in_order(pairs: DataFrame) -> DataFrame:
    """a, b, na, nb with a < b."""
    first = F.col("a") < F.col("rep")
    return pairs.select(
        F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"),
        F.when(first, F.col("na")).otherwise(F.col("n")).alias("na"), F.when(first, F.col("n")).otherwise(F.col("na")).alias("nb"))


def _close(crowd: DataFrame, full: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, na, rep, n: pairs of members of one bucket in different components, all linked ones (or a chain of
    others that links them) among them.

    Every bucket has a reference, the member of it that is in most buckets.  What sets a member apart is the symmetric difference to its
    reference, ``m`` shingles.  Two members whose differences share ``o`` have (n + na - m - ma) / 2 + o shingles in
    common, so they are linked when 2 (100 + percent) o + q + qa >= 0 with q = (100 - percent) n - (100 + percent) m.
    Those linked even if o = 0 are linked to the member with the largest q, too.  The others share one
    of the rarest shingles of their differences: so many shared ones come first in neither that the rest still makes o.
    """
    named = scratch.write(crowd.join(_commonest(crowd).select("bucket", F.col("rep").alias("ref")), "bucket")
                          .select("ref", "rep", "n", "label").distinct(), "crowd")
    own = full.select("rep", F.col("shingles").alias("s"))
    its = named.select("ref").distinct().join(full.select(F.col("rep").alias("ref"), F.col("shingles").alias("sr")), "ref")
    apart = scratch.write(named.join(own, "rep").join(its, "ref").select(
        "ref", "rep", "n", "label", F.concat(F.array_except("s", "sr"), F.array_except("sr", "s")).alias("apart")), "apart")
    scale = 100 + percent
    sized = apart.withColumn("m", F.size("apart").cast("long")).withColumn("q", (100 - percent) * F.col("n") - scale * F.col("m"))
    sized = sized.join(sized.groupBy("ref").agg(F.max(F.struct("q", "rep", "n", "label")).alias("top")), "ref")
    nearest = sized.where((F.col("label") != F.col("top.label")) & (F.col("q") + F.col("top.q") >= 0)) \
        .select(F.col("top.rep").alias("a"), F.col("top.n").alias("na"), "rep", "n")

    each = scratch.write(apart.select("ref", "rep", F.explode("apart").alias("shingle"))
                         .select("ref", "rep", F.xxhash64("ref", "shingle").alias("bucket")), "crowd-shingles")
    often = each.groupBy("bucket").agg(F.count("*").alias("often")).where("often > 1")
    # a shingle that sets one member apart comes first in the order and meets no other
    shared = Window.partitionBy("ref", "rep")
    rank = F.row_number().over(shared.orderBy("often", "bucket"))
    placed = each.join(often, "bucket").withColumn("rank", rank).withColumn("shared", F.count("*").over(shared)) \
        .join(sized.withColumn("best", F.col("top.q")).drop("apart", "top"), ["ref", "rep"]) \
        .withColumn("place", F.col("rank") + F.col("m") - F.col("shared"))
    # the least o with any other member
    least = F.greatest(F.lit(1), F.ceil(-(F.col("q") + F.col("best")) / (2 * scale)))
    met = scratch.write(_mixed(placed.where(F.col("place") <= F.col("m") - least + 1).select("bucket", "rep", "n", "label", "m", "q", "place")), "met")
    both = F.col("q") + F.col("q_a")
    rest = 1 + F.least(F.col("m") - F.col("place"), F.col("m_a") - F.col("place_a"))
    far = _across(met, "m", "q", "place").where((both < 0) & (2 * scale * rest + both >= 0))
    return nearest.union(far.select("a", "na", "rep", "n"))


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int, scratch: Scratch, name: str, tested: DataFrame | None = None) -> DataFrame:
    """a, b, linked: the distinct pairs not tested yet, compared on full sets.

    Pairs whose sizes alone rule out a link are left out.
    """
    pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()
    if tested is not None:
        pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * common >= percent * (F.size("sa") + F.size("sb") - common)
    both = pairs.join(full.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b") \
        .join(full.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    return scratch.write(both.select("a", "b", linked.alias("linked")), name)
