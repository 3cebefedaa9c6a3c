"""Nearest neighbours and vector codes against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import ann, codebooks, queries

VECTORS = "vec_id long, embedding array<float>, label int, node long, code string, id int"


def vectors(n=400, width=16, seed=1):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(8, width))
    rows = []
    for i in range(n):
        x = centres[i % 8] + 0.3 * random.normal(size=width)
        rows.append((i, [float(np.float32(e)) for e in x], i % 5 if i % 7 else None, 1, "x", 2))
    same = rows[0][1]
    rows += [(n + i, same, 1, 1, "x", 2) for i in range(60)]  # a group of copies
    rows += [rows[3], rows[3], (200, rows[4][1], 3, 1, "x", 2), (None, same, None, 1, "x", 2)]  # repeated rows, an id with two vectors, no id
    rows += [(9001, None, 1, 1, "x", 2), (9002, [1.0, None] + [0.0] * (width - 2), 1, 1, "x", 2), (9003, [math.nan] * width, 1, 1, "x", 2),
             (9004, [math.inf] * width, None, 1, "x", 2), (9100, [0.0] * width, 4, 1, "x", 2), (9101, [-0.0] * width, 4, 1, "x", 2)]
    return rows


def usable(row):
    return row[1] is not None and all(e is not None and math.isfinite(e) for e in row[1])


def nearest(rows, is_query, k):
    """query id: (score, vec_id) by comparing everything."""
    kept = {(r[0], tuple(r[1])) for r in rows if r[0] is not None and usable(r) and any(r[1])}
    ids, points = np.array([i for i, _ in kept]), np.array([x for _, x in kept])
    out = {}
    for q, x in kept:
        if is_query(q):
            away = np.sqrt(np.cumsum((points - np.array(x)) ** 2, axis=1)[:, -1])
            for i, d in zip(ids, away, strict=True):
                if i != q:
                    best = out.setdefault(q, {})
                    best[int(i)] = min(best.get(int(i), math.inf), float(d))
    return {q: sorted((d, i) for i, d in best.items())[:k] for q, best in out.items()}


def test_nearest_with_a_full_radius_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "COVER", 1.0)
    monkeypatch.setattr(ann, "CALIBRATION", 10_000)  # the radius covers all true neighbours
    monkeypatch.setattr(ann, "CELL_ROWS", (64, 64))
    monkeypatch.setattr(ann, "QUERY_ROWS", 16)
    rows = vectors()
    found = {}
    for r in sorted(ann.nearest(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", F.col("id") % 10 == 0, 7).collect()):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert found == nearest(rows, lambda i: i % 10 == 0, 7)


def test_nearest_reaches_recall_and_gives_every_query_its_rows(spark):
    rows = vectors(3000, 32, 5)
    got = ann.nearest(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", F.col("id") % 20 == 0, 10).collect()
    want = nearest(rows, lambda i: i % 20 == 0, 10)
    found = {}
    for r in sorted(got):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    assert found.keys() == want.keys() and all(len(v) == 10 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.95 * 10 * len(want)


def test_nearest_of_few_rows(spark):
    def run(rows):
        return [tuple(r) for r in sorted(ann.nearest(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", F.col("id") % 2 == 0, 3).collect())]
    few = [(0, [1.0, 0.0], 1, 1, "x", 2), (1, [0.0, 1.0], 1, 1, "x", 2), (2, [1.0], 1, 1, "x", 2), (4, [0.0, 0.0], 1, 1, "x", 2)]
    root = math.sqrt(2)
    assert run(few) == [(0, 1, 2, 0.0), (0, 2, 1, root), (2, 1, 0, 0.0), (2, 2, 1, root)]
    assert run(few[:1]) == run([]) == run([few[1]]) == run([(2, None, 1, 1, "x", 2)]) == []


def test_probing_finds_every_code_within_the_radius():
    random = np.random.default_rng(2)
    base = random.integers(0, 1 << 63, (6, ann.PARTS), dtype=np.uint64)
    held = base[random.integers(0, 6, 500)].copy()
    for row in held:
        for bit in random.integers(0, ann.BITS, random.integers(0, 40)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    points, ids = random.normal(size=(500, 3)), random.permutation(500)
    for radius in (0, 5, 7, 17, 30, 61, 255, 256):
        assert sum(s + 1 for s in ann.shares(radius)) >= radius + 1 or radius >= ann.BITS
        for q in range(6):
            found = [w for part in range(ann.PARTS) if ann.shares(radius)[part] >= 0
                     for w, _ in ann.search_cell(part, radius, base[q:q + 1], points[:1], held, points, ids, 500)]
            within = np.flatnonzero(np.bitwise_count(held ^ base[q]).sum(1) <= radius)
            assert sorted(np.concatenate(found)) == within.tolist()  # each once


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if usable(r)), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * e) for e in r[1]]))
    points = np.array([[math.floor(4096 * e) for e in r[1]] for r in kept], dtype=object).reshape(len(kept), parts, -1)
    books = points[:entries].transpose(1, 0, 2).copy()

    def assign():
        apart = ((points[:, :, None, :] - books[None]) ** 2).sum(3)
        index = apart.astype(np.int64).argmin(2)
        return index, apart.astype(np.int64).min(2).sum(1)

    for _ in range(rounds):
        index, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = points[index[:, p] == e, p]
                if len(mine):
                    books[p, e] = [s // len(mine) for s in mine.sum(0)]
    index, error = assign()
    labels = {}
    for r, e in zip(kept, error, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    return sorted((str(r[0]), i.tolist(), int(e), labels[r[2]]) for r, i, e in zip(kept, index, error, strict=True)), books.astype(np.int64)


@pytest.mark.parametrize("n", [300, 5])
def test_codes(spark, n):
    rows = vectors(n, 16) if n > 100 else vectors(n, 16)[:n]
    coded, books = codebooks.compress(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", "label")
    want, want_books = plain_codes(rows)
    assert (books == want_books).all()
    assert sorted((str(r.vec_id), list(r.code), r.error, r.label_error) for r in coded.collect()) == want


def test_codes_of_nothing_and_of_uneven_vectors(spark):
    for rows in ([], [(1, None, 1, 1, "x", 2)]):
        coded, books = codebooks.compress(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", "label")
        assert coded.count() == 0 and books.size == 0
    for bad in ([1.0] * 12, [1e9] * 16):
        with pytest.raises(ValueError):
            codebooks.compress(spark.createDataFrame([(1, [1.0] * 16, 1, 1, "x", 2), (2, bad, 1, 1, "x", 2)], VECTORS), "vec_id", "embedding", "label")


@pytest.mark.parametrize("side,most", [(1, 50), (7, 1000), (64, 1 << 16), (1024, 3)])
def test_memoised_cells_are_exact_and_prune(side, most):
    random = np.random.default_rng(3)
    book = random.integers(-300, 300, (16, 4))
    memo = codebooks.GridMemo(book, side, most)
    for _ in range(3):
        points = np.concatenate([random.integers(-400, 400, (3000, 4)), book + random.integers(-2, 2, book.shape)])
        apart = ((points[:, None] - book) ** 2).sum(2)
        index, error = memo.assign(points)
        assert (index == apart.argmin(1)).all() and (error == apart.min(1)).all()
    if side <= 64:
        assert memo.evaluated < 0.5 * 3 * 3016 * 16  # dominated entries are not evaluated


def test_equal_hashes_of_different_cells_do_not_mix():
    random = np.random.default_rng(4)
    book = random.integers(-300, 300, (16, 4))
    memo = codebooks.GridMemo(book, 64)
    memo.weights[:] = 0  # every cell has the same hash
    points = random.integers(-400, 400, (500, 4))
    assert (memo.assign(points)[0] == ((points[:, None] - book) ** 2).sum(2).argmin(1)).all()


def test_queries_give_the_contracts_columns(spark):
    assert queries.op11_multi_index_hashing(spark, queries_dir()).columns == ["query_id", "rank", "vec_id", "score"]
    assert queries.op12_vector_codes(spark, queries_dir()).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def queries_dir():
    return "/root/testdata/sf0.001"
