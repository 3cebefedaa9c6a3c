"""Tokenizer alignment against plain tokenisation and a walk over all pairs."""

import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from platewise.llm import alignment, bpe

SCHEMA = "doc_id long, text string, row string, pair int, n_a string"
TEXTS = ["the river walks over the light house", "der Fluß läuft grün  und\n\nweiter", None, "", " ", "x", " two  spaces ", "a b ", "中文 und 😀😀 é é ﬁ",
         "<|endoftext|> plain </s> <s> <unk>", "tab\tand\x0bfeed\r\n", "12345 67 8", "word " * 700 + "y" * 3000, "▁ marks ▁▁ in text", "<0x41> is a byte piece", "\x00nul"]


def rows():
    return [(i, t, "r", 7, "n") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "r", 7, "n"), (None, TEXTS[1], "r", 7, "n")]


@pytest.fixture(scope="module")
def models():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(P.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def plain_tokens(models):
    a = tokenizers.Tokenizer.from_str(models[0])
    a.encode_special_tokens = True
    a_bytes = bpe.token_bytes(models[0])
    b = sentencepiece.SentencePieceProcessor(model_proto=models[1])

    def piece(i):
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b.is_byte(i) else text.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        mine = [(i, a_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, piece(i)) for i in b.encode(text, num_threads=1)]
        want = b" " + text.encode()
        same = all(b"".join(t for _, t in side) == want for side in (mine, other))
        return (mine, other) if same else ([], [])

    return tokens


def spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain_compare(models, texts):
    tokens = plain_tokens(models)
    each, counts = [], collections.Counter()
    for text in texts:
        a, b = map(spans, tokens(text))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [",".join(str(i) for i, _, e in a if x < e <= y) + "|" + ",".join(str(i) for i, _, e in b if x < e <= y)
                  for x, y in zip([0, *ends], ends)]
        linked, near = [], 0
        for i, s, e in a:
            while near < len(b) and b[near][2] <= s:
                near += 1
            at = near
            while at < len(b) and b[at][1] < e:
                linked.append((i, b[at][0]))
                at += 1
        counts.update(linked)
        each.append((len(a), len(b), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(n_a, n_b, g, len(linked), sum(counts[p] == most[p[1]] for p in linked), sum(counts[p] for p in linked), digest)
            for n_a, n_b, g, linked, digest in each]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_compare(spark, models, broadcast_pairs):
    data = rows()
    want = collections.Counter((r[0], *x) for r, x in zip(data, plain_compare(models, [r[1] for r in data]), strict=True))
    got = alignment.compare(spark.createDataFrame(data, SCHEMA), *models, broadcast_pairs=broadcast_pairs).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert sum(r.n_a > 0 for r in got) > 10


def test_compare_empty_table(spark, models):
    assert alignment.compare(spark.createDataFrame([], SCHEMA), *models).count() == 0


def test_pieces_of_any_size_give_the_same(models):
    both = alignment.Pair(*models)
    import pyarrow as pa
    a_ids, _, b_ids, _ = both.tokens(pa.array([t or "" for t in TEXTS], pa.large_string()))
    a, b = np.cumsum(both.a_size[a_ids]), np.cumsum(both.b_size[b_ids])
    whole = [sorted(zip(*alignment.align(a, b)[:2], strict=True)), *(x.tolist() for x in alignment.align(a, b)[2:])]
    for piece in (1, 2, 3, 7, 64, 1000):
        left, right, *stops = alignment.align(a, b, piece)
        assert [sorted(zip(left, right, strict=True)), *(x.tolist() for x in stops)] == whole
        i, j = alignment.diagonal_cuts(a, b, piece)
        work = np.diff(i) + np.diff(j)
        assert (work[:-1] == piece).all() and 0 < work[-1] <= piece
        assert i[-1] == len(a) and j[-1] == len(b)


def test_random_ends_against_all_pairs():
    random = np.random.default_rng(13)
    for _ in range(200):
        total = int(random.integers(1, 60))
        a, b = (np.append(np.flatnonzero(random.random(total - 1) < random.random()) + 1, total) for _ in range(2))
        left, right, a_stop, b_stop = alignment.align(a, b, int(random.integers(1, 9)))
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(a[i], b[j])]
        assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == want
        common = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[a_stop - 1].tolist() == b[b_stop - 1].tolist() == common
    assert all(len(x) == 0 for x in alignment.align(np.zeros(0, np.int64), np.zeros(0, np.int64)))
