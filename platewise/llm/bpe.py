"""Byte-level BPE over Arrow batches with the tokenizers library.

The result equals the library's for every whole text.  Texts of characters
whose classes are beyond dispute are merged by rank (tiktoken: the same ids,
sooner and without a memory), if the file's tokens are numbered in the order of
their merges.  Other texts are cut into chunks at spaces where the
pre-tokenizer always has a boundary; the distinct chunks of a batch are encoded
once (and remembered for the task, within ``CACHE_CHARS``), and the ids of the
texts are put together by array indexing.  A text that holds the string of an
added token is encoded whole by the library.

Why the cut is safe: no piece of the pattern holds a space except as its first
character or inside a run of white space.  Before a space there is therefore
always a boundary if the character before it is not white space, or if the
space is the last of its run and a word follows.  Texts with other spaces
(longer runs) are cut only after non-white-space.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: characters of the distinct chunks in a generation of a task's memory (two: about 60 MB, with the ids and the table)
CACHE_CHARS = 1 << 20
#: longer chunks are encoded each time
LONGEST_CACHED = 64

_WS = r"[\s\x0B\x{85}\p{Z}]"
_WIDE_RUN = rf"{_WS} (?:{_WS}|$)"
_AFTER_WORD = re.compile(r"(?<=\S)(?= )")
# Characters whose letter / digit / space class no Unicode version disputes.
_PLAIN = re.compile(r"[\t\n\x20-\x7EÀ-ÖØ-öø-ɏ]*\Z")
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf" ?[{_LETTER}]+")
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\t\n {_LETTER}0-9]+|[\t\n ]+(?![^\t\n ])|[\t\n ]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(kept))
    return [table[b] for b in range(256)]


_TO_CHARS = dict(enumerate(byte_chars()))


def _le32(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


def as_byte_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


class ChunkEncoder:
    """Encodes arrays of texts with one tokenizer (byte-level BPE, the pattern
    of the byte-level vocabularies)."""

    def __init__(self, tokenizer_json: str, added: bool = True):
        """``added``: the strings of added tokens in a text are those tokens, as in the library, else ordinary text."""
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.model = self.tokenizer.model
        self.ranked = _rank_encoding(tokenizer_json)
        self.forget()

    def forget(self) -> None:
        """Empty the memory of chunks."""
        # two generations: what is in use moves to the young one
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._chars = 0

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32, all texts in a row) and offsets (one more than texts)."""
        if self.ranked is None:
            return self._by_chunks(array)
        texts = array.to_pylist()
        plain = np.array([_PLAIN.match(t) is not None and not any(a in t for a in self.added) for t in texts], bool)
        others, ends = self._by_chunks(array.filter(pa.array(~plain)))
        lists = [self.ranked.encode_ordinary(t) for t, p in zip(texts, plain, strict=True) if p]
        count = np.empty(len(array), np.int64)
        count[~plain] = np.diff(ends)
        count[plain] = np.fromiter(map(len, lists), np.int64, len(lists))
        ids, ranked = np.empty(count.sum(), np.uint32), np.repeat(plain, count)
        ids[~ranked] = others
        ids[ranked] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, count[plain].sum())
        return ids, np.concatenate([[0], np.cumsum(count)])

    def _by_chunks(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(array):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        wide = pc.match_substring_regex(array, _WIDE_RUN)
        held = pa.array(np.zeros(len(array), bool))
        for token in self.added:
            held = pc.or_(held, pc.match_substring(array, token))
        wide = pc.or_(wide, held)
        split = pc.split_pattern(pc.if_else(wide, "", array), " ")
        firsts = split.offsets.to_numpy()
        firsts, words = firsts - firsts[0], split.flatten().dictionary_encode()
        index = words.indices.to_numpy().copy()
        entries = self._all([f" {w}" for w in words.dictionary.to_pylist()])
        # a text's first chunk has no space before it: an entry of its own per text
        index[firsts[:-1]] = len(entries) + np.arange(len(array))
        heads = self._all(pc.list_element(split, 0).to_pylist())
        for i in np.flatnonzero(wide.to_numpy(zero_copy_only=False)):
            text = array[int(i)].as_py()
            heads[i] = self._library(text) if held[int(i)].as_py() else b"".join(self._all(_AFTER_WORD.split(text)))
        entries += heads

        flat = np.frombuffer(b"".join(entries), "<u4")
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        starts = np.cumsum(sizes) - sizes
        lens = sizes[index]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = flat[np.repeat(starts[index] - ends[:-1], lens) + np.arange(ends[-1])]
        return ids, ends[firsts]

    def _all(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        if self._chars > CACHE_CHARS:
            self._old, self._young, self._chars = self._young, {}, 0
        young, old, out = self._young, self._old, []
        for chunk in chunks:
            ids = young.get(chunk)
            if ids is None:
                ids = old.get(chunk)
                if ids is None:
                    ids = self._encode(chunk)
                if len(chunk) <= LONGEST_CACHED:
                    young[chunk] = ids
                    self._chars += len(chunk)
            out.append(ids)
        return out

    def _encode(self, chunk: str) -> bytes:
        word = _WORD.match(chunk)
        if word:  # a word, or a word and what follows it up to the next space
            if word.end() == len(chunk):
                return self._piece(chunk)
            return b"".join(self._all([word[0], chunk[word.end():]]))
        if _PLAIN.match(chunk):
            return b"".join(map(self._piece, _PIECES.findall(chunk)))
        return self._library(chunk)

    def _library(self, text: str) -> bytes:
        return _le32(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _piece(self, piece: str) -> bytes:
        return _le32([t.id for t in self.model.tokenize(as_byte_chars(piece.encode()))])


def token_bytes(tokenizer_json: str) -> list[bytes | None]:
    """The bytes of every id (an id without token: null)."""
    byte_of = {c: b for b, c in enumerate(byte_chars())}
    spec = json.loads(tokenizer_json)
    vocab = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    vocab |= {i: bytes(map(byte_of.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if i not in vocab}
    return [vocab.get(i) for i in range(max(vocab, default=-1) + 1)]


def _rank_encoding(tokenizer_json: str):
    """The tiktoken encoding with the same ids, if the file's tokens are numbered in the order of their merges (else null)."""
    import public_tokenizers
    import tiktoken

    spec = json.loads(tokenizer_json)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in merges]
    if any(x >= y for x, y in zip(made, made[1:])) or spec["pre_tokenizer"].get("type") != "ByteLevel":
        return None
    added = {t["id"] for t in spec["added_tokens"]}
    ranks = {t: i for i, t in enumerate(token_bytes(tokenizer_json)) if t is not None and i not in added}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[int, ChunkEncoder] = {}


@contextlib.contextmanager
def encoder(tokenizer_json: str) -> Iterator[ChunkEncoder]:
    """The Python worker's encoder for this tokenizer; it forgets its chunks at the end."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(tokenizer_json)
    try:
        yield _ENCODERS[key]
    finally:
        _ENCODERS[key].forget() if key in _ENCODERS else None
