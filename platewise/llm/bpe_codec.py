"""Byte-level BPE encoding and decoding with the tokenizers library.

``rank_tokenizer`` builds a tokenizers BPE from a rank file (one token and its
rank a line): the token bytes become characters by the byte table, and each
token's merge is the pair that merging by rank arrives at just before it.
``encode`` maps Arrow batches of texts to ids (and the character span of every
token); ``decode`` maps ids back to bytes and text.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from platewise.llm import bpe
from platewise.llm.store import fields, text_slices, texts

#: UTF-8 of the replacement character, the bytes of an id that is null or outside the vocabulary
_UNKNOWN = "�".encode()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def rank_tokenizer(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers JSON that encodes like merging by ``ranks`` within each match of ``pattern``."""
    name = {t: bpe.as_byte_chars(t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and (pair := _last_pair(token, ranks)):
            merges.append([name[pair[0]], name[pair[1]]])
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,  # a match that is a token is that token
                  "vocab": {name[t]: r for t, r in ranks.items()}, "merges": merges}})


def _last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by rank leaves of ``token`` before the last merge."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            return None
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def _token_bytes(tokenizer_json: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in a row, and their places and sizes by id; the last entry stands for unknown ids."""
    table = [_UNKNOWN if t is None else t for t in bpe.token_bytes(tokenizer_json)] + [_UNKNOWN]
    size = np.array([len(t) for t in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, tokenizer_json: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; with ``offsets`` also
    the token's first character and the one after its last (a token that holds
    part of a character's bytes spans that character).

    Null and empty texts have no ids.  Rows stay one by one, also repeated
    ones and those without doc_id; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _token_bytes(tokenizer_json)[2] if offsets else None
        with bpe.encoder(tokenizer_json) as encoder:
            for part in (p for batch in batches for p in text_slices(batch, "text")):
                text = texts(part)
                ids, ends = encoder.encode(text)
                out = [part.column("doc_id"), _lists(ids, ends)]
                if offsets:
                    out += [_lists(s, ends) for s in _char_spans(text, ids, ends, size)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    schema = fields(docs, ["doc_id"], "ids array<int>" + ", starts array<int>, ends array<int>" * offsets)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _char_spans(text: pa.Array, ids: np.ndarray, ends: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last, of each token, counted in its text."""
    data = "".join(text.to_pylist()).encode()
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # the character each byte belongs to
    stop = np.cumsum(size[ids])
    chars = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    base = np.repeat(np.cumsum(chars) - chars, np.diff(ends))
    return char[stop - size[ids]] - base, char[stop - 1] + 1 - base


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """``encoded`` (with a column ids) and its decoded bytes and decoded_text.

    The bytes of the tokens are put in a row, so characters that tokens split
    come out whole; bytes that are no UTF-8 (a list of ids cut within a
    character) become U+FFFD in the text, as do null or unknown ids.  Null ids
    decode to nothing.  Columns named like the result's are replaced.
    """
    kept = [c for c in encoded.columns if c not in ("decoded", "decoded_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, start, size = _token_bytes(tokenizer_json)
        for batch in batches:
            step = max(1, 1024 * len(batch) // max(1, len(batch.column("ids").flatten()) // 1024))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                lists = part.column("ids")
                lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = np.where((ids < 0) | (ids >= len(size)), len(size) - 1, ids)
                n = size[ids]
                data = flat[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(lens)])]
                raw = data.tobytes()
                rows = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(rows, pa.binary()),
                     pa.array([r.decode(errors="replace") for r in rows], pa.string())], names=schema.names)

    schema = fields(encoded, kept, "decoded binary, decoded_text string")
    return encoded.select(*kept).mapInArrow(run, schema)
