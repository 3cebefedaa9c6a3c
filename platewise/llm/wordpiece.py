"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces form two tries, one for word starts and one for
continuations.  A node's failure link leads to where the greedy match stands
after the longest pieces at its front are taken off, and the node knows how
many those are; so a word is counted in one pass over its characters, without
backing up and without building a piece.  An empty word start stands for the
vocabulary's bare word mark: a word that no longer start fits takes it as its
first piece and goes on with continuations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from platewise.llm.store import fields, text_slices, texts

#: distinct chunks of text that a Python worker remembers
CACHE_CHUNKS = 250_000
_START, _INSIDE = 0, 1


class LongestMatch:
    """The automaton of a vocabulary: pieces that begin words, and pieces that continue them."""

    def __init__(self, starts: set[str], inside: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((_START, starts), (_INSIDE, inside)):
            for piece in filter(None, pieces):
                node = root
                for char in piece:
                    if char not in self.next[node]:
                        self.next[node][char] = len(self.next)
                        self.next.append({})
                    node = self.next[node][char]
                ends.add(node)
        self.link: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        if "" in starts:
            self.link[_START], self.popped[_START] = _INSIDE, 1
        level = [_START, _INSIDE]
        while level:  # by depth: links lead to shorter strings, or from starts to continuations as long
            for node in level:
                for char, child in self.next[node].items():
                    if child in ends:
                        self.link[child], self.popped[child] = _INSIDE, 1
                        continue
                    back, more = self.link[node], 0
                    while back is not None and char not in self.next[back]:
                        back, more = self.link[back], more + self.popped[back]
                    if back is not None:
                        self.link[child], self.popped[child] = self.next[back][char], self.popped[node] + more
            level = [child for node in level for child in self.next[node].values()]

    def count(self, word: str) -> int | None:
        """The number of pieces of a word; None if greedy matching gets stuck."""
        node, pieces = _START, 0
        for char in word:
            while char not in self.next[node]:
                if self.link[node] is None:
                    return None
                pieces, node = pieces + self.popped[node], self.link[node]
            node = self.next[node][char]
        while node != _INSIDE:
            if self.link[node] is None:
                return None
            pieces, node = pieces + self.popped[node], self.link[node]
        return pieces


def sentencepiece_vocabulary(path: str, mark: str = "▁") -> tuple[set[str], set[str]]:
    """Word starts and continuations of a sentencepiece file: pieces with the mark
    in front begin words (the mark alone is the empty start); control and byte
    pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return {p[1:] for p in pieces if p.startswith(mark)}, {p for p in pieces if not p.startswith(mark)}


_AUTOMATA: dict[int, tuple[LongestMatch, dict]] = {}


def count_tokens(docs: DataFrame, starts: set[str], inside: set[str]) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every whole text.

    Words are runs between ASCII white space.  A word that the vocabulary
    cannot spell is one unknown token.  Null and empty texts count 0; rows stay
    one by one, also repeated ones and those without doc_id; other columns are
    not read.
    """
    vocabulary = (tuple(sorted(starts)), tuple(sorted(inside)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(vocabulary)
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[key] = (LongestMatch(*map(set, vocabulary)), {})
        automaton, known = _AUTOMATA[key]
        for batch in batches:
            for part in text_slices(batch, "text"):
                split = pc.split_pattern(texts(part), " ")
                chunks = split.flatten().dictionary_encode()
                if len(known) > CACHE_CHUNKS:
                    known.clear()
                counts = np.array([_chunk(automaton, known, c) for c in chunks.dictionary.to_pylist()], np.int64).reshape(-1, 3)
                ends = split.offsets.to_numpy() - split.offsets[0].as_py()
                upto = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(counts[chunks.indices.to_numpy()], 0)])
                sums = upto[ends[1:]] - upto[ends[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in sums.T)], names=schema.names)

    schema = fields(docs, ["doc_id"], "n_words long, n_tokens long, n_unknown long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _chunk(automaton: LongestMatch, known: dict, chunk: str) -> tuple[int, int, int]:
    """Words, tokens and unknown words of a text between spaces (it may hold other white space)."""
    found = known.get(chunk)
    if found is None:
        pieces = [automaton.count(w.decode()) for w in chunk.encode().split()]  # bytes split at ASCII white space only
        unknown = pieces.count(None)
        found = (len(pieces), sum(p for p in pieces if p) + unknown, unknown)
        if len(chunk) <= 64:
            known[chunk] = found
    return found
