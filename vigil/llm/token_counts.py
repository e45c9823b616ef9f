"""Greedy longest-match word-piece counts in linear time.

The vocabulary is a trie with failure links. When the trie has no edge for the next character, the
matcher pops the pieces that the longest-match rule fixes for what it has read and goes on at the
failure node, without reading a character twice. How many pieces each failure pops is worked out
once, so a word's length is a sum of small numbers and no piece is ever built.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = 1 << 40  # added to a word's value if it has no pieces
CACHE_WORDS = 500_000


class PieceCounter:
    """Counts the pieces of a word: the longest first piece, then longest continuations."""

    def __init__(self, first: Iterable[str], rest: Iterable[str], prefix: str = ""):
        self.prefix = prefix
        self.edges: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: after a piece
        whole = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.edges[node].get(c)
                    if nxt is None:
                        nxt = len(self.edges)
                        self.edges[node][c] = nxt
                        self.edges.append({})
                        whole.append(False)
                    node = nxt
                if piece:
                    whole[node] = True
        self.fail: list[int] = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for c, v in self.edges[u].items():
                if whole[v]:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.edges[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.edges[z][c], n
                todo.append(v)

    def count(self, word: str) -> int | None:
        """Number of pieces, None if the word cannot be cut into pieces."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for c in self.prefix + word:
            while (nxt := edges[node].get(c)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return None
            node = nxt
        while node > 1:
            total += pops[node]
            node = fail[node]
        return total if node == 1 else None


def piece_lists(vocabulary: str) -> tuple[list[str], list[str], str]:
    """(first pieces, continuation pieces, word prefix) of a vocabulary file: a sentencepiece model, whose
    pieces mark the start of a word, or a text file with a piece a line and ``##`` before continuations.
    A name without a folder is looked up among the public tokenizers."""
    if not os.path.dirname(vocabulary):
        import public_tokenizers
        vocabulary = public_tokenizers.path(vocabulary)
    if vocabulary.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        mark = "▁"
        return [p for p in pieces if p.startswith(mark)], [p for p in pieces if not p.startswith(mark)], mark
    with open(vocabulary, encoding="utf-8") as f:
        pieces = [x.rstrip("\n") for x in f]
    return [p for p in pieces if not p.startswith("##")], [p[2:] for p in pieces if p.startswith("##")], ""


class _Words(dict):
    """Cache: word bytes -> pieces, plus UNKNOWN for a word that is one unknown token."""

    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        n = self.counter.count(word.decode())
        value = 1 + UNKNOWN if n is None else n
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


@cache
def _words(vocabulary: str) -> _Words:
    return _Words(PieceCounter(*piece_lists(vocabulary)))


def token_counts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, n_tokens, n_unknown) of every whole text, one row per input row.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. A word is cut into the longest piece that starts it and then
    the longest continuations; a word that cannot be cut so counts as one unknown token. A null or empty
    text has no words; repeated rows come back once each, ids may be null; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary)
        for b in batches:
            n_words, sums = [], []
            for t in b.column(1).to_pylist():
                w = t.encode().split() if t else []
                n_words.append(len(w))
                sums.append(sum(map(words.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array([s % UNKNOWN for s in sums], pa.int64()),
                                              pa.array([s // UNKNOWN for s in sums], pa.int64())],
                                             names=["id", "n_words", "n_tokens", "n_unknown"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
