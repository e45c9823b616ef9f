"""Token ids of whole texts by a public tokenizer, with a cache of words.

The tokenizer drops white space and never joins characters across it, so a text's ids are those of
its words in a row. In Latin-1 text, where lower case and normal form are plain, a word without an
apostrophe falls apart further into runs of letters, single digits and runs of other signs. Each distinct run, or word of
other texts, goes through the tokenizer once for as long as the cache holds it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 300_000  # runs and words a worker holds: about 60 MB
LETTERS, DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"  # of lower-case Latin-1
RUNS = re.compile(f"[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
RUNS_OR_QUOTED = re.compile(f"[^\\s']*'\\S*|{RUNS.pattern}")
ODD_SPACE = re.compile("[\x1c-\x1f]")
PLAIN_SPACE = re.compile("[ \n\r\t]+")
#: byte-level models write a byte as its Latin-1 sign if that is visible, else as the next sign from 256 on
_HIDDEN = [b for b in range(256) if b < 33 or 127 <= b < 161 or b == 173]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(_HIDDEN)}
TEXTS_AT_ONCE = 1 << 20  # characters that are looked up together


class WordTokenizer:
    """Little-endian uint32 ids of texts; exact for tokenizers that split at white space, drop it, lower
    the case, and mark the last token of a run with ``</w>``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(self.last))]
        self.known: dict[str, bytes] = {}
        form = json.loads(self.tok.to_str())
        steps = [form["pre_tokenizer"], *(form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        # a run that is already lower-case and split can go to the merges at once, its bytes written as the model writes them
        self.bytewise = form["model"]["type"] == "BPE" and any(x and x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in steps)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_runs(self, runs: list[str]) -> None:
        if self.bytewise:
            merge, known, own = self.tok.model.tokenize, self.known, self.id_bytes
            for r in runs:
                word = r if r.isascii() and r.isprintable() else r.encode().decode("latin-1").translate(BYTE_SIGNS)
                known[r] = b"".join([own[t.id] for t in merge(word)])
            return
        for i in range(0, len(runs), 1000):
            part = runs[i:i + 1000]
            ids = np.frombuffer(self.encode([" ".join(part)])[0], "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                starts = np.concatenate(([0], ends[:-1]))
                self.known.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, starts.tolist(), ends.tolist()))
            else:
                self.known.update(zip(part, self.encode(part)))

    def _learn(self, plain: set[str], other: set[str]) -> None:
        """``plain``: runs of lower-case Latin-1 and its words with an apostrophe; ``other``: any words."""
        known = self.known
        if len(known) > CACHE:  # what this group of texts uses stays
            known = self.known = {w: known[w] for w in plain | other if w in known}
        new = [w for w in plain if w not in known]
        self._learn_runs([w for w in new if "'" not in w])
        whole = [w for w in new if "'" in w] + [w for w in other if w not in known]
        self.known.update(zip(whole, self.encode(whole)))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; texts go through in groups of about TEXTS_AT_ONCE characters, longer ones in slices that
        end at white space."""
        held, size = [], 0
        for t in texts:
            if len(t) > TEXTS_AT_ONCE:
                yield from self._ids(held)
                held, size, at, parts = [], 0, 0, []
                while at < len(t):
                    cut = PLAIN_SPACE.search(t, at + TEXTS_AT_ONCE)
                    end = cut.end() if cut else len(t)
                    parts += self._ids([t[at:end]])
                    at = end
                yield b"".join(parts)
                continue
            held.append(t)
            size += len(t)
            if size >= TEXTS_AT_ONCE:
                yield from self._ids(held)
                held, size = [], 0
        yield from self._ids(held)

    def _ids(self, texts: list[str]) -> list[bytes]:
        plain, other, cut = set(), set(), []
        for t in texts:
            try:
                t.encode("latin-1")
                if ODD_SPACE.search(t):
                    runs = None
                else:
                    t = t.lower()
                    runs = (RUNS_OR_QUOTED if "'" in t else RUNS).findall(t)
                    plain.update(runs)
            except UnicodeEncodeError:
                runs = [w for w in PLAIN_SPACE.split(t) if w]
                other.update(runs)
            cut.append(runs)
        self._learn(plain, other - plain)
        get = self.known.__getitem__
        return [self.encode([t])[0] if runs is None else b"".join(map(get, runs)) for t, runs in zip(texts, cut)]


@cache
def word_tokenizer(name: str) -> WordTokenizer:
    """``name``: a path, or without a folder the name of a public tokenizer."""
    if not os.path.dirname(name):
        import public_tokenizers
        name = public_tokenizers.path(name)
    return WordTokenizer(name)


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (``id_col``, piece, start, length, ids_crc32[, ids]).

    A document is the ids of its whole text and then ``end_id``; only a longer one is cut, all pieces but
    its last are full. A null or empty text is ``end_id`` alone. Ids may be null or repeat: each row is cut
    for itself. ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            at, piece, length, crc, ids = [], [], [], [], []
            for i, got in enumerate(tok.ids([t or "" for t in b.column(1).to_pylist()])):
                got += end
                for p, s in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[s:s + 4 * capacity]
                    at.append(i)
                    piece.append(p)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            p = np.array(piece, np.int64)
            cols = {"id": b.column(0).take(pa.array(at, pa.int64())), "piece": pa.array(p.astype(np.int32)), "start": pa.array(p * capacity),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return src.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
