"""Line deduplication with two Bloom filters.

1. Every task hashes the line keys of its documents into two filters: *once* (key seen) and *twice*
   (key seen again). Filters are cut into slices, compressed and merged slice by slice:
   ``twice = twice_a | twice_b | (once_a & once_b)``; a merged bit is never lost, so a repeated key
   always tests positive.
2. A second pass tests every key against *twice*. Only suspects are shuffled, as a 16-byte digest
   with their document id; a grouped ``min``/``max`` confirms repeats exactly and picks the first
   document.
3. The digests to drop come back by document id and the lines are removed.

The filter has ``bits_per_line`` bits a line up to ``max_bits`` (the bound of what is broadcast); past
that bound more suspects are shuffled, the result stays the same.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

WHITE = b" \t\n\x0b\x0c\r"
SLICE_BITS = 1 << 20
HASHES = 4
FAN_IN = 256
LAST_ID = (1 << 63) - 1


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, A-Z lower-cased key of a line, None when it has under ``min_chars`` code points."""
    key = line.strip(WHITE).lower()
    if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars:
        return key
    return None


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def text_digests(text: str | None, min_chars: int) -> set[bytes]:
    keys = {line_key(x, min_chars) for x in (text or "").encode().split(b"\n")}
    keys.discard(None)
    return {digest(k) for k in keys}


def bit_positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """(n, HASHES) positions by double hashing of 16-byte digests, an (n, 2) uint64 array."""
    step = digests[:, 1] | np.uint64(1)
    return np.stack([(digests[:, 0] + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)], 1)


def _as_words(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8").reshape(-1, 2)


class TwoBloom:
    """Bit-packed once/twice filters of one task."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def _set(filt: np.ndarray, pos: np.ndarray) -> None:
        p = pos.ravel()
        np.bitwise_or.at(filt, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    @staticmethod
    def has(filt: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return ((filt[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, digests: np.ndarray) -> None:
        if not len(digests):
            return
        _, at, count = np.unique(digests[:, 0], return_index=True, return_counts=True)
        pos = bit_positions(digests[at], self.bits)
        again = (count > 1) | self.has(self.once, pos)
        self._set(self.twice, pos[again])
        self._set(self.once, pos)


def merge_slices(pdf: pd.DataFrame) -> tuple[bytes, bytes]:
    once = twice = None
    for o, t in zip(pdf["once"], pdf["twice"]):
        o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    return zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def twice_filter(docs: DataFrame, text_col: str, min_chars: int, bits: int) -> np.ndarray:
    """The merged *twice* filter (``bits`` / 8 bytes) over all lines of ``docs``."""
    width = min(SLICE_BITS, bits) // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = TwoBloom(bits)
        for b in batches:
            found = [d for t in b.column(0).to_pylist() for d in text_digests(t, min_chars)]
            bloom.add(_as_words(b"".join(found)))
        task = TaskContext.get().partitionId()
        for i in range(0, bits // 8, width):
            if bloom.once[i:i + width].any():
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([i // width], pa.int32()), "task": pa.array([task], pa.int64()),
                    "once": [zlib.compress(bloom.once[i:i + width].tobytes(), 1)],
                    "twice": [zlib.compress(bloom.twice[i:i + width].tobytes(), 1)]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = merge_slices(pdf)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1].values, "task": [pdf["task"].iloc[0] // FAN_IN],
                             "once": [once], "twice": [twice]})

    schema = "slice int, task long, once binary, twice binary"
    parts = materialize(docs.select(F.col(f"`{text_col}`")).mapInArrow(build, schema), "bloom")
    top = parts.agg(F.max("task")).first()[0]
    lanes = 0 if top is None else top + 1
    while lanes > 1:  # a tree of merges: no group holds more than FAN_IN slices
        lanes = -(-lanes // FAN_IN)
        parts = materialize(parts.groupBy("slice", (F.col("task") / FAN_IN).cast("long").alias("lane")).applyInPandas(
            lambda pdf: merge(pdf), schema), "bloom")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.select("slice", "twice").toLocalIterator():  # at most max_bits / 8 bytes in all
        out[row["slice"] * width:(row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                   bits_per_line: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """(doc, key): the digests of the lines that ``doc`` loses, as they occur in a smaller document."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(max_bits, 1 << max(13, int(lines * bits_per_line - 1).bit_length()))
    shared = spark.sparkContext.broadcast(twice_filter(docs, text_col, min_chars, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = shared.value
        for b in batches:
            ids, found = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = text_digests(t, min_chars)
                ids += [d] * len(keys)
                found += keys
            if not found:
                continue
            hit = np.flatnonzero(TwoBloom.has(filt, bit_positions(_as_words(b"".join(found)), bits)))
            yield pa.RecordBatch.from_pydict({"doc": pa.array([ids[i] for i in hit], pa.int64()),
                                              "key": pa.array([found[i] for i in hit], pa.binary())})

    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))
    suspect = materialize(docs.select(doc.alias("doc"), text.alias("text")).mapInArrow(suspects, "doc long, key binary"),
                          "suspects")
    shared.unpersist()  # its last reader is done
    first = suspect.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    first = materialize(first, "repeats")  # a plain table on both sides lets AQE split the join where a line is hot
    return suspect.join(first, "key").where("doc > first").select("doc", "key")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                bits_per_line: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space and A-Z lower-cased. A key of at least
    ``min_chars`` code points that occurs in two or more documents keeps its lines only in the
    document with the smallest id. Null or empty text is one empty line (a null text stays null);
    rows that share an id count as one document; a null id counts as the largest; input columns named
    ``n_lines`` or ``n_dropped`` are replaced, all others are kept; an empty table stays empty.
    """
    drops = repeated_lines(docs, id_col, text_col, min_chars, bits_per_line, max_bits)
    drops = drops.groupBy("doc").agg(F.collect_set("key").alias("keys"))
    kept_cols = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    key, keys, out = fresh(docs.columns, "line_doc", "line_keys", "line_out")
    left = docs.select(*[F.col(f"`{c}`") for c in kept_cols],
                       F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias(key))
    right = drops.select(F.col("doc").alias(key), F.col("keys").alias(keys))

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        rows = []
        for t, d in zip(texts, drop):
            if t is None or d is None or not len(d):
                rows.append((t, 1 + t.count("\n") if t else 1, 0))
                continue
            gone, lines = {bytes(x) for x in d}, t.encode().split(b"\n")
            keep = [x for x in lines if (k := line_key(x, min_chars)) is None or digest(k) not in gone]
            rows.append((b"\n".join(keep).decode(), len(lines), len(lines) - len(keep)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    # texts stream past a hash table of digests: sorting them by document for a merge join fills the executor's heap
    done = left.join(right.hint("shuffle_hash"), key, "left").withColumn(out, cut(F.col(f"`{text_col}`"), F.col(keys)))
    return done.select(*[F.col(f"{out}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept_cols],
                       F.col(f"{out}.n_lines").alias("n_lines"), F.col(f"{out}.n_dropped").alias("n_dropped"))
