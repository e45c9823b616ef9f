"""Importance resampling towards a target corpus, features hashed from prefix CRCs.

A document is scanned once in its separator-normalised form (every word preceded by one space); the
running CRC after each word is stored. The CRC of any run of words follows from the two
prefixes around it: crc(AB) is crc(A) shifted by len(B) zero bytes, xor crc(B), and the shift is a linear map
over GF(2), put together from its powers of two. Buckets are counted in both corpora, a bucket's log ratio is
its gain, and documents are drawn without replacement by weight plus Gumbel noise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import _bucket_tree, default_buckets, split_points
from .common import materialize

#: A-Z are lowered; digits, letters and all bytes of non-ASCII signs make words, all else is a space
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb" [^ ]+")
WORDS_AT_ONCE = 200_000
SLICE = 1 << 20  # bytes of a text cut into words at once


@cache
def _shift_tables(power: int) -> np.ndarray:
    """(4, 256) images of the register's bytes under a shift by 2**power zero bytes."""
    if power:
        half, basis = _shift_tables(power - 1), np.uint32(1) << np.arange(32, dtype=np.uint32)
        images = _apply(half, _apply(half, basis))
    else:
        images = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            images = (images >> np.uint32(1)) ^ np.where(images & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, images[8 * j:8 * j + 8], np.uint32(0)), axis=1) for j in range(4)])


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs after ``n`` more zero bytes each, without the initial and final inversion."""
    crc, power = crc.astype(np.uint32, copy=True), 0
    while (n >> power).any():
        at = np.flatnonzero((n >> power) & 1)
        crc[at] = _apply(_shift_tables(power), crc[at])
        power += 1
    return crc


def _words(text: bytes) -> Iterator[list[bytes]]:
    normal, at = b" " + text.translate(NORMAL), 0
    while at < len(normal):
        end = normal.find(b" ", at + SLICE)
        end = len(normal) if end < 0 else end
        yield WORD.findall(normal, at, end)
        at = end


def ngram_crcs(texts: list[bytes | None], sizes: range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of each feature, its CRC-32, document of each word) in blocks; the features are the runs of
    ``sizes`` consecutive words joined by one space."""
    space, most = np.uint32(crc32(b" ")), max(sizes) - 1
    none = np.zeros(0, np.int64)
    held = (none, none.astype(np.uint32), none.astype(np.uint32), none)  # last words: document, CRC at start and end, length
    docs, ends, starts, lengths, waiting = [], [], [], [], 0

    def block():
        nonlocal held
        words = np.concatenate(docs)
        end = np.concatenate(ends).astype(np.uint32)
        before = np.concatenate(starts).astype(np.uint32)
        start = _apply(_shift_tables(0), before) ^ space  # one space after the word before
        fresh = (words, start, end, np.concatenate(lengths))
        doc, start, end, length = (np.concatenate(x) for x in zip(held, fresh))
        old, position = len(held[0]), np.cumsum(length + 1)
        out_doc, out_crc = [], []
        for g in sizes:
            j = np.arange(max(old, g - 1), len(doc))
            i = j - (g - 1)
            same = doc[i] == doc[j]
            i, j = i[same], j[same]
            size = position[j] - position[i] + length[i]
            out_doc.append(doc[j])
            out_crc.append(end[j] ^ shift(start[i], size))
        held = tuple(x[len(x) - most:] if most < len(x) else x for x in (doc, start, end, length)) if most else held
        return np.concatenate(out_doc), np.concatenate(out_crc), words

    for d, text in enumerate(texts):
        crc = 0
        for words in _words(text or b""):
            if not words:
                continue
            run = np.fromiter(accumulate(words, lambda c, w: crc32(w, c), initial=crc), np.uint64, len(words) + 1)
            crc = int(run[-1])
            docs.append(np.full(len(words), d))
            starts.append(run[:-1])
            ends.append(run[1:])
            lengths.append(np.fromiter(map(len, words), np.int64, len(words)) - 1)
            waiting += len(words)
            if waiting >= WORDS_AT_ONCE:
                yield block()
                docs, ends, starts, lengths, waiting = [], [], [], [], 0
    if waiting:
        yield block()


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, text_col: str, sizes: range, buckets: int) -> DataFrame:
    """(bucket, n) of all features of all texts; a task sends one row a bucket that it met."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            for _, crc, _ in ngram_crcs(_bytes(b.column(0)), sizes):
                held += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(held[at])], names=["bucket", "n"])

    found = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket, in thousandths of a nat: the log ratio of its smoothed shares in the target and the source,
    rounded down. At most ``buckets`` rows reach the driver."""
    sides = []
    for df in (source, target):
        n = np.zeros(buckets)
        for r in df.collect():
            n[r["bucket"]] = r["n"]
        sides.append(n)
    s, t = sides
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def importance_resample(docs: DataFrame, target: DataFrame, max_words: int = 2, buckets: int = 10_000, percent: int = 10,
                        min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
                        target_text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(``id_col``, n_features, weight, score, rank[, ``text_col``]) for every row of ``docs``; rank is 1, 2, 3... for the drawn
    documents, null for the others.

    Features are the runs of 1 to ``max_words`` words, in ``buckets`` buckets by CRC-32. A document's weight is
    the sum of its features' gains; its score adds Gumbel noise made from a hash of ``seed`` and its id. Of
    the documents with at least ``min_words`` words, ``percent`` % with the highest scores are drawn (rounded down),
    ties to the smaller id, then to fewer features.

    A null text is empty: no feature, weight 0, and never drawn unless ``min_words`` is 0. Rows with equal ids are documents
    of their own with equal noise; a null id is hashed as an empty one and comes after all others in a tie. An empty
    target leaves all target counts 0. Other columns of either table are not read.
    """
    spark, sizes = docs.sparkSession, range(1, max_words + 1)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col, sizes, buckets),
                                              bucket_counts(target, target_text_col, sizes, buckets), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = gain.value.astype(np.float64)
        for b in batches:
            n, weight, words = np.zeros(len(b), np.int64), np.zeros(len(b)), np.zeros(len(b), np.int64)
            for doc, crc, of_word in ngram_crcs(_bytes(b.column(1)), sizes):
                n += np.bincount(doc, minlength=len(b))
                weight += np.bincount(doc, g[crc % np.uint32(buckets)], len(b))
                words += np.bincount(of_word, minlength=len(b))
            cols = [b.column(0), pa.array(n), pa.array(weight.astype(np.int64)), pa.array(words)]
            yield pa.RecordBatch.from_arrays(cols + [b.column(1)] * with_text, names=["id", "n_features", "weight", "words"] + ["text"] * with_text)

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, n_features long, weight long, words long" + ", text string" * with_text
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(src.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise), "importance")
    able = scored.where(F.col("words") >= min_words)
    draws = able.count() * percent // 100
    ranked = _ranked(able, draws).unionByName(scored.where(F.col("words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    named = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(*named, *([F.col("text").alias(text_col)] if with_text else []))


def _ranked(rows: DataFrame, draws: int) -> DataFrame:
    """``rows`` with their rank among the ``draws`` highest scores, else null: score ranges from approximate
    quantiles, each sorted alone after the totals of the ranges above it; only ranges that a drawn row can
    stand in are sorted. Equal rows are one row until they are ranked."""
    if "text" not in rows.columns:
        rows = rows.groupBy(rows.columns).count()
    else:
        rows = rows.withColumn("count", F.lit(1).cast("long"))
    splits = split_points(rows, "score", default_buckets(rows)).get((), [])
    rows = rows.withColumn("range", _bucket_tree(F.col("score"), splits))
    above, before = {}, 0
    for r in sorted(rows.groupBy("range").agg(F.sum("count").alias("n")).collect(), key=lambda r: -r["range"]):  # at most a row a range
        above[r["range"]] = before
        before += r["n"]
    lowest = min((k for k, v in above.items() if v < draws), default=len(splits) + 1)
    offset = F.element_at(F.lit([above.get(i, 0) for i in range(len(splits) + 1)]).cast("array<long>"), F.col("range") + 1)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features")] + [F.asc("text")] * ("text" in rows.columns)
    w = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = rows.where(F.col("range") >= lowest).withColumn("last", offset + F.sum("count").over(w))
    sorted_ = sorted_.withColumn("copy", F.explode(F.sequence(F.col("last") - F.col("count") + 1, F.col("last")))).drop("last")
    sorted_ = sorted_.withColumn("rank", F.when(F.col("copy") <= draws, F.col("copy")))
    rest = rows.where(F.col("range") < lowest).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).withColumn(
        "rank", F.lit(None).cast("long"))
    return sorted_.unionByName(rest).drop("count", "range", "copy")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, ids and texts, best first by ``rank``."""
    return importance_resample(docs, target, with_text=True, **options).where("rank is not null")
