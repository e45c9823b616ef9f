"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the longest known phrase plus one character). The set
of phrases is hashed and the smallest hashes are the fingerprint; two fingerprints estimate
how many phrases the texts share, a likeness akin to that of compressing one with the other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = 128  # hashes kept
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")


def lz_phrases(text: str, stop: int, known: set[str], start: int = 0) -> tuple[list[int], int]:
    """Parse ``text[start:stop]`` into new phrases, added to ``known``: their ends, and where the first
    phrase that does not end by ``stop`` starts."""
    ends, i, size = [], start, 2
    learn, end = known.add, ends.append
    while i < stop:
        j = i + size  # the last phrase's length: every prefix of a known phrase is known, so the search may start anywhere
        if j > stop:
            j = stop
        phrase = text[i:j]
        if phrase in known:
            while True:
                j += 1
                if j > stop:
                    return ends, i
                phrase = text[i:j]
                if phrase not in known:
                    break
        else:
            while j > i + 1:
                shorter = text[i:j - 1]
                if shorter in known:
                    break
                phrase = shorter
                j -= 1
        learn(phrase)
        end(j)
        size, i = j - i, j
    return ends, i


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, n.bit_length())
            for name, base in (("up", MULTIPLIER), ("down", INVERSE)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(cls, name, np.multiply.accumulate(factors))
        return cls.up[:n], cls.down[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def phrase_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32-bit hashes of ``points[s:e]``, equal for equal phrases wherever they stand."""
    up, down = _Powers.of(len(points) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32)


def _smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    if len(hashes) > 8 * k:  # the k smallest distinct ones are among few small values, nearly always
        few = np.unique(hashes[hashes < (1 << 32) // len(hashes) * 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def _starts(first: int, ends: list[int]) -> np.ndarray:
    return np.array([first, *ends[:-1]], np.int64)


def _hash_parse(points: np.ndarray, first: int, ends: list[int]) -> np.ndarray:
    if not ends:
        return np.zeros(0, np.uint32)
    return phrase_hashes(points, _starts(first, ends), np.array(ends, np.int64))


def signature(text: str, k: int = SIGNATURE) -> np.ndarray:
    """The ``k`` smallest distinct phrase hashes of a text, sorted."""
    ends, _ = lz_phrases(text, len(text), set())
    return _smallest(_hash_parse(code_points(text), 0, ends), k)


def signatures_of_edit(text: str, tail: str, k: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of ``text`` and of ``text`` with its last third replaced by ``tail``, and the edited text.
    What both texts begin with is parsed once."""
    cut = len(text) - len(text) // 3
    edited = text[:cut] + tail
    known: set[str] = set()
    head, at = lz_phrases(text, cut, known)
    other = set(known)
    own_ends, _ = lz_phrases(text, len(text), known, at)
    edit_ends, _ = lz_phrases(edited, len(edited), other, at)
    points = code_points(text)
    common = _hash_parse(points, 0, head)
    own = np.concatenate((common, _hash_parse(points, at, own_ends)))
    new = np.concatenate((common, _hash_parse(code_points(edited), at, edit_ends)))
    return _smallest(own, k), _smallest(new, k), edited


def likeness(a: np.ndarray, b: np.ndarray, k: int = SIGNATURE) -> float:
    """Estimated share of common phrases among all phrases of two texts; 1 for two texts without any."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def encode(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype(">u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def fingerprint_documents(docs: DataFrame, text_col: str = "text", k: int = SIGNATURE) -> DataFrame:
    """``docs`` with ``fingerprint``: base64 of the ``k`` smallest phrase hashes of the whole text. A null or
    empty text has the empty fingerprint; an input column of that name is replaced."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(signature(t or "", k)) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", run(F.col(f"`{text_col}`")))


def likeness_of(a: str, b: str, k: int = SIGNATURE):
    """Column: likeness of two fingerprint columns made with the same ``k``."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(decode(p), decode(q), k) for p, q in zip(x, y)], dtype=float)

    return run(F.col(a), F.col(b))


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, part, ahead) dealt to ranges of ids and sorted; each range begins with the row that
    precedes it (``ahead``), the lowest with the row of the largest id."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    cuts = sorted({int(c) for c in src.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    part = F.lit(0)
    if cuts:
        part = F.coalesce(F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c <= F.col("id"))), F.lit(0))
    dealt = src.withColumn("part", part)
    tops = dealt.groupBy("part").agg(F.max("id").alias("top")).orderBy("part").collect()  # one row a range
    if not tops:
        return dealt.withColumn("ahead", F.lit(False))
    follows = {r["part"]: tops[(i + 1) % len(tops)]["part"] for i, r in enumerate(tops)}
    size = max(follows) + 1
    top_of = {r["part"]: r["top"] for r in tops}
    top = F.lit([top_of.get(p) for p in range(size)]).cast("array<long>") if any(v is not None for v in top_of.values()) \
        else F.array_repeat(F.lit(None).cast("long"), size)
    after = F.lit([follows.get(p, 0) for p in range(size)]).cast("array<int>")
    stay = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.get(after, F.col("part")).alias("part"), F.lit(True).alias("ahead"))
    spread = dealt.withColumn("to", F.explode(F.when(F.col("id").eqNullSafe(F.get(top, F.col("part"))), F.array(stay, ahead))
                                              .otherwise(F.array(stay))))
    spread = spread.select("id", "text", F.col("to.part").alias("part"), F.col("to.ahead").alias("ahead"))
    return spread.repartitionById(size, F.col("part")).sortWithinPartitions(
        F.desc("ahead"), F.asc_nulls_first("id"), F.asc_nulls_first("text"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SIGNATURE) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, with two likenesses.

    The edited text replaces the last floor(n_chars / 3) code points by the first as many (or all) of the
    next document in descending id (after the last: the first). Returns ``id_col`` (long), ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``. A null text
    is empty and has the empty fingerprint; two empty fingerprints have likeness 1, an empty and another
    0; rows that share an id are ordered by their text, null ids are last in descending order; a
    single document is its own next; other columns are not read.
    """
    rows = _neighbours(docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long")), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (text, signature) of the document that precedes in ascending order
        for b in batches:
            out = []
            for i, text, ahead in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                text = text or ""
                if ahead:
                    before = (text, None)
                    continue
                if before[1] is None:
                    before = (before[0], signature(before[0], k))
                sig, new, edited = signatures_of_edit(text, before[0][:len(text) // 3], k)
                out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(sig), encode(new),
                            likeness(sig, new, k), likeness(sig, before[1], k)))
                before = (text, sig)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return rows.mapInArrow(run, f"id long, {RESULT}").withColumnRenamed("id", id_col)
