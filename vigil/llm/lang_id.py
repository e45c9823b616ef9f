"""Language identification by rank-order n-gram profiles.

A language profile is the list of its most frequent character n-grams, most frequent first. A text is
given the language whose profile is nearest to the text's own list by out-of-place distance: each
n-gram of the text adds the difference of its two ranks, or the profile length if the language
lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
EDGE = 1  # word boundary; U+0001 is no letter
SLOTS = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_codes(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of letters inside words, with word boundaries; empty without a letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    a[~_letters()[a]] = EDGE
    a = np.concatenate(([EDGE], a, [EDGE]))
    a = a[np.concatenate(([True], (a[1:] != EDGE) | (a[:-1] != EDGE)))]  # one boundary between words
    if len(a) < 3:
        return np.zeros(0, np.int64)
    pairs = (a[:-1] << 21) | a[1:]
    triples = (pairs[:-1] << 21) | a[2:]
    return np.concatenate((a[a != EDGE], pairs, triples[a[1:-1] != EDGE]))


def profile(codes: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` most frequent codes, most frequent first, ties to the smaller code."""
    grams, n = np.unique(codes, return_counts=True)
    if len(grams) > length:
        least = np.partition(n, len(n) - length)[len(n) - length]
        grams, n = grams[n >= least], n[n >= least]
    return grams[np.lexsort((grams, -n))][:length]


class Profiles:
    """Language profiles, each a sorted code array with ranks."""

    def __init__(self, ranked: dict[str, list[int]], length: int):
        self.length, self.langs = length, sorted(ranked)
        self.tables = []
        for lang in self.langs:
            codes = np.array(ranked[lang], np.int64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is one less the distance as a share of the largest possible."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        own = profile(ngram_codes(text), self.length)
        if not len(own):
            return UNKNOWN, 0.0
        ranks, best = np.arange(len(own)), None
        for lang, (codes, order) in zip(self.langs, self.tables):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            d = np.where(codes[at] == own, np.minimum(np.abs(order[at] - ranks), self.length), self.length).sum()
            if best is None or d < best[0]:
                best = (d, lang)
        return best[1], float(1.0 - best[0] / (len(own) * self.length))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).append(ngram_codes(text))
        for lang, parts in by.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in total:
                codes, n = np.concatenate((total[lang][0], codes)), np.concatenate((total[lang][1], n))
                codes, at = np.unique(codes, return_inverse=True)
                n = np.bincount(at, n, len(codes)).astype(np.int64)
            total[lang] = (codes, n)
    for lang, (codes, n) in total.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(codes), "gram": codes, "n": n.astype(np.int64)})


def learn_profiles(labelled: DataFrame, length: int = 300, sample_per_lang: int = 2000) -> Profiles:
    """Profiles from (id, lang, text) rows without nulls.

    About ``sample_per_lang`` documents of each language are read, chosen by a hash of the id: the
    documented bound of the training sample. Ties in an n-gram's count go to the smaller code.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles({}, length)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(SLOTS * min(1.0, sample_per_lang / n)))])
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(SLOTS)) < share[F.col("lang")])
    grams = sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in grams.withColumn("r", rank).where(F.col("r") <= length).orderBy("lang", "r").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, length)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the documents that are never learnt from: crc32 of the id as text, mod ``folds``, is 0."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == 0, F.lit(True))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       length: int = 300, sample_per_lang: int = 2000) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``.

    Profiles are learnt from rows with text and language that are not held out; a prediction sees the
    whole text and nothing else. A null text, a text without a letter, or any text when nothing could
    be learnt gives ``und`` and score 0; languages at equal distance go to the first by name. A null id
    counts as held out; repeated rows are predicted alike; input columns with the names of the three
    outputs are replaced; an empty table stays empty.
    """
    col = lambda c: F.col(f"`{c}`")
    labelled = docs.where(~held_out(id_col) & col(text_col).isNotNull() & col(lang_col).isNotNull()) \
        .select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn_profiles(labelled, length, sample_per_lang))

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.value.predict(t) for t in texts], columns=["lang", "score"])

    outputs = ("held_out", "lang_pred", "score")
    kept = [c for c in docs.columns if c.lower() not in outputs]
    return docs.select(*[col(c) for c in kept], held_out(id_col).alias("held_out"), predict(col(text_col)).alias("_p")) \
        .select(*[col(c) for c in kept], "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = 0.0, **options) -> DataFrame:
    """The documents that are given a language, with a score of at least ``min_score``; columns as before."""
    ok = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
    return identify_languages(docs, **options).where(ok).select(*[F.col(f"`{c}`") for c in docs.columns])
