"""Kendall's tau-b without enumerating pairs.

Rows collapse to distinct (x, y) with counts. Two total orders stand over them: P by (x, y) and Q by (y, x).
A pair of rows is discordant (x_i < x_j and y_i > y_j) exactly if the two orders disagree on it, so ties need
no care and a value that holds a third of all rows can be cut anywhere.

1. P is cut into ranges of about ``RANGE_ROWS`` rows and Q into as many strips. Each row knows its range and
   its strip.
2. Disagreements inside a range are counted in the range's task (merge counting, O(n log n)).
3. Disagreements inside a strip, but between different ranges, are counted in the strip's task.
4. What differs in both is settled by the number of rows in each (range, strip) cell: the same count over the
   table of cells, which is a table of distinct pairs again.

A row is shuffled twice per round. A round over n rows leaves at most (n / RANGE_ROWS)^2 cells.
C = n0 - n1 - n2 + n3 - D, tau_b = (C - D) / sqrt((n0 - n1) (n0 - n2)).
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null, q
from ..session import ensure_checkpoint_dir

_DEC = "decimal(38,0)"  # exact pair counts for any row count
RESULT = f"n long, n_concordant {_DEC}, n_discordant {_DEC}, tau double"
RANGE_ROWS = 1_000_000  # distinct (x, y) that one task counts: about 100 MB of arrays


def inversions(places: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight_i * weight_j over i < j with places_i > places_j; ``places`` holds 0..n-1 once each.

    The merge steps of a merge sort, from the widest down: places that agree above bit b stand together in
    sequence order, those with bit b set ahead of one without it are its inversions there, and a stable
    partition by that bit prepares the next step.
    """
    n, total = len(places), 0
    index = np.arange(n)
    small = 2 * int(weight.sum()).bit_length() < 63 if n else True
    for b in range(max(0, n - 1).bit_length() - 1, -1, -1):
        start = (places >> (b + 1)) << (b + 1)
        one = (places >> b & 1).astype(bool)
        held = np.concatenate(([0], np.cumsum(np.where(one, weight, 0))))
        ahead = (held[:-1] - held[start])[~one]
        mine = weight[~one]
        total += int(np.dot(mine, ahead)) if small else int(np.dot(mine.astype(object), ahead.astype(object)))
        ones = np.concatenate(([0], np.cumsum(one)))
        before = ones[:-1] - ones[start]
        to = np.where(one, start + (1 << b) + before, index - before)
        moved, borne = np.empty_like(places), np.empty_like(weight)
        moved[to], borne[to] = places, weight
        places, weight = moved, borne
    return total


def _disagreements(x: np.ndarray, y: np.ndarray, weight: np.ndarray, part: np.ndarray | None = None) -> int:
    """Weighted disagreements of the orders (x, y) and (y, x); with ``part``, which never falls along (x, y),
    only those between different parts."""
    p = np.lexsort((y, x))
    x, y, weight = x[p], y[p], weight[p]
    places = np.empty(len(p), np.int64)
    places[np.lexsort((x, y))] = np.arange(len(p))
    found = inversions(places, weight)
    if part is not None:
        inside = np.empty(len(p), np.int64)
        inside[np.lexsort((places, part[p]))] = np.arange(len(p))
        found -= inversions(inside, weight)
    return found


def _arrays(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    table = [b for b in batches if len(b)]
    return [np.concatenate([b.column(i).to_numpy() for b in table]) for i in range(table[0].num_columns)] if table else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: its disagreements as digits (columns x, y, c and, for a strip, the range)."""
    if cols := _arrays(batches):
        yield pa.RecordBatch.from_pydict({"d": [str(_disagreements(*cols))]})


def _discordant(pairs: DataFrame, rows: int, range_rows: int) -> int:
    """Discordant pairs of a table of distinct (x, y) with weights ``c``."""
    total = lambda t: int(t.mapInArrow(_count, "d string").agg(F.sum(F.col("d").cast(_DEC)).alias("d")).first()["d"] or 0)
    parts = -(-rows // range_rows)
    if parts <= 1:
        return total(pairs.repartition(1))  # range_rows rows at most
    ranges = pairs.repartitionByRange(parts, "x", "y").select("x", "y", "c", F.spark_partition_id().alias("a")).checkpoint()
    strips = ranges.repartitionByRange(parts, "y", "x").select("x", "y", "c", "a", F.spark_partition_id().alias("s")).checkpoint()
    cells = strips.groupBy(F.col("a").alias("x"), F.col("s").alias("y")).agg(F.sum("c").alias("c")).checkpoint()
    held = cells.count()
    if held >= rows:  # would not shrink: wider ranges
        range_rows *= 2
    return total(ranges.select("x", "y", "c")) + total(strips.select("x", "y", "c", "a")) + _discordant(cells, held, range_rows)


def kendall_tau(df: DataFrame, x: str, y: str, buckets: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Kendall tau-b of two numeric columns over pair-complete rows, in ranges of ``range_rows`` or ``buckets`` ranges.
    Output: one row (n, n_concordant, n_discordant, tau); tau is NULL where a column is constant or fewer than
    two rows are complete."""
    xs = nan_to_null(q(x).cast("double"), T.DoubleType())
    ys = nan_to_null(q(y).cast("double"), T.DoubleType())
    d = df.select(xs.alias("x"), ys.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ensure_checkpoint_dir(df.sparkSession)
    pairs = d.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).checkpoint()  # heavy ties are one row from here on

    # pair counts t(t-1) exceed a long once one value holds ~3e9 rows: exact decimals
    def twice_pairs(t):
        return F.col(t).cast(_DEC) * (F.col(t) - F.lit(1)).cast(_DEC)

    # ties on x, on y and on both in one job; (x, y) is unique, so ties on both need no grouping
    sides = pairs.select(F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("k"), "c"),
                                          F.struct(F.lit(1).alias("side"), F.col("y").alias("k"), "c"))))
    ties = {r["side"]: r for r in sides.groupBy("side", "k").agg(F.sum("c").alias("t"), F.count("*").alias("rows"), F.sum(twice_pairs("c")).alias("t3"))
            .groupBy("side").agg(F.sum(twice_pairs("t")).alias("s"), F.sum("t").alias("n"), F.sum("rows").alias("rows"), F.sum("t3").alias("t3")).collect()}
    n = int(ties[0]["n"]) if ties else 0
    if n < 2:
        return df.sparkSession.createDataFrame([(n, decimal.Decimal(0), decimal.Decimal(0), None)], RESULT)
    n1, n2, n3 = int(ties[0]["s"]) // 2, int(ties[1]["s"]) // 2, int(ties[0]["t3"]) // 2
    rows = int(ties[0]["rows"])
    disc = _discordant(pairs, rows, -(-rows // buckets) if buckets else range_rows)

    # exact integer arithmetic on the driver (a handful of numbers)
    n0 = n * (n - 1) // 2
    conc = n0 - n1 - n2 + n3 - disc
    denom = math.sqrt((n0 - n1) * (n0 - n2))
    tau = (conc - disc) / denom if denom > 0 else None
    return df.sparkSession.createDataFrame([(n, decimal.Decimal(conc), decimal.Decimal(disc), tau)], RESULT)
