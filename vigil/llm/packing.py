"""Bulk-synchronous best-fit packing.

Waiting documents and the open gaps of sequences are sorted by size, largest first, and cut into ranges. In a round
every range is swept by its own task: from the longest document on, each takes its successor, the smallest open
gap that holds it, and what is left of the gap stands for the next documents. Documents that found no gap in
their range are ranked, and so are the gaps that are left; the ranks alone, counted by range, say which
gaps of higher ranges they take. Gaps are updated, and rounds go on until no waiting document
fits any open gap. Only then the longest ones open sequences, and the rounds begin again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

GAP, WAITS, PLACED = 0, 1, 2
SWEPT = "kind int, part int, class int, nth long, id long, size int, sequence_id long, offset int"
NAMES = ["kind", "part", "class", "nth", "id", "size", "sequence_id", "offset"]


def sweep(rows: Iterator[tuple[int, int, int]], capacity: int, first: int, opens: bool) -> tuple[list, list, list]:
    """Best fit of ``rows`` (size, kind, id), largest first and gaps before documents of their size.

    Returns placements (rid, length, sequence, offset), what is left of the gaps (gap, sequence) and the documents
    that no gap holds (rid, length), all in order; with ``opens`` such a document opens sequence ``first``,
    ``first`` + 1, ... instead.
    """
    open_, placed, waits = [], [], []
    for size, kind, id_ in rows:
        if kind == GAP:
            insort(open_, (size, id_))
            continue
        at = bisect_left(open_, (size,))
        if at < len(open_):
            gap, sequence = open_.pop(at)
        elif opens:
            gap, sequence, first = capacity, first, first + 1
        else:
            waits.append((id_, size))
            continue
        placed.append((id_, size, sequence, capacity - gap))
        if gap > size:
            insort(open_, (gap - size, sequence))
    return placed, open_[::-1], waits


def across_ranges(gaps: list[tuple[int, int, int, int, int]], waits: list[tuple[int, int, int]]) -> list[tuple[int, ...]]:
    """Give the documents that wait to gaps of higher ranges (lower numbers), smallest class first, nearest range first.

    ``gaps``: (range, class, number, least gap, largest gap); ``waits``: (range, number, longest document). A gap takes as many
    documents as surely fit it; of a class whose least gap is too small the largest one takes one. Returns rows (range, first
    rank, documents, documents a gap, gap range, class, first gap rank). A gap that was left untouched in its own range holds
    every document of a lower one, so a round without any placement means that nothing fits.
    """
    pool: dict[int, list] = {}
    steps = sorted([(p, 0, n, longest) for p, n, longest in waits] + [(p, 1, c, n, least, most) for p, c, n, least, most in gaps])
    out = []
    for part, kind, *step in steps:
        if kind:
            c, n, least, most = step
            pool.setdefault(c, []).append([part, n, least, most, 0])
            continue
        n, longest = step
        rank = 0
        for c in sorted(k for k in pool if k >= longest.bit_length()):
            stack, i = pool[c], len(pool[c]) - 1
            while i >= 0 and rank < n:
                at, left, least, most, used = stack[i]
                if least >= longest:
                    each = least // longest
                    take = min(left, -(-(n - rank) // each))
                elif most >= longest and not used:  # gaps rank from the largest
                    each = take = 1
                else:
                    i -= 1
                    continue
                docs = min(n - rank, take * each)
                out.append((part, rank, docs, each, at, c, used))
                rank += docs
                stack[i] = [at, left - take, least, most, used + take]
                if left == take:
                    stack.pop(i)
                i -= 1
    return out


def _dealt(rows: DataFrame, n: int, per_range: int) -> tuple[DataFrame, int]:
    """``rows`` (size, kind, id) in ranges of about ``per_range``, largest first; a hash cuts runs of equal size."""
    ranges = max(1, -(-n // per_range))
    order = [F.desc("size"), F.asc("kind"), F.asc("h")]
    rows = rows.select("size", "kind", "id", F.xxhash64("id").alias("h"))
    dealt = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions(*order).select("size", "kind", "id"), ranges


def _sweep_all(rows: DataFrame, n: int, capacity: int, per_range: int, base: int, opens: bool) -> tuple[DataFrame, int]:
    """Every range swept once (SWEPT rows): placements, gaps left by class (power of two) and rank, documents left by rank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        placed, gaps, waits = sweep(stream, capacity, base + (part << 28), opens)
        out, seen = [(PLACED, part, 0, 0, i, s, q, o) for i, s, q, o in placed], {}
        for gap, sequence in gaps:
            c = gap.bit_length()
            seen[c] = nth = seen.get(c, -1) + 1
            out.append((GAP, part, c, nth, sequence, gap, None, None))
        out += [(WAITS, part, 0, nth, i, s, None, None) for nth, (i, s) in enumerate(waits)]
        for at in range(0, len(out), 20_000):
            cols = zip(*out[at:at + 20_000])
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=NAMES)

    dealt, ranges = _dealt(rows, n, per_range)
    return materialize(dealt.mapInArrow(run, SWEPT), "swept"), ranges


def _across(swept: DataFrame, plan: list[tuple], capacity: int) -> DataFrame:
    """Placements (rid, length, sequence_id, offset, gap_left) of the documents that ``plan`` gives to gaps of other ranges."""
    spark = swept.sparkSession
    a = np.array(sorted(plan), np.int64).reshape(-1, 7)  # a few rows a range
    top = int((a[:, 1] + a[:, 2]).max()) + 1
    shared = spark.sparkContext.broadcast((a, a[:, 0] * top + a[:, 1], top))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys, top = shared.value
        for b in batches:
            part, nth = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()
            at = np.maximum(np.searchsorted(keys, part * top + np.minimum(nth, top - 1), "right") - 1, 0)
            hit = rows[at]
            ok = (hit[:, 0] == part) & (nth >= hit[:, 1]) & (nth < hit[:, 1] + hit[:, 2])
            hit, keep = hit[ok], pa.array(np.flatnonzero(ok))
            step = nth[ok] - hit[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(keep) for i in (2, 3)), pa.array(hit[:, 4].astype(np.int32)), pa.array(hit[:, 5].astype(np.int32)),
                                              pa.array(hit[:, 6] + step // hit[:, 3]), pa.array(step)], names=["rid", "length", "part", "class", "nth", "step"])

    docs = swept.where(F.col("kind") == WAITS).select("part", "nth", "id", "size").mapInArrow(
        find, "rid long, length int, part int, class int, nth long, step long")
    gaps = swept.where(F.col("kind") == GAP).select("part", "class", "nth", F.col("id").alias("sequence_id"), F.col("size").alias("gap"))
    met = docs.join(gaps, ["part", "class", "nth"])
    w = Window.partitionBy("sequence_id").orderBy("step")  # at most `capacity` documents
    before = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("length").over(Window.partitionBy("sequence_id"))
    return met.select("rid", "length", "sequence_id", (F.lit(capacity) - F.col("gap") + F.coalesce(before, F.lit(0))).cast("int").alias("offset"),
                      (F.col("gap") - whole).cast("int").alias("gap_left"))


def _open(band: DataFrame, n: int, k: int, capacity: int, per_range: int, base: int) -> DataFrame:
    """Placements of documents that open sequences of ``k`` in a row each, in order of length."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), part, np.int32)), pa.array(np.arange(seen, seen + len(b))), b.column(2), b.column(0)],
                                             names=["part", "nth", "rid", "length"])
            seen += len(b)

    dealt, _ = _dealt(band, n, per_range)
    ranked = materialize(dealt.mapInArrow(number, "part int, nth long, rid long, length int"), "ranked")
    counts = ranked.groupBy("part").count().orderBy("part")
    starts = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("start"))  # a row a range
    rank = F.col("start") + F.col("nth")
    ranked = ranked.join(F.broadcast(starts), "part").withColumns({"rank": rank, "sequence_id": F.lit(base) + F.floor(rank / k)})
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("length").over(Window.partitionBy("sequence_id"))
    return ranked.select("rid", "length", "sequence_id", F.coalesce(before, F.lit(0)).cast("int").alias("offset"), (F.lit(capacity) - whole).cast("int").alias("gap_left"))


def pack_pieces(pieces: DataFrame, capacity: int, per_range: int = 200_000) -> DataFrame:
    """(rid, sequence_id, offset) for ``pieces`` (rid long, unique; length between 1 and ``capacity``).

    Once documents and gaps fit one range, a sweep that may open sequences ends the work; before, documents of which as many fit
    a sequence as of the longest one waiting (for short ones: of nearly its length) open sequences when no gap holds any.
    """
    docs = pieces.select(F.col("rid").alias("id"), F.col("length").cast("int").alias("size"))
    gaps, done, opened = None, [], 0
    place = lambda df: df.select("rid", "sequence_id", F.col("offset").cast("long").alias("offset"))
    as_rows = lambda df, kind: df.select("size", F.lit(kind).alias("kind"), "id")
    while True:
        waiting = docs.agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("longest")).first()
        if not waiting["n"]:
            break
        base = (opened := opened + 1) << 48
        if gaps is not None:
            gaps = gaps.where(F.col("size") >= waiting["least"])  # a smaller one holds nothing any more
        n_gaps = gaps.count() if gaps is not None else 0
        rows = as_rows(docs, WAITS) if not n_gaps else as_rows(docs, WAITS).union(as_rows(gaps, GAP))
        if waiting["n"] + n_gaps <= per_range:
            swept, _ = _sweep_all(rows, waiting["n"] + n_gaps, capacity, per_range, base, True)
            done.append(place(swept.where(F.col("kind") == PLACED).withColumnRenamed("id", "rid")))
            break
        if n_gaps:
            swept, ranges = _sweep_all(rows, waiting["n"] + n_gaps, capacity, per_range, base, False)
            placed = swept.where(F.col("kind") == PLACED).withColumnRenamed("id", "rid")
            found = swept.groupBy("kind", "part", "class").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).collect()
            plan = across_ranges([(r["part"], r["class"], r["n"], r["least"], r["most"]) for r in found if r["kind"] == GAP],
                                 [(r["part"], r["n"], r["most"]) for r in found if r["kind"] == WAITS])
            if plan or any(r["kind"] == PLACED for r in found):
                done.append(place(placed))
                docs, gaps = (swept.where(F.col("kind") == k).select("id", "size") for k in (WAITS, GAP))
                if plan:
                    crossed = materialize(_across(swept, plan, capacity), "crossed")
                    done.append(place(crossed))
                    docs = docs.join(crossed.select(F.col("rid").alias("id")), "id", "left_anti")
                    used = crossed.groupBy(F.col("sequence_id").alias("id")).agg(F.first("gap_left").alias("size"))
                    gaps = gaps.join(used.select("id"), "id", "left_anti").union(used.where("size > 0"))
                docs, gaps = materialize(docs, "waiting"), materialize(gaps, "gaps")
                continue
        k = capacity // waiting["longest"]
        fits = F.floor(F.lit(capacity) / F.col("size")) == k if k < 8 else F.col("size") * 8 > waiting["longest"] * 7
        band = materialize(docs.where(fits), "band")
        new = materialize(_open(as_rows(band, WAITS), band.count(), k, capacity, per_range, base), "opened")
        done.append(place(new))
        docs = docs.where(~fits)
        left = new.groupBy(F.col("sequence_id").alias("id")).agg(F.first("gap_left").alias("size")).where("size > 0")
        gaps = materialize(left if gaps is None else gaps.union(left), "gaps")
    if not done:
        return pieces.sparkSession.createDataFrame([], "rid long, sequence_id long, offset long")
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    return out


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, per_range: int = 200_000) -> DataFrame:
    """Pack the whole texts of ``docs`` into sequences of at most ``capacity`` tokens.

    Returns per piece ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` (its
    place, gapless from 0), and ``ids`` if ``with_ids``. Only documents longer than ``capacity`` are cut. A null
    text is empty and has the closing id alone; rows that share an id (or have none) are packed each for
    itself; other columns are not read; an empty table gives no piece.
    """
    from .tokenize import token_pieces
    pieces = token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    pieces = materialize(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    placed = pack_pieces(pieces.select("rid", "length"), capacity, per_range)
    return pieces.join(placed, "rid").drop("rid").withColumnRenamed("id", id_col)
