"""Removal of byte strings that repeat across documents, by sharded suffix arrays.

Texts are cut into overlapping pieces in such a way that all copies of a string of ``width`` bytes lie in
pieces of one shard: a piece is a run of windows of that width with the same smallest hash of a shorter
gram. Batches of documents first announce the hashes of their grams; pieces whose gram occurs nowhere
else hold no repeat and stay at home. Equal pieces of a batch travel once. Of a gram with very many
pieces every window is dealt by itself, as a digest, so that no gram fills a shard. A shard sorts the suffixes of
its pieces in sub-shards of bounded size, finds equal windows by common prefixes, and learns the smallest
document of each; sub-shards that a frequent gram fills are merged by binary search of their sorted
strings. What a document has to give up goes back to its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .suffix import LIMIT, common_prefixes, suffix_array

LAST_ID = (1 << 63) - 1
BATCH_BYTES = 4 << 20
BATCH_DOCS = 20_000
SHARD_BYTES = 64 << 20  # of pieces; about four times the text
SUB_BYTES = LIMIT - (1 << 16)
PIECE_WINDOWS = 4096
HOT_BYTES = 4 << 20  # a gram with more bytes of distinct pieces has its windows dealt one by one
WEIGHT_BYTES = 64  # unit in which the bytes of a gram's pieces are announced
FEW = 8  # pieces of a gram in a batch that are announced without looking for equal ones
SHARD_SCHEMA = "shard int, kind int, batch long, n int, a binary, b binary"
PIECES, PLACES, WINDOWS, WINDOW_PLACES = range(4)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, n: int, *types: str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(raw, t, n, at))
        at += size
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.int64), prepend=0).astype("<i4")


def _sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.int64)


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A well-mixed 64-bit hash of every ``text[i:i + k]``."""
    base, out, size = 0x9E3779B97F4A7C15, None, 0
    part, span = text.astype(np.uint64) + np.uint64(1), 1
    while True:
        if k & span:
            out = part if out is None else out[:len(part) - size] * np.uint64(pow(base, span, 1 << 64)) + part[size:] \
                if len(part) > size else part[:0]
            size += span
        if span * 2 > k:
            break
        part = part[:-span] * np.uint64(pow(base, span, 1 << 64)) + part[span:]
        span *= 2
    out = out[:max(0, len(text) - k + 1)]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (w - size)], x[w - size:]) if size < w else x


def cut_pieces(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, gram) of the pieces of documents ``text[s:e]``; equal windows have equal grams."""
    gram = max(1, min(16, width // 3))
    if len(text) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = sliding_min(gram_hashes(text, gram), width - gram + 1)
    valid = np.ones(len(low), bool)
    for s, e in zip(starts.tolist(), ends.tolist()):
        valid[max(s, e - width + 1):e] = False
    same = (low[1:] == low[:-1]) & valid[1:] & valid[:-1]
    first = np.flatnonzero(valid & np.concatenate(([True], ~same)))
    last = np.flatnonzero(valid & np.concatenate((~same, [True])))
    count = last - first + 1
    grams = low[first]
    if len(count) and count.max() > PIECE_WINDOWS:  # very regular text: long pieces are cut, copies stay together
        cuts = -(-count // PIECE_WINDOWS)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, left, grams = np.repeat(first, cuts) + nth * PIECE_WINDOWS, np.repeat(count, cuts) - nth * PIECE_WINDOWS, np.repeat(grams, cuts)
        count = np.minimum(left, PIECE_WINDOWS)
    return first, count, grams


def _batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(batch, ids, lens, size, text): documents in compressed batches of about ``BATCH_BYTES``; a longer
    document is a batch of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "batch": pa.array([(task << 32) + n], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "lens": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "size": pa.array([size], pa.int64()),
                "text": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary())})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (t or "").encode()
                if texts and (size + len(raw) > BATCH_BYTES or len(texts) >= BATCH_DOCS):
                    yield row()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield row()

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(run, "batch long, ids array<long>, lens array<long>, size long, text binary")


def _ends(lens: list[int]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array(lens, np.int64)
    ends = np.cumsum(lens)
    return ends - lens, ends


def _order_ids(ids: list) -> np.ndarray:
    return np.array([LAST_ID if i is None else i for i in ids], np.int64)


def gram_codes(gram: np.ndarray, shards: int) -> np.ndarray:
    """Shard and 32 bits of each gram in one number; equal grams have equal codes."""
    return ((gram % np.uint64(shards)) << np.uint64(32)) | (gram >> np.uint64(32))


def announce(batch: int, lens: list[int], raw: bytes, width: int, shards: int) -> Iterator[tuple]:
    """(shard, batch, n, keys): the distinct grams of a batch, and about how much their distinct pieces weigh."""
    first, count, gram = cut_pieces(np.frombuffer(raw, np.uint8), *_ends(lens), width)
    codes, of, times = np.unique(gram_codes(gram, shards), return_inverse=True, return_counts=True)
    size = count + (width - 1)
    many = np.flatnonzero(times[of] > FEW)
    once = {raw[a:a + n]: i for i, a, n in zip(many.tolist(), first[many].tolist(), size[many].tolist())}
    counted = np.concatenate((np.flatnonzero(times[of] <= FEW), np.fromiter(once.values(), np.int64, len(once))))
    weight = np.bincount(of[counted], -(-size[counted] // WEIGHT_BYTES), len(codes)).astype("<u4")
    shard = (codes >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
    for a, b in zip(first, [*first[1:], len(codes)]):
        keys = (codes[a:b] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield int(shard[a]), batch, int(b - a), _pack(np.diff(keys, prepend=0).astype("<u4"), weight[a:b])


def common_grams(announced: list[tuple[int, int, bytes]], hot_bytes: int = HOT_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(batch, n, bits) for the batches of a shard: which of their grams another batch has too, and, where there
    are any, as many bits again: of which all batches together have more than ``hot_bytes`` of pieces."""
    keys, weights = zip(*(_unpack(blob, n, "<u4", "<u4") for _, n, blob in announced))
    keys = [np.cumsum(k, dtype=np.int64) for k in keys]
    every, weight = np.concatenate(keys), np.concatenate(weights)
    grams, count = np.unique(every, return_counts=True)
    grams = grams[count > 1]
    heavy = np.bincount(every >> 12, weight)[every >> 12] > hot_bytes // WEIGHT_BYTES  # grams that share their upper bits
    hot_grams, of = np.unique(every[heavy], return_inverse=True)
    hot_grams = hot_grams[np.bincount(of, weight[heavy], len(hot_grams)) > hot_bytes // WEIGHT_BYTES]
    for (batch, n, _), k in zip(announced, keys):
        at = np.minimum(np.searchsorted(grams, k), max(0, len(grams) - 1))
        common = grams[at] == k if len(grams) else np.zeros(n, bool)
        hot = np.isin(k, hot_grams) if len(hot_grams) else np.zeros(n, bool)
        if common.any() or hot.any():
            yield batch, n, np.packbits(common).tobytes() + (np.packbits(hot).tobytes() if hot.any() else b"")


def _equal(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct row, number of the distinct row at each place) of (n, 2) ``words``."""
    order = np.lexsort((words[:, 1], words[:, 0]))
    w = words[order]
    head = np.ones(len(w), bool)
    head[1:] = (w[1:] != w[:-1]).any(1)
    group = np.empty(len(w), np.int64)
    group[order] = np.cumsum(head) - 1
    return order[head], group


def _distinct(raw: bytes, first: np.ndarray, size: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    known: dict[bytes, int] = {}
    of = np.fromiter((known.setdefault(raw[a:a + n], len(known)) for a, n in zip(first.tolist(), size.tolist())), np.int64, len(first))
    return list(known), of


def deal_pieces(batch: int, ids: list, lens: list[int], raw: bytes, width: int, shards: int,
                common: dict[int, tuple[int, bytes]]) -> Iterator[tuple]:
    """Rows of ``SHARD_SCHEMA``: by shard, a batch's distinct pieces that may hold a repeat, and where they
    occur; of hot grams the distinct windows. ``common`` has by shard the answer to what the batch announced."""
    starts, ends = _ends(lens)
    text, who = np.frombuffer(raw, np.uint8), _order_ids(ids)
    first, count, gram = cut_pieces(text, starts, ends, width)
    codes, of, times = np.unique(gram_codes(gram, shards), return_inverse=True, return_counts=True)
    travels = times > 1  # or in another batch
    hot = np.zeros(len(codes), bool)
    for s, (n, bits) in common.items():
        a = int(np.searchsorted(codes, np.uint64(s << 32)))
        flags, half = np.frombuffer(bits, np.uint8), -(-n // 8)
        travels[a:a + n] |= np.unpackbits(flags[:half], count=n).astype(bool)
        if len(flags) > half:
            hot[a:a + n] = np.unpackbits(flags[half:], count=n).astype(bool)

    def rows(kind, of, first, shard, body, *meta):
        doc = np.searchsorted(ends, first, "right")
        least = np.full(len(shard), LAST_ID, np.int64)
        np.minimum.at(least, of, who[doc])
        order = np.argsort(shard, kind="stable")
        local = np.empty(len(shard), np.int64)
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        local[order] = np.arange(len(shard)) - bounds[shard[order]]
        occ = np.argsort(shard[of], kind="stable")
        occ_bounds = np.searchsorted(shard[of][occ], np.arange(shards + 1))
        for s in np.unique(shard).tolist():
            mine = order[bounds[s]:bounds[s + 1]]
            yield (s, kind, batch, len(mine), zstandard.ZstdCompressor(level=3).compress(body(mine)),
                   _pack(least[mine].astype("<i8"), *(x[mine] for x in meta)))
            at = occ[occ_bounds[s]:occ_bounds[s + 1]]
            docs, nth = np.unique(doc[at], return_inverse=True)
            yield (s, kind + 1, batch, len(at), _pack(_deltas(local[of[at]]), _deltas(nth), _deltas(first[at] - starts[doc[at]])),
                   _pack(np.array([len(docs)], "<i4"), docs.astype("<i4"), who[docs].astype("<i8")))

    cold, hot = (travels & ~hot)[of], (travels & hot)[of]
    if cold.any():
        at, windows, gram = first[cold], count[cold], gram[cold]
        pieces, of = _distinct(raw, at, windows + (width - 1))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        gram_of = np.empty(len(pieces), np.uint64)
        gram_of[of] = gram
        yield from rows(PIECES, of, at, (gram_of % np.uint64(shards)).astype(np.int64), lambda mine: b"".join([pieces[i] for i in mine.tolist()]),
                        size.astype("<i4"), (gram_of >> np.uint64(32)).astype("<u4"))
    if hot.any():
        at, windows = first[hot], count[hot]
        pieces, of = _distinct(raw, at, windows + (width - 1))
        held, digests = np.fromiter((len(x) - width + 1 for x in pieces), np.int64, len(pieces)), bytearray()
        for x in pieces:
            for i in range(len(x) - width + 1):
                digests += hashlib.blake2b(x[i:i + width], digest_size=16).digest()
        words = np.frombuffer(bytes(digests), "<u8").reshape(-1, 2)
        one, group = _equal(words)
        words = words[one]
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)  # of the piece's windows
        of = group[np.repeat((np.cumsum(held) - held)[of], windows) + nth]
        yield from rows(WINDOWS, of, np.repeat(at, windows) + nth, (words[:, 0] % np.uint64(shards)).astype(np.int64), lambda mine: words[mine].tobytes())


class SubShard:
    """Suffix array of some pieces; ``least`` is the smallest document of each sorted distinct window."""

    def __init__(self, pieces: list[bytes], least: np.ndarray, width: int):
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # no UTF-8 text holds 0xFF
        text = raw + np.uint8(1)  # the separator becomes 0, every byte of text more
        ends = np.cumsum(lens + 1) - 1
        rem = np.repeat(ends, lens + 1) - np.arange(len(text))
        self.text, self.width, self.starts, self.count = text, width, ends - lens, lens - width + 1
        self.sa = suffix_array(text, rem, width)
        lcp = common_prefixes(text, self.sa, self.starts, self.count, width)
        self.group = np.cumsum(lcp < width) - 1  # the first entry shares nothing
        heads = np.flatnonzero(lcp < width)
        owner = np.repeat(least, lens + 1)
        self.heads = self.sa[heads]
        self.least = np.minimum.reduceat(owner[self.sa], heads)

    def strings(self) -> np.ndarray:
        """The distinct windows in order."""
        rows = np.lib.stride_tricks.sliding_window_view(self.text, self.width)[self.heads]
        return np.ascontiguousarray(rows).view(f"S{self.width}").ravel()

    def window_least(self, least: np.ndarray) -> np.ndarray:
        """Smallest document of every window, piece after piece, from that of every distinct one."""
        by_place = np.zeros(len(self.text), np.int64)
        by_place[self.sa] = least[self.group]
        places = np.repeat(self.starts - np.concatenate(([0], np.cumsum(self.count)[:-1])), self.count) + np.arange(self.count.sum())
        return by_place[places]


def merge_subshards(subs: list[SubShard]) -> list[np.ndarray]:
    """Smallest document of each sub-shard's distinct windows over all of them: the sorted strings are
    merged one after the other, found by binary search."""
    if len(subs) == 1:
        return [subs[0].least]
    strings, least = subs[0].strings(), subs[0].least.copy()
    for sub in subs[1:]:
        new = sub.strings()
        at = np.searchsorted(strings, new)
        hit = strings[np.minimum(at, len(strings) - 1)] == new
        np.minimum.at(least, at[hit], sub.least[hit])
        strings, least = np.insert(strings, at[~hit], new[~hit]), np.insert(least, at[~hit], sub.least[~hit])
    return [least[np.searchsorted(strings, sub.strings())] for sub in subs]


def _sub_shards(order: np.ndarray, gram: np.ndarray, size: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Pieces (sorted by gram) as lists of sub-shards: whole grams together where they fit, else a gram's
    pieces in several."""
    if not len(order):
        return
    g, room = gram[order], size[order] + 1
    cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    weights = np.add.reduceat(room, cut)
    bounds, held, start = np.append(cut, len(order)), 0, 0
    for i, w in enumerate(weights.tolist()):
        if held and held + w > SUB_BYTES:
            yield _chunks(order[start:bounds[i]], room[start:bounds[i]])
            start, held = bounds[i], 0
        held += w
    yield _chunks(order[start:], room[start:])


def _chunks(pieces: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    out, start, held = [], 0, 0
    if room.sum() <= SUB_BYTES:
        return [pieces]
    for i, w in enumerate(room.tolist()):
        if held and held + w > SUB_BYTES:
            out.append(pieces[start:i])
            start, held = i, 0
        held += w
    return [*out, pieces[start:]]


class Shard:
    """Distinct pieces of a shard, and for each the runs of windows with their smallest document."""

    def __init__(self, width: int):
        self.width, self.pieces, self.least, self.size, self.gram, self.base = width, [], [], [], [], {}
        self.n = 0

    def add(self, batch: int, n: int, text: bytes, meta: bytes) -> None:
        least, size, gram = _unpack(meta, n, "<i8", "<i4", "<u4")
        self.base[batch] = self.n
        self.n += n
        self.pieces.append(zstandard.ZstdDecompressor().decompress(text))
        self.least.append(least)
        self.size.append(size.astype(np.int64))
        self.gram.append(gram)

    def settle(self) -> None:
        raw, least, size, gram = b"".join(self.pieces), *(np.concatenate(x) for x in (self.least, self.size, self.gram))
        self.pieces = []
        ends = np.cumsum(size)
        starts = ends - size
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        twin = np.zeros(len(g), bool)
        twin[1:] |= g[1:] == g[:-1]
        twin[:-1] |= g[1:] == g[:-1]
        alone = order[~twin]
        run_piece, run_from, run_to, run_least = ([alone], [np.zeros(len(alone), np.int64)], [size[alone] - self.width + 1], [least[alone]])
        for chunks in _sub_shards(order[twin], gram, size):
            subs = [SubShard([raw[a:b] for a, b in zip(starts[c].tolist(), ends[c].tolist())], least[c], self.width) for c in chunks]
            for sub, found, c in zip(subs, merge_subshards(subs), chunks):
                low = sub.window_least(found)
                piece = np.repeat(np.arange(len(c)), sub.count)
                first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (piece[1:] != piece[:-1]))))
                base = (np.cumsum(sub.count) - sub.count)[piece[first]]
                run_piece.append(c[piece[first]])
                run_from.append(first - base)
                run_to.append(np.append(first[1:], len(low)) - base)
                run_least.append(low[first])
        piece, self.run_from, self.run_to, self.run_least = (np.concatenate(x) for x in (run_piece, run_from, run_to, run_least))
        by = np.argsort(piece, kind="stable")
        self.run_from, self.run_to, self.run_least = self.run_from[by], self.run_to[by], self.run_least[by]
        self.run_at = np.searchsorted(piece[by], np.arange(self.n + 1))

    def repeats(self, batch: int, n: int, places: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document of the batch, first window, last window + 1) of what occurs in a smaller document."""
        local, nth, pos = (_sums(x) for x in _unpack(places, n, "<i4", "<i4", "<i4"))
        m = int(np.frombuffer(zstandard.ZstdDecompressor().decompress(docs)[:4], "<i4")[0])
        rest = zstandard.ZstdDecompressor().decompress(docs)[4:]
        doc, who = np.frombuffer(rest, "<i4", m), np.frombuffer(rest, "<i8", m, 4 * m)
        piece = local + self.base[batch]
        runs = self.run_at[piece + 1] - self.run_at[piece]
        occ = np.repeat(np.arange(n), runs)
        run = np.repeat(self.run_at[piece] - (np.cumsum(runs) - runs), runs) + np.arange(len(occ))
        gone = self.run_least[run] < who[nth[occ]]
        occ, run = occ[gone], run[gone]
        return doc[nth[occ]], pos[occ] + self.run_from[run], pos[occ] + self.run_to[run]


class Windows(Shard):
    """Windows of hot grams by their digests: each is a run of its own."""

    def add(self, batch: int, n: int, text: bytes, meta: bytes) -> None:
        self.base[batch] = self.n
        self.n += n
        self.pieces.append(zstandard.ZstdDecompressor().decompress(text))
        self.least.append(_unpack(meta, n, "<i8")[0])

    def settle(self) -> None:
        one, group = _equal(np.frombuffer(b"".join(self.pieces), "<u8").reshape(-1, 2))
        self.pieces, least = [], np.full(len(one), LAST_ID, np.int64)
        np.minimum.at(least, group, np.concatenate(self.least))
        self.run_from, self.run_to, self.run_least = np.zeros(self.n, np.int64), np.ones(self.n, np.int64), least[group]
        self.run_at = np.arange(self.n + 1)


def repeated_windows(batches: DataFrame, width: int, shards: int) -> DataFrame:
    """(batch, n, spans): windows that each batch's documents share with smaller documents."""
    hot_bytes = HOT_BYTES

    def tell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                if rows := list(announce(r["batch"], r["lens"], zstandard.ZstdDecompressor().decompress(r["text"]), width, shards)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                                                     names=["shard", "batch", "n", "keys"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [(r["shard"], (r["batch"], r["n"], r["keys"])) for b in it for r in b.to_pylist()]  # about 8 bytes a piece of one shard
        if told:
            if found := list(common_grams([x for _, x in told], hot_bytes)):
                yield pa.RecordBatch.from_arrays([pa.array([told[0][0]] * len(found), pa.int32()), *(
                    pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary())))], names=["shard", "batch", "n", "bits"])

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, common = [], {r["shard"]: (r["n"], r["bits"]) for r in right.to_pylist()}
        for r in left.to_pylist():
            rows += deal_pieces(r["batch"], r["ids"], r["lens"], zstandard.ZstdDecompressor().decompress(r["text"]), width, shards, common)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, settled = None, False
        for b in it:  # all pieces come before the first places, then all windows before theirs
            for i in range(b.num_rows):
                _, kind, batch, n, x, y = (c[i].as_py() for c in b.columns)
                if kind in (PIECES, WINDOWS):
                    if shard is None or settled:
                        shard, settled = (Shard if kind == PIECES else Windows)(width), False
                    shard.add(batch, n, x, y)
                    continue
                if not settled:
                    shard.settle()
                    settled = True
                doc, lo, hi = shard.repeats(batch, n, x, y)
                if len(doc):
                    yield pa.RecordBatch.from_pydict({"batch": pa.array([batch], pa.int64()), "n": pa.array([len(doc)], pa.int32()),
                                                      "spans": pa.array([_pack(_deltas(doc), _deltas(lo), (hi - lo).astype("<i4"))], pa.binary())})

    names, kinds = ["shard", "kind", "batch", "n", "a", "b"], [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    told = batches.select("batch", "lens", "text").mapInArrow(tell, "shard int, batch long, n int, keys binary")
    answers = told.repartitionById(shards, F.col("shard")).sortWithinPartitions("batch").mapInArrow(
        compare, "shard int, batch long, n int, bits binary")
    # the same exchange of the batches serves here and when the spans come home
    dealt = batches.select("batch", "ids", "lens", "text").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(deal, SHARD_SCHEMA)
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "batch").mapInArrow(
        solve, "batch long, n int, spans binary")


def remove_repeated_substrings(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` (long), ``kept`` (binary: the remaining bytes), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), one row per input row.

    A text is its UTF-8 bytes. A byte goes if it is covered by a string of ``width`` bytes that also starts in
    a document with a smaller id; strings lie inside one document, may overlap, and are judged on the
    input. A null text is empty; rows that share an id count as one document; a null id counts as the
    largest; other columns are not read; an empty table stays empty.
    """
    batches = materialize(_batches(docs, id_col, text_col), "batches")
    size = batches.agg(F.sum("size")).first()[0] or 0
    spans = repeated_windows(batches, width, max(1, -(-4 * size // SHARD_BYTES)))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for r in left.to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(r["text"])
            starts, ends = _ends(r["lens"])
            edge = np.zeros(len(raw) + 1, np.int32)
            for n, blob in zip(right["n"].to_pylist(), right["spans"].to_pylist()):
                doc, lo, more = _unpack(blob, n, "<i4", "<i4", "<i4")
                lo, at = _sums(lo), starts[_sums(doc)]
                np.add.at(edge, at + lo, 1)
                np.add.at(edge, at + lo + more + (width - 1), -1)
            gone = np.cumsum(edge[:-1]) > 0
            text = np.frombuffer(raw, np.uint8)
            for i, s, e in zip(r["ids"], starts.tolist(), ends.tolist()):
                g = gone[s:e]
                n = int(np.count_nonzero(g))
                spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0
                rows.append((i, text[s:e][~g].tobytes() if n else raw[s:e], e - s, n, spans))
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    out = batches.select("batch", "ids", "lens", "text").groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(
        cut, "id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.withColumnRenamed("id", id_col)
