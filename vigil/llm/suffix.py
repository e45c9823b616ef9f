"""Suffix arrays of byte texts in numpy, to the depth that substring deduplication needs."""

from __future__ import annotations

import numpy as np

FIRST = 5  # bytes of the first sort key; with a position it fits one integer
LIMIT = 1 << 21  # bytes of a text
WALK = 64  # positions that one Kasai walk covers


def suffix_array(text: np.ndarray, rem: np.ndarray, depth: int) -> np.ndarray:
    """Positions with at least ``depth`` bytes left (``rem``), sorted by their next ``depth`` bytes.

    Larsson-Sadakane refinement: positions are grouped by their first bytes, and every round splits the
    groups of more than one position by the rank of what follows, which doubles the sorted depth; the
    last round overlaps. A group's rank is its first place in the order and never moves, so a position
    alone in its group is settled: no later round reads or sorts it.
    """
    n = len(text)
    if n > LIMIT:
        raise ValueError("text too long for packed sort keys")
    bits = np.uint64(max(1, n.bit_length()))
    mask = np.uint64((1 << int(bits)) - 1)
    h = min(FIRST, depth)
    key = np.zeros(max(0, n - h + 1), np.uint64)
    for i in range(h):
        key = (key << np.uint64(8)) | text[i:i + len(key)]
    at = np.flatnonzero(rem >= h)
    packed = np.sort((key[at] << bits) | at.astype(np.uint64))
    sa, key = (packed & mask).astype(np.int32), packed >> bits
    rank = np.zeros(n, np.int32)
    group = _heads(key[1:] != key[:-1], len(sa))
    rank[sa] = group
    sa, group = _unsettled(sa, group)
    while h < depth and len(sa):
        step = min(h, depth - h)
        h += step
        long = rem[sa] >= h  # a shorter position is nobody's successor from here on
        sa, group = sa[long], group[long]
        # unsettled groups begin at least two places apart, so half a place still tells them apart
        packed = np.sort((((group >> 1).astype(np.uint64) << bits | rank[sa + step].astype(np.uint64)) << bits) | sa.astype(np.uint64))
        sa, key = (packed & mask).astype(np.int32), packed >> bits
        # the sort keeps each group in its places: only the order inside changes
        group = group + _heads(key[1:] != key[:-1], len(sa)) - _heads(group[1:] != group[:-1], len(sa))
        rank[sa] = group
        sa, group = _unsettled(sa, group)
    place = np.full(n, -1, np.int32)
    whole = np.flatnonzero(rem >= depth)
    place[rank[whole]] = whole
    place[group + np.arange(len(sa)) - _heads(group[1:] != group[:-1], len(sa))] = sa
    return place[place >= 0].astype(np.int64)


def _unsettled(sa: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of an order whose group has another entry."""
    cut = np.concatenate(([True], group[1:] != group[:-1], [True]))
    many = ~(cut[1:] & cut[:-1]) if len(sa) else np.zeros(0, bool)
    return sa[many], group[many]


def _heads(changes: np.ndarray, n: int) -> np.ndarray:
    """For every place in an order the place where its group begins."""
    if not n:
        return np.zeros(0, np.int32)
    first = np.concatenate(([True], changes))
    return np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), np.int32(0)))


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """Kasai: for each entry of ``sa`` the length of the prefix it shares with the entry before, at most ``depth``.

    ``starts``/``counts`` give the runs of consecutive positions that make up ``sa``. The runs are walked in
    step: the next position of a run shares all but one byte of what the last one shared. Runs are cut at
    ``WALK`` positions, each part beginning anew, so the steps are few and wide whatever the longest run.
    Entries that are equal to ``depth`` must stand in text order, as ``suffix_array`` leaves them.
    """
    parts = -(-counts // WALK)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, counts = np.repeat(starts, parts) + nth * WALK, np.minimum(np.repeat(counts, parts) - nth * WALK, WALK)
    place = np.full(len(text) + 1, -1, np.int32)
    place[sa] = np.arange(len(sa), dtype=np.int32)
    lcp = np.zeros(len(text) + 1, np.int16)
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    h = np.zeros(len(starts), np.int64)
    q = np.full(len(starts), -1, np.int64)
    for t in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -t, "left"))
        p, last = starts[:live] + t, q[:live]
        own = place[p]
        q = np.where(own > 0, sa[own - 1], -1)
        # the rule needs the old neighbour's next position in the order and before this one; equal windows
        # stand in text order, so inside a repeat it is
        old = place[last + 1]
        h = np.where((last >= 0) & (old >= 0) & (old < own), np.maximum(h[:live] - 1, 0), 0)
        h[q < 0] = 0
        go = np.flatnonzero((q >= 0) & (h < depth))
        while len(go):
            go = go[text[p[go] + h[go]] == text[q[go] + h[go]]]
            h[go] += 1
            go = go[h[go] < depth]
        lcp[p] = h
    return lcp[sa]
