"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy vectors.

The scans of the induced sort run by ranges of buckets that send nothing into each other: all that a range sends to later
buckets goes as one vector, in a stable order by symbol, and what a bucket sends to itself (a run of one symbol) is laid
out in one step from the run lengths. So the recursion over named substrings, which has as many symbols as names, needs
no step for each of them.
"""

from __future__ import annotations

import numpy as np

def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. t ends with a unique least symbol, which counts as smaller."""
    n = len(t)
    decided = np.append(t[1:] > t[:-1], True)  # smaller than its successor
    at = np.where(np.append(t[1:] != t[:-1], True), np.arange(n, dtype=np.int32), np.int32(n))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return decided[following]


def _deal(sa: np.ndarray, heads: np.ndarray, items: np.ndarray, symbols: np.ndarray, forward: bool) -> None:
    """Put items (in scan order) at the heads of their buckets."""
    if not len(items):
        return
    order = np.argsort(symbols, kind="stable")
    items, symbols = items[order], symbols[order]
    first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    lengths = np.diff(np.append(first, len(items)))
    rank = np.arange(len(items), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    at = heads[symbols]
    sa[at + rank if forward else at - rank] = items
    heads[symbols[first]] += lengths if forward else -lengths


def _runs(items: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What a bucket sends to itself: item - 1 of all items, then item - 2, ... as far as each one's run goes."""
    r = before[items]
    items, r = items[r > 0], r[r > 0]
    if not len(items):
        return items
    which = np.repeat(np.arange(len(items)), r)
    step = (np.arange(len(which)) - np.repeat(np.cumsum(r) - r, r) + 1).astype(np.int32)
    return (items[which] - step)[np.argsort(step, kind="stable")]


def _batches(t: np.ndarray, sends: np.ndarray, count: np.ndarray, ascending: bool) -> list[tuple[int, int]]:
    """Ranges of symbols that one step of a scan can take together: no suffix of such a range sends another one into it.

    sends: whether a place is sent by the suffix after it. A symbol that a run sends to itself is a range of its own.
    There are about as many ranges as the root of the number of places, whatever the number of symbols."""
    top = len(count)
    at = np.flatnonzero(sends[:-1])
    to, by = t[at], t[at + 1]
    alone = np.zeros(top, bool)
    alone[to[to == by]] = True
    if ascending:
        nearest = np.full(top, -1, np.int64)
        np.maximum.at(nearest, to[to > by], by[to > by])
    else:
        nearest = np.full(top, top, np.int64)
        np.minimum.at(nearest, to[to < by], by[to < by])
    order = np.flatnonzero(count)
    order = order if ascending else order[::-1]
    out: list[tuple[int, int]] = []
    first = last = -1
    single = True
    for c, x, own in zip(order.tolist(), nearest[order].tolist(), alone[order].tolist(), strict=True):
        if single or own or (x >= first if ascending else x <= first):
            if first >= 0:
                out.append((first, last))
            first, single = c, own
        last = c
    out.append((first, last))
    return out


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, up: list, down: list) -> np.ndarray:
    """The order of all suffixes induced from lms, which is in the wanted order."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    narrow = np.uint8 if len(starts) <= 256 else np.uint16 if len(starts) <= 1 << 16 else np.int32
    keys = t.astype(narrow)
    # leftmost-smaller suffixes stand at the ends of their buckets until the second scan
    grouped = lms[np.argsort(keys[lms], kind="stable")]
    symbol = t[grouped]
    own = np.bincount(symbol, minlength=len(starts))
    sa[(ends - np.cumsum(own))[symbol] + np.arange(len(grouped))] = grouped
    heads = starts.copy()
    for first, last in up:
        if first == last:
            c = first
            placed = sa[starts[c] : heads[c]]
            placed = np.concatenate((placed, _runs(placed, before)))
            sa[starts[c] : starts[c] + len(placed)] = placed
            heads[c] = starts[c] + len(placed)
            scan = np.concatenate((placed, sa[ends[c] - own[c] : ends[c]]))
        else:
            scan = sa[starts[first] : ends[last]]
        sent = scan[scan > 0] - 1
        sent = sent[~smaller[sent]]
        sent = sent[keys[sent] > last]
        _deal(sa, heads, sent, keys[sent], True)
    larger_end = heads
    tails = ends - 1
    for first, last in down:
        if first == last:
            c = first
            placed = sa[tails[c] + 1 : ends[c]][::-1]
            placed = np.concatenate((placed, _runs(placed, before)))
            sa[ends[c] - len(placed) : ends[c]] = placed[::-1]
            tails[c] = ends[c] - len(placed) - 1
            scan = np.concatenate((placed, sa[starts[c] : larger_end[c]][::-1]))
        else:
            scan = sa[starts[last] : ends[first]][::-1]
        sent = scan[scan > 0] - 1
        sent = sent[smaller[sent]]
        sent = sent[keys[sent] < last]
        _deal(sa, tails, sent, keys[sent], False)
    sa[starts[t[-1]]] = n - 1
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of t (whole numbers from 0), whose last symbol is least and occurs nowhere else."""
    t = np.asarray(t, np.int32)
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    smaller = _types(t)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    count = np.bincount(t)
    ends = np.cumsum(count)
    starts = ends - count
    larger = ~smaller
    up, down = _batches(t, larger, count, True), _batches(t, smaller, count, False)
    # how many equal symbols stand right before each place
    change = np.concatenate(([True], t[1:] != t[:-1]))
    place = np.arange(n, dtype=np.int32)
    before = place - np.maximum.accumulate(np.where(change, place, np.int32(0)))
    sa = _induce(t, smaller, lms, starts, ends, before, up, down)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    if len(ordered) > 1:
        # name the substrings from one leftmost-smaller place to the next: neighbours are compared symbol by symbol
        end_of = np.full(n, n - 1, np.int32)
        end_of[lms[:-1]] = lms[1:]
        a, b = ordered[:-1], ordered[1:]
        differs = (end_of[a] - a) != (end_of[b] - b)
        active = np.flatnonzero(~differs)
        offset = 0
        while len(active):
            unequal = t[a[active] + offset] != t[b[active] + offset]
            differs[active[unequal]] = True
            active = active[~unequal]
            offset += 1
            active = active[a[active] + offset <= end_of[a[active]]]
        names = np.cumsum(np.concatenate(([0], differs.astype(np.int64))))
        if names[-1] + 1 < len(ordered):
            name_at = np.empty(n, np.int32)
            name_at[ordered] = names
            reduced = name_at[lms]
            ordered = lms[suffix_array(reduced)]
    return _induce(t, smaller, ordered, starts, ends, before, up, down)


def common_prefixes(t: np.ndarray, sa: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes, by place in t: the place before it in the suffix order (-1 for the first), and the length
    of their common prefix, which is exact below limit and at least limit else.

    Only irreducible places (whose symbols to the left differ) are compared; the others follow from the place before."""
    n = len(t)
    prior = np.full(n, -1, np.int32)
    prior[sa[1:]] = sa[:-1]
    at = np.flatnonzero(prior >= 0).astype(np.int32)
    left = prior[at]
    irreducible = at[(at == 0) | (left == 0) | (t[np.maximum(at - 1, 0)] != t[np.maximum(left - 1, 0)])]
    # lengths that reducible places take over can be limit + their distance, so compare as far as the next irreducible one
    length = np.zeros(n, np.int32)
    ends = np.append(irreducible[1:], n) if len(irreducible) else irreducible
    most = (ends - irreducible) + limit
    i, j, room = irreducible, prior[irreducible], most.copy()
    done = np.zeros(len(i), np.int32)
    active = np.arange(len(i))
    while len(active):
        p, q = i[active] + done[active], j[active] + done[active]
        equal = (p < n) & (q < n)
        equal[equal] = t[p[equal]] == t[q[equal]]
        done[active[equal]] += 1
        active = active[equal]
        active = active[done[active] < room[active]]
    length[irreducible] = done
    known = np.full(n, -1, np.int32)
    known[irreducible] = irreducible
    source = np.maximum.accumulate(known)
    ok = (prior >= 0) & (source >= 0)
    length = np.where(ok, np.maximum(0, length[np.maximum(source, 0)] - (np.arange(n, dtype=np.int32) - source)), 0)
    return prior, length
