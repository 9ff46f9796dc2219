"""Suffix arrays of many short strings by two-stage sorting, in numpy.

Only suffixes smaller than their successors are sorted directly; the others are induced: a scan of the buckets in order puts the
predecessor of each suffix at the next place of its own bucket. Every string ends with a separator of its own, smaller than any byte.
"""

from __future__ import annotations

import numpy as np

PACK = 7  # symbols of 9 bits in a word


def _packed(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """PACK symbols from each place on as one number; past the place's own separator all are 0."""
    one = np.concatenate([s, np.zeros(PACK, dtype=np.int64)])
    two = (one[:-1] << 9) | one[1:]
    four = (two[:-2] << 18) | two[2:]
    n = len(s)
    seven = (four[:n] << 27) | (two[4 : 4 + n] << 9) | one[6 : 6 + n]
    masks = np.array([((1 << (9 * k)) - 1) << (9 * (PACK - k)) for k in range(PACK + 1)], dtype=np.int64)
    return seven & masks[np.minimum(ends - np.arange(n), PACK)]


def _direct(packed: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorts the suffixes at `at` (ascending places) by their strings, equal ones by place, which is the separators' order (all sorts are stable)."""
    key = packed[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    ended = key % 512 == 0
    depth = 0
    while len(at):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero((np.bincount(group)[group] > 1) & ~ended)
        if not len(tied):
            break
        depth += PACK
        place = at[tied] + depth
        key = np.where(place < ends[at[tied]], packed[np.minimum(place, len(packed) - 1)], 0)
        order = np.lexsort((key, group[tied]))
        at[tied], key = at[tied][order], key[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (group[tied][1:] != group[tied][:-1])])
        new[tied] = new[tied] | first
        ended[tied] = key % 512 == 0
    return at


def suffix_array(s: np.ndarray, ends: np.ndarray, packed: np.ndarray | None = None) -> np.ndarray:
    """The sorted places of all suffixes of s: symbols from 1 to 256, 0 for separators; ends[i]: the place of the separator after i (or at i).

    s ends with a separator; a separator is smaller than those after it. packed: of _packed, if it is known.
    """
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])
    run_end = change[np.minimum(np.searchsorted(change, np.arange(n)), max(0, len(change) - 1))] if len(change) else np.full(n, n - 1)
    follows = np.minimum(run_end + 1, n - 1)
    smaller = (s[follows] > s) & (np.arange(n) <= (change[-1] if len(change) else -1))
    smaller[s == 0] = True  # separators are sorted by place
    larger = ~smaller
    direct = np.flatnonzero(smaller & (s > 0))
    direct = _direct(_packed(s, ends) if packed is None else packed, ends, direct)
    by_symbol = {0: np.flatnonzero(s == 0)}
    cuts = np.searchsorted(s[direct], np.arange(1, 258))
    out: list[np.ndarray] = []
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    for c in range(257):
        own = by_symbol[0] if c == 0 else direct[cuts[c - 1] : cuts[c]]
        induced = waiting[c]
        if induced:
            induced = [np.concatenate(induced)]
            while True:  # runs of one symbol induce within their bucket
                last = induced[-1]
                before = last[last > 0] - 1
                before = before[larger[before] & (s[before] == c)]
                if not len(before):
                    break
                induced.append(before)
        bucket = np.concatenate([*induced, own]) if induced else own
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[larger[before] & (s[before] > c)]
        if len(before):
            symbols = s[before]
            order = np.argsort(symbols, kind="stable")
            symbols, before = symbols[order], before[order]
            for part, x in zip(np.split(before, np.flatnonzero(np.diff(symbols)) + 1), symbols[np.concatenate([[True], symbols[1:] != symbols[:-1]])].tolist()):
                waiting[x].append(part)
    return np.concatenate(out)


def symbols_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings one after the other as symbols with separators, and for each place that of its separator."""
    lens = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    seps = np.cumsum(lens + 1) - 1
    s = np.zeros(int(seps[-1]) + 1, dtype=np.int64)
    text = np.ones(len(s), dtype=bool)
    text[seps] = False
    s[text] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int64) + 1
    return s, np.repeat(seps, lens + 1)


def common_prefixes(s: np.ndarray, ends: np.ndarray, packed: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order the length, up to `most`, of what it shares with the one before (0 for the first): PACK symbols at once, then one by one."""
    out = np.zeros(len(order), dtype=np.int64)
    live = np.arange(1, len(order))
    apart = []
    for j in range(0, most, PACK):
        a, b = order[live] + j, order[live - 1] + j
        last = len(packed) - 1
        x = np.where(a < ends[order[live]], packed[np.minimum(a, last)], 0)
        y = np.where(b < ends[order[live - 1]], packed[np.minimum(b, last)], 0)
        same = (x == y) & (x % 512 != 0)  # PACK symbols of both
        apart.append(live[~same])
        live = live[same]
        out[live] += PACK
    live = np.concatenate([*apart, live])
    live = live[out[live] < most]
    for _ in range(PACK - 1):
        a, b = order[live] + out[live], order[live - 1] + out[live]
        same = (a < ends[order[live]]) & (b < ends[order[live - 1]])
        same[same] = s[a[same]] == s[b[same]]
        live = live[same]
        out[live] += 1
    return np.minimum(out, most)


def repeated(strings: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The substrings of `length` bytes that occur under different ids: (string, offset, least id, greatest id) for each place.

    low, high: the least and the greatest id that each string stands for.
    """
    s, ends = symbols_of(strings)
    packed = _packed(s, ends)
    order = suffix_array(s, ends, packed)
    order = order[ends[order] - order >= length]
    if not len(order):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    first = common_prefixes(s, ends, packed, order, length) < length
    starts = np.flatnonzero(first)
    seps = np.flatnonzero(s == 0)
    number = np.zeros(len(s), dtype=np.int64)
    number[seps[:-1] + 1] = 1
    which = np.cumsum(number)[order]
    least, most = np.minimum.reduceat(low[which], starts), np.maximum.reduceat(high[which], starts)
    group = np.cumsum(first) - 1
    keep = least[group] < most[group]
    begin = np.concatenate([[0], seps[:-1] + 1])
    return which[keep], (order - begin[which])[keep], least[group][keep], most[group][keep]
