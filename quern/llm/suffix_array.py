"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Induced sorting places a suffix once its successor stands. Suffixes of one bucket that stand already induce their
predecessors together, in the order in which a scan would meet them. A run of one symbol within its bucket is laid out at
once, from the lengths of the runs. Neighbouring buckets go together as long as none of them induces into another of them:
a batch of buckets is cut before the first that another one induces into, so that the many small buckets of a string of
names cost few steps.

The leftmost-smaller (LMS) substrings are named by rank, equal symbols by equal names; where names repeat, the string of
names is sorted in the same way (recursion), whatever the size of its alphabet.
"""

from __future__ import annotations

import numpy as np

from quern.llm import hashing as H

#: Places of a batch of buckets: the least and the most that are tried.
LEAST_BATCH, MOST_BATCH = 1024, 1 << 16


def classify(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successors (S-type); the last symbol is the unique least."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])
    smaller = np.ones(n, bool)
    if n > 1:
        following = change[np.searchsorted(change, np.arange(n - 1))]
        smaller[:-1] = s[following] < s[following + 1]
    return smaller


def run_places(s: np.ndarray) -> np.ndarray:
    """For each place, how many equal symbols stand right before it."""
    starts = H.runs(s[1:] == s[:-1])
    return np.arange(len(s)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(s)]])))


def _deal(sa: np.ndarray, places: np.ndarray, symbols: np.ndarray, at: np.ndarray, step: int) -> None:
    """Puts places into the buckets of their symbols, in order, at the pointers `at`, which move by step."""
    if not len(places):
        return
    n = len(places)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    starts = np.zeros(len(cuts) + 1, np.int64)
    starts[1:] = cuts
    lengths = np.empty_like(starts)
    lengths[:-1] = starts[1:] - starts[:-1]
    lengths[-1] = n - starts[-1]
    here = ordered[starts]
    if step > 0:
        sa[np.repeat(at[here] - starts, lengths) + np.arange(n)] = places[order]
        at[here] += lengths
    else:
        sa[np.repeat(at[here] + (starts - 1), lengths) - np.arange(n)] = places[order]
        at[here] -= lengths


def chains(places: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The places before the given ones in their runs, one step back for all, then two steps, and so on."""
    many = back[places]
    if not many.any():
        return places[:0]
    of = np.repeat(np.arange(len(places)), many)
    steps = H.ranges(np.ones(len(places), np.int64), many)
    order = np.argsort(steps, kind="stable")
    return places[of[order]] - steps[order]


def induce(s: np.ndarray, smaller: np.ndarray, back: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the given order; ends[c] is the end of bucket c."""
    starts = np.concatenate([[0], ends[:-1]])
    present = np.flatnonzero(ends > starts)
    low, high = starts[present], ends[present]
    sa = np.full(len(s), -1, np.int64)
    _deal(sa, lms[::-1], s[lms[::-1]], ends.copy(), -1)

    # larger suffixes: buckets in ascending order, each filled from its start
    heads = starts.copy()
    i, size = 0, LEAST_BATCH
    while i < len(present):
        j = max(i + 1, int(np.searchsorted(high, low[i] + size, "right")))
        if j > i + 1:
            found = sa[low[i] : high[j - 1]]
            before = found[found > 0] - 1
            before = before[~smaller[before]]
            into = s[before]
            inside = into[into <= present[j - 1]]
            if len(inside):
                cut = int(np.searchsorted(present, inside.min()))
                size = max(LEAST_BATCH, int(low[cut] - low[i]))
                j = max(cut, i + 1)
                if cut > i + 1:
                    found = sa[low[i] : high[cut - 1]]
                    before = found[found > 0] - 1
                    before = before[~smaller[before]]
                    into = s[before]
            else:
                size = min(2 * size, MOST_BATCH)
        if j == i + 1:
            c = present[i]
            more = chains(sa[low[i] : heads[c]], back)
            sa[heads[c] : heads[c] + len(more)] = more
            heads[c] += len(more)
            found = sa[low[i] : high[i]]
            before = found[found > 0] - 1
            before = before[~smaller[before] & (s[before] != c)]
            into = s[before]
            size = max(size, LEAST_BATCH)
        _deal(sa, before, into, heads, 1)
        i = j

    # smaller suffixes: buckets in descending order, each filled from its end
    sa[(sa >= 0) & smaller[sa]] = -1
    tails = ends.copy()
    i, size = len(present), LEAST_BATCH
    while i > 0:
        j = min(i - 1, int(np.searchsorted(low, high[i - 1] - size, "left")))
        if j < i - 1:
            found = sa[low[j] : high[i - 1]][::-1]
            before = found[found > 0] - 1
            before = before[smaller[before]]
            into = s[before]
            inside = into[into >= present[j]]
            if len(inside):
                cut = int(np.searchsorted(present, inside.max()))
                size = max(LEAST_BATCH, int(high[i - 1] - high[cut]))
                j = min(cut + 1, i - 1)
                if cut + 1 < i - 1:
                    found = sa[low[j] : high[i - 1]][::-1]
                    before = found[found > 0] - 1
                    before = before[smaller[before]]
                    into = s[before]
            else:
                size = min(2 * size, MOST_BATCH)
        if j == i - 1:
            c = present[j]
            more = chains(sa[tails[c] : high[j]][::-1], back)
            sa[tails[c] - len(more) : tails[c]] = more[::-1]
            tails[c] -= len(more)
            found = sa[low[j] : high[j]][::-1]
            before = found[found > 0] - 1
            before = before[smaller[before] & (s[before] != c)]
            into = s[before]
        _deal(sa, before, into, tails, -1)
        i = j
    sa[0] = len(s) - 1
    return sa


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Of s, which ends with its unique least symbol 0 and has symbols 0 .. symbols - 1."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller, back = classify(s), run_places(s)
    ends = np.cumsum(np.bincount(s, minlength=symbols))
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = induce(s, smaller, back, lms, ends)
    if len(lms) <= 1:
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    del sa
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    # neighbours in order have one name if their substrings have equal symbols
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    many = length[a[at]]
    equal = s[H.ranges(a[at], many)] == s[H.ranges(b[at], many)]
    same[at] = np.logical_and.reduceat(equal, np.cumsum(many) - many) if len(at) else False
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] == len(lms) - 1:
        return induce(s, smaller, back, ordered, ends)
    name = np.empty(n, np.int64)
    name[ordered] = names
    reduced, kinds = name[lms], int(names[-1]) + 1
    del name, length, equal, is_lms
    return induce(s, smaller, back, lms[suffix_array(reduced, kinds)], ends)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, before): for each place, the common prefix with the suffix before it in sa, and that suffix (-1: none).

    Where a place and its neighbour both follow from the place before, the value is one less than there; only the other,
    irreducible values are compared, eight symbols at a time. s holds values under 256 but for its separators.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (s[:-1] == s[np.maximum(before[1:] - 1, 0)])
    places = np.flatnonzero(~follows & (before >= 0))
    padded = np.concatenate([s, np.zeros(16, s.dtype)]).astype(np.uint64)
    four = padded[:-1] | (padded[1:] << H.U(16))
    eight = four[:-2] | (four[2:] << H.U(32))  # four symbols of 16 bits
    plcp = np.zeros(n, np.int64)
    at, other = places.copy(), before[places].copy()
    live = np.arange(len(places))
    most = np.zeros(len(places), np.int64)
    while len(live):
        inside = (at < n) & (other < n)
        at, other, live = at[inside], other[inside], live[inside]
        same = eight[at] == eight[other]
        ended = ~same
        if ended.any():
            a, b, which = at[ended], other[ended], live[ended]
            extra = np.zeros(len(which), np.int64)
            equal = np.ones(len(which), bool)
            for j in range(4):
                equal &= padded[a + j] == padded[b + j]
                extra += equal
            most[which] += extra
        at, other, live = at[same] + 4, other[same] + 4, live[same]
        most[live] += 4
    plcp[places] = most
    index = np.arange(n)
    last = np.maximum.accumulate(np.where(follows, -1, index))
    plcp = np.where(follows, np.maximum(plcp[last] - (index - last), 0), plcp)
    return plcp, before


def repeats(pieces: list[np.ndarray], counts: np.ndarray, owners: np.ndarray, length: int, shorter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, twice, shared) of the first counts[i] starts of each byte string, one string after another.

    twice: `length` bytes from there stand elsewhere in any of the strings, or in itself; shared: `shorter` bytes from there
    stand in a string of another owner, at one of its first places too.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    s = np.ones(int(sizes.sum()) + len(pieces) + 1, np.uint16)  # 1 separates, 0 ends
    s[-1] = 0
    firsts = (np.cumsum(sizes + 1) - sizes - 1).astype(np.int64)
    s[H.ranges(firsts, sizes)] = np.concatenate(pieces).astype(np.uint16) + 2
    sa = suffix_array(s, 258)
    plcp, _ = permuted_lcp(s, sa)
    common = plcp[sa]
    place = H.ranges(np.zeros(len(pieces), np.int64), counts)
    at = H.ranges(firsts, counts)
    # a string that is cut off by the end of its piece is shorter than it must be
    left = np.repeat(sizes, counts) - place

    hit = common >= length
    twice = np.zeros(len(s), bool)
    twice[sa[hit]] = True
    twice[sa[:-1][hit[1:]]] = True

    least, most = np.full(len(s), len(pieces), np.int64), np.full(len(s), -1, np.int64)
    least[at] = most[at] = np.repeat(owners, counts)
    groups = H.runs(common[1:] >= shorter)
    several = np.minimum.reduceat(least[sa], groups) < np.maximum.reduceat(most[sa], groups)
    shared = np.zeros(len(s), bool)
    shared[sa] = np.repeat(several, np.diff(np.concatenate([groups, [len(sa)]])))
    return place, twice[at] & (left >= length), shared[at] & (left >= shorter)
