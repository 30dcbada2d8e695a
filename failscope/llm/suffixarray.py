"""Suffix arrays by induced sorting, vectorised over runs of buckets.

The classic scheme: classify suffixes, sort the leftmost-smaller (LMS) substrings by
inducing from unsorted ones, name them, sort their suffixes recursively, and induce
the whole array from those.  An induced scan handles a run of buckets at once as long
as no bucket of the run feeds another one; a bucket that feeds itself (runs of one
letter) is scanned in rounds.  Time is linear up to the sorts within a run.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor; the last one (the sentinel) counts as such."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    smaller = s[differs] < s[differs + 1]
    out = np.ones(n, bool)
    if n > 1:
        # Equal letters take the type of the next place where the letter changes.
        out[:-1] = np.repeat(smaller, np.diff(np.r_[-1, differs]))[:n - 1]
    return out


def _runs(feeds: np.ndarray, loops: np.ndarray) -> list[tuple[int, int]]:
    """Greedy runs [a, b] of buckets; ``feeds[d]``: the last bucket below d that feeds d (-1: none)."""
    out, a, k = [], 0, len(feeds)
    feed, loop = feeds.tolist(), loops.tolist()
    for d in range(1, k):
        if feed[d] >= a or loop[d] or loop[a]:
            out.append((a, d - 1))
            a = d
    out.append((a, k - 1))
    return out


def _spread(sa: np.ndarray, suffixes: np.ndarray, letters: np.ndarray, pointer: np.ndarray, step: int) -> None:
    """Append the suffixes to their buckets in order, upwards (step 1) or downwards (-1)."""
    if not len(suffixes):
        return
    order = np.argsort(letters, kind="stable")
    ordered = letters[order].astype(np.int64)
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(ordered)])
    rank = np.arange(len(ordered)) - np.repeat(starts, sizes)
    sa[pointer[ordered] + step * rank] = suffixes[order]
    pointer[ordered[starts]] += step * sizes


def _induce(s: np.ndarray, small: np.ndarray, ends: np.ndarray, starts: np.ndarray, lms: np.ndarray, plan: tuple) -> np.ndarray:
    """The suffix array induced from LMS suffixes in the given order."""
    n = len(s)
    sa = np.full(n, -1, np.int32)
    tail = ends - 1
    letters = s[lms]
    _spread(sa, lms[::-1], letters[::-1], tail, -1)
    head = starts.copy()
    up, down, loops_up, loops_down = plan

    def larger_before(block: np.ndarray) -> np.ndarray:
        pred = block[block > 0] - 1
        return pred[~small[pred]]

    for a, b in up:
        if loops_up[a]:
            done = starts[a]
            while done < head[a]:
                upto = head[a]
                pred = larger_before(sa[done:upto])
                _spread(sa, pred, s[pred], head, 1)
                done = upto
            pred = larger_before(sa[tail[a] + 1:ends[a]])
        else:
            pred = larger_before(sa[starts[a]:ends[b]])
        _spread(sa, pred, s[pred], head, 1)

    tail = ends - 1
    sa[0] = n - 1
    tail[0] -= 1

    def smaller_before(block: np.ndarray) -> np.ndarray:
        pred = block[block > 0] - 1
        return pred[small[pred]]

    for a, b in down:
        if loops_down[b]:
            done = ends[b] - 1
            while done > tail[b]:
                upto = tail[b]
                pred = smaller_before(sa[upto + 1:done + 1][::-1])
                _spread(sa, pred, s[pred], tail, -1)
                done = upto
            pred = smaller_before(sa[starts[b]:head[b]][::-1])
        else:
            pred = smaller_before(sa[starts[a]:ends[b]][::-1])
        _spread(sa, pred, s[pred], tail, -1)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, whose last letter 0 occurs nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    k = int(s.max()) + 1
    s = s.astype(np.uint8 if k <= 256 else np.uint16 if k <= 65536 else np.int32)
    small = _types(s)
    ends = np.cumsum(np.bincount(s, minlength=k))
    starts = np.r_[0, ends[:-1]]
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1

    # Which buckets feed which, for the runs of both scans.
    this, after = s[:-1].astype(np.int64), s[1:].astype(np.int64)
    big = ~small[:-1]
    same = this == after
    loops_up, loops_down = np.zeros(k, bool), np.zeros(k, bool)
    loops_up[this[big & same]] = True
    loops_down[this[~big & same]] = True
    feeds = np.full(k, -1, np.int64)
    np.maximum.at(feeds, this[big & ~same], after[big & ~same])
    up = _runs(feeds, loops_up)
    feeds = np.full(k, k, np.int64)
    np.minimum.at(feeds, this[~big & ~same], after[~big & ~same])
    down = [(k - 1 - b, k - 1 - a) for a, b in _runs(k - 1 - feeds[::-1], loops_down[::-1])]
    plan = (up, down, loops_up, loops_down)

    sa = _induce(s, small, ends, starts, lms, plan)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    m = len(lms)
    if m <= 1:
        return sa

    place = np.zeros(n, np.int32)
    place[lms] = np.arange(m, dtype=np.int32)
    length = np.r_[np.diff(lms), 0] + 1
    size = length[place[ordered]]
    equal = np.r_[False, size[1:] == size[:-1]]
    at, offset = np.flatnonzero(equal), 0
    while len(at):  # letter by letter, for the pairs that are still equal
        at = at[size[at] > offset]
        same_letter = s[ordered[at] + offset] == s[ordered[at - 1] + offset]
        equal[at[~same_letter]] = False
        at, offset = at[same_letter], offset + 1
    names = np.cumsum(~equal) - 1
    if names[-1] + 1 < m:
        reduced = np.zeros(m, np.int32)
        reduced[place[ordered]] = names
        ordered = lms[suffix_array(reduced)]
    return _induce(s, small, ends, starts, ordered, plan)


def long_matches(s: np.ndarray, sa: np.ndarray, least: int, breaks: np.ndarray, cap: int) -> np.ndarray:
    """Whether each suffix shares its first ``least`` letters with a neighbour in the array.

    Common prefixes are computed in text order (permuted): compared letters only where
    the letter before differs from the one before the neighbour, and at ``breaks``;
    elsewhere the prefix is one shorter than that of the suffix before.  ``cap`` bounds
    the compared length; it must be ``least`` plus the longest distance between breaks.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    before = np.where(phi > 0, s[phi - 1], -1)
    fresh = np.ones(n, bool)
    fresh[1:] = (phi[1:] <= 0) | (s[:-1] != before[1:])
    fresh[breaks] = True
    start = np.flatnonzero(fresh & (phi >= 0))
    # Eight letters at a time, on overlapping 64-bit words; behind the end come differing paddings.
    padded = np.r_[s.astype(np.uint8), np.zeros(8, np.uint8)]
    word = np.lib.stride_tricks.as_strided(padded[:n].view(np.uint8), (n, 8), (1, 1)) if n else padded.reshape(0, 8)
    word = np.ascontiguousarray(word).view(np.uint64).ravel()
    value = np.zeros(n, np.int32)
    live = start
    shift = 0
    while len(live) and shift < cap:
        a, b = live + shift, phi[live] + shift
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        diff = word[a] ^ word[b]
        ends = diff != 0
        low = diff[ends]
        value[live[ends]] = shift + _zero_bytes(low)
        live = live[~ends]
        shift += 8
        value[live] = shift
    anchor = np.maximum.accumulate(np.where(fresh, at, 0))
    value = np.where(fresh, value, value[anchor] - (at - anchor))
    linked = value >= least
    out = linked.copy()
    out[phi[linked]] = True
    return out


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """Number of equal low bytes of a nonzero difference."""
    count = np.zeros(len(x), np.int32)
    rest = x.copy()
    for step in (4, 2, 1):
        zero = (rest & np.uint64((1 << (8 * step)) - 1)) == 0
        count[zero] += step
        rest[zero] >>= np.uint64(8 * step)
    return count
