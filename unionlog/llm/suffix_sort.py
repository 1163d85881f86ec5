"""Suffix arrays by induced sorting, on whole arrays instead of symbol by symbol.

Suffixes are S (smaller than the next one) or L; an LMS suffix is an S whose left neighbour is an L. Sorted
LMS suffixes induce the L suffixes, bucket by bucket upwards, and these the S suffixes downwards. Within a bucket
the suffixes induced by the bucket itself come in waves; each wave is a few array operations, so a pass
costs O(n) work in O(256 x longest run of one byte) steps. The LMS substrings are sorted by the same induction
from their unsorted order and named; where names repeat, the string of names is sorted by naming pairs of
names, then pairs of pairs, until all differ.

Common prefixes are computed in text order (permuted): an entry follows from its left neighbour's, less one,
unless the bytes before both suffixes differ; only those irreducible entries are compared.
"""

from __future__ import annotations

import numpy as np


def _eights(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as one number, first byte lowest; zeros past the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    out = np.zeros(len(t), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(t)].astype(np.uint64) << np.uint64(8 * i)
    return out


def common_lengths(eights: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """For each pair of places the length of the common prefix, up to `most` or an end of the text."""
    n = len(eights)
    out = np.minimum(most, n - np.maximum(a, b))
    active = np.arange(len(a))
    at = 0
    while len(active):
        active = active[out[active] > at]
        if not len(active):
            break
        diff = eights[a[active] + at] ^ eights[b[active] + at]
        differ = diff != 0
        hit, d = active[differ], diff[differ]
        lowest = d & (~d + np.uint64(1))
        bit = np.log2(lowest.astype(np.float64)).astype(np.int64)  # exact: powers of two
        out[hit] = np.minimum(out[hit], at + bit // 8)
        active = active[~differ]
        at += 8
    return out


def types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes. The end of the text is smaller than any byte, so the last suffix is L."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    step[-1] = -1
    # Equal neighbours take the type of the next place that differs.
    places = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(places[::-1])[::-1]
    return step[decides] > 0


def _place(sa: np.ndarray, edge: np.ndarray, t: np.ndarray, js: np.ndarray, down: bool) -> None:
    """Puts suffixes, in order, at the next free places of their buckets."""
    chars = t[js]
    order = np.argsort(chars, kind="stable")
    counts = np.bincount(chars, minlength=256)
    starts = np.cumsum(counts) - counts
    sorted_chars = chars[order]
    rank = np.arange(len(js)) - starts[sorted_chars]
    if down:
        sa[edge[sorted_chars] - 1 - rank] = js[order]
        edge -= counts
    else:
        sa[edge[sorted_chars] + rank] = js[order]
        edge += counts


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced by an order of the LMS suffixes."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    sizes = np.bincount(t, minlength=256)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    lms_chars = t[lms]
    by_char = lms[np.argsort(lms_chars, kind="stable")]
    lms_ends = np.cumsum(np.bincount(lms_chars, minlength=256))
    used = np.flatnonzero(sizes)
    head = heads.copy()
    _place(sa, head, t, np.array([n - 1]), False)
    for c in used:
        at = heads[c]
        while at < head[c]:  # each turn takes what the bucket has got meanwhile
            cur, at = sa[at : head[c]], head[c]
            js = cur[cur > 0] - 1
            js = js[~is_s[js]]
            if len(js):
                _place(sa, head, t, js, False)
        own = by_char[(lms_ends[c - 1] if c else 0) : lms_ends[c]]
        if len(own):
            _place(sa, head, t, own - 1, False)
    l_ends = head
    tail = ends.copy()
    for c in used[::-1]:
        at = ends[c]
        while at > tail[c]:
            cur, at = sa[tail[c] : at][::-1], tail[c]
            js = cur[cur > 0] - 1
            js = js[is_s[js]]
            if len(js):
                _place(sa, tail, t, js, True)
        cur = sa[heads[c] : l_ends[c]][::-1]
        js = cur[cur > 0] - 1
        js = js[is_s[js]]
        if len(js):
            _place(sa, tail, t, js, True)
    return sa


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by naming pairs of names until all differ."""
    m = len(names)
    rank = names.astype(np.int64) + 1
    width = 1
    while True:
        after = np.zeros(m, np.int64)
        after[: m - width if width < m else 0] = rank[width:] if width < m else 0
        key = rank * (m + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.all():
            return order
        width *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a uint8 array, in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    is_s = types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms):
        first = induce(t, is_s, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_substring = first[is_lms[first]]
        # Equal substrings are neighbours now: they reach to the next LMS place and have equal bytes.
        reach = np.empty(n, np.int64)
        reach[lms] = np.concatenate([lms[1:], [n]]) - lms + 1
        a, b = by_substring[:-1], by_substring[1:]
        length = reach[a]
        same = (length == reach[b]) & (a + length <= n) & (b + length <= n)
        pairs = np.flatnonzero(same)
        if len(pairs):
            eights = _eights(t)
            got = common_lengths(eights, a[pairs], b[pairs], int(length[pairs].max()))
            same[pairs] = got >= length[pairs]
        names = np.empty(n, np.int64)
        names[by_substring] = np.concatenate([[0], np.cumsum(~same)])
        if same.any():
            lms = lms[_order_of_names(names[lms])]
        else:
            lms = by_substring
    return induce(t, is_s, lms)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int, fresh: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix and the one before it in order.

    Exact up to most less the distance to the last place in `fresh` (True where entries are compared in any
    case, so that none is derived over a long way).
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    compared = fresh | (phi <= 0)
    compared[0] = True
    inner = np.flatnonzero(~compared)
    compared[inner] = t[inner - 1] != t[phi[inner] - 1]
    at = np.flatnonzero(compared & (phi >= 0))
    own = np.zeros(n, np.int64)
    own[at] = common_lengths(_eights(t), at, phi[at], most)
    last = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
    return np.maximum(own[last] - (np.arange(n) - last), 0)
