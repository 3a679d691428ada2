"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

#: Symbols that are compared at a time.
SYMBOLS = 6


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last is S, being followed by nothing."""
    n = len(t)
    s = np.empty(n, bool)
    s[-1] = True
    if n > 1:
        differ = np.flatnonzero(t[1:] != t[:-1])
        up = np.concatenate([t[differ] < t[differ + 1], [False]])  # a run at the end: each suffix is larger than the next
        s[:-1] = np.repeat(up, np.diff(np.concatenate([[-1], differ, [n - 2]])))
    return s


def _rank_strings(seq: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, name) of the strings seq[start:stop]. Ties are refined by as many symbols at a time as fit in a key."""
    m = len(start)
    name = np.zeros(m, np.int64)
    active, at = np.arange(m), start.copy()
    bits = (int(seq.max()) + 1).bit_length()
    width = max(1, 62 // bits)  # symbols of a key
    padded = np.concatenate([seq, np.zeros(width, seq.dtype)]) + 1
    groups = 0  # bits of a name, once names have been given
    while len(active):
        take = max(1, (62 - groups) // bits)
        p, e = at[active], stop[active]
        key = np.zeros(len(active), np.int64)
        for k in range(take):
            key = key << bits | np.where(p + k < e, padded[np.minimum(p + k, len(seq))], 0)
        g = name[active]
        if groups + take * bits <= 62:
            o = np.argsort(g << (take * bits) | key)  # equal strings in any order
        else:
            o = np.lexsort((key, g))
        a, k, g = active[o], key[o], g[o]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
        head = np.concatenate([[True], g[1:] != g[:-1]])
        first = np.flatnonzero(head)
        place = np.arange(len(a))
        name[a] = g + (np.maximum.accumulate(np.where(new, place, 0)) - first[np.cumsum(head) - 1])
        at[a] += take
        size = np.diff(np.append(np.flatnonzero(new), len(a)))
        left = a[np.repeat(size > 1, size)]
        active = left[at[left] < stop[left]]
        groups = int(m).bit_length()
    return np.argsort(name), name


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array from the sorted leftmost S positions: L suffixes from the left, then S suffixes from the right, bucket by bucket."""
    n, size = len(t), np.bincount(t)
    t = t.astype(np.uint16)  # sorted by radix
    end = np.cumsum(size)
    begin = end - size
    n_l = np.bincount(t[~s], minlength=len(size))
    sa = np.full(n, -1, np.int64)
    lms_of = np.searchsorted(t[lms], np.arange(len(size) + 1))
    fill = begin.copy()

    def put(found: np.ndarray, step: int) -> None:
        """found, in order, at the next free places of their buckets (from the left, or from the right)."""
        c = t[found]
        o = np.argsort(c, kind="stable")
        c, f = c[o], found[o]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.append(first, len(c)))
        k = np.arange(len(c)) - np.repeat(first, count)
        if step > 0:
            sa[fill[c] + k] = f
        else:
            sa[fill[c] - 1 - k] = f
        fill[c[first]] += step * count

    def before(x: np.ndarray, kind: bool) -> np.ndarray:
        x = x[x > 0] - 1
        return x[s[x] == kind]

    for c in np.flatnonzero(size):
        done = begin[c]
        while done < fill[c]:
            wave = sa[done : fill[c]]
            done = fill[c]
            if len(f := before(wave, False)):
                put(f, 1)
        if len(f := before(lms[lms_of[c] : lms_of[c + 1]], False)):
            put(f, 1)
    sa[0] = n - 1  # the end, which nothing induces
    fill = end.copy()
    fill[t[-1]] -= 1
    for c in np.flatnonzero(size)[::-1]:
        done = end[c]
        while fill[c] < done:
            wave = sa[fill[c] : done][::-1]
            done = fill[c]
            if len(f := before(wave, True)):
                put(f, -1)
        if n_l[c] and len(f := before(sa[begin[c] : begin[c] + n_l[c]][::-1], True)):
            put(f, -1)
    return sa


def _induce_wide(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As _induce, over an alphabet of names: buckets hold next to nothing, so suffixes are induced one by one."""
    n, size = len(t), np.bincount(t)
    end = np.cumsum(size)
    front, back = (end - size).tolist(), (end - 1).tolist()
    sa = np.full(n, -1, np.int64)
    # sorted leftmost S positions at the ends of their buckets, in order
    c = t[lms]
    last = np.concatenate([c[1:] != c[:-1], [True]]) if len(c) else np.zeros(0, bool)
    run = np.flatnonzero(last)
    until = np.repeat(run, np.diff(np.concatenate([[-1], run]))) if len(c) else run
    sa[end[c] - 1 - (until - np.arange(len(c)))] = lms
    sa[0] = n - 1
    order, symbol, small = sa.tolist(), t.tolist(), s.tolist()
    for j in order:  # grows while it is read: what is put lies further right
        if j > 0 and not small[j - 1]:
            x = symbol[j - 1]
            order[front[x]] = j - 1
            front[x] += 1
    for i in range(n - 1, -1, -1):
        j = order[i]
        if j > 0 and small[j - 1]:
            x = symbol[j - 1]
            order[back[x]] = j - 1
            back[x] -= 1
    out = np.array(order, np.int64)
    out[0] = n - 1
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of t's suffixes in their order. t: non-negative whole numbers, of which the last is the only least one."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    seq = (t.astype(np.int64) << 1) | s
    following = np.append(lms[1:], n - 1)  # the last one is the end itself
    order, name = _rank_strings(seq, lms, following + 1)
    names = np.cumsum(np.concatenate([[0], np.diff(name[order]) != 0])) if len(order) else name
    reduced = np.empty(len(lms), np.int64)
    reduced[order] = names
    if len(lms) and names[-1] + 1 < len(lms):
        order = suffix_array(reduced)
    lms = lms[order]
    if int(t.max()) < 1024:
        return _induce(t, s, lms)
    return _induce_wide(t, s, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, fresh: np.ndarray) -> np.ndarray:
    """For each position the length of the prefix that it shares with the suffix before it in sa, up to `most`.

    Where the characters before the two agree, the length is that of the position before less one; only the others, and
    the positions `fresh`, are compared. Exact as far as `most` less the distance from the last position compared.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    own = np.ones(n, bool)
    ok = (i > 0) & (phi > 0)
    own[ok] = t[i[ok] - 1] != t[phi[ok] - 1]
    own[fresh] = True
    own[1:][phi[:-1] < 0] = True
    plcp = np.zeros(n, np.int64)
    active = np.flatnonzero(own & (phi >= 0))
    # SYMBOLS at a time, in ten bits each; the end is unlike all else, so no comparison goes beyond it
    wide = np.concatenate([t.astype(np.int64), np.full(SYMBOLS, 1023)])
    packed = sum(wide[k : k + n] << 10 * k for k in range(SYMBOLS))
    while len(active):
        x = packed[active + plcp[active]] ^ packed[phi[active] + plcp[active]]
        part = x != 0
        bit = np.log2((x[part] & -x[part]).astype(np.float64)).astype(np.int64)  # the lowest one that differs
        plcp[active] += SYMBOLS
        plcp[active[part]] += bit // 10 - SYMBOLS
        active = active[~part]
        active = active[plcp[active] < most]
    last = np.maximum.accumulate(np.where(own, i, 0))
    return np.maximum(plcp[last] - (i - last), 0)
