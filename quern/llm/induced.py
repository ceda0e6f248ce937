"""External induced sorting of suffixes with common-prefix values.

The types of suffixes (L: larger than the next one, S: smaller), the sorting of the S* suffixes
(S behind an L) by the names of their substrings and recursion, and the two inductions are those
of induced sorting. Each induction runs through a priority queue that is an array with one range for each
first character: entries (position, common prefix with the one before) come out in order, and the suffix
that an entry induces goes to the next free place in its character's range. What comes out at once is as
long a piece of the queue as can be before anything falls into that piece itself, so all steps
are over arrays. Queues that are larger than ``Memory.limit`` are files in a scratch folder of the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

BIG = np.int16(32000)


class Memory:
    """Arrays in memory, or, beyond ``limit`` bytes each, in files that go with this object."""

    def __init__(self, limit: int = 256 << 20):
        self.limit, self.folder, self.n = limit, None, 0

    def full(self, n: int, value: int, kind) -> np.ndarray:
        kind = np.dtype(kind)
        if n * kind.itemsize <= self.limit:
            return np.full(n, value, kind)
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.n += 1
        out = np.memmap(f"{self.folder.name}/{self.n}", kind, "w+", shape=(n,))
        for k in range(0, n, 1 << 24):
            out[k : k + (1 << 24)] = value
        return out

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()
            self.folder = None


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one, a character smaller than all others, is S."""
    step = np.diff(text.astype(np.int64))
    change = np.append(np.flatnonzero(step), len(step))
    at = np.searchsorted(change, np.arange(len(step)))
    rises = np.append(step, 1)[change] > 0
    return np.append(rises[at], True)


def runs(text: np.ndarray, most: int) -> np.ndarray:
    """How often the character at each position follows itself from there on (itself included)."""
    ends = np.append(np.flatnonzero(np.diff(text)), len(text) - 1)
    return np.minimum(ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text)) + 1, most).astype(np.int16)


def substring_names(text: np.ndarray, s: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """For each S* position (ascending) the rank of its substring up to the next one; equal ones share it.

    Characters count with their types, so no substring is a proper prefix of another.
    """
    n = len(stars)
    ends = np.append(stars[1:], stars[-1])
    symbols = text.astype(np.uint64) * np.uint64(2) + s + np.uint64(1)
    bits = max(1, int(symbols.max()).bit_length())
    per = 63 // bits

    def word(which: np.ndarray, offset: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for k in range(per):
            at = stars[which] + offset + k
            inside = at <= ends[which]
            out = out << np.uint64(bits) | np.where(inside, symbols[np.minimum(at, len(text) - 1)], 0).astype(np.uint64)
        return out

    first = word(np.arange(n), 0)
    ordered = np.sort(first)
    rank = np.searchsorted(ordered, first)
    offset, longer = per, np.flatnonzero(ends - stars >= per)
    while len(longer):
        sizes = np.bincount(rank, minlength=n)
        longer = longer[sizes[rank[longer]] > 1]
        if not len(longer):
            break
        w = word(longer, offset)
        order = np.lexsort((w, rank[longer]))
        r, w = rank[longer][order], w[order]
        new_rank = np.append(True, r[1:] != r[:-1])
        new = new_rank | np.append(True, w[1:] != w[:-1])
        k = np.arange(len(r))
        rank[longer[order]] = r + np.maximum.accumulate(np.where(new, k, 0)) - np.maximum.accumulate(np.where(new_rank, k, 0))
        offset += per
        longer = longer[ends[longer] - stars[longer] >= offset]
    return rank


class _Prefixes:
    """Common prefixes of what one induction puts out, from those of what it takes in."""

    def __init__(self, sigma: int, most: int):
        self.least, self.met, self.most = np.full(sigma, BIG, np.int16), np.zeros(sigma, bool), most

    def step(self, lcp: np.ndarray, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For items taken from entries ``at`` (in order of c, then at), the common prefix with the item taken before in c, and whether there is one.

        ``lcp``: of each entry taken at once with the entry taken before it.
        """
        k, g = len(lcp), len(at)
        out, known = np.zeros(g, np.int16), np.zeros(g, bool)
        if g:
            first = np.append(True, c[1:] != c[:-1])
            # What lies between two takers: the entries behind the last one, up to this one.
            cuts = np.empty(2 * g, np.int64)
            cuts[0::2], cuts[1::2] = np.where(first, 0, np.append(0, at[:-1] + 1)), at + 1
            low = np.minimum.reduceat(np.append(lcp, BIG), cuts)[0::2]
            low = np.where(first, np.minimum(low, self.least[c]), low)
            known = ~first | self.met[c]
            out = np.minimum(low + 1, self.most).astype(np.int16)
        self.least = np.minimum(self.least, lcp.min())
        if g:
            last = np.append(c[1:] != c[:-1], True)
            ahead = np.append(np.minimum.accumulate(lcp[::-1])[::-1], BIG)
            self.least[c[last]] = ahead[at[last] + 1]
            self.met[c[last]] = True
        return out, known


def _piece(distance: np.ndarray, at: np.ndarray, m: int) -> tuple[int, int]:
    """How many entries can be taken, and how many of them induce, so that nothing falls among them."""
    least = np.minimum.accumulate(distance)
    taken = int(np.count_nonzero(least > at))
    return min(int(least[taken - 1]), int(at[taken]) if taken < len(at) else m), taken


def induce(text: np.ndarray, s: np.ndarray, stars: np.ndarray, sigma: int, memory: Memory, most: int = 0, star_lcp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The suffix array from the sorted S* suffixes, with common prefixes (up to ``most``) if theirs are given."""
    n, carry = len(text), star_lcp is not None
    all_l, all_s = np.bincount(text[~s], minlength=sigma), np.bincount(text[s], minlength=sigma)
    first_star = text[stars]
    n_star = np.bincount(first_star, minlength=sigma)
    begin = np.cumsum(all_l + n_star) - all_l - n_star
    star_begin = begin + all_l
    size = int(all_l.sum()) + len(stars)
    queue = memory.full(size, -1, np.int64)
    prefix = memory.full(size, 0, np.int16) if carry else None
    at = star_begin[first_star] + np.arange(len(stars)) - (np.cumsum(n_star) - n_star)[first_star]
    queue[at] = stars
    is_l = np.ones(size, bool)
    is_l[at] = False
    if carry:
        prefix[at] = np.where(np.append(True, first_star[1:] != first_star[:-1]), 0, star_lcp)
        same = runs(text, most)
        meets = np.sort(star_begin[(all_l > 0) & (n_star > 0)])
        prefixes = _Prefixes(sigma, most)
    free, p, width = begin.copy(), 0, 1024
    while p < size:
        x = queue[p : p + width]
        if len(gaps := np.flatnonzero(x < 0)):
            x = x[: gaps[0]]
        m = k = len(x)
        own = np.flatnonzero(~s[x - 1])  # before position 0 stands the last one, which is S
        y = x[own] - 1
        c = text[y]
        order = np.argsort(c, kind="stable")
        if len(own):
            sorted_c = c[order]
            begins = np.append(True, sorted_c[1:] != sorted_c[:-1])
            counted = np.arange(len(order))
            to = np.empty(len(order), np.int64)
            to[order] = free[sorted_c] + counted - np.maximum.accumulate(np.where(begins, counted, 0))
            k, taken = _piece(to - p, own, m)
            if taken < len(own):
                order = order[order < taken]
            to = to[order]
            queue[to] = y[order]
            c = c[order]
            last = np.append(c[1:] != c[:-1], True)
            free[c[last]] = to[last] + 1
        if carry:
            lo, hi = np.searchsorted(meets, (p, p + k))
            b = meets[lo:hi]
            prefix[b] = np.minimum(same[queue[b - 1]], same[queue[b]])
            value, known = prefixes.step(prefix[p : p + k], own[order], c)
            if len(own):
                prefix[to] = np.where(known, value, 0)
        p += k
        width = min(max(4 * k, 256), 1 << 18)

    begin = np.cumsum(all_l + all_s) - all_l - all_s
    out = memory.full(n, -1, np.int64)
    lcp = memory.full(n + 1, 0, np.int16) if carry else None
    letters = np.repeat(np.arange(sigma), all_l)
    at = begin[letters] + np.arange(len(letters)) - (np.cumsum(all_l) - all_l)[letters]
    out[at] = queue[is_l]
    out[0] = n - 1
    if carry:
        lcp[at] = prefix[is_l]
        meets = np.sort((begin + all_l)[(all_l > 0) & (all_s > 0)])
        prefixes = _Prefixes(sigma, most)
    del queue, prefix
    free, q, width = begin + all_l + all_s, n, 1024
    while q > 0:
        x = out[max(0, q - width) : q][::-1]
        if len(gaps := np.flatnonzero(x < 0)):
            x = x[: gaps[0]]
        m = k = len(x)
        own = np.flatnonzero((x > 0) & s[x - 1])
        y = x[own] - 1
        c = text[y]
        order = np.argsort(c, kind="stable")
        if len(own):
            sorted_c = c[order]
            begins = np.append(True, sorted_c[1:] != sorted_c[:-1])
            counted = np.arange(len(order))
            to = np.empty(len(order), np.int64)
            to[order] = free[sorted_c] - 1 - counted + np.maximum.accumulate(np.where(begins, counted, 0))
            k, taken = _piece(q - 1 - to, own, m)
            if taken < len(own):
                order = order[order < taken]
            to = to[order]
            out[to] = y[order]
            c = c[order]
            last = np.append(c[1:] != c[:-1], True)
            free[c[last]] = to[last]
        if carry:
            lo, hi = np.searchsorted(meets, (q - k + 1, min(q + 1, n)))
            b = meets[lo:hi]
            lcp[b] = np.minimum(same[out[b - 1]], same[out[b]])
            value, known = prefixes.step(lcp[q - k + 1 : q + 1][::-1], own[order], c)
            if len(own):
                lcp[to[known] + 1] = value[known]
        q -= k
        width = min(max(4 * k, 256), 1 << 18)
    return out, lcp[:n] if carry else None


def star_positions(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def sorted_stars(text: np.ndarray, s: np.ndarray, memory: Memory) -> np.ndarray:
    """The S* suffixes in order: by their substrings' names, and by recursion where names recur."""
    stars = star_positions(s)
    names = substring_names(text, s, stars)
    own, reduced = np.unique(names, return_inverse=True)
    if len(own) == len(stars):
        return stars[np.argsort(names)]
    return stars[suffix_array(reduced, len(own), memory)]


def suffix_array(text: np.ndarray, sigma: int, memory: Memory) -> np.ndarray:
    """Of numbers below ``sigma`` of which the last one is the only 0."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    s = smaller_than_next(text)
    return induce(text, s, sorted_stars(text, s, memory), sigma, memory)[0]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For suffixes in order, the common prefix of each with the one before, up to ``most``."""
    n = len(text)
    eight = np.zeros(n + most + 8, np.uint64)
    wide = np.zeros(n + most + 16, np.uint64)
    wide[:n] = text.astype(np.uint64) & np.uint64(255)
    for k in range(8):
        eight |= wide[k : k + len(eight)] << np.uint64(56 - 8 * k)
    del wide
    out = np.zeros(len(order), np.int64)
    todo = np.arange(1, len(order))
    for step in range(0, most, 8):
        differ = eight[order[todo] + step] ^ eight[order[todo - 1] + step]
        ended = differ != 0
        zeros = np.zeros(len(todo), np.int64)
        if ended.any():
            # Whole equal bytes at the front: those before the highest set bit.
            zeros[ended] = (63 - np.floor(np.log2(differ[ended].astype(np.float64))).clip(0, 63).astype(np.int64)) // 8
        out[todo] = step + np.where(ended, zeros, 8)
        todo = todo[~ended]
        if not len(todo):
            break
    return np.minimum(out, most).astype(np.int16)


def repeated_starts(text: np.ndarray, length: int, memory_limit: int = 256 << 20) -> np.ndarray:
    """For each position of a text of bytes whether the ``length`` characters from there start elsewhere too.

    ``text`` holds numbers from 1 to 256; a 0 is put behind it.
    """
    memory = Memory(memory_limit)
    try:
        text = np.append(text, 0).astype(np.int16)
        s = smaller_than_next(text)
        stars = sorted_stars(text, s, memory)
        order, lcp = induce(text, s, stars, 257, memory, length, common_prefixes(text, stars, length))
        same = lcp >= length
        out = np.zeros(len(text), bool)
        out[order[same]] = True
        out[order[np.flatnonzero(same) - 1]] = True
        return out[:-1]
    finally:
        memory.close()
