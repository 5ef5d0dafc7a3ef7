"""FM-index pieces on numpy arrays: suffix sorting, wavelet-matrix ranks, backward search.

Everything works on whole arrays of intervals, never one pattern at a time, and one
index covers one bounded shard of text.
"""

from __future__ import annotations

import numpy as np


def suffix_array(sym: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix positions in order of their first ``depth`` symbols (all if None).

    Prefix doubling that sorts again only what is still tied.  Ties beyond ``depth``
    stay in an arbitrary order, which backward search by at most ``depth`` steps does
    not notice.
    """
    n = len(sym)
    h, first_key = 1, sym
    if n and int(sym.max()) < 127:  # eight small symbols fit one sort key
        h, first_key = 8, np.zeros(n, np.int64)
        for j in range(8):
            first_key <<= 7
            first_key[:max(0, n - j)] |= sym[j:].astype(np.int64) + 1  # 0: beyond the end
    sa = np.argsort(first_key, kind="stable")
    ordered = first_key[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first  # a suffix's rank: where its group of ties begins
    tied = ~(new & np.append(new[1:], True)) if n else new
    at = np.flatnonzero(tied)
    while len(at) and (depth is None or h < depth):
        idx = sa[at]
        nxt = idx + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[idx] * np.int64(n + 2) + second
        order = np.argsort(key, kind="stable")
        idx, key = idx[order], key[order]
        sa[at] = idx
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[idx] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class BitRank:
    """Bit vector with rank: 64-bit words and the ones before each of them."""

    __slots__ = ("words", "before")

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        pad = -len(packed) % 8 + 8  # one word more, so that rank(len) can look
        self.words = np.concatenate([packed, np.zeros(pad, np.uint8)]).view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Symbol ranks on a sequence over 0..sigma-1, one bit vector per bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.sigma = len(seq), sigma
        self.levels: list[tuple[int, BitRank, int]] = []
        cur = seq
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            b = ((cur >> bit) & 1).astype(bool)
            self.levels.append((bit, BitRank(b), int(len(b) - b.sum())))
            cur = np.concatenate([cur[~b], cur[b]])
        self.counts = np.zeros(sigma + 1, np.int64)  # symbols below c in the sequence
        np.cumsum(np.bincount(seq, minlength=sigma), out=self.counts[1:])

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``c`` followed by what [lo, hi) starts with (one LF step)."""
        s, e, base = lo, hi, np.zeros(len(c), np.int64)
        for bit, ranks, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            rs, re, rb = ranks.rank1(s), ranks.rank1(e), ranks.rank1(base)
            s = np.where(one, zeros + rs, s - rs)
            e = np.where(one, zeros + re, e - re)
            base = np.where(one, zeros + rb, base - rb)
        start = self.counts[c]
        return start + s - base, start + e - base

    def back(self, i: np.ndarray) -> np.ndarray:
        """LF of single positions: reads the symbol and its rank on the way down."""
        s, base, c = i, np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for bit, ranks, zeros in self.levels:
            one = ranks.get(s)
            rs, rb = ranks.rank1(s), ranks.rank1(base)
            s = np.where(one, zeros + rs, s - rs)
            base = np.where(one, zeros + rb, base - rb)
            c |= one.astype(np.int64) << bit
        return self.counts[c] + s - base


class FMIndex:
    """Index of runs of symbols 1..sigma-1; symbol 0 separates runs, begins and ends the text."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = 8):
        n = len(text)
        gaps = text == 0
        # Separators sort by place, so that no order looks beyond one.
        sym = np.where(gaps, np.cumsum(gaps) - 1, text + int(gaps.sum()))
        sa = suffix_array(sym)
        bwt = text[np.where(sa > 0, sa - 1, 0)]
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), sigma)
        # Sampled positions: every few symbols and wherever a run begins, so that the
        # walk back never meets a separator.
        sampled = (sa % every == 0) | (bwt == 0)
        self.marks = BitRank(sampled)
        self.samples = sa[sampled]
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) per row of an (n, m) array of patterns, searched from their ends."""
        n, m = patterns.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        live = np.arange(n)
        for j in range(m - 1, -1, -1):
            if not len(live):
                break
            a, b = self.wavelet.step(patterns[live, j], lo[live], hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
        return lo, np.maximum(lo, hi)

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text position of each suffix-array index."""
        out, steps, todo, at = np.zeros(len(i), np.int64), 0, np.arange(len(i)), i.copy()
        while len(todo):
            done = self.marks.get(at)
            out[todo[done]] = self.samples[self.marks.rank1(at[done])] + steps
            todo, at = todo[~done], at[~done]
            at = self.wavelet.back(at)
            steps += 1
        return out


def _children(wavelet: WaveletMatrix, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of c w for every interval [lo, hi) of w and every symbol c > 0 before it."""
    base = np.zeros(len(lo), np.int64)  # where the symbols read so far begin at this level
    sym = np.zeros(len(lo), np.int64)
    for bit, ranks, zeros in wavelet.levels:
        l1, h1, b1 = ranks.rank1(lo), ranks.rank1(hi), ranks.rank1(base)
        l0, h0, b0 = lo - l1, hi - h1, base - b1
        left, right = np.flatnonzero(l0 < h0), np.flatnonzero(l1 < h1)
        lo = np.concatenate([l0[left], l1[right] + zeros])
        hi = np.concatenate([h0[left], h1[right] + zeros])
        base = np.concatenate([b0[left], b1[right] + zeros])
        sym = np.concatenate([sym[left], sym[right] | (1 << bit)])
    keep = sym > 0
    start = wavelet.counts[sym[keep]] - base[keep]
    return lo[keep] + start, hi[keep] + start


def long_prefix(sa: np.ndarray, text: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """True at i where the suffixes sa[i - 1] and sa[i] agree in at least ``depth`` symbols.

    Breadth-first backward extension on the transform: the intervals of all strings of
    length l come from those of length l - 1 by one symbol in front.  The first interval
    to end before i shows that the prefixes there part after l symbols; it is kept for
    the next length only then, so every place is visited once, by increasing value.  The
    walk stops at ``depth``; places not reached by then have longer common prefixes.
    Symbol 0 ends a text: strings may end with it, none goes on beyond it.
    """
    n = len(sa)
    wavelet = WaveletMatrix(text[np.where(sa > 0, sa - 1, n - 1)].astype(np.int64), sigma)
    open_ = np.ones(n + 1, bool)
    ends = int(wavelet.counts[1])
    open_[:ends + 1] = False  # suffixes that begin with an end, and the outer borders
    open_[n] = False
    lo, hi = np.array([0], np.int64), np.array([n], np.int64)
    for length in range(depth):
        lo, hi = _children(wavelet, lo, hi)
        if length == 0:  # the interval of the end symbol itself
            lo, hi = np.append(lo, 0), np.append(hi, ends)
            new = np.ones(len(lo), bool)
        else:
            new = open_[hi]
        open_[hi[new]] = False
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
    return open_[:n]
