"""SuperMinHash signatures of many sets at once (numpy).

Each element draws, from a generator seeded by its hash, a uniform number r and a step
of a Fisher-Yates shuffle for j = 0, 1, ...; the slot that the shuffle puts at place j
competes with r + j.  Ranks of one element are a permutation over the slots, which
correlates them and lowers the variance below that of independent hashes.  Once every
slot of a set is below j, no later draw can win: the set stops early, so a large set
makes one or two draws per element instead of one per slot.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _draw(seed: np.ndarray, j: int) -> np.ndarray:
    return mix64(seed + np.uint64(((j + 1) * int(_STEP)) % (1 << 64)))


def signatures(elements: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """(sets, slots) uint32: j in the high bits, r below, so that order is that of r + j.

    ``elements`` are the 64-bit hashes of all sets in a row, ``first`` their borders.
    Empty sets keep the largest value in every slot.
    """
    n = len(first) - 1
    low = 32 - int(slots).bit_length()
    out = np.full(n * slots, np.uint32(0xFFFFFFFF), np.uint32)
    owner = np.repeat(np.arange(n), np.diff(first))
    seed, done = elements, np.zeros(n, bool)
    chosen: list[np.ndarray] = []  # the shuffle's step per earlier j, for the live elements
    table = None                   # dense permutations once few elements are left
    for j in range(slots):
        if not len(seed):
            break
        h = _draw(seed, j)
        r = (h >> np.uint64(64 - low)).astype(np.uint32)
        k = j + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j < 8:
            slot = k.copy()
            for i in range(j - 1, -1, -1):  # follow the swaps back to where the place came from
                slot = np.where(slot == chosen[i], i, slot)
            chosen.append(k)
        else:
            rows = np.arange(len(seed))
            if table is None:
                table = np.tile(np.arange(slots, dtype=np.int16), (len(seed), 1))
                for i, c in enumerate(chosen):
                    a, b = table[rows, i].copy(), table[rows, c].copy()
                    table[rows, i], table[rows, c] = b, a
            slot = table[rows, k].astype(np.int64)
            table[rows, k] = table[rows, j]
        np.minimum.at(out, owner * slots + slot, np.uint32(j << low) | r)
        full = out.reshape(n, slots)[np.unique(owner)].max(axis=1) < np.uint32(((j + 1) << low) & 0xFFFFFFFF) \
            if j + 1 < slots else None
        if full is not None:
            done[np.unique(owner)[full]] = True
            live = ~done[owner]
            if not live.all():
                seed, owner = seed[live], owner[live]
                chosen = [c[live] for c in chosen]
                table = table[live] if table is not None else None
    return out.reshape(n, slots)
