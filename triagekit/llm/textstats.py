"""Per-document text statistics on flat byte arrays (numpy, one round of texts at a time)."""

from __future__ import annotations

import numpy as np

from .common import IS_SPACE, span_hashes, window_hashes, word_spans

REPEAT_WINDOW = 8


def _table(chars: str | bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars if isinstance(chars, bytes) else chars.encode())] = 1
    return t


SYMBOL = _table("#*$%&|<>")
DIGIT = _table("0123456789")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
PUNCT = _table(".,;:!?\"'()-")
#: Bytes that begin a character and stand in a word.
WORD_CHAR = (~IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)


def per_text(table: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``table[byte]`` over each text."""
    total = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(table[flat], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(words: np.ndarray, first: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of ``width`` words found twice or more in it."""
    out = np.zeros(len(first) - 1, np.int64)
    full = window_hashes(words, width)
    for i in range(len(out)):
        a, b = first[i], first[i + 1]
        if b - a <= width:
            continue
        w = full[a:b - width + 1]
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(w), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(b - a + 1, np.int64)
        at = np.flatnonzero(twice)
        cover[at] += 1
        cover[at + width] -= 1  # window starts are distinct, so each place is hit once
        out[i] = np.count_nonzero(np.cumsum(cover)[:-1])
    return out


def line_counts(data: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def statistics(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = word_spans(flat, offsets)
    words = span_hashes(flat, starts, ends)
    n = len(offsets) - 1
    data = flat.tobytes()
    lines = np.array([line_counts(data[offsets[i]:offsets[i + 1]]) for i in range(n)], np.int64).reshape(n, 2)
    distinct = np.array([len(np.unique(words[first[i]:first[i + 1]])) for i in range(n)], np.int64)
    return {
        "n_words": np.diff(first), "word_chars": per_text(WORD_CHAR, flat, offsets),
        "n_symbols": per_text(SYMBOL, flat, offsets), "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeat_words(words, first), "n_lines": lines[:, 0], "n_distinct": distinct,
        "n_digits": per_text(DIGIT, flat, offsets), "n_upper": per_text(UPPER, flat, offsets),
        "n_punct": per_text(PUNCT, flat, offsets)}
