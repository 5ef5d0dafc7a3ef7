"""Small inputs with every awkward case the operators define, and brute-force versions."""

from __future__ import annotations

import random
import re
from collections import defaultdict

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as extra columns of the input.
CLASH = "size string, shard2 int, `key` string, rank int, u string, t int, grp string, row string, h int, `count` int"


def sentence(rng: random.Random, n: int, words: int = 400, stem: str = "w") -> str:
    return " ".join(f"{stem}{rng.randrange(words)}" for _ in range(n))


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    a, b, long = sentence(rng, 60), sentence(rng, 60), sentence(rng, 30_000, 20_000)
    texts = [(1, a), (2, a), (2, a), (3, a + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one"),
             (8, "one two three four"), (9, long), (10, long + " end"), (None, b), (None, None), (11, b + " x y"),
             (12, "ÄÖ ünï   “quotes”\n\nline\nline"), (13, "x" * 5000), (14, "!!! ??? 123"), (15, a.upper()),
             (7, "other text under the same id " + b)]
    langs, sources = ["en", "de", None], ["s0", "s1", None, "s0"]
    return [(i, t, langs[k % 3], sources[k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def edge_docs(spark, clash: bool = True):
    rows = edge_rows()
    if not clash:
        return spark.createDataFrame(rows, DOC)
    return spark.createDataFrame([(*r, "s", 1, "k", 2, "u", 3, "g", "r", 4, 5) for r in rows], f"{DOC}, {CLASH}")


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


def words10(text) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items) -> list[tuple]:
    """(n_words, n_hit, item ids) per document text."""
    windows = defaultdict(set)
    for item, text in items:
        w = words10(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i:i + 10])].add(item)
    out = []
    for _, text in docs:
        w, hit, ids = words10(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i:i + m])) in windows:
                    hit.update(range(i, i + m))
                    ids |= windows[k]
        out.append((len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return out


def shingles(text) -> set:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return ({tuple(w)} if w else set()) if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def near_components(docs) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeats(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(bytes removed, spans, what stays) per text."""
    count = defaultdict(int)
    for b in texts:
        for k in range(len(b) - length + 1):
            count[b[k:k + length]] += 1
    out = []
    for b in texts:
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                mark[k:k + length] = b"\1" * length
        out.append((sum(mark), len([x for x in bytes(mark).split(b"\0") if x]),
                    bytes(c for c, m in zip(b, mark, strict=True) if not m)))
    return out
