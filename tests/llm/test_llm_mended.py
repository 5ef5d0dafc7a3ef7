"""Hash collisions, caps, clashing names, and brute-force forms added later."""

import math
import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import DOC, repeats, sentence  # noqa: E402

from triagekit.llm import langid, mixing, near_dedup, quality_rules, sharding, substring_dedup, token_files  # noqa: E402
from triagekit.llm.common import span_hashes  # noqa: E402


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


# ------------------------------------------------ words of equal old hashes
@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_words_are_told_apart(n):
    data = np.frombuffer((thue_morse(n) + thue_morse(n, "b", "a")).encode(), np.uint8)
    one, two = span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert one != two


def test_span_hashes_agree_wherever_a_span_stands():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 40_000).astype(np.uint8)
    data[30_000:30_700] = data[100:800]
    a, b = span_hashes(data, np.array([100, 30_000]), np.array([800, 30_700]))
    assert a == b == span_hashes(data[100:800], np.array([0]), np.array([700]))[0]


def test_thue_morse_words_in_the_operators(spark):
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    texts = [f"one two three four {a}", f"one two three four {b}", f"{a}\n{b}", f"{b} x {a}", " ".join([a, b] * 10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_digest(docs).collect()}
    assert near == {i: i for i in range(5)}
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup.dedup_digest(docs).collect()}
    assert got == {i: x[:2] for i, x in enumerate(repeats([t.encode() for t in texts], 400))}
    base = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_digest(docs).collect()}
    assert base == {0: 0, 1: 0, 2: 0, 3: 0, 4: 20}
    import public_tokenizers
    enc = token_files.Encoder(public_tokenizers.path(token_files.TOKENIZER))
    data = [t.encode() for t in texts]
    ids, sizes = enc.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(x) for x in data]))
    want = [[*e.ids, 0] for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


# ------------------------------------------------------------ language ID
def _ppm(texts: list[bytes], order: int):
    """A plain recursive PPM (method C): bits of a byte after a context."""
    seen = defaultdict(Counter)
    for t in texts:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[t[i - k:i]][t[i]] += 1

    def bits(context: bytes, c: int) -> float:
        counts = seen.get(context)
        if counts:
            total = sum(counts.values()) + len(counts)
            if c in counts:
                return -math.log2(counts[c] / total)
            escape = -math.log2(len(counts) / total)
        else:
            escape = 0.0
        return escape + (bits(context[1:], c) if context else 8.0)
    return bits


def test_code_lengths_against_a_recursive_ppm():
    rng = random.Random(4)
    own = {x: ["".join(rng.choice(x) for _ in range(200)).encode() for _ in range(3)] for x in ("abc ", "bcdé ", "xyz")}
    trees = langid.ContextTrees({x: langid.count_windows([np.frombuffer(t, np.uint8) for t in ts]) for x, ts in own.items()})
    for text in (b"abcab cab", "éddb bc".encode(), b"zzzyx", b"unseen bytes?", b""):
        want = []
        for x in sorted(own):
            bits, t = _ppm(own[x], langid.ORDER), b"\0" * langid.ORDER + text
            want.append(sum(bits(t[i - langid.ORDER:i], t[i]) for i in range(langid.ORDER, len(t))))
        assert np.allclose(trees.bits(np.frombuffer(text, np.uint8)), want)


def test_every_label_has_a_model(spark):
    rng = random.Random(6)
    rows = []
    for j in range(300):  # three hundred languages, each with letters of its own
        own = [chr(0x4E00 + 30 * j + k) for k in range(12)]
        rows += [(10 * j + i, " ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(12)), f"x{j:03d}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    trained = {r[2] for r in rows if not __import__("zlib").crc32(str(r[0]).encode()) % 4 == 2}
    assert all(out[i] == lang for i, _, lang in rows if lang in trained) and len(trained) == 300


def test_letters_are_those_of_unicode(spark):
    docs = spark.createDataFrame([(1, "½ ②", None), (2, "Ⅳ", None), (3, "ⅳ 5 _", None), (4, "日本", None), (5, "a plain text", "en"),
                                  (6, "another text", "en"), (7, "more of it", "en")], "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert [out[i] for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]


# ------------------------------------------------- names that clash inside
INNER = ("`__cell` int, `__h` long, `__crc` long, `__rank` long, `__id` long, `__k` long, `__c` long, `__t` long, `__u` long, "
         "`__n` int, `__piece` int, mix string, row string, ident string, wordy int, own string, piece int, k int, c int, n int")


def test_inner_names_as_input_columns(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 40, 3000), "en", "s0", 0, *range(7, 18), "m", "r", "i", 1, "o", 2, 3, 4, 5) for i in range(30)]
    rows.append((30, rows[3][1], *rows[3][2:]))
    docs = spark.createDataFrame(rows, f"{DOC}, {INNER}")
    want = {tuple(r) for r in docs.collect()}
    placed = sharding.shard_documents(docs, 4)
    assert placed.columns == [*docs.columns, "shard", "slot"] and {tuple(r)[:-2] for r in placed.collect()} == want
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and {tuple(r) for r in good.collect()} <= want
    one = near_dedup.keep_one(docs)
    assert one.columns == docs.columns and {tuple(r) for r in one.collect()} == {r for r in want if r[0] != 30}
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} == want


# ------------------------------------------------------------ permutations
def test_blocks_are_moved_for_every_number_of_them(spark):
    """n blocks are permuted, and not left in place, also where n divides 2**31 - 2."""
    for n in (62, 63, 66, 93, 99, 126, 151, 154, 198, 331, 64, 9, 18, 1024):
        prime = next((p for p in mixing.PRIMES if p % n not in (0, 1, n - 1)), None)
        assert prime is not None, n
        image = [(i * prime + 5) % n for i in range(n)]
        assert sorted(image) == list(range(n)) and image != [(i + 5) % n for i in range(n)]


@pytest.mark.parametrize("worth", [near_dedup.WORTH, 0])
def test_groups_of_drifting_copies(spark, monkeypatch, worth):
    """Copies that drift apart: linear turns (from the first pair on, if worth is 0) and the
    exhaustive round find all links."""
    from fixtures import near_components
    monkeypatch.setattr(near_dedup, "WORTH", worth)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(200)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_digest(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_components(rows)
