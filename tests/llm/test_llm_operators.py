import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import os
import sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import (contamination, edge_docs, edge_rows, empty_docs, near_components, repeats,  # noqa: E402
                      sentence, shingles)

from triagekit.llm import (decontamination, langid, mixing, near_dedup, quality_rules, sharding,  # noqa: E402
                           substring_dedup, token_files, toxicity, urlfilter)
from triagekit.llm.queries import ORACLE, QUERIES  # noqa: E402
from triagekit.sources.tables import read_table  # noqa: E402

SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_oracle_parity(spark, key):
    from oracle_harness import compare
    r = compare(spark, key, SF, QUERIES[key], ORACLE[key])
    assert r["ok"], r


# ------------------------------------------------------------------ 1
def _items(spark):
    rows = edge_rows()
    w = rows[0][1].split()
    return [(1, " ".join(w[5:25])), (2, " ".join(w[10:22]).upper()), (3, "one two"), (4, None), (5, "!!"),
            (None, " ".join(rows[11][1].split()[:12])), (1, " ".join(w[5:25])), (6, "never seen here at all by anyone")]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_brute_force(spark, block):
    items = _items(spark)
    docs = edge_docs(spark)
    found = decontamination.find_contamination(docs, spark.createDataFrame(items, ITEMS), block_bytes=block)
    assert found.columns == [*docs.columns, "found"]
    rows = edge_rows()
    exp = contamination([(r[0], r[1]) for r in rows], items)
    got = [(r.doc_id, r.text, r.found.n_words, sum(s.e - s.b for s in r.found.spans), r.found["items"])
           for r in found.collect()]
    want = [(r[0], r[1], *x) for r, x in zip(rows, exp, strict=True)]
    assert Counter(map(str, got)) == Counter(map(str, want))


def test_decontamination_empty_and_removal(spark):
    items = spark.createDataFrame([], ITEMS)
    d = decontamination.contamination_digest(edge_docs(spark), items).collect()
    assert len(d) == len(edge_rows()) and not any(r.contaminated for r in d)
    assert decontamination.contamination_digest(empty_docs(spark), items).count() == 0
    docs = edge_docs(spark)
    out = decontamination.remove_contamination(docs, spark.createDataFrame(_items(spark), ITEMS))
    assert out.columns == docs.columns and out.count() == docs.count()
    again = decontamination.contamination_digest(out, spark.createDataFrame(_items(spark)[:2], ITEMS)).collect()
    assert not any(r.contaminated for r in again)
    clean = {r.doc_id: r.text for r in out.collect()}
    assert clean[9] == edge_rows()[9][1] and clean[14] == "!!! ??? 123" and clean[8] == " three four"


def test_fm_index_brute_force():
    from triagekit.llm.fmindex import FMIndex, long_prefix, suffix_array
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, sigma = int(rng.integers(1, 60)), int(rng.integers(2, 6))
        x = rng.integers(0, sigma, n)
        x[0] = 0
        x = np.append(x, 0).astype(np.int64)
        f = FMIndex(x, sigma)
        m = int(rng.integers(1, 4))
        p = rng.integers(1, sigma, (10, m))
        for row, lo, hi in zip(p, *f.search(p), strict=True):
            assert sorted(f.locate(np.arange(lo, hi))) == [
                i for i in range(len(x) - m + 1) if (x[i:i + m] == row).all()]
        depth = int(rng.integers(1, 6))
        sa = suffix_array(x, depth)
        long = long_prefix(sa, x, sigma, depth)
        twice = long.copy()
        twice[:-1] |= long[1:]
        whole = [i for i in range(len(x) - depth + 1) if (x[i:i + depth] > 0).all()]
        seen = Counter(tuple(x[i:i + depth]) for i in whole)
        assert sorted(int(i) for i, d in zip(sa, twice, strict=True) if d and i in whole) == [
            i for i in whole if seen[tuple(x[i:i + depth])] > 1]


# ------------------------------------------------------------------ 2
def test_sharding_law(spark):
    docs = edge_docs(spark)
    out = sharding.shard_documents(docs, 4)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == len(edge_rows()) and set(by) == set(range(4))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_digest(empty_docs(spark)).count() == 0
    few = sharding.shard_digest(docs.limit(3)).collect()  # fewer rows than shards
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


def test_sharding_digest_and_movement(spark):
    docs = read_table(spark, SF, "documents")
    a = {r.doc_id: r for r in sharding.shard_digest(docs).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert set(a) == set(texts)
    for i, r in a.items():
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[i]) + 16, zlib.crc32(texts[i]), "rows", None)
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_digest(docs.repartition(7)).collect()}
    assert again == {i: (r.shard, r.slot) for i, r in a.items()}
    # Ring placement: most rows keep their shard when one shard is added.
    grown = {r.doc_id: r.shard for r in sharding.shard_digest(docs, 41).collect()}
    assert sum(grown[i] == a[i].shard for i in a) > 0.5 * len(a)


def test_ring_overflow_goes_clockwise():
    arcs = [(0, 0, 1), (1, 2, 3), (2, 4, 5), (0, 6, 7)]
    plan = sharding.place({0: 5, 7: 1, 2: 1}, arcs, 3)  # 7 rows: bounds 3, 2, 2
    assert sorted(plan) == [(0, 0, 3, 0, 0), (0, 3, 4, 1, 1), (0, 4, 5, 2, 0), (2, 0, 1, 1, 0), (7, 0, 1, 2, 1)]


# ------------------------------------------------------------------ 3
def test_superminhash_definition():
    from triagekit.llm.superminhash import _draw, signatures
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 3, 9, 40, 300)]
    m, low = 24, 32 - (24).bit_length()
    got = signatures(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]), m)
    for s, row in zip(sets, got, strict=True):
        want = [0xFFFFFFFF] * m
        for d in s:
            p = list(range(m))
            for j in range(m):
                h = int(_draw(np.array([d], np.uint64), j)[0])
                k = j + (((h & 0xFFFFFFFF) * (m - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], (j << low) | (h >> (64 - low)))
        assert list(row) == want


def test_near_dedup_edges(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    out = near_dedup.near_duplicate_digest(edge_docs(spark)).collect()
    assert len(out) == len(edge_rows())
    c = defaultdict(set)
    for r in out:
        c[r.doc_id].add(r.component_id)
    assert c[1] == c[2] == c[3] == c[15] == {1} and c[9] == c[10] == {9}
    assert c[4] == {4} and c[5] == {5} and c[6] == {6}
    assert c[None] == {7, None} and c[11] == {7}  # id 7 also has that text
    n = Counter((r.doc_id, r.n_shingles) for r in out)
    assert n == Counter((r[0], len(shingles(r[1]))) for r in edge_rows())
    assert near_dedup.near_duplicate_digest(empty_docs(spark)).count() == 0
    kept = near_dedup.keep_one(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert all(ids[i] == 1 for i in (1, 4, 5, 6, 8, 9, 12, 13, 14)) and not any(i in ids for i in (2, 3, 10, 11, 15))
    assert len(rows)


def test_near_dedup_family_brute_force(spark, monkeypatch):
    """A family of edited copies around the threshold, in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(3)
    base = sentence(rng, 60, 5000).split()
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, sentence(rng, 40, 5000)) for i in range(20)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_digest(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_components(docs)


def test_near_dedup_stage_threshold(spark):
    """The stage keeps one of each group from 0.8 up; op3 links from 0.85 up."""
    rng = random.Random(12)
    docs = []
    for i in range(0, 60, 2):  # pairs that differ in one to three words: 0.73 to 0.95
        w = sentence(rng, 100, 5000).split()
        docs.append((i, " ".join(w)))
        for k in range(1 + i // 2 % 3):
            w[10 + 20 * k] = f"e{i}"
        docs.append((i + 1, " ".join(w)))
    sets = [shingles(t) for _, t in docs]
    alike = [100 * len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert any(80 <= x < 85 for x in alike) and any(x < 80 for x in alike) and any(x >= 85 for x in alike)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.keep_one(d).collect()}
    assert kept == {2 * i + j for i, x in enumerate(alike) for j in (0, 1) if not (j and x >= 80)}
    strict = {r.doc_id for r in near_dedup.near_duplicate_digest(d).collect() if r.kept}
    assert strict == {2 * i + j for i, x in enumerate(alike) for j in (0, 1) if not (j and x >= 85)}


def test_near_dedup_null_ids(spark):
    """Null-id rows are told apart by their texts; copies go, unrelated rows stay."""
    rng = random.Random(13)
    a, b, c, e, f = (sentence(rng, 60, 5000) for _ in range(5))
    rows = [(1, a), (None, a + " x"), (None, b), (None, c), (None, e), (None, e + " y"), (None, e + " z z"), (None, e),
            (2, f), (3, f + " x"), (2, f), (None, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect())
    same = [k for k in kept if k[1] and k[1].startswith(e)]
    assert len(same) == 1 and same[0][0] is None
    assert kept == Counter([(1, a), (None, b), (None, c), (2, f), (None, None), (None, " "), *same])
    out = near_dedup.near_duplicate_digest(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter(
        {(1, 1): 1, (None, 1): 1, (None, None): 8, (2, 2): 2, (3, 2): 1})


# ------------------------------------------------------------------ 4
def _targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1e-9, sum(weight[s] for s in rest))
        over = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def test_mixing_targets_and_rows(spark):
    docs = edge_docs(spark)
    out = mixing.mix_documents(docs)
    assert out.columns == [*docs.columns, "mix"]
    rows = out.collect()
    assert len(rows) == len(edge_rows())
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        n = len((r.text or "").split(" ")) if (r.text or "").strip(" \n\t\r\x0b\x0c") else 0
        size[r.source] += r.mix["size"]
        taken[r.source] += r.mix.taken
        target[r.source] = r.mix.target
        assert r.mix.taken <= 2 * r.mix["size"] and (n > 0) == (r.mix["size"] > 0)
        assert r.mix.taken == sum(p.words for p in r.mix.pieces)
        assert all(0 <= p.shard < mixing.SHARDS for p in r.mix.pieces)
    want = _targets(dict(size))
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    assert mixing.mix_digest(empty_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], docs.select(docs.columns[:5]).schema)
    assert [r.taken for r in mixing.mix_digest(blank).collect()] == [0, 0]


def test_mixing_reruns_agree_and_quotas(spark):
    docs = read_table(spark, SF, "documents")
    a = sorted(mixing.mix_digest(docs).collect(), key=lambda r: r.doc_id)
    b = sorted(mixing.mix_digest(docs.repartition(5)).collect(), key=lambda r: r.doc_id)
    assert a == b
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns
    n = Counter(r.doc_id for r in rows.select("doc_id").collect())
    assert max(n.values()) <= 2


def test_splitting_tree(spark):
    q = {0: 40, 1: 7, 2: 0, 3: 100}
    rows = mixing.split_quotas(spark.createDataFrame(list(q.items()), "colour long, quota long"), 5).collect()
    per = {r.colour: [b - a for a, b in zip([0, *r.ends[:-1]], r.ends, strict=True)] for r in rows}
    assert {c: sum(v) for c, v in per.items()} == q and all(x >= 0 for v in per.values() for x in v)
    totals = [sum(v[j] for v in per.values()) for j in range(5)]
    assert max(totals) - min(totals) <= 2


def test_hypergeometric_law(spark):
    from pyspark.sql import functions as F
    for k, m, n in ((300, 1000, 400), (3, 10, 5), (0, 5, 2), (5, 5, 2)):
        x = spark.range(3000).select(mixing.hypergeometric(
            *[F.lit(v).cast("long") for v in (k, m, n)], F.rand(1)).alias("x"))
        mean, sd, lo, hi = x.selectExpr("avg(x)", "stddev_pop(x)", "min(x)", "max(x)").first()
        p = k / m
        want = (n * p * (1 - p) * (m - n) / (m - 1)) ** 0.5
        assert abs(mean - n * p) <= 4 * want / 3000 ** 0.5 + 1e-9 and abs(sd - want) <= 0.1 * want + 1e-9
        assert lo >= max(0, n - (m - k)) and hi <= min(k, n)


# ------------------------------------------------------------------ 5
def test_quality_base_counts_brute_force(spark):
    import re
    rows = edge_rows()
    extra = [(20, "a b c d e f g h a b c d e f g h i\nx\nx\n\n\nx", "en", "s", 0), (21, "# $ % & | < > *", "en", "s", 0)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(tuple(r[:7]) for r in quality_rules.quality_digest(docs).collect())
    want = Counter()
    for i, t, *_ in rows + extra:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k:k + 8])].append(k)
        rep = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep),
              len(w) < 20 or 100 * len(rep) > 30 * len(w))] += 1
    assert got == want
    assert quality_rules.quality_digest(empty_docs(spark)).count() == 0
    assert quality_rules.keep_good(empty_docs(spark)).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(40, 300), 3000, "wo") + ".", "en", f"s{i % 2}", 0) for i in range(500)]
    junk = [(1000 + i, " ".join(f"w{rng.randrange(3000)}***###" for _ in range(80)), "en", "s0", 0) for i in range(20)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in quality_rules.quality_digest(docs).collect()}
    assert not any(out[r[0]].kept for r in junk) and not any(out[r[0]].base_failed for r in junk)
    assert sum(out[r[0]].kept for r in rows) >= 498
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    edge = edge_docs(spark)
    assert quality_rules.keep_good(edge).columns == edge.columns


def test_quality_third_of_a_source_is_junk(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(40, 300), 3000, "wo") + ".", "en", f"s{i % 2}", 0) for i in range(800)]
    junk = [(1000 + i, " ".join(f"w{rng.randrange(3000)}***###" for _ in range(80)), "en", "s0", 0) for i in range(200)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in quality_rules.quality_digest(docs).collect()}
    assert not any(out[r[0]].kept for r in junk) and not any(out[r[0]].base_failed for r in junk)
    assert sum(out[r[0]].kept for r in rows) >= 796


# ------------------------------------------------------------------ 6
def test_language_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in out.items() if r.held_out]
    assert len(held) > 100 and all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out for i, r in out.items())
    assert sum(out[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)


def test_language_edges(spark):
    out = langid.identify(edge_docs(spark)).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.lang_pred for r in out}
    assert by[4] == by[5] == by[6] == by[14] == "und" and by[1] in ("en", "de")
    assert langid.identify(empty_docs(spark)).count() == 0
    unlabelled = edge_docs(spark, False).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_context_trees_code_lengths():
    """Costs of all bytes after any context sum to at most one in probability."""
    t = langid.ContextTrees({x: langid.count_windows([np.frombuffer(y, np.uint8) for y in z], 2) for x, z in (
        ("a", [b"abracadabra", b"a"]), ("b", [b"banana", b""]))}, order=2)
    for context in (b"ab", b"an", b"zz", b"ra"):
        p = sum(2.0 ** -(t._cost(np.array([(context[0] << 16) | (context[1] << 8) | c], np.uint32), 2)[0]) for c in range(256))
        assert (p <= 1 + 1e-9).all()
    assert t.bits(np.frombuffer(b"banana", np.uint8)).argmin() == 1
    assert (t.bits(np.zeros(0, np.uint8)) == 0).all()


# ------------------------------------------------------------------ 7
def test_url_filter_cases(spark):
    urls = ["http://a.net/", "http://net/x", "HTTP://WWW.Example.NET/en/1?q=/de/", "http://example.net/EN/1", "x.net/",
            "http://b.example.com/de/9#t", "http://example.com/de", "http://sub.org/fr/", "http://org/fr", None, "",
            "://net/", "http://evilexample.net/en/x", "http://net", "ftp://cheap-pills.example.org/x", "http://h/a\nb?c",
            "http://cheappills.org/", "http://café.NET/é", "http://a.net/", "http://casino.example.net/en/1"]
    pages = spark.createDataFrame([(i, u, "h", "tok", "v") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, token string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect()}
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    import re
    for i, u in enumerate(urls):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=None)
        verdict = rule[2] if rule else "block" if i == 14 else "allow"
        assert got[i] == (host, path, rule[1] if rule else None, verdict), u
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_without_literals_still_run(spark):
    pages = spark.createDataFrame([(1, "http://a/b"), (2, "http://zz/b")], "page_id long, url string")
    rules = urlfilter.rules_frame(spark, [urlfilter.Rule(None, "block", "^z+/", (), 0)])
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {1: "allow", 2: "block"}


# ------------------------------------------------------------------ 8
@pytest.mark.parametrize("group", [20_000, 1])
def test_substring_dedup_brute_force(spark, group):
    rng = random.Random(4)
    piece = [sentence(rng, 8, 90) for _ in range(6)]
    texts = [None, "", "short", "ab" * 60, "x" * 90, "é" * 50] + [
        " ".join(rng.choice(piece) if rng.random() < 0.4 else sentence(rng, 6, 5000) for _ in range(8)) for _ in range(30)]
    texts += [texts[8], texts[8], texts[9] + "!"]
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, t int")
    out = substring_dedup.dedup_digest(docs, length=40, seed=13, max_group=group, task_bytes=500).collect()
    want = [(i if i % 7 else None, len((t or "").encode()), n, s, hashlib.sha256(kept).hexdigest())
            for (i, t), (n, s, kept) in zip(enumerate(texts), repeats([(t or "").encode() for t in texts], 40), strict=True)]
    assert Counter(map(str, (tuple(r) for r in out))) == Counter(map(str, want))
    assert any(r.n_removed for r in out)


def test_substring_dedup_edges(spark):
    out = substring_dedup.dedup_digest(edge_docs(spark)).collect()
    assert len(out) == len(edge_rows())
    got = {r.doc_id: r for r in out}
    assert got[13].n_removed == 5000 and got[4].n_bytes == 0 and got[14].n_removed == 0
    assert substring_dedup.dedup_digest(empty_docs(spark)).count() == 0


# ------------------------------------------------------------------ 9
def _toxic_docs(spark):
    rng = random.Random(6)
    bad, rows, labels = ["vilex", "scurn", "grotz"], [], []
    for i in range(700):
        w = sentence(rng, 50, 800).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = _toxic_docs(spark)
    rows += [(9000, None, None, None, 0), (9001, "", None, None, 0), (None, "vilex you scurn", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels + [(None, None, None), (3, None, None), (9000, 0, None)],
                                "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, lab).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert next(r for r in out if r.doc_id == 9000).predicted == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(edge_docs(spark), none).collect()
    assert len(out) == len(edge_rows()) and {r.score for r in out} == {0.0}
    assert toxicity.score_documents(empty_docs(spark), none).count() == 0


# ------------------------------------------------------------------ 10
def test_pfor_round_trip():
    from triagekit.llm.pfor import Image, encode
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 50_257, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.05] = top - 1
            lengths = np.array([n // 3, n - n // 3])
            image = Image(encode(ids, np.array([5, -1]), np.array([False, True]), lengths))
            assert (image.ids() == ids).all() and list(image.lengths) == list(lengths)
            assert list(image.doc_ids) == [5, -1] and list(image.is_null) == [False, True]
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (image.ids(a, b) == ids[a:b]).all()


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_pieces_encode_like_whole_texts():
    import public_tokenizers
    rng = random.Random(8)
    chars = "ab'sdtlmre .,;:!?\n\t\r \x0b\x1c\x85\xa0 　éß1-_<|endoftext|>中"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    texts += ["don't stop.Now\n\nNext  line\n x", "<|endoftext|>", "", "\n", "\nA", " \nA b", "a \n", "x.\nY,z!w"]
    encoder = token_files.Encoder(public_tokenizers.path(token_files.TOKENIZER))
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(x) for x in data])
    ids, lengths = encoder.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    at = np.cumsum([0, *lengths.tolist()])
    for k, e in enumerate(_tokenizer().encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k]:at[k + 1]].tolist() == e.ids + [0], texts[k]


def test_token_files_round_trip(spark):
    rows = sorted(((r[0], r[1]) for r in edge_rows() if r[0] not in (2, 7, None)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, token_files.token_digest(docs).collect()))
    start, want = 0, []
    for (i, t), e in zip(rows, _tokenizer().encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    out = token_files.token_digest(edge_docs(spark)).collect()  # null and repeated ids: nulls first
    assert len(out) == len(edge_rows()) and {r.start for r in out if r.doc_id is None} >= {0}
    assert token_files.token_digest(empty_docs(spark)).count() == 0
