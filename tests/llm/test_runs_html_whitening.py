import hashlib
import os
import random
import sys
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import CLASH, DOC, edge_docs, edge_rows, empty_docs  # noqa: E402

from triagekit.llm import charpoly, html_extract, periodic_runs, whitening  # noqa: E402
from triagekit.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ 13
def brute_runs(w) -> list[tuple]:
    """Every lag compared with the whole text; of runs with one place, the smallest lag."""
    numbers = {x: i for i, x in enumerate(dict.fromkeys(w))}
    a, found = np.array([numbers[x] for x in w], np.int64), {}
    for q in range(1, len(a) // 3 + 1):
        same = np.concatenate([[0], a[q:] == a[:-q], [0]])
        for begin, end in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist(),
                              strict=True):
            if end - begin + q >= max(24, 3 * q):
                found.setdefault((begin, end - begin + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def words_of(text) -> list[str]:
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def digest(doc_id, text) -> tuple:
    w = words_of(text)
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2]))),
        " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)


def test_runs_of_random_words():
    rng = np.random.default_rng(3)
    for _ in range(800):
        parts = []
        for _ in range(rng.integers(1, 5)):
            base = rng.integers(0, rng.integers(1, 4), int(rng.integers(1, 30)))
            base = np.tile(base, rng.integers(1, 5)) if rng.random() < 0.4 else base
            parts += [np.tile(base, rng.integers(1, 9))[:rng.integers(1, 200)], rng.integers(0, 50, rng.integers(0, 9))]
        w = np.concatenate(parts)
        got = [tuple(r) for r in periodic_runs.runs_of(w).tolist()]
        assert got == sorted(brute_runs(w.tolist()), key=lambda r: (r[0], r[2]))


def test_runs_at_the_limits():
    def runs(w):
        return [tuple(r) for r in periodic_runs.runs_of(np.array(w)).tolist()]
    assert runs([1] * 23) == [] and runs([1] * 24) == [(0, 24, 1)]
    assert runs(list(range(8)) * 3) == [(0, 24, 8)] and runs((list(range(8)) * 3)[:-1]) == []
    assert runs(list(range(100)) * 3) == [(0, 300, 100)] and runs((list(range(100)) * 3)[:-1]) == []
    assert runs([]) == [] and runs([5]) == []
    # One word a hundred thousand times costs no pairs of its occurrences.
    assert runs([7] * 100_000) == [(0, 100_000, 1)]


def _periodic_rows():
    rng = random.Random(2)
    rows = edge_rows()
    for i in range(100, 160):
        unit = " ".join(f"u{rng.randrange(9)}" for _ in range(rng.randrange(1, 40)))
        text = f"{rng.randrange(9)} " + " ".join([unit] * rng.randrange(1, 9)) + "\n" + " ".join(
            f"v{rng.randrange(3)}" for _ in range(rng.randrange(40)))
        rows.append((i, text, "en", "s0", len(text)))
    return rows


def test_run_digest_brute_force(spark):
    rows = _periodic_rows()
    docs = spark.createDataFrame([(*r, "s", 1, "k", 2, "u", 3, "g", "r", 4, 5) for r in rows], f"{DOC}, {CLASH}")
    got = [tuple(r) for r in periodic_runs.run_digest(docs).collect()]
    assert sorted(map(str, got)) == sorted(str(digest(r[0], r[1])) for r in rows)
    assert sum(x[1] > 0 for x in got) > 20
    assert periodic_runs.run_digest(empty_docs(spark)).count() == 0


def test_find_and_collapse_runs(spark):
    rows = _periodic_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], f"{DOC}, found string")
    found = periodic_runs.find_runs(docs)
    assert found.columns == [*docs.columns[:-1], "found"] and found.count() == len(rows)
    for r in found.collect():
        assert [tuple(x) for x in r.found.runs] == sorted(brute_runs(words_of(r.text)), key=lambda x: (x[0], x[2]))
    once = periodic_runs.collapse_runs(edge_docs(spark))
    assert once.columns == edge_docs(spark).columns and once.count() == len(edge_rows())
    same = {(r.doc_id, r.text) for r in once.collect()}
    assert {(r[0], r[1]) for r in edge_rows() if r[0] in (4, 9, 12)} <= same  # no runs: byte for byte


# ------------------------------------------------------------------ 11
class Article(HTMLParser):
    """Text of <article>, block by block: an independent reading of the test pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = False, [], []

    def end_block(self):
        t = " ".join("".join(self.now).split())
        self.blocks += [t] if t and self.inside else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.end_block()
        self.inside = self.inside or tag == "article"
        self.now += [" "] if tag == "br" else []

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.end_block()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.now += [data] if self.inside else []


def article(page) -> str:
    p = Article()
    p.feed(page)
    p.close()
    p.end_block()
    return "\n".join(p.blocks)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_pages_against_an_html_parser(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op11_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = "A sentence of the article which is long enough to stand out from menus and notices of any kind."


def test_lines_that_are_something_other():
    page = f"""<!-- <p>{LONG}</p> --><body class="has-sidebar"><div id=header><b>{LONG}</b></div>
      <ul class=mainMenu><li><a href="?a>b">Home</a><li><a>About</a></ul>
      <div class=cookie-notice>{LONG}</div><aside><p>{LONG}</aside>
      <div><h1>Title &amp;&eacute;&#33;</h1><p>{LONG}\n two <!-- x -->  <b>bo<i>ld</i></b> <span class=ad>Buy!</span>
      <p>Short.<script>var t = "</p>" + '<p>{LONG}';</script><style>p{{}}</style>
      <form><p>{LONG}<input></form><table><tr><td>cell one<td>cell two</table><p>See <a href=x>this</a>.
      <div class="ad box">{LONG}</div><p>Last&nbsp;one</div>
      <section id="comments"><article><p>{LONG} I disagree.</article></section><div class="page-footer">&copy; {LONG}</div>"""
    want = f"Title &é!\n{LONG} two bold\nShort.\ncell one\ncell two\nSee this.\nLast one"
    assert html_extract.main_text(page) == want
    inside = page.replace("<div><h1>", "<main><header><h1>").replace("</h1>", "</h1></header>").replace("one</div>", "one</main>")
    assert html_extract.main_text(inside) == want


def test_surge_and_dive_points():
    assert html_extract.spans_of([0, 0, 9, 1, 0, 5, 0, 0, 0, 2, 0], 6) == [(2, 6)]
    assert html_extract.spans_of([3, 0, 0, 0, 0, 8, 8], 6) == [(5, 7)]
    assert html_extract.spans_of([], 1) == [] and html_extract.spans_of([0, 0], 1) == []
    # No declared article: a short line apart from the text stays out, however it is marked.
    far = "<p>stray</p><p><a>a link</a></p><p><a>b</a></p><p><a>c</a></p><p><a>d</a></p>"
    assert html_extract.main_text(far + f"<p>{LONG}</p><p>near</p>") == f"{LONG}\nnear"


def test_broken_and_empty_pages(spark):
    for page, text in ((None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a", "a"), ("<article>", ""),
                       ("<article><p>one</article>two", "one"), ("<script>x", ""), ("a < b & c <3", "a < b & c <3"),
                       ("<p class='x>open", "open"), ("&lt;p&gt;", "<p>"), ("<article><p>a<nav>m</nav>b</p>", "a\nb"),
                       ("<P>Upper</P><BR>", "Upper"), ("</p></div>x", "x")):
        assert html_extract.main_text(page) == text, page
    html_extract.main_text("<b><i>x</u>" * 20_000 + "<div><p>" * 2000 + "<script>" * 2000)  # in good time
    rows = [(1, "u", "<p>a", "m"), (1, "u", "<p>a", "m"), (None, None, None, None), (2, "v", "<p>" + "w " * 500_000, "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    out = html_extract.extract(pages)
    assert out.columns == pages.columns
    got = sorted(((r.page_id or 0, r.main_text) for r in out.collect()))
    assert got[:3] == [(0, ""), (1, "a"), (1, "a")] and len(got[3][1]) == 999_999
    d = html_extract.extract_digest(pages.limit(0))
    assert d.columns == ["page_id", "url", "text", "n_chars"] and d.count() == 0


# ------------------------------------------------------------------ 12
def test_characteristic_polynomial_and_roots():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 5, 9):
        for less in range(4):
            b = rng.integers(-3, 4, (d, max(1, d - less)))
            m = (b @ b.T).astype(object)
            if less == 3:  # equal roots and blocks: zero pivots
                m = np.diag(rng.integers(0, 3, d)).astype(object)
            primes = charpoly.primes_below(1 << 31, charpoly.coefficient_bits(int(m.trace()), d) // 30 + 1)
            poly = charpoly.combine(dict(zip(primes, charpoly.polynomials_mod(m, np.array(primes)).tolist(), strict=True)))
            for x in (-2, 0, 3):  # det(x - m) by expansion over fractions
                assert sum(c * x ** k for k, c in enumerate(poly)) == _determinant(x * np.eye(d, dtype=int).astype(object) - m)
            want = np.linalg.eigvalsh(m.astype(float))[::-1]
            roots = charpoly.largest_roots(poly, d)
            got = [v / (1 << bits) for v, bits, k in roots for _ in range(k)]
            assert np.allclose(got, want[:len(got)], atol=1e-9) and np.allclose(want[len(got):], 0, atol=1e-9)
            vectors = [v for r in roots for v in charpoly.eigenvectors(m, r)]
            for e, v in zip(got, vectors, strict=True):
                assert np.allclose(m.astype(float) @ v, e * v, atol=1e-9)
            assert np.allclose(np.array(vectors) @ np.array(vectors).T, np.eye(len(vectors)), atol=1e-9) if vectors else True


def _determinant(m) -> int:
    from fractions import Fraction
    a, out = [[Fraction(int(v)) for v in row] for row in m], Fraction(1)
    for k in range(len(a)):
        i = next((i for i in range(k, len(a)) if a[i][k]), None)
        if i is None:
            return 0
        if i != k:
            a[k], a[i], out = a[i], a[k], -out
        out *= a[k][k]
        for r in range(k + 1, len(a)):
            f = a[r][k] / a[k][k]
            a[r] = [x - f * y for x, y in zip(a[r], a[k], strict=True)]
    return int(out)


def test_close_roots_are_told_apart():
    m = np.array([[10 ** 20, 1, 0], [1, 10 ** 20, 0], [0, 0, 3]], object)  # 10**20 + 1, 10**20 - 1, 3
    primes = charpoly.primes_below(1 << 31, charpoly.coefficient_bits(int(m.trace()), 3) // 30 + 1)
    poly = charpoly.combine(dict(zip(primes, charpoly.polynomials_mod(m, np.array(primes)).tolist(), strict=True)))
    roots = charpoly.largest_roots(poly, 3)
    assert [k for *_, k in roots] == [1, 1, 1] and [v >> b for v, b, _ in roots] in (
        [10 ** 20 + 1, 10 ** 20 - 1, 3], [10 ** 20 + 1, 10 ** 20 - 2, 3])
    assert np.allclose(charpoly.eigenvectors(m, roots[1])[0], [0.5 ** 0.5, -(0.5 ** 0.5), 0], atol=1e-12) or np.allclose(
        charpoly.eigenvectors(m, roots[1])[0], [-(0.5 ** 0.5), 0.5 ** 0.5, 0], atol=1e-12)


def _against_numpy(rows, vectors, got):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    c = fit - fit.mean(0)
    w, u = np.linalg.eigh(c.T @ c / n)
    w, u = w[::-1][:16], u[:, ::-1][:, :16]
    z = (x - fit.mean(0)) @ u / np.sqrt(w)
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    mine = np.array([r.whitened for r in got]).reshape(len(x), -1)
    assert mine.shape == z.shape and [r.vec_id for r in got[::z.shape[1]]] == rows
    assert np.abs(mine * np.sign((mine * z).sum(0)) - z).max() < 1e-8
    assert all(r.n == n and r.identity_error < 1e-9 for r in got)
    assert [r.deviation for r in got[::z.shape[1]]] == ((n * x - total) ** 2).sum(1).tolist()
    share = w / np.trace(c.T @ c / n)
    assert np.allclose([r.explained for r in got[:z.shape[1]]], share, rtol=1e-9)


def test_whitening_against_numpy(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    _against_numpy([r.vec_id for r in e], np.array([r.embedding for r in e], np.float32),
                   QUERIES["op12_embedding_whitening"](spark, SF).collect())


def test_whitening_edges(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 5)) * [1, 2, 3, 4, 5]
    v[7] = v[3]  # repeated vectors count once in the fit
    rows = [(i, [float(x) for x in r], "d") for i, r in enumerate(v)]
    odd = [(100, None, "x"), (101, [1.0, None, 1.0, 1.0, 1.0], "x"), (102, [float("nan")] * 5, "x"),
           (103, [float("inf")] * 5, "x"), (104, [], "x"), (105, [1.0] * 4, "x")]
    schema = "vec_id long, embedding array<double>, deviation string"
    d = spark.createDataFrame(rows + odd, schema)
    got = whitening.whitening_digest(d).collect()
    _against_numpy(list(range(40)), v, got)
    fit = whitening.fit_whitening(d)
    out = whitening.whiten(d, fit)
    assert out.columns == ["vec_id", "embedding", "deviation", "whitened"] and out.count() == 40
    for few in (d.limit(0), spark.createDataFrame(odd[:5], schema), spark.createDataFrame(rows[:1] * 3, schema)):
        assert whitening.whitening_digest(few).count() == 0  # nothing, or no direction with any variance
    far = spark.createDataFrame([(1, [1e300, 0.0], ""), (2, [0.0, 1.0], ""), (None, [5.0, 2.0], "")], schema)
    assert all(r.deviation is None for r in whitening.whitening_digest(far).collect())  # beyond a long
    assert whitening.whiten(far, whitening.fit_whitening(far)).count() == 3
    flat = spark.createDataFrame([(i, [float(i), 7.0, -2.0 * i], "") for i in range(9)], schema)
    assert {r.component for r in whitening.whitening_digest(flat).collect()} == {1}  # rank one
    square = spark.createDataFrame([(i, [float(x), float(y)], "") for i, (x, y) in enumerate(
        [(1, 1), (1, -1), (-1, 1), (-1, -1)])], schema)
    two = whitening.whitening_digest(square).collect()  # one double eigenvalue
    assert len(two) == 8 and all(r.identity_error < 1e-12 and abs(r.explained - 0.5) < 1e-12 for r in two)
