"""Exact characteristic polynomials of integer matrices, and their eigenpairs.

The polynomial is computed modulo many primes: a similarity transformation to Hessenberg
form, then the recurrence over its leading blocks; Chinese remaindering puts the integer
coefficients together.  For a positive semidefinite matrix all roots are real and none is
negative, so the coefficients' signs are known, Maclaurin's inequality bounds their size by
the trace, and Descartes' rule counts the roots above a point exactly.  Roots are isolated
by that count and refined by signs, in integers; eigenvectors come from inverse iteration
on the null space of the matrix minus a root, in decimal arithmetic of ``DIGITS`` digits.
"""

from __future__ import annotations

import math
from decimal import Context, Decimal, localcontext

import numpy as np

#: Precision of the inverse iteration.
DIGITS = 110
#: Bits of a root: relative precision of the isolation.
ROOT_BITS = 120


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``limit`` (at most 2**31)."""
    root = math.isqrt(limit) + 1
    sieve = np.ones(root + 1, bool)
    sieve[:2] = False
    for i in range(2, math.isqrt(root) + 1):
        if sieve[i]:
            sieve[i * i::i] = False
    small = np.flatnonzero(sieve)
    out: list[int] = []
    top = limit
    while len(out) < count:
        low = max(top - 4096, 2)
        block = np.arange(low, top)
        whole = np.ones(len(block), bool)
        for p in small[small < low].tolist():
            whole[(-low) % p::p] = False
        out += block[whole][::-1].tolist()
        top = low
    return out[:count]


def coefficient_bits(trace: int, size: int) -> int:
    """Bits that hold any coefficient: e_k <= C(size, k) (trace / size)**k."""
    t = max(trace, 1)
    return max(math.comb(size, k) * t ** k // size ** k + 1 for k in range(size + 1)).bit_length() + 1


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x**(p - 2) mod p, all primes at once."""
    out, base, e = np.ones_like(x), x % p, p - 2
    while (e > 0).any():
        out = np.where(e & 1, out * base % p, out)
        base = base * base % p
        e = e >> 1
    return out


def polynomials_mod(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(x - matrix), lowest power first, modulo each prime."""
    d, b = len(matrix), len(primes)
    p = primes.astype(np.int64)
    a = np.stack([(matrix % int(q)).astype(np.int64) for q in primes]) if d else np.zeros((b, 0, 0), np.int64)
    p1, p2 = p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        below = a[:, m:, m - 1] != 0
        pick = m + below.argmax(1)
        for k in np.flatnonzero(below.any(1) & (pick != m)).tolist():  # a zero pivot: another row and column
            i = int(pick[k])
            a[k, [m, i]] = a[k, [i, m]]
            a[k][:, [m, i]] = a[k][:, [i, m]]
        u = a[:, m + 1:, m - 1] * _inverse(a[:, m, m - 1], p)[:, None] % p1  # 0 where the column is done already
        a[:, m + 1:] = (a[:, m + 1:] - u[:, :, None] * a[:, m, None, :] % p2) % p2
        a[:, :, m] = (a[:, :, m] + (a[:, :, m + 1:] * u[:, None, :] % p2).sum(2)) % p1
    poly = np.zeros((d + 1, b, d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(d):
        out = -a[:, k, k, None] * poly[k] % p1
        out[:, 1:] += poly[k, :, :-1]
        under = np.ones(b, np.int64)
        for i in range(k - 1, -1, -1):
            under = under * a[:, i + 1, i] % p
            out -= (a[:, i, k] * under % p)[:, None] * poly[i] % p1
        poly[k + 1] = out % p1
    return poly[d]


def combine(residues: dict[int, list[int]]) -> list[int]:
    """The integer coefficients, by Chinese remaindering: of x - roots with no root below
    zero, so that signs alternate."""
    primes = sorted(residues)
    product = math.prod(primes)
    parts = [(q, product // q) for q in primes]
    weight = {q: r * pow(r, -1, q) for q, r in parts}
    d = len(residues[primes[0]]) - 1
    out = []
    for k in range(d + 1):
        sign = -1 if (d - k) % 2 else 1
        out.append(sign * (sum(weight[q] * (sign * residues[q][k] % q) for q in primes) % product))
    return out


def shifted(poly: list[int], at: int) -> list[int]:
    """Coefficients of poly(x + at)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    return c


def roots_above(poly: list[int], at: int) -> int:
    """Roots greater than ``at``, with multiplicity; exact as all roots are real."""
    signs = [c > 0 for c in shifted(poly, at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], at: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * at + c
    return (v > 0) - (v < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """The largest positive roots as (numerator, bits of the denominator, multiplicity),
    falling, until their multiplicities sum to ``count`` or no positive root is left.

    Roots closer than ``ROOT_BITS`` bits can tell count as one of higher multiplicity.
    """
    while len(poly) > 1 and poly[0] == 0:
        poly = poly[1:]
    d = len(poly) - 1
    if not d:
        return []
    bits = ROOT_BITS
    while True:
        scaled = [c << (bits * (d - k)) for k, c in enumerate(poly)]
        found: list[tuple[int, int, int]] = []
        top = -scaled[-2] + 1  # the sum of the roots is above each of them
        todo = [(0, top, d, 0)]
        fine = True
        while todo and sum(m for *_, m in found) < count:
            lo, hi, above_lo, above_hi = todo.pop()
            n = above_lo - above_hi
            if not n:
                continue
            if n == 1:
                s = _sign(scaled, hi)
                while s and hi - lo > 1 and (hi - lo) << ROOT_BITS > lo:
                    mid = (lo + hi) // 2
                    t = _sign(scaled, mid)
                    if t == 0:
                        lo = hi = mid
                    elif t == s:
                        hi = mid
                    else:
                        lo = mid
                if not s:
                    lo = hi
            elif hi - lo > 1 and (hi - lo) << ROOT_BITS > lo:
                mid = (lo + hi) // 2
                above = roots_above(scaled, mid)
                todo += [(lo, mid, above_lo, above), (mid, hi, above, above_hi)]
                continue
            fine &= hi >> (ROOT_BITS - 20) > 0
            found.append((hi, bits, n))
        if fine:
            return found
        bits *= 4  # a root so small that its leading bits are not there yet


def _solve_all(a: np.ndarray, rhs: np.ndarray, tiny: Decimal) -> np.ndarray:
    """Solutions of a x = rhs (several columns), by elimination with row pivots; a pivot of
    nothing becomes ``tiny``."""
    a, x, n = a.copy(), rhs.copy(), len(a)
    for k in range(n):
        i = k + max(range(n - k), key=lambda r: abs(a[k + r, k]))
        if i != k:
            a[[k, i]], x[[k, i]] = a[[i, k]], x[[i, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        f = a[k + 1:, k] / a[k, k]
        a[k + 1:, k:] -= f[:, None] * a[k, k:]
        x[k + 1:] -= f[:, None] * x[k]
    for k in range(n - 1, -1, -1):
        x[k] = (x[k] - (a[k, k + 1:, None] * x[k + 1:]).sum(0) if k + 1 < n else x[k]) / a[k, k]
    return x


def _orthonormal(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for j in range(x.shape[1]):
            for i in range(j):
                x[:, j] -= (x[:, i] * x[:, j]).sum() * x[:, i]
            x[:, j] /= (x[:, j] * x[:, j]).sum().sqrt()
    return x


def eigenvectors(matrix: np.ndarray, root: tuple[int, int, int]) -> np.ndarray:
    """Unit eigenvectors (rows, as many as the root's multiplicity) of a symmetric integer
    matrix; the entry of largest size is positive."""
    value, bits, m = root
    with localcontext(Context(prec=DIGITS)):
        e = Decimal(value) / Decimal(1 << bits)
        a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        a[np.arange(len(a)), np.arange(len(a))] -= e
        tiny = (e + 1) * Decimal(10) ** (30 - DIGITS)
        # Any start that is not orthogonal to the null space will do.
        rng = np.random.default_rng(1)
        x = np.array([[Decimal(int(v)) for v in row] for row in rng.integers(1, 1 << 30, (len(a), m))], object)
        for _ in range(3):
            x = _orthonormal(_solve_all(a, x, tiny))
        out = np.array([[float(v) for v in row] for row in x.T])
    return out * np.where(out[np.arange(m), np.abs(out).argmax(1)] < 0, -1.0, 1.0)[:, None]
