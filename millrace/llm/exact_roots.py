"""Eigenvalues and eigenvectors of an integer symmetric matrix, from its exact characteristic polynomial.

1. Modulo a prime, the matrix is brought to Hessenberg form by row and column operations and its characteristic polynomial read off by a recurrence
   (:func:`residues`, many primes at once). Enough primes give the coefficients by Chinese remaindering.
2. All roots are real, so by Descartes' rule the sign changes of the coefficients of p(x + a) are exactly the number of roots above a.
   Halving intervals by that count isolates roots and shows multiplicities; an isolated root is refined by the sign of p.
3. With a root to many digits, inverse iteration in long decimals finds the null space of (matrix - root).

Everything here is bounded by the matrix; nothing depends on the number of rows it came from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np

# Bits behind the binary point to which a root is known, relative to the largest one.
ROOT_BITS = 200
# Digits of the decimals in which null spaces are found; the last pivot is about 2^-ROOT_BITS.
DIGITS = 160
# Bits of the moduli: products of two residues fit 64 bits.
_PRIME_BITS = 31
_WITNESSES = (2, 3, 5, 7)           # enough below 3,215,031,751


def is_prime(n: int) -> bool:
    if n < 2 or any(n % p == 0 for p in _WITNESSES):
        return n in _WITNESSES
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for witness in _WITNESSES:
        x = pow(witness, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes() -> Iterator[int]:
    """Primes below 2^31, the largest first."""
    n = (1 << _PRIME_BITS) - 1
    while n > 2:
        if is_prime(n):
            yield n
        n -= 2


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial of this positive semidefinite matrix is larger.

    The k-th is a sum of products of k eigenvalues, so together they are at most (1 + trace / d)^d.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    return (1 + -(-trace // d)) ** d if d else 1


def primes_for(matrix: list[list[int]]) -> list[int]:
    need, product, chosen = 2 * coefficient_bound(matrix) + 1, 1, []
    for p in primes():
        chosen.append(p)
        product *= p
        if product > need:
            return chosen
    raise ValueError("no primes are left")


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x^(p-2) modulo p, elementwise."""
    power, result, left = x % p, np.ones_like(x), p - 2
    while left.any():
        result = np.where(left & 1, result * power % p, result)
        power = power * power % p
        left = left >> 1
    return result


def residues(matrix: list[list[int]], moduli: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix), lowest first, modulo each prime: one row per prime."""
    d, p = len(matrix), np.array(moduli, np.int64)
    h = np.array([[[x % q for x in row] for row in matrix] for q in moduli], np.int64).reshape(len(p), d, d)
    every = np.arange(len(p))
    p1, p2 = p[:, None], p[:, None, None]
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1:, k] != 0, axis=1)
        rows = h[every, pivot].copy()
        h[every, pivot], h[:, k + 1] = h[:, k + 1].copy(), rows
        columns = h[every, :, pivot].copy()
        h[every, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), columns
        # Without a pivot the column is zero already: the factors are zero then, too.
        factor = h[:, k + 2:, k] * _inverse(h[:, k + 1, k], p)[:, None] % p1
        h[:, k + 2:] = (h[:, k + 2:] - factor[:, :, None] * h[:, k + 1][:, None, :] % p2) % p2
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * factor[:, None, :] % p2).sum(axis=2)) % p1
    polynomials = np.zeros((d + 1, len(p), d + 1), np.int64)
    polynomials[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((len(p), d + 1), np.int64)
        new[:, 1:] = polynomials[k - 1, :, :-1]
        new = (new - polynomials[k - 1] * h[:, k - 1, k - 1][:, None]) % p1
        product = np.ones(len(p), np.int64)
        for i in range(1, k):
            product = product * h[:, k - i, k - i - 1] % p
            new = (new - polynomials[k - i - 1] * (product * h[:, k - i - 1, k - 1] % p)[:, None]) % p1
        polynomials[k] = new
    return polynomials[d]


def remaindered(moduli: list[int], rows: list[list[int]]) -> list[int]:
    """The integers, of either sign, with these residues."""
    product, values = 1, [0] * len(rows[0])
    for p, row in zip(moduli, rows):
        inverse = pow(product, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, row)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def _above(polynomial: list[int], at: int) -> int:
    """How many roots (all of them real) are larger than ``at``: the sign changes of p(x + at)."""
    shifted, d = list(polynomial), len(polynomial) - 1
    if at:
        for k in range(d):
            for i in range(d - 1, k - 1, -1):
                shifted[i] += at * shifted[i + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _scaled(polynomial: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    d = len(polynomial) - 1
    return [c << (bits * (d - k)) for k, c in enumerate(polynomial)]


def _sign(polynomial: list[int], at: int, bits: int) -> int:
    """The sign of the polynomial at at / 2^bits."""
    value, scale = 0, 0
    for c in reversed(polynomial):
        value = value * at + (c << scale)
        scale += bits
    return (value > 0) - (value < 0)


def top_roots(polynomial: list[int], wanted: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """The largest positive roots as (numerator, bits of the denominator, multiplicity), at least ``wanted`` with multiplicity if there are so many.

    A numerator is at most one too small. Roots that agree to all digits count as one of higher multiplicity.
    """
    low = next(k for k, c in enumerate(polynomial) if c)
    polynomial = polynomial[low:]                   # zero is no eigenvalue that is asked for
    total = len(polynomial) - 1
    if not total:
        return []
    height = max(1, -polynomial[-2] if total else 1).bit_length() + 1       # the sum of the roots bounds each
    fraction = max(0, bits - height)
    roots: list[tuple[int, int, int]] = []
    # An interval (lower, upper] / 2^at of roots, with the number of roots above either end; the highest is looked at first.
    open_ends = [(0, 1 << height, 0, total, 0)]
    levels = {0: polynomial}
    while open_ends and sum(m for _, _, m in roots) < wanted:
        lower, upper, at, above_lower, above_upper = open_ends.pop()
        inside = above_lower - above_upper
        if inside == 0:
            continue
        if inside == 1:
            roots.append((*_refined(polynomial, lower, upper, at, fraction), 1))
        elif upper - lower == 1 and at >= fraction:
            roots.append((lower, at, inside))
        else:
            if upper - lower == 1:
                lower, upper, at = 2 * lower, 2 * upper, at + 1
            middle = (lower + upper) // 2
            if at not in levels:
                levels[at] = _scaled(polynomial, at)
            above = _above(levels[at], middle)
            open_ends += [(lower, middle, at, above_lower, above), (middle, upper, at, above, above_upper)]
    return roots


def _refined(polynomial: list[int], lower: int, upper: int, at: int, fraction: int) -> tuple[int, int]:
    """The only root in (lower, upper] / 2^at, a simple one, to ``fraction`` bits."""
    top = _sign(polynomial, upper, at)
    if top == 0:
        return upper, at
    while upper - lower > 1 or at < fraction:
        if upper - lower == 1:
            lower, upper, at = 2 * lower, 2 * upper, at + 1
        middle = (lower + upper) // 2
        sign = _sign(polynomial, middle, at)
        if sign == 0:
            return middle, at
        lower, upper = (lower, middle) if sign == top else (middle, upper)
    return lower, at


def _solver(matrix: list[list[int]], root: Decimal):
    """Triangular factors of (matrix - root), rows exchanged for the largest pivot."""
    d = len(matrix)
    a = np.array([[Decimal(x) for x in row] for row in matrix], object)
    a[np.arange(d), np.arange(d)] -= root
    order = np.arange(d)
    tiny = max(1, *(abs(x) for row in matrix for x in row)) * Decimal(10) ** (8 - DIGITS)
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = Decimal(tiny)
        a[k + 1:, k] /= a[k, k]
        if k + 1 < d:
            a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])

    def solve(vector: np.ndarray) -> np.ndarray:
        x = vector[order].copy()
        for k in range(d):
            x[k] -= (a[k, :k] * x[:k]).sum() if k else 0
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] - ((a[k, k + 1:] * x[k + 1:]).sum() if k + 1 < d else 0)) / a[k, k]
        return x

    return solve


def null_space(matrix: list[list[int]], numerator: int, bits: int, multiplicity: int) -> list[list[Decimal]]:
    """Orthonormal vectors of (matrix - numerator / 2^bits), each with its largest entry positive."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        solve = _solver(matrix, Decimal(numerator) / Decimal(1 << bits))
        found: list[np.ndarray] = []
        for number in range(multiplicity):
            # Starting vectors without any pattern, the same in every run.
            vector = np.array([Decimal(pow(3, (number * d + k + 1) * 7919, 1_000_003) - 500_001) for k in range(d)], object)
            for _ in range(4):
                vector = _unit(solve(vector), found)
            found.append(vector)
        for vector in found:
            if max(vector, key=abs) < 0:
                vector *= -1
        return [list(v) for v in found]


def _unit(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    vector = vector / max(abs(x) for x in vector)
    for _ in range(2):
        for other in others:
            vector = vector - other * (vector * other).sum()
    return vector / (vector * vector).sum().sqrt()


def common_factor(matrix: list[list[int]]) -> int:
    return math.gcd(*(x for row in matrix for x in row)) or 1
