from __future__ import annotations

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from econspark.llm import whitening as wh


def determinant(a):
    """By expansion over permutations."""
    total = 0
    for order in itertools.permutations(range(len(a))):
        sign = (-1) ** sum(order[i] > order[j] for i in range(len(a)) for j in range(i + 1, len(a)))
        total += sign * math.prod(a[i][order[i]] for i in range(len(a)))
    return total


def test_polynomial_against_determinants(spark):
    rng = random.Random(3)
    for d in (1, 2, 5):
        b = [[rng.randint(-(10**9), 10**9) for _ in range(d)] for _ in range(d + (d != 5))]
        a = [[sum(r[i] * r[j] for r in b) for j in range(d)] for i in range(d)]
        p = wh.characteristic_polynomial(spark, a)
        for x in (-3, 0, 10**18 + 1):
            assert sum(c * x**i for i, c in enumerate(p)) == determinant([[x * (i == j) - a[i][j] for j in range(d)] for i in range(d)])


def test_polynomial_needs_pivots():
    p = wh.primes_below(1 << 31, 3)
    assert p[0] == (1 << 31) - 1 and all(q % 2 and q > 1 << 30 for q in p)
    a = np.array([[1, 0, 0, 2], [0, 3, 1, 0], [0, 1, 0, 5], [2, 0, 5, 7]])
    want = [round(c) for c in np.poly(a.astype(float))[::-1]]
    assert [v - p[0] if v > p[0] // 2 else v for v in wh.polynomial_mod(a % p[0], p[0]).tolist()] == want
    assert wh.remainders_to_number(p, [(-(10**20)) % q for q in p]) == -(10**20)


def test_roots_are_counted_and_found_to_many_digits():
    roots = [Fraction(1, 1), Fraction(2), Fraction(2), Fraction(2), Fraction(9)]
    p = [1]
    for r in roots:
        p = [a - int(r) * b for a, b in zip([0, *p], [*p, 0], strict=True)]
    assert [wh.roots_above(p, t, 1) for t in (0, 2, 3, 4, 17, 18)] == [5, 4, 4, 1, 1, 0]
    for k, (first, multiplicity, value) in enumerate([(1, 1, 9), (2, 3, 2), (2, 3, 2), (2, 3, 2), (5, 1, 1)], 1):
        num, bits, *rest = wh.largest_root(p, k, 16)
        assert rest == [first, multiplicity] and abs(Fraction(num, 1 << bits) - value) <= Fraction(16, 1 << wh.RELATIVE_BITS)
    num, bits, _, _ = wh.largest_root([-2, 0, 1], 1, 2)  # an irrational root
    assert abs(Fraction(num, 1 << bits) ** 2 - 2) < Fraction(1, 10**60)


def test_null_space_of_a_repeated_root():
    q, _ = np.linalg.qr(np.arange(25.0).reshape(5, 5) % 7 + np.eye(5))
    a = [[2, 0, 0], [0, 2, 0], [0, 0, 5]]
    v = np.array(wh.null_vectors(a, 2, 0, 2))
    assert np.allclose(v @ v.T, np.eye(2), atol=1e-15) and np.allclose(v[:, 2], 0, atol=1e-15)
    b = np.round(1e6 * q @ np.diag([1, 2, 3, 4, 5]) @ q.T).astype(int)
    b = ((b + b.T) // 2).tolist()
    top = np.linalg.eigvalsh(np.array(b, float))[-1]
    assert np.abs(np.array(b) @ wh.null_vectors(b, round(top * 2**40), 40, 1)[0] - top * wh.null_vectors(b, round(top * 2**40), 40, 1)[0]).max() < 1e-6


def brute(rows, components):
    """From the definition, in exact fractions up to the eigenvectors."""
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in ok), default=0)
    ok = [(i, tuple(x + [1_000_000] * (d - len(x)))) for i, x in ok]
    fit = sorted({x for _, x in ok})
    n = len(fit)
    s = [sum(x[j] for x in fit) for j in range(d)]
    y = [[Fraction(x[j]) - Fraction(s[j], n) for j in range(d)] for x in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    order = [i for i in np.argsort(-e) if e[i] > 1e-9 * max(e[-1], 1e-300)][:components]
    out = []
    for i, x in ok:
        far = [n * a - b for a, b in zip(x, s, strict=True)]
        white = [float(np.dot([f / n for f in far], u[:, k])) / math.sqrt(e[k]) for k in order]
        out.append((i, n, sum(f * f for f in far), white))
    return out, [e[k] / np.trace(v) for k in order]


def table(spark, rows, extra="component"):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], f"vec_id long, embedding array<float>, `{extra}` int, whitened double").repartition(3)


def check(spark, rows, components=16):
    want, shares = brute(rows, components)
    got = {}
    for r in wh.whiten(table(spark, rows), components=components).collect():
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert len({r["n"] for g in got.values() for rs in g.values() for r in rs}) <= 1
    assert sum(len(rs) for g in got.values() for rs in g.values()) == len(want) * len(shares)
    signs = {}
    for i, n, deviation, white in want:
        mine = got[i, deviation] if shares else {}
        for k, (w, share) in enumerate(zip(white, shares, strict=True), 1):
            for r in mine[k]:
                assert r["n"] == n and abs(r["explained"] - share) <= 1e-9 and r["identity_error"] < 1e-9
                if abs(w) > 1e-6:
                    assert signs.setdefault(k, r["whitened"] * w > 0) == (r["whitened"] * w > 0)
                assert abs(abs(r["whitened"]) - abs(w)) < 1e-6


def test_whitening_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.1 * (j + 1)) for j in range(6)]) for i in range(60)]
    rows += rows[:9] + [(None, rows[3][1]), (77, None), (78, [0.1, None] * 3), (79, [float("nan")] * 6), (80, [float("inf")] + [0.0] * 5), (81, []), (82, [0.5, 0.25])]
    rows += [(90 + i, rows[0][1]) for i in range(40)]  # one vector in many rows counts once
    check(spark, rows)
    check(spark, rows, 2)


def test_awkward_tables(spark):
    line = [(i, [0.1 * i, 0.0, 0.2 * i]) for i in range(5)]
    check(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(5)])  # one component has all the variance
    assert {r["component"] for r in wh.whiten(table(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(5)])).collect()} == {1}
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5])] * 3, [(1, [float("nan")])]):
        out = wh.whiten(table(spark, rows))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    square = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])]  # equal eigenvalues
    got = wh.whiten(table(spark, square)).collect()
    assert len(got) == 8 and all(r["identity_error"] < 1e-12 and abs(r["explained"] - 0.5) < 1e-12 for r in got)
    huge = wh.whiten(table(spark, [*line, (9, [1e30, 0.0, -1e30])])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] == 9} == {None} and all(math.isfinite(r["whitened"]) for r in huge)
    kept = wh.fit_whitening(table(spark, line)).transform(table(spark, line, extra="whitening"))
    assert kept.columns == ["vec_id", "embedding", "whitened", "whitening"]
    with pytest.raises(ValueError):
        wh.fit_whitening(table(spark, line), vector="nothing")


def test_large_numbers_are_summed_exactly(spark):
    rows = [(i, [i * 2.0**40, -(i % 3) * 2.0**41, 0.25 * i]) for i in range(50)]
    fit = wh.whole(table(spark, rows), "embedding", 64, 0, 3).select("_x")
    x = [[math.floor(64 * np.float32(c)) for c in v] for _, v in rows]
    n, s, a = wh.scatter(fit, 0)
    assert n == 50 and s == [sum(r[j] for r in x) for j in range(3)]
    assert a == [[50 * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(3)] for i in range(3)]
