"""Whitening of vectors from the exact characteristic polynomial of their scatter.

Entries become whole numbers, so the scatter ``A = n * sum(x x') - S S'`` of the distinct vectors is a matrix of whole numbers, summed without
rounding. Its characteristic polynomial is found modulo many primes (reduction to Hessenberg form, then the recurrence over its leading
blocks), one prime in a task, and put together by Chinese remaindering; a bound on the coefficients tells how many primes are needed.

A is symmetric, so all roots are real, and the number of roots above t is exactly the number of sign changes in the coefficients of p(x + t)
(Descartes, Budan). Bisection at dyadic points with whole-number arithmetic gives each root to RELATIVE_BITS of the trace; the multiplicity is known by
the same count. Inverse iteration on A - root in decimal arithmetic gives the components, a root of multiplicity m its m vectors together.

Only what has the size of the matrix goes through the driver: sums (d * d numbers), coefficients, components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._shared import need, send_by_value, written

send_by_value(__name__)

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: The matrix, d * d numbers, is held by the driver and by each task.
MOST_DIMENSIONS = 1024
RELATIVE_BITS = 220
DIGITS = 120
LIMB = 60  # bits; sums of whole numbers travel as two of them
LONGEST = (1 << 63) - 1


def matrix(column) -> np.ndarray:
    """Rows of a list column whose lists are all as long."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def whole(df: DataFrame, vector: str, scale: float, offset: int, width: int | None = None) -> DataFrame:
    """``df`` with ``_x``, the entries as whole numbers, without the rows that take no part; shorter vectors end in zeros."""
    entry = lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-(2.0**61))), F.lit(2.0**61))).cast("long") + F.lit(offset).cast("long")
    usable = F.col(f"`{vector}`").isNotNull() & F.forall(F.col(f"`{vector}`"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(F.col(f"`{vector}`"), entry)
    if width is not None:
        x = F.concat(x, F.array_repeat(F.lit(offset).cast("long"), F.lit(width) - F.size(x)))
    return df.where(F.coalesce(usable, F.lit(False))).withColumn("_x", x)


# the scatter


def _sums(offset: int) -> Callable:
    """Of the rows of a task: how many, the sum of each entry, and of each product of two; entries less ``offset``."""

    def products(x: np.ndarray, most: int) -> np.ndarray:
        if most * most * len(x) < 1 << 53:  # then sums in doubles are exact
            x = x.astype(np.float64)
            return (x.T @ x).astype(np.int64).astype(object)
        x = x.astype(object)
        return x.T @ x

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, total, cross = 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = matrix(batch.column(0).slice(at, 2048)) - offset
                most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
                n += len(x)
                total = total + (x.sum(axis=0).astype(object) if most < 1 << 50 else x.astype(object).sum(axis=0))
                cross = cross + products(x, most)
        if not n:
            return
        d = len(total)
        cells = [(-1, -1, n), *((i, -1, int(total[i])) for i in range(d)), *((i, j, int(cross[i, j])) for i in range(d) for j in range(i, d))]
        whole_number = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1)] + [pa.array([Decimal(v) for v in limbs], whole_number) for limbs in zip(*((c[2] >> LIMB, c[2] & ((1 << LIMB) - 1)) for c in cells), strict=True)],
            ["i", "j", "high", "low"],
        )

    return run


def scatter(fit: DataFrame, offset: int) -> tuple[int, list[int], list[list[int]]]:
    """Of the table's one column: rows, sums of the entries less ``offset``, and n times the scatter."""
    cells = fit.mapInArrow(_sums(offset), "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    value = {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in cells}
    n = value.get((-1, -1), 0)
    d = sum(j == -1 for _, j in value) - 1 if n else 0
    s = [value[i, -1] for i in range(d)]
    return n, s, [[n * value[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


# the characteristic polynomial


def primes_below(top: int, count: int) -> list[int]:
    """The largest ``count`` primes below ``top``."""
    sieve = np.ones(math.isqrt(top) + 1, bool)
    sieve[:2] = False
    for i in range(2, math.isqrt(len(sieve)) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    small, found = np.flatnonzero(sieve), []
    while len(found) < count:
        top -= 1
        if (top % small).all():
            found.append(top)
    return found


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - a) modulo the prime p < 2**31, constant first; ``a`` is reduced already."""
    h, d = a.copy(), len(a)
    for k in range(d - 2):
        pivot = k + 1 + int((h[k + 1 :, k] != 0).argmax())
        if not h[pivot, k]:
            continue
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    blocks = np.zeros((d + 1, d + 1), np.int64)  # polynomials of the leading blocks
    blocks[0, 0] = 1
    for k in range(d):
        weight, chain = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weight[i] = h[i, k] * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else 0
        blocks[k + 1, 1:] = blocks[k, :-1]
        blocks[k + 1] = (blocks[k + 1] - (weight[:, None] * blocks[: k + 1] % p).sum(axis=0)) % p
    return blocks[d]


def coefficient_bits(a: list[list[int]]) -> int:
    """No coefficient has more bits: of non-negative roots with this sum, equal ones have the largest elementary symmetric sums."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    mean = math.log2(trace) - math.log2(d)
    return math.ceil(max(math.log2(math.comb(d, k)) + k * mean for k in range(d + 1))) + 2


def _residues(a: list[list[int]]) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = polynomial_mod(np.array([[v % p for v in row] for row in a], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(np.full(len(found), p, np.int64)), pa.array(found)], ["power", "prime", "residue"])

    return run


def remainders_to_number(primes: list[int], residues: list[int]) -> int:
    """The number of least magnitude with these residues."""
    value, modulus = 0, 1
    for p, r in zip(primes, residues, strict=True):
        value += modulus * ((r - value) * pow(modulus, -1, p) % p)
        modulus *= p
    return value - modulus if 2 * value > modulus else value


def _together(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        numbers = [remainders_to_number([c["prime"] for c in cells], [c["residue"] for c in cells]) for cells in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hex(v) for v in numbers], pa.string())], ["power", "coefficient"])


def characteristic_polynomial(spark, a: list[list[int]]) -> list[int]:
    """Coefficients of det(x - a) for a symmetric matrix without negative roots, constant first; primes are spread over the tasks."""
    primes = primes_below(1 << 31, coefficient_bits(a) // 30 + 1)
    given = spark.range(0, len(primes), 1, min(len(primes), 64)).select(F.element_at(F.array(*[F.lit(p).cast("long") for p in primes]), (F.col("id") + 1).cast("int")).alias("prime"))
    residues = given.mapInArrow(_residues(a), "power int, prime long, residue long")
    cells = residues.groupBy("power").agg(F.sort_array(F.collect_list(F.struct("prime", "residue"))).alias("cells"))
    return [int(r["coefficient"], 16) for r in sorted(cells.mapInArrow(_together, "power int, coefficient string").collect())]


# its roots


def roots_above(p: list[int], num: int, bits: int) -> int:
    """How many roots of ``p`` (all are real) lie above num / 2**bits, each as often as its multiplicity."""
    d = len(p) - 1
    c = [v << bits * (d - i) for i, v in enumerate(p)]
    for i in range(d):  # c(x + num)
        for j in range(d - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(p: list[int], num: int, bits: int) -> int:
    """Value of ``p`` at num / 2**bits, times 2**(bits * degree)."""
    total, scale = 0, 0
    for v in reversed(p):
        total = total * num + (v << scale)
        scale += bits
    return total


def largest_root(p: list[int], k: int, top: int) -> tuple[int, int, int, int]:
    """``num, bits, first, multiplicity``: num / 2**bits lies within top / 2**RELATIVE_BITS of the k-th largest root (from 1); ``first`` is the
    rank of the first of the roots that equal it to that precision. All roots lie in [0, top]."""
    bits = max(0, RELATIVE_BITS - top.bit_length())
    low, high = -1, top << bits  # above low there are k roots or more, above high fewer
    above, here = 0, len(p) - 1
    sign = None
    while high - low > 1:
        mid = (low + high) // 2
        if here - above == 1:  # one root left in between: the sign of the polynomial tells its side
            if sign is None:
                end = _value(p, high, bits)
                if not end:
                    break
                sign = end > 0
            v = _value(p, mid, bits)
            right = bool(v) and (v > 0) != sign
            if right:
                low = mid
            else:
                high = mid
            if not v:
                break
        elif (n := roots_above(p, mid, bits)) >= k:
            low, here = mid, n
        else:
            high, above = mid, n
    return high, bits, above + 1, here - above


# components


def null_vectors(a: list[list[int]], num: int, bits: int, multiplicity: int) -> list[np.ndarray]:
    """Unit vectors that span the null space of a - num / 2**bits, by inverse iteration in decimal arithmetic."""
    import decimal

    with decimal.localcontext(Context(prec=DIGITS)):
        d, root = len(a), Decimal(num) / Decimal(1 << bits)
        rows = [[Decimal(v) for v in row] for row in a]
        for i in range(d):
            rows[i][i] -= root
        least = max(root, *(abs(v) for row in rows for v in row)) * Decimal(10) ** (10 - DIGITS)
        swaps, factors = [], []
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[pivot] = rows[pivot], rows[k]
            if abs(rows[k][k]) < least:
                rows[k][k] = least
            inverse, top = 1 / rows[k][k], rows[k]
            column = []
            for i in range(k + 1, d):
                f = rows[i][k] * inverse
                column.append(f)
                if f:
                    own = rows[i]
                    for j in range(k + 1, d):
                        own[j] -= f * top[j]
            swaps.append(pivot)
            factors.append(column)

        def solved(b: list[Decimal]) -> list[Decimal]:
            b = list(b)
            for k in range(d):
                b[k], b[swaps[k]] = b[swaps[k]], b[k]
                for i, f in enumerate(factors[k], k + 1):
                    b[i] -= f * b[k]
            for k in range(d - 1, -1, -1):
                b[k] = (b[k] - sum(rows[k][j] * b[j] for j in range(k + 1, d))) / rows[k][k]
            return b

        found = [[Decimal(1 + (37 * i + 101 * m + i * i * (m + 1)) % 97) for i in range(d)] for m in range(multiplicity)]
        for _ in range(3):
            for m in range(multiplicity):
                v = solved(found[m])
                size = max(abs(x) for x in v)
                v = [x / size for x in v]
                for u in found[:m]:
                    dot = sum(x * y for x, y in zip(u, v, strict=True))
                    v = [y - dot * x for x, y in zip(u, v, strict=True)]
                norm = sum(x * x for x in v).sqrt()
                found[m] = [x / norm for x in v]
        return [np.array([float(x) for x in v]) for v in found]


def _components(a: list[list[int]], p: list[int], top: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                num, bits, first, multiplicity = largest_root(p, k, top)
                v = null_vectors(a, num, bits, multiplicity)[k - first]
                v = v if v[np.abs(v).argmax()] > 0 else -v
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([hex(num)]), pa.array([bits]), pa.array([v.tolist()], pa.list_(pa.float64()))], ["component", "root", "bits", "vector"])

    return run


# whitening


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``n`` distinct vectors, their sums less ``offset``, the eigenvalues of their covariance, their unit vectors (rows), each
    one's share of the trace, and the largest entry of the whitened vectors' covariance less the identity."""

    n: int
    sums: list[int]
    offset: int
    scale: float
    eigenvalues: list[float]
    vectors: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S (whole numbers), and the whitened rows."""
        y = x - self.offset
        most = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
        if self.n * most + max(map(abs, self.sums), default=0) < 1 << 62:
            far = self.n * y - np.array(self.sums, np.int64)
        else:
            far = self.n * y.astype(object) - np.array(self.sums, object)
        centred = (far / self.n).astype(np.float64)
        return far, centred @ self.vectors.T / np.sqrt(self.eigenvalues)

    def transform(self, df: DataFrame, vector: str = "embedding", into: str = "whitening") -> DataFrame:
        """``df`` without the rows that take no part, with a struct ``into`` of ``deviation`` (long, null where it has more than 63 bits)
        and ``values``, one whitened number a component. A column of that name is replaced."""
        need(df, vector)
        df = df.drop(into)
        rows = whole(df, vector, self.scale, self.offset, len(self.sums))
        kind = StructType.fromDDL("deviation long, values array<double>")
        return rows.mapInArrow(_whitened_rows(self, into), StructType([*df.schema.fields, StructField(into, kind)]))


def _whitened_rows(fitted: Whitening, into: str) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            far, values = fitted.whitened(matrix(batch.column(batch.num_columns - 1)))
            most = int(np.abs(far).max()) if far.size else 0
            if most * most * max(1, far.shape[1]) >= 1 << 63:
                far = far.astype(object)
            deviation = [v if v <= LONGEST else None for v in map(int, (far * far).sum(axis=1))]
            flat = pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32), pa.array(values.ravel())) if values.size else pa.array([[]] * batch.num_rows, pa.list_(pa.float64()))
            struct = pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), flat], ["deviation", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], struct], [*batch.schema.names[:-1], into])

    return run


def _whitened_sums(fitted: Whitening) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        k = len(fitted.eigenvalues)
        total, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = fitted.whitened(matrix(batch.column(0)))[1]
            total += z.sum(axis=0)
            cross += z.T @ z
        i, j = np.triu_indices(k)
        first, second = np.concatenate((i, np.arange(k))), np.concatenate((j, np.full(k, -1)))
        yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(np.concatenate((cross[i, j], total)))], ["i", "j", "v"])

    return run


def _identity_error(fit: DataFrame, fitted: Whitening) -> float:
    """Rows are centred exactly before they are multiplied; what is left of the mean is taken off as well."""
    cells = fit.mapInArrow(_whitened_sums(fitted), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    value = {(r["i"], r["j"]): r["v"] / fitted.n for r in cells}
    return max(abs(v - value[i, -1] * value[j, -1] - (i == j)) for (i, j), v in value.items() if j >= 0)


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> Whitening:
    """Principal components of the distinct vectors of ``df``, entries c taken as floor(scale * c) + offset.

    Rows whose vector is null or holds null or non-finite entries take no part; a shorter vector counts as if it ended in zeros; an entry of
    2**61 or more after scaling counts as 2**61. There are at most ``components`` components, and none with an eigenvalue of
    zero, so none at all for fewer than two distinct vectors or an empty table. Components of equal eigenvalues are any orthonormal
    basis of their space, the same for all rows. At most MOST_DIMENSIONS entries a vector.
    """
    need(df, vector)
    spark = df.sparkSession
    width = whole(df, vector, scale, offset).agg(F.max(F.size("_x")).alias("d")).first()["d"] or 0
    if width > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {width} entries; at most {MOST_DIMENSIONS} are taken")
    none = Whitening(0, [0] * width, offset, scale, [], np.zeros((0, width)), [])
    if not width:
        return none
    fit = written(whole(df, vector, scale, offset, width).select("_x").distinct(), "whitening-fit")
    n, s, a = scatter(fit, offset)
    trace = sum(a[i][i] for i in range(len(a)))
    if not trace:
        return Whitening(n, s or none.sums, offset, scale, [], none.vectors, [])
    p = characteristic_polynomial(spark, a)
    while not p[0]:  # roots that are zero
        p = p[1:]
    k = min(components, len(p) - 1)
    found = spark.range(1, k + 1, 1, k).mapInArrow(_components(a, p, trace), "component long, root string, bits long, vector array<double>").collect()
    found = sorted(found, key=lambda r: r["component"])
    roots = [(int(r["root"], 16), 1 << r["bits"]) for r in found]
    fitted = Whitening(n, s, offset, scale, [num / (den * n * n) for num, den in roots], np.array([r["vector"] for r in found]), [num / (den * trace) for num, den in roots])
    return Whitening(**{**fitted.__dict__, "identity_error": _identity_error(fit, fitted)})


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each vector that takes part and each component."""
    fitted = fit_whitening(df, vector, **settings)
    rows = fitted.transform(df.select(F.col(f"`{id}`").alias(id), F.col(f"`{vector}`").alias("_vector")), "_vector", "_white")
    shares = F.array(*[F.lit(v) for v in fitted.explained]).cast("array<double>")
    rows = rows.select(F.col(f"`{id}`"), F.col("_white.deviation").alias("deviation"), F.posexplode("_white.values").alias("_at", "whitened"))
    return rows.select(f"`{id}`", (F.col("_at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"))
