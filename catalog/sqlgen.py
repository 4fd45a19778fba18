"""Builders for the SQL that states expected results: rounding, tail probabilities, least squares."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from econspark.functions.dist import norm_ppf, normal_quantile_sql
from econspark.operators import normality

SIMPSON_STEPS = 2000


@dataclass
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def entry(
    name: str,
    run: Callable[[SparkSession, str], DataFrame],
    sql: str | None = None,
    *,
    plain: Sequence[str] = (),
    sig: Sequence[str] = (),
    prob: Sequence[str] = (),
    digits: int = 9,
    places: int = 6,
) -> Entry:
    """A query and its SQL with the same columns: ``plain`` as they are, ``sig`` to ``digits``
    significant digits after the first, ``prob`` to ``places`` decimals."""
    columns = [*plain, *sig, *prob]

    def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select(
            *[F.col(c) for c in plain],
            *[
                F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}e", F.col(c).cast("double")).cast("double")).alias(c)
                for c in sig
            ],
            *[(F.round(F.col(c).cast("double"), places) + F.lit(0.0)).alias(c) for c in prob],
        )

    if not columns:
        return Entry(name, run, sql)
    full = None
    if sql is not None:
        quoted = {c: f'"{c}"' for c in columns}
        parts = [
            *[quoted[c] for c in plain],
            *[f"CAST(printf('%.{digits}e', CAST({quoted[c]} AS DOUBLE)) AS DOUBLE) AS {quoted[c]}" for c in sig],
            *[f"round(CAST({quoted[c]} AS DOUBLE), {places}) + 0.0 AS {quoted[c]}" for c in prob],
        ]
        full = f"SELECT {', '.join(parts)} FROM ({sql}) AS expected"
    return Entry(name, finished, full)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- tail probabilities by Simpson's rule ---------------------------------------------------------


def _simpson(integrand: str, upper: str) -> str:
    """∫ from 0 to ``upper``; ``integrand`` is written in u."""
    n = SIMPSON_STEPS
    u = f"(({upper}) * i / {n}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    body = integrand.replace("{u}", u)
    return f"(({upper}) / {3 * n}.0 * list_sum(list_transform(range(0, {n + 1}), lambda i: {weight} * ({body}))))"


def norm_sf(z: str) -> str:
    """Upper tail for z ≥ 0."""
    return f"greatest(0.0, 0.5 - {_simpson('exp(-{u} * {u} / 2) / sqrt(2 * pi())', f'least({z}, 40.0)')})"


def sample_key(*keys: str, seed: int = 42) -> str:
    """The digest by which rows are sampled and grouped."""
    return f"md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}, '{seed}'))"


def shapiro_sql(rows: str, x: str) -> str:
    """W and its p-value from the scores of all ranks; 12 rows at least."""
    poly = lambda cs, v: " + ".join(f"({c!r} * pow({v}, {i}))" for i, c in enumerate(cs))
    z = normal_quantile_sql("((i - 0.375) / (n + 0.25))")
    p = norm_sf("abs(s)")
    return (
        f"WITH v AS (SELECT {x}::DOUBLE AS x, row_number() OVER (ORDER BY {x}) AS i, (count(*) OVER ())::DOUBLE AS n FROM ({rows}) WHERE {x} IS NOT NULL), "
        f"m AS (SELECT *, {z} AS z FROM v), "
        "c AS (SELECT any_value(n) AS n, sum(z * z) AS sq, min(z) AS z1, max(CASE WHEN i = 2 THEN z END) AS z2, avg(x) AS mean, var_pop(x) * count(*) AS ss FROM m), "
        f"k AS (SELECT *, {poly(normality.LAST_WEIGHT, '(1 / sqrt(n))')} - z1 / sqrt(sq) AS a1, {poly(normality.NEXT_WEIGHT, '(1 / sqrt(n))')} - z2 / sqrt(sq) AS a2 FROM c), "
        "d AS (SELECT *, sqrt((sq - 2 * z1 * z1 - 2 * z2 * z2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS div FROM k), "
        "w AS (SELECT any_value(d.n) AS n, pow(sum((x - mean) * CASE WHEN i = 1 THEN -a1 WHEN i = m.n THEN a1 WHEN i = 2 THEN -a2 WHEN i = m.n - 1 THEN a2 ELSE z / div END), 2) / any_value(ss) AS w FROM m, d), "
        f"t AS (SELECT n::BIGINT AS n, w, (ln(1 - w) - ({poly(normality.LARGE_MEAN, 'ln(n)')})) / exp({poly(normality.LARGE_SCALE, 'ln(n)')}) AS s FROM w) "
        f"SELECT n, w AS w_stat, CASE WHEN s >= 0 THEN {p} ELSE 1 - {p} END AS p_value, CASE WHEN s >= 0 THEN {p} ELSE 1 - {p} END > 0.05 AS normal FROM t"
    )


def t_two_sided(t: str, df: str) -> str:
    const = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    body = f"exp(-((({df}) + 1) / 2.0) * ln(1 + {{u}} * {{u}} / ({df})))"
    return f"greatest(0.0, 1 - 2 * {const} * {_simpson(body, f'least(abs({t}), 40.0)')})"


def f_sf(f: str, d1: str, d2: str) -> str:
    const = (
        f"exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0)"
        f" + ({d1}) / 2.0 * ln(({d1}) * 1.0 / ({d2})))"
    )
    body = f"2 * pow({{u}}, ({d1}) - 1) * exp(-((({d1}) + ({d2})) / 2.0) * ln(1 + ({d1}) * 1.0 / ({d2}) * {{u}} * {{u}}))"
    return f"greatest(0.0, 1 - {const} * {_simpson(body, f'least(sqrt({f}), 60.0)')})"


def chi2_sf(x: str, k: str) -> str:
    const = f"exp(-({k}) / 2.0 * ln(2.0) - lgamma(({k}) / 2.0))"
    body = f"2 * pow({{u}}, ({k}) - 1) * exp(-{{u}} * {{u}} / 2)"
    return f"greatest(0.0, 1 - {const} * {_simpson(body, f'least(sqrt({x}), 40.0)')})"


def t_crit_95(df: str) -> str:
    """97.5 % point of Student's t."""
    return t_crit(df, 0.95)


def t_crit(df: str, level: float) -> str:
    """Two-sided point of Student's t by its expansion around the normal point, for large df."""
    z = norm_ppf((1 + level) / 2)
    a, b = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    c = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return f"({z} + {a} / ({df}) + {b} / pow({df}, 2) + {c} / pow({df}, 3))"


# --- least squares by sweeping -----------------------------------------------------------------


def ols_sql(rows: str, y: str, xs: Sequence[str], const: bool = True, by: Sequence[str] = (), prefix: str = "o") -> str:
    """CTE list (no leading WITH). The last CTE ``{prefix}`` has by…, n, k, ssr, tss, mean_y,
    mean_i, b_i (slopes), v_i_j (inverse of the cross-products, i ≤ j), b_0 (constant)."""
    names = [*xs, y]
    p = len(names)
    keys = list(by)
    key_sql = "".join(f"{k}, " for k in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(names))
    join = f"JOIN {prefix}_m USING ({', '.join(keys)})" if keys else f"CROSS JOIN {prefix}_m"
    centre = (lambda i: f"({names[i]} - m{i})") if const else (lambda i: f"{names[i]}")
    cross = ", ".join(
        f"sum({centre(i)} * {centre(j)}) AS a_{i}_{j}" for i in range(p) for j in range(i, p)
    )
    first_means = ", ".join(f"any_value(m{i}) AS m{i}" for i in range(p))
    ctes = [
        f"{prefix}_r AS ({rows})",
        f"{prefix}_m AS (SELECT {key_sql}count(*) AS n, {means} FROM {prefix}_r{group})",
        f"{prefix}_0 AS (SELECT {key_sql}any_value(n) AS n, {first_means}, {cross} FROM {prefix}_r {join}{group})",
    ]

    def a(i: int, j: int) -> str:
        return f"a_{min(i, j)}_{max(i, j)}"

    keep = ", ".join([*keys, "n", *[f"m{i}" for i in range(p)]])
    last = f"a_{p - 1}_{p - 1}"
    tss = last
    for k in range(p - 1):
        cells = []
        for i in range(p):
            for j in range(i, p):
                d = a(k, k)
                if i == k and j == k:
                    value = f"-1.0 / {d}"
                elif i == k or j == k:
                    value = f"{a(i, j)} / {d}"
                else:
                    value = f"{a(i, j)} - {a(i, k)} * {a(k, j)} / {d}"
                cells.append(f"{value} AS {a(i, j)}")
        total = f"{tss} AS tss" if k == 0 else "tss"
        ctes.append(f"{prefix}_{k + 1} AS (SELECT {keep}, {total}, {', '.join(cells)} FROM {prefix}_{k})")
    k = p - 1
    slopes = ", ".join(f"{a(i, k)} AS b_{i + 1}" for i in range(k))
    inverse = ", ".join(f"-{a(i, j)} AS v_{i + 1}_{j + 1}" for i in range(k) for j in range(i, k))
    level = f"m{k}" + "".join(f" - {a(i, k)} * m{i}" for i in range(k)) if const else "0.0"
    mean_cols = ", ".join(f"m{i} AS mean_{i + 1}" for i in range(k))
    ctes.append(
        f"{prefix} AS (SELECT {key_sql}n, {k} AS k, tss, {a(k, k)} AS ssr, m{k} AS mean_y, {mean_cols}, "
        f"{slopes}, {inverse}, {level} AS b_0 FROM {prefix}_{k})"
    )
    return ",\n".join(ctes)


def const_variance(k: int) -> str:
    """Unscaled variance of the constant: 1/n + x̄' (X'X)⁻¹ x̄."""
    terms = [
        f"mean_{i} * mean_{j} * v_{min(i, j)}_{max(i, j)}" for i in range(1, k + 1) for j in range(1, k + 1)
    ]
    return f"(1.0 / n + {' + '.join(terms)})"


def coefficient_union(names: Sequence[str], prefix: str = "o", const: bool = True, by: Sequence[str] = (), dof: str | None = None) -> str:
    """One row per coefficient with position, variable, coefficient, std_error, t_stat, p_value, ci."""
    k = len(names)
    dof = dof or f"(n - {k + int(const)})"
    keys = "".join(f"{c}, " for c in by)
    parts = []
    if const:
        parts.append(
            f"SELECT {keys}0 AS position, '_cons' AS variable, b_0 AS b, sqrt(ssr / {dof} * {const_variance(k)}) AS s, {dof} AS dof FROM {prefix}"
        )
    for i, name in enumerate(names, 1):
        parts.append(
            f"SELECT {keys}{i if const else i - 1} AS position, '{name}' AS variable, b_{i} AS b, sqrt(ssr / {dof} * v_{i}_{i}) AS s, {dof} AS dof FROM {prefix}"
        )
    union = " UNION ALL ".join(parts)
    return (
        f"SELECT {keys}position, variable, b AS coefficient, s AS std_error, b / s AS t_stat, "
        f"{t_two_sided('b / s', 'dof')} AS p_value, b - {t_crit_95('dof')} * s AS ci_lower, "
        f"b + {t_crit_95('dof')} * s AS ci_upper FROM ({union})"
    )
