"""Regression, diagnostics, model comparison, margins, instrumental variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.descriptive import li
from catalog.sqlgen import Entry, chi2_sf, coefficient_union, const_variance, entry, f_sf, ols_sql, shapiro_sql, t_crit, t_crit_95, t_two_sided, table
from econspark.operators import margins as M, model_compare as MC, plotdata as L
from econspark.operators.iv import InstrumentalVariables
from econspark.operators.ols import Regression, error_metrics, simple_regressions

Y, XS = "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]
X2 = XS[:2]
LINES = f"SELECT {Y}, {', '.join(XS)} FROM lineitem"
COEF = dict(plain=["position", "variable"], sig=["coefficient", "std_error", "t_stat", "ci_lower", "ci_upper"], prob=["p_value"], digits=6, places=6)


def holed(s: SparkSession, d: str) -> DataFrame:
    return li(s, d).select(
        Y, "l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_linenumber").cast("double")).alias("line"),
        F.when(F.col("l_partkey") % 13 == 0, float("nan")).otherwise(F.col("l_tax")).alias("tax"),
    )


HOLED = f"SELECT {Y}, l_quantity, l_linenumber AS line, l_tax AS tax FROM lineitem WHERE l_linenumber <> 3 AND l_partkey % 13 <> 0"


def reg(s: SparkSession, d: str, by=None, xs=XS, **kw) -> Regression:
    return Regression(li(s, d), Y, xs, by, **kw)


def summary_sql(rows: str, y: str, xs, by=()) -> str:
    k = len(xs)
    keys = "".join(f"{c}, " for c in by)
    f = f"((tss - ssr) / {k} / (ssr / (n - {k + 1})))"
    llf = "(-n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1))"
    return (
        f"WITH {ols_sql(rows, y, xs, by=by)} SELECT {keys}n, {k}::BIGINT AS df_model, n - {k + 1} AS df_resid, 1 - ssr / tss AS r2, "
        f"1 - (n - 1.0) / (n - {k + 1}) * (ssr / tss) AS adj_r2, {f} AS f_stat, {f_sf(f, str(k), f'n - {k + 1}')} AS f_p_value, "
        f"-2 * {llf} + 2 * {k + 1} AS aic, -2 * {llf} + {k + 1} * ln(n) AS bic, {llf} AS log_likelihood, ssr, ssr / (n - {k + 1}) AS mse, "
        f"sqrt(ssr / (n - {k + 1})) AS rmse, 'ok' AS status FROM o"
    )


SUMMARY = dict(plain=["n", "df_model", "df_resid", "status"], sig=["aic", "bic", "log_likelihood", "ssr", "mse", "rmse"],
               prob=["r2", "adj_r2", "f_stat", "f_p_value"], digits=7, places=7)


def with_fit(rows: str, y: str, xs, prefix: str = "b") -> tuple[str, str]:
    """(CTEs, SELECT) of the rows with fitted and residual."""
    fitted = "b_0 + " + " + ".join(f"b_{i} * {x}" for i, x in enumerate(xs, 1))
    select = f"SELECT r.*, {fitted} AS fitted, {y} - ({fitted}) AS residual FROM {prefix}_r AS r CROSS JOIN {prefix}"
    return ols_sql(rows, y, xs, prefix=prefix), select


def standard(rows: str, cols, keep: str) -> str:
    """Rows with standardised columns z0, z1, … plus ``keep`` expressions."""
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(cols))
    return f"SELECT {z}, {keep} FROM ({rows})"


def lm_select(name: str, prefix: str, k: int) -> str:
    r2 = "(1 - ssr / tss)"
    f = f"({r2} / {k} / ((1 - {r2}) / (n - {k + 1})))"
    p = chi2_sf(f"n * {r2}", str(k))
    return (
        f"SELECT '{name}' AS test, n, n * {r2} AS lm_stat, {k} AS lm_df, {p} AS lm_p_value, {f} AS f_stat, "
        f"{f_sf(f, str(k), f'n - {k + 1}')} AS f_p_value, {r2} AS r2, {p} < 0.05 AS heteroskedastic FROM {prefix}"
    )


def heteroskedasticity_sql() -> str:
    ctes, fit = with_fit(LINES, Y, XS)
    sq = [f"z{i} * z{j} AS q{i}{j}" for i in range(3) for j in range(i, 3)]
    quad = [f"q{i}{j}" for i in range(3) for j in range(i, 3)]
    base = standard(fit, [*XS, "fitted"], "residual / stddev_pop(residual) OVER () AS e")
    aux = f"SELECT z0, z1, z2, z3, {', '.join(sq)}, e * e AS e2 FROM ({base})"
    z = ["z0", "z1", "z2"]
    parts = [("Breusch-Pagan", "bp", z), ("White", "wh", z + quad), ("Fitted values", "fv", ["z3"])]
    built = ", ".join(ols_sql("SELECT * FROM aux", "e2", xs, prefix=p) for _, p, xs in parts)
    return f"WITH {ctes}, aux AS ({aux}), {built} " + " UNION ALL ".join(lm_select(n, p, len(xs)) for n, p, xs in parts)


def reset_sql() -> str:
    ctes, fit = with_fit(LINES, Y, XS)
    base = standard(fit, [*XS, "fitted"], "residual / stddev_pop(residual) OVER () AS e")
    aux = f"SELECT z0, z1, z2, pow(z3, 2) AS f2, pow(z3, 3) AS f3, e FROM ({base})"
    big = ols_sql("SELECT * FROM aux", "e", ["z0", "z1", "z2", "f2", "f3"], prefix="g")
    f = "((tss - ssr) / 2 / (ssr / (n - 6)))"
    p = f_sf(f, "2", "n - 6")
    return f"WITH {ctes}, aux AS ({aux}), {big} SELECT {f} AS f_stat, 2::BIGINT AS df_num, n - 6 AS df_den, {p} AS p_value, {p} < 0.05 AS misspecified FROM g"


def link_sql(summary: bool) -> str:
    """y on standardised ŷ and its square; coefficients mapped back to ŷ in SQL."""
    ctes, fit = with_fit(LINES, Y, XS)
    aux = (
        f"SELECT {Y} AS y, (fitted - fm) / fs AS f, pow((fitted - fm) / fs, 2) AS f2, fm, fs FROM ({fit}), "
        f"(SELECT avg(fitted) AS fm, stddev_pop(fitted) AS fs FROM ({fit}))"
    )
    link = ols_sql("SELECT y, f, f2 FROM aux", "y", ["f", "f2"], prefix="k")
    head = f"WITH {ctes}, aux AS ({aux}), {link}"
    if summary:
        chi = "(b_2 * b_2 / (ssr / (n - 3) * v_2_2))"
        f = "((tss - ssr) / 2 / (ssr / (n - 3)))"
        return (
            f"{head} SELECT {chi} AS chi2_stat, {chi2_sf(chi, '1')} AS chi2_p_value, 1 - ssr / tss AS r2, 1 - (n - 1.0) / (n - 3) * ssr / tss AS adj_r2, "
            f"{f} AS f_stat, {f_sf(f, '2', 'n - 3')} AS f_p_value FROM k"
        )
    # (X'X)⁻¹ with the constant: c00 = 1/n + x̄'Vx̄, c0i = −(Vx̄)_i
    cov = (
        f"SELECT n, b_0, b_1, b_2, {const_variance(2)} AS c00, -(v_1_1 * mean_1 + v_1_2 * mean_2) AS c01, -(v_1_2 * mean_1 + v_2_2 * mean_2) AS c02, "
        "v_1_1 AS c11, v_1_2 AS c12, v_2_2 AS c22, ssr / (n - 3) AS s2, fm, fs FROM k, (SELECT any_value(fm) AS fm, any_value(fs) AS fs FROM aux)"
    )
    g = "(fm / fs)"
    rows = (
        f"SELECT '_cons' AS variable, b_0 - {g} * b_1 + {g} * {g} * b_2 AS b, s2 * (c00 + {g}*{g}*c11 + pow({g}, 4)*c22 - 2*{g}*c01 + 2*{g}*{g}*c02 - 2*pow({g}, 3)*c12) AS v, n FROM cov "
        f"UNION ALL SELECT 'fitted', b_1 / fs - 2 * {g} / fs * b_2, s2 * (c11 / (fs*fs) + 4*{g}*{g}/(fs*fs)*c22 - 4*{g}/(fs*fs)*c12), n FROM cov "
        f"UNION ALL SELECT 'fitted_squared', b_2 / (fs*fs), s2 * c22 / pow(fs, 4), n FROM cov"
    )
    return (
        f"{head}, cov AS ({cov}) SELECT variable, b AS coefficient, sqrt(v) AS std_error, b / sqrt(v) AS t_stat, "
        f"{t_two_sided('b / sqrt(v)', 'n - 3')} AS p_value FROM ({rows})"
    )


def vif_sql() -> str:
    def part(prefix: str, x: str, i: int) -> str:
        diag = f"(SELECT sum({x} * {x}) FROM lineitem)" if prefix == "u" else f"(SELECT var_pop({x}) * count(*) FROM lineitem)"
        return f"{diag} * v_{i}_{i}"

    rows = " UNION ALL ".join(
        f"SELECT '{x}' AS variable, (SELECT {part('u', x, i)} FROM u) AS vif_uncentered, (SELECT {part('c', x, i)} FROM c) AS vif"
        for i, x in enumerate(XS, 1)
    )
    return f"WITH {ols_sql(LINES, Y, XS, const=False, prefix='u')}, {ols_sql(LINES, Y, XS, prefix='c')} SELECT *, vif_uncentered > 10 AS high FROM ({rows})"


def added_sql(x: str, others, i: int) -> tuple[str, str]:
    """FWL by residual rows: two auxiliary fits, then the built-in regression aggregates."""
    a, b = f"ax{i}", f"ay{i}"
    ctes = f"{ols_sql(LINES, x, others, prefix=a)}, {ols_sql(LINES, Y, others, prefix=b)}"
    joined = (
        f"SELECT {x} - (SELECT b_0 FROM {a}) " + " ".join(f"- (SELECT b_{j} FROM {a}) * {o}" for j, o in enumerate(others, 1)) + " AS ex, "
        f"{Y} - (SELECT b_0 FROM {b}) " + " ".join(f"- (SELECT b_{j} FROM {b}) * {o}" for j, o in enumerate(others, 1)) + " AS ey FROM lineitem"
    )
    r2, n = "regr_r2(ey, ex)", "count(*)"
    f = f"({r2} / ((1 - {r2}) / ({n} - 2)))"
    p = t_two_sided("corr(ex, ey) * sqrt((count(*) - 2) / (1 - pow(corr(ex, ey), 2)))", "count(*) - 2")
    return ctes, (
        f"SELECT '{x}' AS variable, {n} AS n, regr_slope(ey, ex) AS partial_slope, {r2} AS partial_r2, {f} AS partial_f, {p} AS partial_f_p, "
        f"corr(ex, ey) AS partial_r, {p} AS partial_r_p FROM ({joined})"
    )


def added_all_sql(xs) -> str:
    made = [added_sql(x, [o for o in XS if o != x], i) for i, x in enumerate(xs)]
    return f"WITH {', '.join(c for c, _ in made)} " + " UNION ALL ".join(s for _, s in made)


ADDED = dict(plain=["variable", "n"], sig=["partial_slope"], prob=["partial_r2", "partial_f", "partial_f_p", "partial_r", "partial_r_p"], digits=6)


def error_sql() -> str:
    ctes, fit = with_fit(LINES, Y, XS)
    hits = ", ".join(f"100 * avg(CASE WHEN pct <= {p} THEN 1.0 ELSE 0.0 END) AS hit_rate_{p}" for p in (5, 10, 15, 20))
    return (
        f"WITH {ctes} SELECT count(*) AS n, avg(residual * residual) AS mse, sqrt(avg(residual * residual)) AS rmse, avg(abs(residual)) AS mae, avg(pct) AS mape_pct, "
        f"quantile_cont(abs(residual), 0.5) AS median_abs_error, max(abs(residual)) AS max_error, {hits} FROM (SELECT *, 100 * abs(residual) / abs({Y}) AS pct FROM ({fit}))"
    )


SHAPE = (
    "count(*) AS n, avg(residual) AS mean, stddev_samp(residual) AS sd, min(residual) AS min, max(residual) AS max, "
    "avg(pow(residual, 3)) / pow(avg(pow(residual, 2)), 1.5) AS skew_pop, avg(pow(residual, 4)) / pow(avg(pow(residual, 2)), 2) - 3 AS kurt_pop"
)


def zero_part(s: SparkSession, d: str) -> DataFrame:
    """A prediction with zero outcomes, which the relative measures must leave out."""
    return table(s, d, "part").select((F.col("p_size") % 5).cast("double").alias("y"), F.lit(2.0).alias("f"))


SIMPLE_NAMES = ["slope", "intercept", "intercept_se", "slope_se", "intercept_t", "slope_t"]


def simple_sql(x: str) -> str:
    rows = f"SELECT {x}, {Y} FROM lineitem"
    c = ols_sql(rows, Y, [x], prefix=f"s_{x}")
    se0, se1 = f"sqrt(ssr / (n - 2) * {const_variance(1)})", "sqrt(ssr / (n - 2) * v_1_1)"
    f = "((tss - ssr) / (ssr / (n - 2)))"
    return (
        f"(WITH {c} SELECT '{x}' AS variable, n, b_1 AS slope, b_0 AS intercept, 1 - ssr / tss AS r2, 1 - (n - 1.0) / (n - 2) * ssr / tss AS adj_r2, {f} AS f_stat, "
        f"{t_two_sided(f'sqrt({f})', 'n - 2')} AS f_p_value, {se0} AS intercept_se, {se1} AS slope_se, b_0 / {se0} AS intercept_t, b_1 / {se1} AS slope_t, "
        f"{t_two_sided(f'b_0 / {se0}', 'n - 2')} AS intercept_p, {t_two_sided(f'b_1 / {se1}', 'n - 2')} AS slope_p FROM s_{x})"
    )


def ic_sql() -> str:
    """Six candidate fits on standardised columns."""
    base = standard(LINES, X2, f"{Y} AS y")
    aux = f"SELECT y, z0, z1, pow(z0,2) AS a2, pow(z1,2) AS b2, pow(z0,3) AS a3, pow(z1,3) AS b3, z0*z1 AS ab FROM ({base})"
    designs = [
        ("Base Linear", ["z0", "z1"]), ("Polynomial (degree 2)", ["z0", "z1", "a2", "b2"]),
        ("Polynomial (degree 3)", ["z0", "z1", "a2", "b2", "a3", "b3"]), ("With Interactions", ["z0", "z1", "ab"]),
    ]
    llf = "(-n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1))"
    parts, ctes = [], []
    for i, (name, xs) in enumerate(designs):
        k = len(xs)
        f = f"((tss - ssr) / {k} / (ssr / (n - {k + 1})))"
        ctes.append(ols_sql("SELECT * FROM aux", "y", xs, prefix=f"d{i}"))
        parts.append(
            f"SELECT {i} AS position, '{name}' AS model, n, {k + 1}::BIGINT AS params, -2 * {llf} + 2 * {k + 1} AS aic, -2 * {llf} + {k + 1} * ln(n) AS bic, "
            f"1 - ssr / tss AS r2, 1 - (n - 1.0) / (n - {k + 1}) * ssr / tss AS adj_r2, {f} AS f_stat, {f_sf(f, str(k), f'n - {k + 1}')} AS f_p_value, ssr, ssr / (n - {k + 1}) AS mse FROM d{i}"
        )
    return f"WITH aux AS ({aux}), {', '.join(ctes)} " + " UNION ALL ".join(parts)


def scenario_sql() -> str:
    stats = "SELECT " + ", ".join(f"avg({x}) AS a{i}, stddev_samp({x}) AS s{i}" for i, x in enumerate(XS, 1)) + " FROM lineitem"
    base = "(b_0 + b_1 * a1 + b_2 * a2 + b_3 * a3)"
    rows = [f"SELECT 'All Variables at Mean' AS scenario, {base} AS predicted FROM o, st"]
    for i, x in enumerate(XS, 1):
        rows += [f"SELECT '{x} at Mean + 1 SD', {base} + b_{i} * s{i} FROM o, st", f"SELECT '{x} at Mean - 1 SD', {base} - b_{i} * s{i} FROM o, st"]
    rows.append(f"SELECT '{XS[0]} & {XS[1]} High', {base} + b_1 * s1 + b_2 * s2 FROM o, st")
    return f"WITH {ols_sql(LINES, Y, XS)}, st AS ({stats}) " + " UNION ALL ".join(rows)


def curves_sql() -> str:
    parts = []
    base = "(b_0 + b_1 * mean_1 + b_2 * mean_2 + b_3 * mean_3)"
    for i, x in enumerate(XS, 1):
        off = f"(lo + i * (hi - lo) / 49.0 - mean_{i})"
        band = f"({t_crit_95('n - 4')} * sqrt(ssr / (n - 4) * (1.0 / n + {off} * {off} * v_{i}_{i})))"
        fit = f"({base} + b_{i} * {off})"
        parts.append(
            f"SELECT '{x}' AS variable, i::INT AS point, lo + i * (hi - lo) / 49.0 AS x, {fit} AS fitted, {fit} - {band} AS lower, {fit} + {band} AS upper "
            f"FROM o, (SELECT min({x}) AS lo, max({x}) AS hi FROM lineitem), range(0, 50) AS g(i)"
        )
    return f"WITH {ols_sql(LINES, Y, XS)} " + " UNION ALL ".join(parts)


INTERACT = f"SELECT {Y}, l_quantity AS a, l_discount AS b, l_quantity * l_discount AS ab FROM lineitem"


def interaction_curves_sql() -> str:
    x1 = "(lo + i * (hi - lo) / 19.0)"
    levels = " UNION ALL ".join(
        f"SELECT '{name}' AS level, quantile_cont(l_discount, {p}) AS x2 FROM lineitem" for name, p in M.MODERATOR_LEVELS
    )
    return (
        f"WITH {ols_sql(INTERACT, Y, ['a', 'b', 'ab'])} SELECT level, x2, i::INT AS point, {x1} AS x1, b_0 + b_1 * {x1} + b_2 * x2 + b_3 * {x1} * x2 AS fitted "
        f"FROM o, ({levels}), (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), range(0, 20) AS g(i)"
    )


def lines_sql(kind: str) -> str:
    x = "(lo + i * (hi - lo) / 99.0)"
    extra = "1.0 + " if kind == "obs" else ""
    se = f"sqrt(ssr / (n - 2) * ({extra}1.0 / n + pow({x} - mean_1, 2) * v_1_1))"
    fit = f"(b_0 + b_1 * {x})"
    return (
        f"WITH {ols_sql(f'SELECT l_quantity, {Y} FROM lineitem', Y, ['l_quantity'])} SELECT 'l_quantity' AS variable, i::INT AS point, {x} AS x, {fit} AS fitted, "
        + ", ".join(f"{fit} {sign} {t_crit('n - 2', level / 100)} * {se} AS {side}_{level}" for level in (95, 68) for side, sign in (("lower", "-"), ("upper", "+"))) +
        " "
        "FROM o, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), range(0, 100) AS g(i)"
    )


# --- instrumental variables ------------------------------------------------------------------

IV_Y, IV_X, IV_Z, IV_C = Y, "l_quantity", ["l_linenumber", "l_tax"], ["l_discount"]
IV_ROWS = f"SELECT {IV_Y}, {IV_X}, l_linenumber::DOUBLE AS l_linenumber, l_tax, l_discount FROM lineitem"


def iv(s: SparkSession, d: str) -> InstrumentalVariables:
    return InstrumentalVariables(li(s, d), IV_Y, IV_X, IV_Z, IV_C)


def iv_ctes() -> str:
    first = ols_sql(IV_ROWS, IV_X, [*IV_Z, *IV_C], prefix="f")
    xhat = "b_0 + b_1 * l_linenumber + b_2 * l_tax + b_3 * l_discount"
    rows = f"SELECT r.*, {xhat} AS xhat FROM f_r AS r CROSS JOIN f"
    return f"{first}, h AS ({rows}), {ols_sql(f'SELECT {IV_Y}, xhat, l_discount FROM h', IV_Y, ['xhat', 'l_discount'], prefix='k')}"


TRUE_SSR = f"(SELECT sum(pow({IV_Y} - (SELECT b_0 FROM k) - (SELECT b_1 FROM k) * {IV_X} - (SELECT b_2 FROM k) * l_discount, 2)) FROM h)"


def iv_coef_sql() -> str:
    rows = []
    for i, (name, b, v) in enumerate([("_cons", "b_0", const_variance(2)), (IV_X, "b_1", "v_1_1"), ("l_discount", "b_2", "v_2_2")]):
        rows.append(f"SELECT {i} AS position, '{name}' AS variable, {b} AS coefficient, sqrt({TRUE_SSR} / (n - 3) * {v}) AS std_error, sqrt(ssr / (n - 3) * {v}) AS se_naive, n FROM k")
    t, tn = "coefficient / std_error", "coefficient / se_naive"
    return (
        f"WITH {iv_ctes()} SELECT position, variable, coefficient, std_error, {t} AS t_stat, {t_two_sided(t, 'n - 3')} AS p_value, "
        f"coefficient - {t_crit_95('n - 3')} * std_error AS ci_lower, coefficient + {t_crit_95('n - 3')} * std_error AS ci_upper, se_naive, {tn} AS t_naive, "
        f"{t_two_sided(tn, 'n - 3')} AS p_naive FROM ({' UNION ALL '.join(rows)})"
    )


def iv_first_sql() -> str:
    f = "((tss - ssr) / 3 / (ssr / (n - 4)))"
    return f"WITH {iv_ctes()} SELECT n, 1 - ssr / tss AS r2, 1 - (n - 1.0) / (n - 4) * ssr / tss AS adj_r2, {f} AS f_stat, {f_sf(f, '3', 'n - 4')} AS f_p_value FROM f"


def iv_weak_sql() -> str:
    small = ols_sql(f"SELECT {IV_X}, l_discount FROM h", IV_X, ["l_discount"], prefix="w")
    f = "((f.tss - f.ssr) / 3 / (f.ssr / (f.n - 4)))"
    e = "((w.ssr - f.ssr) / 2 / (f.ssr / (f.n - 4)))"
    return (
        f"WITH {iv_ctes()}, {small} SELECT {f} AS f_overall, {f_sf(f, '3', 'f.n - 4')} AS f_overall_p, {e} AS f_excluded, {f_sf(e, '2', 'f.n - 4')} AS f_excluded_p, "
        "2::BIGINT AS df_num, f.n - 4 AS df_den, 1 - f.ssr / f.tss AS r2 FROM f, w"
    )


def iv_overid_sql() -> str:
    def resid(x: str) -> str:
        return f"SELECT {IV_Y} - (SELECT b_0 FROM k) - (SELECT b_1 FROM k) * {x} - (SELECT b_2 FROM k) * l_discount AS u, l_linenumber, l_tax, l_discount FROM h"

    zs = [*IV_Z, *IV_C]
    j, sg = "(j.n * (1 - j.ssr / j.tss))", "(q.n * (1 - q.ssr / q.tss))"
    return (
        f"WITH {iv_ctes()}, {ols_sql(resid('xhat'), 'u', zs, prefix='j')}, {ols_sql(resid(IV_X), 'u', zs, prefix='q')} "
        f"SELECT {j} AS j_stat, {chi2_sf(j, '1')} AS j_p_value, {sg} AS sargan, {chi2_sf(sg, '1')} AS sargan_p_value, 1 AS df FROM j, q"
    )


def iv_endog_sql() -> str:
    plain = ols_sql(f"SELECT {IV_Y}, {IV_X}, l_discount FROM h", IV_Y, [IV_X, "l_discount"], prefix="p")
    gap = "(k.ssr / (k.n - 3) * k.v_1_1 - p.ssr / (p.n - 3) * p.v_1_1)"
    stat = f"(pow(p.b_1 - k.b_1, 2) / {gap})"
    return (
        f"WITH {iv_ctes()}, {plain} SELECT CASE WHEN {gap} > 0 THEN {stat} END AS dwh_stat, CASE WHEN {gap} > 0 THEN {chi2_sf(stat, '1')} END AS dwh_p_value, "
        "p.b_1 AS ols_coefficient, k.b_1 AS iv_coefficient, p.b_1 - k.b_1 AS difference FROM p, k"
    )


IV1_SQL = (
    "SELECT 'l_quantity' AS variable, covar_pop(l_linenumber, l_extendedprice) / covar_pop(l_linenumber, l_quantity) AS coefficient FROM lineitem"
)


def direction_sql() -> str:
    ctes, fit = with_fit(f"SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, {Y}, {', '.join(XS)} FROM lineitem", Y, XS)
    order = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
    return (
        f"WITH {ctes} SELECT count(*) AS changes, 100.0 * avg(CASE WHEN (dy > 0) = (df > 0) THEN 1.0 ELSE 0.0 END) AS direction_accuracy_pct FROM ("
        f"SELECT {Y} - lag({Y}) OVER w AS dy, fitted - lag(fitted) OVER w AS df FROM ({fit}) WINDOW w AS ({order})) WHERE dy IS NOT NULL"
    )


def direction_events_sql() -> str:
    rows = "SELECT event_id, user_id, ts, value, (event_id % 17)::DOUBLE AS x FROM events"
    ctes, fit = with_fit(rows, "value", ["x"])
    return (
        f"WITH {ctes} SELECT count(*) AS changes, 100.0 * avg(CASE WHEN (dy > 0) = (df > 0) THEN 1.0 ELSE 0.0 END) AS direction_accuracy_pct FROM ("
        f"SELECT value - lag(value) OVER w AS dy, fitted - lag(fitted) OVER w AS df FROM ({fit}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dy IS NOT NULL"
    )


def events_x(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("x", (F.col("event_id") % 17).cast("double"))


def near_lines(s: SparkSession, d: str) -> DataFrame:
    """Two regressors that differ in one part of a million, the price in cents."""
    return li(s, d).select((F.col("l_extendedprice") * 100).alias("y"), F.col("l_quantity").alias("a"), (F.col("l_quantity") * 20_000 + F.col("l_linenumber")).cast("double").alias("b"))


#: The same plane through quantity and line number, which are not collinear, in the other coordinates.
NEAR_SQL = f"""WITH {ols_sql("SELECT l_extendedprice * 100 AS y, l_quantity AS q, l_linenumber AS l FROM lineitem", "y", ["q", "l"], prefix="o")}
SELECT '_cons' AS variable, b_0 AS coefficient, FALSE AS omitted FROM o UNION ALL SELECT 'a', b_1 - 20000 * b_2, FALSE FROM o UNION ALL SELECT 'b', b_2, FALSE FROM o"""


def entries() -> list[Entry]:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    first_ctes, first_fit = with_fit(f"SELECT l_orderkey, l_linenumber, l_partkey, {Y}, {', '.join(XS)} FROM lineitem", Y, XS)
    shape_ctes, shape_fit = with_fit(LINES, Y, XS)
    by = ["l_returnflag"]
    by_rows = f"SELECT l_returnflag, {Y}, {', '.join(X2)} FROM lineitem"
    return [
        entry("regress_nearly_collinear", lambda s, d: Regression(near_lines(s, d), "y", ["a", "b"]).coefficients().select("variable", "coefficient", "omitted"), NEAR_SQL,
              plain=["variable", "omitted"], sig=["coefficient"], digits=4),
        entry("regress_coefficients", lambda s, d: reg(s, d).coefficients(), f"WITH {ols_sql(LINES, Y, XS)} {coefficient_union(XS)}", **COEF),
        entry("regress_summary", lambda s, d: reg(s, d).summary(), summary_sql(LINES, Y, XS), **SUMMARY),
        entry(
            "regress_complete_cases", lambda s, d: Regression(holed(s, d), Y, ["l_quantity", "line", "tax"]).coefficients(),
            f"WITH {ols_sql(HOLED, Y, ['l_quantity', 'line', 'tax'])} {coefficient_union(['l_quantity', 'line', 'tax'])}", **COEF,
        ),
        entry(
            "regress_by_returnflag", lambda s, d: reg(s, d, "l_returnflag", X2).coefficients(),
            f"WITH {ols_sql(by_rows, Y, X2, by=by)} {coefficient_union(X2, by=by)}", **(COEF | {"plain": ["l_returnflag", "position", "variable"]}),
        ),
        entry(
            "regress_summary_by_returnflag", lambda s, d: reg(s, d, "l_returnflag", X2).summary(), summary_sql(by_rows, Y, X2, by),
            **(SUMMARY | {"plain": ["l_returnflag", *SUMMARY["plain"]]}),
        ),
        entry(
            "regress_no_constant", lambda s, d: reg(s, d, const=False).coefficients(),
            f"WITH {ols_sql(LINES, Y, XS, const=False)} {coefficient_union(XS, const=False)}", **COEF,
        ),
        entry("regress_vif", lambda s, d: reg(s, d).vif(), vif_sql(), plain=["variable", "high"], sig=["vif_uncentered", "vif"], digits=7),
        entry(
            "regress_heteroskedasticity", lambda s, d: reg(s, d).heteroskedasticity(), heteroskedasticity_sql(),
            plain=["test", "n", "lm_df", "heteroskedastic"], sig=["lm_stat", "f_stat", "r2"], prob=["lm_p_value", "f_p_value"], digits=5,
        ),
        entry("regress_reset", lambda s, d: reg(s, d).reset(), reset_sql(), plain=["df_num", "df_den", "misspecified"], sig=["f_stat"], prob=["p_value"], digits=5),
        entry("linktest_coefficients", lambda s, d: reg(s, d).linktest(), link_sql(False),
              plain=["variable"], sig=["coefficient", "std_error", "t_stat"], prob=["p_value"], digits=4, places=5),
        entry("linktest_summary", lambda s, d: reg(s, d).linktest_summary(), link_sql(True),
              sig=["chi2_stat", "f_stat"], prob=["chi2_p_value", "r2", "adj_r2", "f_p_value"], digits=5),
        entry(
            "regress_residuals", lambda s, d: reg(s, d).residual_summary(), f"WITH {shape_ctes} SELECT {SHAPE} FROM ({shape_fit})",
            plain=["n"], sig=["sd", "min", "max"], prob=["mean", "skew_pop", "kurt_pop"], digits=7, places=5,
        ),
        entry(
            "regress_first_residuals",
            lambda s, d: reg(s, d, keep=order).first_residuals(["l_orderkey", "l_linenumber", "l_partkey"]),
            f"WITH {first_ctes} SELECT l_orderkey, l_linenumber, l_partkey, fitted, residual FROM ({first_fit}) ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 20",
            plain=["l_orderkey", "l_linenumber", "l_partkey"], sig=["fitted", "residual"], digits=7,
        ),
        entry("residual_normality", lambda s, d: reg(s, d).residual_tests(),
              f"WITH {shape_ctes} SELECT *, n / 6.0 * (skew_pop * skew_pop + kurt_pop * kurt_pop / 4) AS jb_stat, "
              f"exp(-n / 12.0 * (skew_pop * skew_pop + kurt_pop * kurt_pop / 4)) AS jb_p_value, "
              f"exp(-n / 12.0 * (skew_pop * skew_pop + kurt_pop * kurt_pop / 4)) > 0.05 AS normal FROM (SELECT {SHAPE} FROM ({shape_fit}))",
              plain=["n", "normal"], sig=["sd", "jb_stat"], prob=["jb_p_value"], digits=6),
        entry(
            "fit_measures", lambda s, d: reg(s, d).fit_measures(),
            f"WITH {ols_sql(LINES, Y, XS)} SELECT n, 1 - ssr / tss AS r2, 1 - (n - 1.0) / (n - 4) * ssr / tss AS adj_r2, 1 - (n - 1.0) / (n - 2) * ssr / tss AS adj_r2_p1, "
            "1 - ssr / tss AS mcfadden_r2, 1 - pow(ssr / tss, 2.0 / n) AS cox_snell_r2, (1 - pow(ssr / tss, 2.0 / n)) / (1 - n / (2 * pi() * exp(1) * tss)) AS nagelkerke_r2, "
            "CASE WHEN 1 - ssr / tss >= 0.9 THEN 'Excellent' WHEN 1 - ssr / tss >= 0.7 THEN 'Good' WHEN 1 - ssr / tss >= 0.5 THEN 'Moderate' ELSE 'Poor' END AS quality FROM o",
            plain=["n", "quality"], prob=["r2", "adj_r2", "adj_r2_p1", "mcfadden_r2", "cox_snell_r2", "nagelkerke_r2"], places=9,
        ),
        entry("error_metrics", lambda s, d: reg(s, d).error_metrics(), error_sql(),
              plain=["n"], sig=["mse", "rmse", "mae", "mape_pct", "median_abs_error", "max_error"], prob=[f"hit_rate_{p}" for p in (5, 10, 15, 20)], digits=7),
        entry(
            "error_metrics_zero_outcome", lambda s, d: error_metrics(zero_part(s, d), "y", "f"),
            "SELECT count(*) AS n, avg(pow(y - 2, 2)) AS mse, avg(abs(y - 2)) AS mae, 100 * avg(abs(y - 2) / nullif(y, 0)) AS mape_pct, quantile_cont(abs(y - 2), 0.5) AS median_abs_error, "
            "100 * avg(CASE WHEN y <> 0 THEN (CASE WHEN abs(y - 2) / y <= 0.2 THEN 1.0 ELSE 0.0 END) END) AS hit_rate_20 FROM (SELECT (p_size % 5)::DOUBLE AS y FROM part)",
            plain=["n"], sig=["mse", "mae", "mape_pct", "median_abs_error", "hit_rate_20"], digits=8,
        ),
        entry("direction_accuracy", lambda s, d: reg(s, d, keep=order).direction_accuracy(order), direction_sql(), plain=["changes"], prob=["direction_accuracy_pct"]),
        entry(
            "direction_accuracy_by_user",
            lambda s, d: Regression(events_x(s, d), "value", "x", keep=["user_id", "ts", "event_id"]).direction_accuracy(["ts", "event_id"], "user_id"),
            direction_events_sql(), plain=["changes"], prob=["direction_accuracy_pct"],
        ),
        entry("shapiro_wilk_residuals", lambda s, d: _shapiro(s, d), _shapiro_residuals_sql(), plain=["n", "normal"], sig=["w_stat"], prob=["p_value"], digits=6, places=5),
        entry("simple_regressions", lambda s, d: simple_regressions(li(s, d), Y, ["l_quantity", "l_tax"]), " UNION ALL ".join(simple_sql(x) for x in ("l_quantity", "l_tax")),
              plain=["variable", "n"], sig=SIMPLE_NAMES, prob=["r2", "adj_r2", "f_stat", "f_p_value", "intercept_p", "slope_p"], digits=6),
        entry("added_variables", lambda s, d: reg(s, d).added_variables(), added_all_sql(XS), **ADDED),
        entry("added_variable_one", lambda s, d: L.added_variable(li(s, d), Y, "l_quantity", ["l_discount", "l_tax"]), added_all_sql(["l_quantity"]), **ADDED),
        entry("information_criteria", lambda s, d: MC.information_criteria(li(s, d), Y, X2), ic_sql(),
              plain=["position", "model", "n", "params"], sig=["aic", "bic", "ssr", "mse"], prob=["r2", "adj_r2", "f_stat", "f_p_value"], digits=8),
        entry(
            "information_changes", lambda s, d: MC.criteria_changes(MC.information_criteria(li(s, d), Y, X2)),
            f"SELECT model, aic - base_aic AS delta_aic, CASE WHEN aic < base_aic THEN 'Better' ELSE 'Worse' END AS aic_verdict, bic - base_bic AS delta_bic, "
            f"CASE WHEN bic < base_bic THEN 'Better' ELSE 'Worse' END AS bic_verdict FROM (SELECT *, max(CASE WHEN position = 0 THEN aic END) OVER () AS base_aic, "
            f"max(CASE WHEN position = 0 THEN bic END) OVER () AS base_bic FROM ({ic_sql()})) WHERE position > 0",
            plain=["model", "aic_verdict", "bic_verdict"], prob=["delta_aic", "delta_bic"], places=4,
        ),
        entry(
            "information_best", lambda s, d: MC.best_models(MC.information_criteria(li(s, d), Y, X2)),
            f"WITH t AS MATERIALIZED ({ic_sql()}) SELECT 'AIC' AS criterion, arg_min(model, aic) AS model, min(aic) AS value FROM t UNION ALL "
            "SELECT 'BIC', arg_min(model, bic), min(bic) FROM t UNION ALL SELECT 'R2', arg_max(model, r2), max(r2) FROM t",
            plain=["criterion", "model"], prob=["value"], places=3,
        ),
        entry("marginal_effects", lambda s, d: reg(s, d).marginal_effects(), f"WITH {ols_sql(LINES, Y, XS)} SELECT * FROM ({coefficient_union(XS)}) WHERE variable <> '_cons'",
              plain=["variable"], sig=["coefficient", "std_error", "t_stat"], prob=["p_value"], digits=6),
        entry("predicted_scenarios", lambda s, d: reg(s, d).predicted_scenarios(), scenario_sql(), plain=["scenario"], sig=["predicted"]),
        entry("marginal_curves", lambda s, d: M.marginal_curves(li(s, d), Y, XS), curves_sql(), plain=["variable", "point"], sig=["x", "fitted", "lower", "upper"], digits=8),
        entry(
            "interaction_model", lambda s, d: M.interaction_model(li(s, d), Y, "l_quantity", "l_discount"),
            f"WITH {ols_sql(INTERACT, Y, ['a', 'b', 'ab'])} {coefficient_union(['l_quantity', 'l_discount', 'l_quantity x l_discount'])}", **COEF,
        ),
        entry("interaction_curves", lambda s, d: M.interaction_curves(li(s, d), Y, "l_quantity", "l_discount"), interaction_curves_sql(),
              plain=["level", "point"], sig=["x2", "x1", "fitted"], digits=8),
        entry("fitted_line_mean", lambda s, d: M.fitted_lines(li(s, d), Y, "l_quantity"), lines_sql("mean"),
              plain=["variable", "point"], sig=["x", "fitted", "lower_95", "upper_95", "lower_68", "upper_68"], digits=6),
        entry("fitted_line_prediction", lambda s, d: M.fitted_lines(li(s, d), Y, "l_quantity", kind="obs"), lines_sql("obs"),
              plain=["variable", "point"], sig=["x", "fitted", "lower_95", "upper_95", "lower_68", "upper_68"], digits=6),
        entry("iv_first_stage", lambda s, d: iv(s, d).first_stage(), iv_first_sql(), plain=["n"], prob=["r2", "adj_r2", "f_stat", "f_p_value"]),
        entry("iv_coefficients", lambda s, d: iv(s, d).coefficients(), iv_coef_sql(), plain=["position", "variable"],
              sig=["coefficient", "std_error", "t_stat", "ci_lower", "ci_upper", "se_naive", "t_naive"], prob=["p_value", "p_naive"], digits=5, places=5),
        entry(
            "iv_summary", lambda s, d: iv(s, d).summary(),
            f"WITH {iv_ctes()} SELECT n, 1 - ssr / tss AS r2_second_stage, 1 - (n - 1.0) / (n - 3) * ssr / tss AS adj_r2_second_stage, 1 - {TRUE_SSR} / tss AS r2, sqrt({TRUE_SSR} / (n - 3)) AS rmse FROM k",
            plain=["n"], sig=["rmse"], prob=["r2_second_stage", "adj_r2_second_stage", "r2"], digits=7,
        ),
        entry("iv_weak_instruments", lambda s, d: iv(s, d).weak_instruments(), iv_weak_sql(), plain=["df_num", "df_den"],
              prob=["f_overall", "f_overall_p", "f_excluded", "f_excluded_p", "r2"]),
        entry("iv_overidentification", lambda s, d: iv(s, d).overidentification(), iv_overid_sql(), plain=["df"], prob=["j_stat", "j_p_value", "sargan", "sargan_p_value"], places=5),
        entry("iv_endogeneity", lambda s, d: iv(s, d).endogeneity(), iv_endog_sql(), sig=["ols_coefficient", "iv_coefficient", "difference"], prob=["dwh_stat", "dwh_p_value"], digits=5, places=5),
        entry(
            "iv_single_instrument",
            lambda s, d: InstrumentalVariables(li(s, d), Y, "l_quantity", "l_linenumber").coefficients().filter("variable = 'l_quantity'"),
            IV1_SQL, plain=["variable"], sig=["coefficient"], digits=6,
        ),
        entry("iv_coefficients_by_flag", lambda s, d: InstrumentalVariables(li(s, d), IV_Y, IV_X, IV_Z, IV_C, by=FLAG).coefficients(), per_flag(iv_coef_sql()), plain=[FLAG, "position", "variable"],
              sig=["coefficient", "std_error", "t_stat"], prob=["p_value"], digits=4, places=4),
        entry("regress_vif_by_flag", lambda s, d: reg(s, d, FLAG).vif(), per_flag(vif_sql()), plain=[FLAG, "variable", "high"], sig=["vif_uncentered", "vif"], digits=6),
        entry("regress_heteroskedasticity_by_flag", lambda s, d: reg(s, d, FLAG).heteroskedasticity(), per_flag(heteroskedasticity_sql()),
              plain=[FLAG, "test", "n", "lm_df", "heteroskedastic"], sig=["lm_stat", "f_stat", "r2"], prob=["lm_p_value", "f_p_value"], digits=5),
        entry("regress_reset_by_flag", lambda s, d: reg(s, d, FLAG).reset(), per_flag(reset_sql()), plain=[FLAG, "df_num", "df_den", "misspecified"], sig=["f_stat"], prob=["p_value"], digits=5),
        entry("linktest_by_flag", lambda s, d: reg(s, d, FLAG).linktest(), per_flag(link_sql(False)),
              plain=[FLAG, "variable"], sig=["coefficient", "std_error", "t_stat"], prob=["p_value"], digits=4, places=5),
        entry("regress_minimum_rows", lambda s, d: Regression(table(s, d, "orders"), "o_totalprice", "o_orderkey", by="o_orderdate").summary().withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")),
              "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, CASE WHEN count(*) < 10 THEN 'insufficient' ELSE 'ok' END AS status FROM orders GROUP BY 1", plain=["day", "n", "status"]),
    ]


def _shapiro(s: SparkSession, d: str) -> DataFrame:
    from econspark.operators.normality import shapiro_wilk

    return shapiro_wilk(reg(s, d).predictions, "residual")


def _shapiro_residuals_sql() -> str:
    ctes, fit = with_fit(LINES, Y, XS)
    return shapiro_sql(f"WITH {ctes} {fit}", "residual")


FLAG = "l_returnflag"


def per_flag(sql: str) -> str:
    """The same SQL for the lines of each flag."""
    return " UNION ALL ".join(f"SELECT '{f}' AS {FLAG}, * FROM ({sql.replace('lineitem', one)})" for f in ("A", "N", "R") for one in [f"(SELECT * FROM lineitem WHERE {FLAG} = '{f}')"])
