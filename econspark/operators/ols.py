"""Linear regression and everything that hangs on it.

One pass over the data gives the moments of (y, x…). Coefficients, fit, VIF, marginal effects and
partial regressions are algebra on them. Specification tests need one more pass, over the residuals
and powers of the fitted values, and share it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from econspark.functions.dist import chi2_sf, f_sf, f_sf_col, t_two_sided, t_two_sided_col
from econspark.operators.normality import jarque_bera, shapiro_wilk
from econspark.plans.moments import Moments, MomentSource, collect_factor
from econspark.plans.ranks import moments_and_quantiles, quantiles, successive_changes
from econspark.plans.solver import COEFFICIENT_SCHEMA, Fit, nearly_collinear, ols, solve_cross
from econspark.schema import as_list, complete_cases, drop_missing, number

# Fixed limits of the reports.
MIN_ROWS = 10
VIF_HIGH = 10.0
GOOD_FIT = ((0.9, "Excellent"), (0.7, "Good"), (0.5, "Moderate"))
HIT_PERCENTS = (5, 10, 15, 20)
SUMMARY_SCHEMA = (
    "n long, df_model long, df_resid long, r2 double, adj_r2 double, f_stat double, f_p_value double, "
    "aic double, bic double, log_likelihood double, ssr double, mse double, rmse double, status string"
)


class FactoredSource(MomentSource):
    """Moments of a regression. Where its regressors are nearly collinear, one more pass takes the factor of the columns, so that
    estimates keep their digits and a regressor is left out only if nothing of it remains."""

    regressors: list[str]

    @cached_property
    def moments(self):
        m = MomentSource.moments.func(self)
        if m.n > len(self.cols) and nearly_collinear(m, self.regressors):
            m = replace(m, factor=collect_factor(self.df, m))
        return m


class Regression:
    """y on xs over the complete cases of ``df``, for the whole table or per group of ``by``."""

    def __init__(self, df: DataFrame, y: str, xs, by=None, const: bool = True, min_rows: int = MIN_ROWS, keep=None):
        self.y, self.xs, self.by = y, as_list(xs), as_list(by)
        if not self.xs:
            raise ValueError("at least one regressor is needed")
        if y in self.xs:
            raise ValueError("the outcome cannot be its own regressor")
        self.const, self.min_rows = const, min_rows
        self.keep = as_list(keep)
        self.rows = complete_cases(df, [y, *self.xs], self.by, self.keep)
        self.source = FactoredSource(self.rows, [y, *self.xs], self.by)
        self.source.regressors = self.xs

    # --- fits --------------------------------------------------------------------------------

    def fit_of(self, m: Moments) -> Fit | None:
        if m.n < max(self.min_rows, 1):
            return None
        return ols(m, self.y, self.xs, self.const)

    @cached_property
    def fit(self) -> Fit:
        """The ungrouped fit."""
        out = self.fit_of(self.source.moments)
        if out is None:
            raise ValueError(f"only {self.source.moments.n} complete rows, {self.min_rows} are needed")
        return out

    def _solve(self, rows_of_fit, schema: str) -> DataFrame:
        fit_of = _fit_function(self.y, self.xs, self.const, self.min_rows)

        def rows(m: Moments) -> list[dict]:
            fit = fit_of(m)
            return [] if fit is None else rows_of_fit(fit, m)

        return self.source.solve(rows, schema)

    # --- tables from the moments alone ---------------------------------------------------------

    def coefficients(self, level: float = 0.95) -> DataFrame:
        return self._solve(lambda fit, m: fit.coefficient_rows(level), COEFFICIENT_SCHEMA)

    def summary(self) -> DataFrame:
        fit_of = _fit_function(self.y, self.xs, self.const, self.min_rows)

        def rows(m: Moments) -> list[dict]:
            fit = fit_of(m)
            return [{"n": m.n, "status": "insufficient"} if fit is None else summary_row(fit)]

        return self.source.solve(rows, SUMMARY_SCHEMA)

    def vif(self) -> DataFrame:
        """Variance inflation: ``vif_uncentered`` (auxiliary fits without constant) and ``vif``."""
        xs = self.xs

        def rows(fit: Fit, m: Moments) -> list[dict]:
            raw, centred = _vif(m.raw, m.at(xs)), _vif(m.comoment, m.at(xs))
            return [
                {"variable": x, "vif_uncentered": a, "vif": b, "high": bool(a > VIF_HIGH)}
                for x, a, b in zip(xs, raw, centred)
            ]

        return self._solve(rows, "variable string, vif_uncentered double, vif double, high boolean")

    def added_variables(self) -> DataFrame:
        """For each x: slope, R², F, p and r of y on x with the other regressors partialled out."""
        y, xs = self.y, self.xs

        def rows(fit: Fit, m: Moments) -> list[dict]:
            return [added_variable_row(m, y, x, [o for o in xs if o != x]) for x in xs]

        return self._solve(
            rows,
            "variable string, n long, partial_slope double, partial_intercept double, partial_r2 double, "
            "partial_f double, partial_f_p double, partial_r double, partial_r_p double",
        )

    def marginal_effects(self) -> DataFrame:
        return self.coefficients().filter(F.col("variable") != "_cons").select(
            *[F.col(f"`{k}`") for k in self.by], "variable", "coefficient", "std_error", "t_stat", "p_value"
        )

    def predicted_scenarios(self) -> DataFrame:
        """ŷ with all x at the mean, each x one sd above and below, and the first two both high."""
        xs = self.xs

        def rows(fit: Fit, m: Moments) -> list[dict]:
            at = fit.x_mean
            sd = np.array([m.sd(x) for x in xs])
            base = fit.const + fit.beta @ at
            out = [{"scenario": "All Variables at Mean", "predicted": base}]
            for j, x in enumerate(xs):
                step = fit.beta[j] * sd[j]
                out.append({"scenario": f"{x} at Mean + 1 SD", "predicted": base + step})
                out.append({"scenario": f"{x} at Mean - 1 SD", "predicted": base - step})
            if len(xs) > 1:
                both = fit.beta[:2] @ sd[:2]
                out.append({"scenario": f"{xs[0]} & {xs[1]} High", "predicted": base + both})
            return out

        return self._solve(rows, "scenario string, predicted double")

    # --- row-level output ----------------------------------------------------------------------

    def coefficient_arrays(self) -> DataFrame:
        """Per group: slopes, constant, means and sds of x, mean and sd of ŷ."""
        xs = self.xs
        return self._solve(lambda fit, m: [_array_row(fit, m, xs)], _ARRAY_SCHEMA)

    @cached_property
    def predictions(self) -> DataFrame:
        """The complete cases with ``fitted`` and ``residual``."""
        return self._with_fit().drop("_fit")

    def _with_fit(self) -> DataFrame:
        """Rows with the fit's numbers in the struct ``_fit``: literals, or joined per group."""
        if self.by:
            arrays = self.coefficient_arrays()
            names = [n for n in arrays.columns if n not in self.by]
            packed = arrays.select(*[F.col(f"`{k}`") for k in self.by], F.struct(*names).alias("_fit"))
            rows = self.rows.join(packed, self.by)
        else:
            row = _array_row(self.fit, self.source.moments, self.xs)
            parts = [
                (F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, list) else F.lit(float(v))).alias(k)
                for k, v in row.items()
            ]
            rows = self.rows.withColumn("_fit", F.struct(*parts))
        fitted = F.col("_fit.const")
        for j, x in enumerate(self.xs):
            fitted = fitted + F.col("_fit.beta")[j] * F.col(f"`{x}`")
        rows = rows.withColumn("fitted", fitted)
        return rows.withColumn("residual", F.col(f"`{self.y}`") - F.col("fitted"))

    def first_residuals(self, order_by, k: int = 20) -> DataFrame:
        """Fitted values and residuals of the first ``k`` rows; ``order_by`` must be in ``keep``."""
        order_by = as_list(order_by)
        kept = [F.col(f"`{c}`") for c in order_by]
        return self.predictions.orderBy(*kept).limit(k).select(*kept, "fitted", "residual")

    def residual_summary(self) -> DataFrame:
        r = F.col("residual")
        return self.predictions.groupBy(*[F.col(f"`{k}`") for k in self.by]).agg(
            F.count(r).alias("n"),
            F.avg(r).alias("mean"),
            F.stddev_samp(r).alias("sd"),
            F.min(r).alias("min"),
            F.max(r).alias("max"),
            F.skewness(r).alias("skew_pop"),
            F.kurtosis(r).alias("kurt_pop"),
        )

    # --- second pass: residuals, squares and products of x, powers of ŷ --------------------------

    @cached_property
    def auxiliary(self) -> MomentSource:
        """Moments of standardised x, their squares and products, powers of standardised ŷ, e and e².

        The auxiliary regressions only use spans that contain the constant, so standardising
        changes none of their test statistics and keeps the matrices well conditioned.
        """
        rows = self._with_fit()
        z = {x: (F.col(f"`{x}`") - F.col("_fit.x_mean")[j]) / F.col("_fit.x_scale")[j] for j, x in enumerate(self.xs)}
        k = len(self.xs)
        cols = {f"_z{i}": z[x] for i, x in enumerate(self.xs)}
        for i in range(k):
            for j in range(i, k):
                cols[f"_z{i}_{j}"] = z[self.xs[i]] * z[self.xs[j]]
        f = (F.col("fitted") - F.col("_fit.fitted_mean")) / F.col("_fit.fitted_scale")
        e = F.col("residual") / F.col("_fit.sigma")
        cols |= {"_f": f, "_f2": f * f, "_f3": f * f * f, "_e": e, "_e2": e * e}
        keys = [F.col(f"`{c}`") for c in self.by]
        return MomentSource(rows.select(*keys, *[c.alias(a) for a, c in cols.items()]), list(cols), self.by, centred=True)

    def _names(self) -> tuple[list[str], list[str]]:
        k = len(self.xs)
        return [f"_z{i}" for i in range(k)], [f"_z{i}_{j}" for i in range(k) for j in range(i, k)]

    def heteroskedasticity(self, alpha: float = 0.05) -> DataFrame:
        """Breusch–Pagan (e² on x), White (e² on x, squares, products) and e² on ŷ."""
        lin, quad = self._names()

        def rows(m: Moments) -> list[dict]:
            designs = {"Breusch-Pagan": lin, "White": lin + quad, "Fitted values": ["_f"]}
            return [lm_row(name, ols(m, "_e2", xs), alpha) for name, xs in designs.items()]

        return self.auxiliary.solve(
            rows,
            "test string, n long, lm_stat double, lm_df int, lm_p_value double, f_stat double, f_p_value double, "
            "r2 double, heteroskedastic boolean",
        )

    def reset(self, alpha: float = 0.05) -> DataFrame:
        """Ramsey RESET with ŷ² and ŷ³."""
        lin, _ = self._names()

        def rows(m: Moments) -> list[dict]:
            # the residual of the base model stands in for y: same gain, no cancellation
            small, big = ols(m, "_e", lin), ols(m, "_e", [*lin, "_f2", "_f3"])
            num = big.rank - small.rank
            out = {"df_num": num, "df_den": big.df_resid}
            if num > 0 and big.df_resid > 0 and big.ssr > 0:
                stat = (small.ssr - big.ssr) / num / (big.ssr / big.df_resid)
                p = f_sf(stat, num, big.df_resid)
                out |= {"f_stat": stat, "p_value": p, "misspecified": bool(p < alpha)}
            return [out]

        return self.auxiliary.solve(
            rows, "f_stat double, df_num long, df_den long, p_value double, misspecified boolean"
        )

    @cached_property
    def _link_source(self) -> MomentSource:
        rows = self._with_fit()
        f = (F.col("fitted") - F.col("_fit.fitted_mean")) / F.col("_fit.fitted_scale")
        keys = [F.col(f"`{c}`") for c in self.by]
        scale = [F.col("_fit.fitted_mean").alias("_fm"), F.col("_fit.fitted_scale").alias("_fs")]
        cols = rows.select(*keys, F.col(f"`{self.y}`").alias("_y"), f.alias("_f"), (f * f).alias("_f2"), *scale)
        return MomentSource(cols, ["_y", "_f", "_f2", "_fm", "_fs"], self.by)

    def linktest(self) -> DataFrame:
        """y on ŷ and ŷ²: coefficients with t and p."""
        return self._link_source.solve(
            _link_coefficients, "variable string, coefficient double, std_error double, t_stat double, p_value double"
        )

    def linktest_summary(self) -> DataFrame:
        def rows(m: Moments) -> list[dict]:
            fit = ols(m, "_y", ["_f", "_f2"])
            t = fit.beta[1] / fit.se()[2] if fit.se()[2] > 0 else math.nan
            return [
                {
                    "chi2_stat": t * t, "chi2_p_value": chi2_sf(t * t, 1), "r2": fit.r2, "adj_r2": fit.adj_r2,
                    "f_stat": fit.f, "f_p_value": fit.f_p,
                }
            ]

        return self._link_source.solve(
            rows, "chi2_stat double, chi2_p_value double, r2 double, adj_r2 double, f_stat double, f_p_value double"
        )

    # --- goodness of fit -------------------------------------------------------------------------

    def fit_measures(self) -> DataFrame:
        """R² family. ``adj_r2_p1`` counts one parameter whatever the model."""

        def rows(fit: Fit, m: Moments) -> list[dict]:
            n, r2 = m.n, fit.r2
            cox = 1 - (1 - r2) ** (2 / n)
            # the largest value a Gaussian likelihood ratio can reach: 1 − L0^(2/n)
            top = 1 - n / (2 * math.pi * math.e * fit.tss) if fit.tss > 0 else math.nan
            return [
                {
                    "n": n, "r2": r2, "adj_r2": fit.adj_r2, "adj_r2_p1": 1 - (1 - r2) * (n - 1) / (n - 2),
                    "mcfadden_r2": r2, "cox_snell_r2": cox, "nagelkerke_r2": cox / top if top > 0 else math.nan,
                    "quality": fit_quality(r2),
                }
            ]

        return self._solve(
            rows,
            "n long, r2 double, adj_r2 double, adj_r2_p1 double, mcfadden_r2 double, cox_snell_r2 double, "
            "nagelkerke_r2 double, quality string",
        )

    def error_metrics(self) -> DataFrame:
        """MSE, RMSE, MAE, MAPE %, median and maximum absolute error, hit rates, residual shape."""
        return error_metrics(self.predictions, self.y, "fitted", self.by)

    def residual_tests(self, alpha: float = 0.05) -> DataFrame:
        """Residual moments with Jarque–Bera statistic, p and verdict."""
        return jarque_bera(self.residual_summary(), alpha)

    def direction_accuracy(self, order_by, partition_by=None) -> DataFrame:
        """Share of successive changes whose sign ŷ gets right; ``order_by`` must be in ``keep``."""
        if self.by:
            raise ValueError("give the groups as partition_by")
        return direction_accuracy(self.predictions, self.y, "fitted", order_by, partition_by)


_ARRAY_SCHEMA = (
    "beta array<double>, const double, x_mean array<double>, x_scale array<double>, "
    "fitted_mean double, fitted_scale double, sigma double"
)


def _fit_function(y: str, xs: Sequence[str], const: bool, min_rows: int):
    """A fit closure free of DataFrames, so that it can travel to the tasks."""
    xs = list(xs)

    def fit_of(m: Moments) -> Fit | None:
        return None if m.n < max(min_rows, 1) else ols(m, y, xs, const)

    return fit_of


def _array_row(fit: Fit, m: Moments, xs: Sequence[str]) -> dict:
    def positive(v: float) -> float:
        return float(v) if v and v > 0 and math.isfinite(v) else 1.0

    at = m.at(xs)
    spread = float(np.sqrt(max(fit.beta @ m.comoment[np.ix_(at, at)] @ fit.beta, 0.0) / m.n))
    return {
        "beta": [float(b) for b in fit.beta],
        "const": float(fit.const),
        "x_mean": [float(v) for v in fit.x_mean],
        "x_scale": [positive(m.sd(x)) for x in xs],
        "fitted_mean": float(fit.const + fit.beta @ fit.x_mean),
        "fitted_scale": positive(spread),
        "sigma": positive(math.sqrt(fit.ssr / m.n)),
    }


def summary_row(fit: Fit) -> dict:
    return {
        "n": fit.n, "df_model": fit.rank, "df_resid": fit.df_resid, "r2": fit.r2, "adj_r2": fit.adj_r2,
        "f_stat": fit.f if math.isfinite(fit.f) else math.nan, "f_p_value": fit.f_p, "aic": fit.aic, "bic": fit.bic,
        "log_likelihood": fit.log_likelihood, "ssr": fit.ssr, "mse": fit.mse,
        "rmse": math.sqrt(fit.mse) if fit.mse >= 0 else math.nan, "status": "ok",
    }


def _vif(cross: np.ndarray, at: list[int]) -> list[float]:
    block = cross[np.ix_(at, at)]
    _, inverse, omitted = solve_cross(block, np.zeros(len(at)))
    if any(omitted):  # an exact combination has no finite inflation
        dependent = [_depends(block, j) for j in range(len(at))]
        return [math.inf if d else block[j, j] * inverse[j, j] for j, d in enumerate(dependent)]
    return [block[j, j] * inverse[j, j] for j in range(len(at))]


def _depends(block: np.ndarray, j: int) -> bool:
    """Is column j an exact combination of the others?"""
    rest = [i for i in range(len(block)) if i != j]
    order = [*rest, j]
    _, _, omitted = solve_cross(block[np.ix_(order, order)], np.zeros(len(order)))
    return omitted[-1]


def lm_row(name: str, fit: Fit, alpha: float) -> dict:
    lm = fit.n * fit.r2
    p = chi2_sf(lm, fit.rank)
    return {
        "test": name, "n": fit.n, "lm_stat": lm, "lm_df": fit.rank, "lm_p_value": p, "f_stat": fit.f,
        "f_p_value": fit.f_p, "r2": fit.r2, "heteroskedastic": bool(p < alpha),
    }


def _link_coefficients(m: Moments) -> list[dict]:
    """Solve on standardised ŷ, then map the polynomial back to ŷ itself."""
    fit = ols(m, "_y", ["_f", "_f2"])
    centre, scale = (float(m.mean[i]) for i in m.at(["_fm", "_fs"]))
    back = np.array(
        [
            [1, -centre / scale, centre**2 / scale**2],
            [0, 1 / scale, -2 * centre / scale**2],
            [0, 0, 1 / scale**2],
        ]
    )
    params = back @ fit.params
    se = np.sqrt(np.maximum(np.diag(back @ fit.cov @ back.T), 0))
    rows = []
    for name, b, s in zip(["_cons", "fitted", "fitted_squared"], params, se):
        t = b / s if s > 0 else math.nan
        rows.append(
            {"variable": name, "coefficient": b, "std_error": s, "t_stat": t, "p_value": t_two_sided(t, fit.df_resid)}
        )
    return rows


def added_variable_row(m: Moments, y: str, x: str, others: Sequence[str]) -> dict:
    """Regression of the y-residual on the x-residual, both net of the other regressors."""
    pair, ctrl = m.at([x, y]), m.at(others)
    block = m.comoment[np.ix_(pair, pair)].copy()
    if ctrl:
        cross = m.comoment[np.ix_(ctrl, pair)]
        _, inverse, _ = solve_cross(m.comoment[np.ix_(ctrl, ctrl)], np.zeros(len(ctrl)))
        block -= cross.T @ inverse @ cross
    row = {"variable": x, "n": m.n, "partial_intercept": 0.0}
    if block[0, 0] <= 1e-9 * m.comoment[pair[0], pair[0]]:
        return row
    resid = Moments((x, y), m.n, np.zeros(2), block)
    fit = ols(resid, y, [x])
    r = math.copysign(math.sqrt(max(fit.r2, 0.0)), fit.beta[0]) if fit.tss > 0 else math.nan
    t = r * math.sqrt((m.n - 2) / (1 - r * r)) if abs(r) < 1 else math.inf
    return row | {
        "partial_slope": fit.beta[0], "partial_r2": fit.r2, "partial_f": fit.f if math.isfinite(fit.f) else math.nan,
        "partial_f_p": fit.f_p, "partial_r": r, "partial_r_p": t_two_sided(t, m.n - 2),
    }


def fit_quality(r2: float) -> str:
    return next((label for limit, label in GOOD_FIT if r2 >= limit), "Poor")


def error_metrics(df: DataFrame, y: str, fitted: str, by=None) -> DataFrame:
    """Error measures of a prediction column; rows with y = 0 stay out of the relative ones."""
    by = as_list(by)
    keys = [F.col(f"`{k}`") for k in by]
    rows = df.select(*keys, F.col(f"`{y}`").cast("double").alias("_y"), F.col(f"`{fitted}`").cast("double").alias("_f"))
    rows = rows.filter(F.col("_y").isNotNull() & F.col("_f").isNotNull())
    rows = rows.withColumn("abs_error", F.abs(F.col("_y") - F.col("_f")))
    rows = rows.withColumn("pct", F.when(F.col("_y") != 0, 100 * F.col("abs_error") / F.abs("_y")))
    hits = [
        (100 * F.avg(F.when(F.col("pct").isNotNull(), (F.col("pct") <= p).cast("int")))).alias(f"hit_rate_{p}")
        for p in HIT_PERCENTS
    ]
    figures = [
        F.count("*").alias("n"),
        F.avg(F.col("abs_error") * F.col("abs_error")).alias("mse"),
        F.sqrt(F.avg(F.col("abs_error") * F.col("abs_error"))).alias("rmse"),
        F.avg("abs_error").alias("mae"),
        F.avg("pct").alias("mape_pct"),
        F.max("abs_error").alias("max_error"),
        *hits,
    ]
    if not by and (found := moments_and_quantiles(rows, ["abs_error"], [0.5], figures)) is not None:
        row, table = found
        names = rows.agg(*figures).schema
        main = df.sparkSession.createDataFrame([tuple(row[f.name] for f in names)], names)
        return main.withColumn("median_abs_error", table.select(F.col("q")[0]).scalar())
    main = rows.groupBy(*keys).agg(*figures)
    middle = quantiles(rows, "abs_error", [0.5], by).select(*keys, F.col("q")[0].alias("median_abs_error"))
    if by:
        return main.join(middle, by)
    return main.withColumn("median_abs_error", middle.select("median_abs_error").scalar())


def direction_accuracy(df: DataFrame, y: str, fitted: str, order_by, partition_by=None) -> DataFrame:
    """Share (%) of row-to-row changes in which y and ŷ agree on 'up' or 'not up'."""
    changes = successive_changes(df, [y, fitted], order_by, partition_by)
    agree = (F.col(f"`{y}`") > 0) == (F.col(f"`{fitted}`") > 0)
    return changes.agg(
        F.count("*").alias("changes"), (100 * F.avg(agree.cast("int"))).alias("direction_accuracy_pct")
    )


def simple_regressions(df: DataFrame, y: str, xs, by=None) -> DataFrame:
    """y on each single x, on the rows complete for that pair, from the built-in ``regr_`` aggregates."""
    by, xs = as_list(by), as_list(xs)
    keys = [F.col(f"`{k}`") for k in by]
    yv = number(df, y)

    def stats(x: str) -> Column:
        xv = number(df, x)
        return F.struct(
            F.lit(x).alias("variable"),
            F.regr_count(yv, xv).alias("n"),
            F.regr_slope(yv, xv).alias("slope"),
            F.regr_intercept(yv, xv).alias("intercept"),
            F.regr_sxx(yv, xv).alias("sxx"),
            F.regr_syy(yv, xv).alias("syy"),
            F.regr_sxy(yv, xv).alias("sxy"),
            F.regr_avgx(yv, xv).alias("avgx"),
        )

    base = (
        drop_missing(df, by).groupBy(*keys).agg(F.array(*[stats(x) for x in xs]).alias("_rows"))
        .select(*keys, F.inline("_rows"))
    )
    df_resid = (F.col("n") - 2).cast("double")
    steps = {
        "_ssr": F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)),
        "_df": F.when(df_resid > 0, df_resid),
        "_mse": F.col("_ssr") / F.col("_df"),
        "r2": F.when(F.col("syy") > 0, 1 - F.col("_ssr") / F.col("syy")),
        "adj_r2": 1 - (F.col("n") - 1) / F.col("_df") * (1 - F.col("r2")),
        "f_stat": F.when(F.col("_mse") > 0, (F.col("syy") - F.col("_ssr")) / F.col("_mse")),
        "f_p_value": f_sf_col(F.col("f_stat"), F.lit(1.0), F.col("_df")),
        "intercept_se": F.sqrt(F.col("_mse") * (1 / F.col("n") + F.col("avgx") * F.col("avgx") / F.col("sxx"))),
        "slope_se": F.sqrt(F.col("_mse") / F.col("sxx")),
        "intercept_t": F.when(F.col("intercept_se") > 0, F.col("intercept") / F.col("intercept_se")),
        "slope_t": F.when(F.col("slope_se") > 0, F.col("slope") / F.col("slope_se")),
        "intercept_p": t_two_sided_col(F.col("intercept_t"), F.col("_df")),
        "slope_p": t_two_sided_col(F.col("slope_t"), F.col("_df")),
    }
    out = base
    for name, step in steps.items():
        out = out.withColumn(name, step)
    return out.drop("_ssr", "_df", "_mse", "sxx", "syy", "sxy", "avgx")


def regress(df: DataFrame, y: str, xs, by=None, order_by=None) -> dict[str, DataFrame]:
    """All tables of a regression; ``order_by`` adds the first twenty residuals."""
    r = Regression(df, y, xs, by, keep=order_by)
    r.source.pin()
    tables = {
        "summary": r.summary(),
        "coefficients": r.coefficients(),
        "vif": r.vif(),
        "heteroskedasticity": r.heteroskedasticity(),
        "reset": r.reset(),
        "residuals": r.residual_summary(),
    }
    if order_by:
        tables["first_residuals"] = r.first_residuals(order_by)
    return tables


def goodness_of_fit(df: DataFrame, y: str, xs, order_by=None) -> dict[str, DataFrame]:
    """All goodness-of-fit tables; ``order_by`` adds the direction accuracy."""
    r = Regression(df, y, xs, keep=order_by)
    tables = {
        "fit_measures": r.fit_measures(),
        "errors": r.error_metrics(),
        "residual_tests": r.residual_tests(),
        "shapiro_wilk": shapiro_wilk(r.predictions, "residual"),
        "summary": r.summary(),
    }
    if order_by:
        tables["direction"] = r.direction_accuracy(order_by)
    return tables


def linktest(df: DataFrame, y: str, xs, by=None) -> dict[str, DataFrame]:
    r = Regression(df, y, xs, by)
    r.source.pin()
    return {
        "coefficients": r.linktest(),
        "summary": r.linktest_summary(),
        "reset": r.reset(),
        "heteroskedasticity": r.heteroskedasticity().filter(F.col("test") == "Fitted values"),
    }

