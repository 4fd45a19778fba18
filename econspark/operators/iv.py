"""Two-stage least squares on one cross-product matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from econspark.functions.dist import chi2_sf, f_sf, t_ppf, t_two_sided
from econspark.operators.ols import MIN_ROWS
from econspark.plans.moments import Moments, MomentSource
from econspark.plans.solver import CONST, Fit, ols, solve_cross
from econspark.schema import as_list, complete_cases


@dataclass
class TwoStage:
    first: Fit  # x on instruments and controls
    second: Fit  # y on fitted x and controls, residuals around fitted x
    reduced: Fit  # x on the controls alone
    params: np.ndarray  # constant, x, controls
    ssr_true: float  # Σ (y − Xb)² with x itself
    n: int
    m: Moments
    y: str
    x: str
    z: list[str]
    controls: list[str]

    @property
    def dof(self) -> int:
        return self.second.df_resid


def two_stage(m: Moments, y: str, x: str, z: Sequence[str], controls: Sequence[str]) -> TwoStage:
    z, controls = list(z), list(controls)
    first = ols(m, x, [*z, *controls])
    reduced = ols(m, x, controls)
    # add the fitted x as a column: it is a linear combination of known columns
    size = len(m.cols)
    combine = np.zeros((size, size + 1))
    combine[:, :size] = np.eye(size)
    combine[m.at([*z, *controls]), size] = first.beta
    wide = Moments(
        (*m.cols, "_xhat"),
        m.n,
        np.append(m.mean, first.const + m.mean[m.at([*z, *controls])] @ first.beta),
        combine.T @ m.comoment @ combine,
    )
    second = ols(wide, y, ["_xhat", *controls])
    slopes = second.beta
    design = m.at([x, *controls])
    yi = m.cols.index(y)
    c = m.comoment
    ssr = float(c[yi, yi] - 2 * slopes @ c[design, yi] + slopes @ c[np.ix_(design, design)] @ slopes)
    return TwoStage(first, second, reduced, second.params, max(ssr, 0.0), m.n, wide, y, x, z, controls)


class InstrumentalVariables:
    """y on endogenous x and controls, x instrumented by z; ``z`` may be one name or several."""

    def __init__(self, df: DataFrame, y: str, x: str, z, controls=None, by=None, min_rows: int = MIN_ROWS):
        self.y, self.x, self.z = y, x, as_list(z)
        self.controls, self.by, self.min_rows = as_list(controls), as_list(by), min_rows
        if not self.z:
            raise ValueError("at least one instrument is needed")
        cols = [y, x, *self.z, *self.controls]
        if len(set(cols)) < len(cols):
            raise ValueError("outcome, regressor, instruments and controls must differ")
        self.source = MomentSource(complete_cases(df, cols, self.by), cols, self.by)

    def _solve(self, fn, schema: str) -> DataFrame:
        y, x, z, controls, least = self.y, self.x, self.z, self.controls, self.min_rows

        def rows(m: Moments) -> list[dict]:
            return [] if m.n < least else fn(two_stage(m, y, x, z, controls))

        return self.source.solve(rows, schema)

    def first_stage(self) -> DataFrame:
        return self._solve(_first_stage, "n long, r2 double, adj_r2 double, f_stat double, f_p_value double")

    def coefficients(self, level: float = 0.95) -> DataFrame:
        """2SLS coefficients: ``std_error`` from the true residuals, ``se_naive`` from the second stage."""
        return self._solve(
            lambda t: _coefficients(t, level),
            "position int, variable string, coefficient double, std_error double, t_stat double, p_value double, "
            "ci_lower double, ci_upper double, se_naive double, t_naive double, p_naive double",
        )

    def summary(self) -> DataFrame:
        return self._solve(_summary, "n long, r2_second_stage double, adj_r2_second_stage double, r2 double, rmse double")

    def weak_instruments(self) -> DataFrame:
        """Overall first-stage F (controls included) and the F of the excluded instruments alone."""
        return self._solve(
            _weak,
            "f_overall double, f_overall_p double, f_excluded double, f_excluded_p double, df_num long, df_den long, r2 double",
        )

    def overidentification(self) -> DataFrame:
        """J = n·R² of the second-stage residuals (``j_stat``) and of the true ones (``sargan``) on
        all instruments; empty with a single instrument."""
        return self._solve(
            _overidentification, "j_stat double, j_p_value double, sargan double, sargan_p_value double, df int"
        )

    def endogeneity(self) -> DataFrame:
        """Durbin–Wu–Hausman contrast of OLS and IV; statistic NULL unless the IV variance is larger."""
        return self._solve(
            _endogeneity,
            "dwh_stat double, dwh_p_value double, ols_coefficient double, iv_coefficient double, difference double",
        )


def _first_stage(t: TwoStage) -> list[dict]:
    f = t.first
    return [{"n": t.n, "r2": f.r2, "adj_r2": f.adj_r2, "f_stat": f.f, "f_p_value": f.f_p}]


def _coefficients(t: TwoStage, level: float) -> list[dict]:
    naive = t.second.se()
    sigma2 = t.ssr_true / t.dof if t.dof > 0 else math.nan
    true = np.sqrt(np.maximum(np.diag(t.second.unscaled_cov), 0) * sigma2)
    crit = t_ppf((1 + level) / 2, t.dof)
    rows = []
    for i, (name, b, s, sn) in enumerate(zip([CONST, t.x, *t.controls], t.params, true, naive)):
        stat = b / s if s > 0 else math.nan
        stat_n = b / sn if sn > 0 else math.nan
        rows.append(
            {
                "position": i, "variable": name, "coefficient": b, "std_error": s, "t_stat": stat,
                "p_value": t_two_sided(stat, t.dof), "ci_lower": b - crit * s, "ci_upper": b + crit * s,
                "se_naive": sn, "t_naive": stat_n, "p_naive": t_two_sided(stat_n, t.dof),
            }
        )
    return rows


def _summary(t: TwoStage) -> list[dict]:
    return [
        {
            "n": t.n, "r2_second_stage": t.second.r2, "adj_r2_second_stage": t.second.adj_r2,
            "r2": 1 - t.ssr_true / t.second.tss if t.second.tss > 0 else math.nan,
            "rmse": math.sqrt(t.ssr_true / t.dof) if t.dof > 0 else math.nan,
        }
    ]


def _weak(t: TwoStage) -> list[dict]:
    f, num = t.first, t.first.rank - t.reduced.rank
    row = {"f_overall": f.f, "f_overall_p": f.f_p, "df_num": num, "df_den": f.df_resid, "r2": f.r2}
    if num > 0 and f.mse > 0:
        stat = (t.reduced.ssr - f.ssr) / num / f.mse
        row |= {"f_excluded": stat, "f_excluded_p": f_sf(stat, num, f.df_resid)}
    return [row]


def _overidentification(t: TwoStage) -> list[dict]:
    df = len(t.z) - 1
    if df < 1:
        return []

    def n_r2(x_column: str) -> float:
        """n·R² of y − b·(x column) − controls on instruments and controls."""
        use = t.m.at([t.y, x_column, *t.controls])
        weights = np.concatenate([[1.0], -t.second.beta])
        inst = t.m.at([*t.z, *t.controls])
        c = t.m.comoment
        total = float(weights @ c[np.ix_(use, use)] @ weights)
        cross = c[np.ix_(inst, use)] @ weights
        b, _, _ = solve_cross(c[np.ix_(inst, inst)], cross)
        return t.n * float(b @ cross) / total if total > 0 else math.nan

    j, sargan = n_r2("_xhat"), n_r2(t.x)
    return [{"j_stat": j, "j_p_value": chi2_sf(j, df), "sargan": sargan, "sargan_p_value": chi2_sf(sargan, df), "df": df}]


def _endogeneity(t: TwoStage) -> list[dict]:
    plain = ols(t.m, t.y, [t.x, *t.controls])
    b_ols, b_iv = plain.beta[0], t.second.beta[0]
    gap = t.second.se()[1] ** 2 - plain.se()[1] ** 2
    row = {"ols_coefficient": b_ols, "iv_coefficient": b_iv, "difference": b_ols - b_iv}
    if gap > 0:
        stat = (b_ols - b_iv) ** 2 / gap
        row |= {"dwh_stat": stat, "dwh_p_value": chi2_sf(stat, 1)}
    return [row]


def ivregress(df: DataFrame, y: str, x: str, z, controls=None, by=None) -> dict[str, DataFrame]:
    """All tables of a two-stage regression."""
    iv = InstrumentalVariables(df, y, x, z, controls, by)
    iv.source.pin()
    return {
        "first_stage": iv.first_stage(),
        "coefficients": iv.coefficients(),
        "summary": iv.summary(),
        "weak_instruments": iv.weak_instruments(),
        "overidentification": iv.overidentification(),
        "endogeneity": iv.endogeneity(),
    }
