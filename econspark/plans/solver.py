"""Least squares on moments: small dense algebra, one matrix at a time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from econspark.functions.dist import f_sf, t_ppf, t_two_sided
from econspark.plans.moments import Moments

COLLINEAR_TOLERANCE = 1e-9
NEAR = 1e-7  # below, cross-products have lost too many digits and the columns themselves are factored
FACTOR_TOLERANCE = 1e-11  # what a column must keep of its length
CONST = "_cons"


@dataclass
class Fit:
    """A least-squares fit. Omitted regressors have coefficient 0 and zero rows in ``cov``."""

    y: str
    xs: list[str]
    has_const: bool
    n: int
    beta: np.ndarray  # slopes in the order of xs
    const: float
    inverse: np.ndarray  # inverse of the (centred or raw) cross-products, zero where omitted
    omitted: list[bool]
    x_mean: np.ndarray
    ssr: float
    tss: float

    @property
    def rank(self) -> int:
        return len(self.xs) - sum(self.omitted)

    @property
    def df_resid(self) -> int:
        return self.n - self.rank - int(self.has_const)

    @property
    def mse(self) -> float:
        return self.ssr / self.df_resid if self.df_resid > 0 else np.nan

    @property
    def r2(self) -> float:
        return 1 - self.ssr / self.tss if self.tss > 0 else np.nan

    @property
    def adj_r2(self) -> float:
        return 1 - (self.n - int(self.has_const)) / self.df_resid * (1 - self.r2) if self.df_resid > 0 else np.nan

    @property
    def f(self) -> float:
        if self.rank == 0 or self.df_resid <= 0:
            return np.nan
        explained = max(self.tss - self.ssr, 0.0) / self.rank
        return explained / self.mse if self.mse > 0 else np.inf

    @property
    def f_p(self) -> float:
        return f_sf(self.f, self.rank, self.df_resid)

    @property
    def log_likelihood(self) -> float:
        if self.ssr <= 0 or self.n == 0:
            return np.nan
        return -self.n / 2 * (np.log(2 * np.pi) + np.log(self.ssr / self.n) + 1)

    @property
    def n_params(self) -> int:
        return self.rank + int(self.has_const)

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.n_params

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + np.log(self.n) * self.n_params

    @property
    def names(self) -> list[str]:
        return [CONST, *self.xs] if self.has_const else list(self.xs)

    @property
    def params(self) -> np.ndarray:
        return np.concatenate([[self.const], self.beta]) if self.has_const else self.beta

    @property
    def unscaled_cov(self) -> np.ndarray:
        """(X'X)⁻¹ including the constant, if any."""
        if not self.has_const:
            return self.inverse
        tilt = self.inverse @ self.x_mean
        corner = 1 / self.n + self.x_mean @ tilt
        return np.block([[np.array([[corner]]), -tilt[None, :]], [-tilt[:, None], self.inverse]])

    @property
    def cov(self) -> np.ndarray:
        return self.mse * self.unscaled_cov

    def se(self, df: float | None = None) -> np.ndarray:
        scale = self.mse if df is None else (self.ssr / df if df > 0 else np.nan)
        return np.sqrt(np.maximum(np.diag(self.unscaled_cov), 0) * scale)

    def coefficient_rows(self, level: float = 0.95) -> list[dict]:
        se = self.se()
        crit = t_ppf((1 + level) / 2, self.df_resid)
        flags = [False, *self.omitted] if self.has_const else self.omitted
        rows = []
        for i, (name, b, s, gone) in enumerate(zip(self.names, self.params, se, flags)):
            if gone:
                rows.append({"position": i, "variable": name, "omitted": True})
                continue
            t = b / s if s > 0 else np.nan
            rows.append(
                {
                    "position": i,
                    "variable": name,
                    "coefficient": b,
                    "std_error": s,
                    "t_stat": t,
                    "p_value": t_two_sided(t, self.df_resid),
                    "ci_lower": b - crit * s,
                    "ci_upper": b + crit * s,
                    "omitted": False,
                }
            )
        return rows


COEFFICIENT_SCHEMA = (
    "position int, variable string, coefficient double, std_error double, t_stat double, "
    "p_value double, ci_lower double, ci_upper double, omitted boolean"
)


def sweep_collinear(cross: np.ndarray, scale: np.ndarray) -> list[int]:
    """Indices of columns that are not linear combinations of earlier ones.

    ``cross`` is a cross-product matrix, ``scale`` the size below which a diagonal counts as zero.
    """
    kept: list[int] = []
    factor = np.zeros((0, 0))
    diag = np.diag(cross)
    for j in range(len(diag)):
        if diag[j] <= scale[j]:
            continue
        unit = cross[kept, j] / np.sqrt(diag[kept] * diag[j]) if kept else np.zeros(0)
        row = _forward(factor, unit)
        left = 1.0 - row @ row
        if left <= COLLINEAR_TOLERANCE:
            continue
        grown = np.zeros((len(kept) + 1, len(kept) + 1))
        grown[:-1, :-1] = factor
        grown[-1, :-1] = row
        grown[-1, -1] = np.sqrt(left)
        factor = grown
        kept.append(j)
    return kept


def _forward(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(lower, b) if len(b) else b


def scaled_inverse(cross: np.ndarray) -> np.ndarray:
    d = 1 / np.sqrt(np.diag(cross))
    return np.linalg.inv(cross * np.outer(d, d)) * np.outer(d, d)


def solve_cross(
    cross: np.ndarray, xy: np.ndarray, scale: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """Solve ``cross · b = xy`` leaving out collinear columns: (b, inverse, omitted)."""
    k = len(xy)
    kept = sweep_collinear(cross, np.zeros(k) if scale is None else scale)
    inverse = np.zeros((k, k))
    if kept:
        grid = np.ix_(kept, kept)
        inverse[grid] = scaled_inverse(cross[grid])
    return inverse @ xy, inverse, [j not in kept for j in range(k)]


def nearly_collinear(m: Moments, xs: Sequence[str]) -> bool:
    """Does some column keep less than NEAR of its variation once the earlier ones are taken out?"""
    xi = m.at(xs)
    cross = m.comoment[np.ix_(xi, xi)]
    diag = np.diag(cross)
    live = [i for i in range(len(xi)) if diag[i] > abs(m.raw[xi[i], xi[i]]) * 1e-20]
    if len(live) < 2:
        return False
    unit = cross[np.ix_(live, live)] / np.sqrt(np.outer(diag[live], diag[live]))
    values = np.linalg.eigvalsh(unit)
    return bool(values[0] < NEAR * values[-1])


def solve_factor(design: np.ndarray, target: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, list[bool], float]:
    """Least squares on a triangle's columns, in their order, without squaring them: (b, inverse of the cross-products, omitted, ssr).

    ``noise`` is what rounding of the data leaves of a column's length."""
    k, size = design.shape[1], np.linalg.norm(design, axis=0)
    kept, basis = [], np.zeros((len(design), 0))
    for j in range(k):
        left = design[:, j].copy()
        for _ in range(2):  # once more for what rounding brought back
            left -= basis @ (basis.T @ left)
        norm = np.linalg.norm(left)
        if norm > max(FACTOR_TOLERANCE, noise) * size[j]:
            basis = np.column_stack([basis, left / norm])
            kept.append(j)
    b, inverse = np.zeros(k), np.zeros((k, k))
    if kept:
        triangle = basis.T @ (design[:, kept] / size[kept])
        back = np.linalg.solve(triangle, np.eye(len(kept))) / size[kept][:, None]
        b[kept] = back @ (basis.T @ target)
        inverse[np.ix_(kept, kept)] = back @ back.T
    left = target - basis @ (basis.T @ target)
    left -= basis @ (basis.T @ left)
    return b, inverse, [j not in kept for j in range(k)], float(left @ left)


def ols(m: Moments, y: str, xs: Sequence[str], const: bool = True) -> Fit:
    xs = list(xs)
    yi, xi = m.cols.index(y), m.at(xs)
    if m.factor is not None:
        factor = m.factor if const else np.vstack([m.factor, np.sqrt(m.n) * m.mean])
        length = np.linalg.norm(factor[:, xi], axis=0)
        noise = 64 * np.finfo(float).eps * np.sqrt(m.n) * max((abs(m.mean[i]) / x for i, x in zip(xi, length) if x > 0), default=0.0)
        beta, inverse, omitted, ssr = solve_factor(factor[:, xi], factor[:, yi], noise)
        tss, x_mean = float(factor[:, yi] @ factor[:, yi]), m.mean[xi]
        level = float(m.mean[yi] - beta @ x_mean) if const else 0.0
        return Fit(y, xs, const, m.n, beta, level, inverse, omitted, x_mean, ssr if ssr > 1e-26 * tss else 0.0, tss)
    cross = m.comoment if const else m.raw
    spread = np.abs(np.diag(m.raw))[xi] * 1e-20
    beta, inverse, omitted = solve_cross(cross[np.ix_(xi, xi)], cross[xi, yi], spread)
    tss = float(cross[yi, yi])
    ssr = float(tss - beta @ cross[xi, yi])
    # a residual below the rounding error of the total is an exact fit
    ssr = ssr if ssr > 1e-14 * tss else 0.0
    x_mean = m.mean[xi]
    level = float(m.mean[yi] - beta @ x_mean) if const else 0.0
    return Fit(y, xs, const, m.n, beta, level, inverse, omitted, x_mean, ssr, tss)
