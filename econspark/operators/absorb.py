"""Regression with one or many sets of fixed effects absorbed."""

from __future__ import annotations

import math
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from econspark.functions.dist import f_sf, t_two_sided
from econspark.operators.panel import _number, panel_moments
from econspark.plans.effects import components_by_joins, pack_cells, solve_effects
from econspark.plans.moments import Moments, collect_moments, moments_frame, unpack
from econspark.plans.solver import COEFFICIENT_SCHEMA, Fit, ols
from econspark.schema import as_list, complete_cases
from econspark.session import cut_lineage, drop_written

MIN_ROWS = 20
HIGH_DIMENSION = 50
TOLERANCE = 1e-9
STALLED = 200  # steps without halving the step
BROADCAST_LEVELS = 200_000  # effect tables up to this many levels are shipped to every executor
VECTOR_COLUMNS, WIDER = 20, 5  # packed cells need one number a level and column there: this many columns, or up to so many times the levels of fewer


class Absorption:
    """y on xs net of the fixed effects of every column in ``fe``.

    Rows collapse to cells, one per combination of effect levels: count, means and co-moments
    inside the cell. Within-cell co-moments are final at once; only the cell means need solving.
    One effect needs no sweep at all, since its cells are its levels.
    """

    def __init__(self, df: DataFrame, y: str, xs, fe, min_rows: int = MIN_ROWS, tolerance: float = TOLERANCE):
        self.y, self.xs, self.fe = y, as_list(xs), as_list(fe)
        if not self.fe:
            raise ValueError("at least one fixed effect is needed")
        self.cols = [y, *self.xs]
        self.tolerance, self.min_rows = tolerance, min_rows
        self.rows = complete_cases(df, self.cols, self.fe)
        self.sweeps = 0
        self.dof_exact = True
        self._added = 0  # parameters of all effects but the largest, less the redundant ones

    @cached_property
    def _base(self) -> tuple[Moments, dict[str, int]]:
        """Total moments and the number of levels of each effect."""
        # One small branch an effect: a distinct aggregate of several columns would multiply the rows.
        counts = [self.rows.select(f"`{f}`").distinct().agg(F.lit(f).alias("f"), F.count("*").alias("levels")) for f in self.fe]
        levels = {r["f"]: r["levels"] for r in reduce(DataFrame.union, counts).collect()}
        total = collect_moments(self.rows, self.cols)
        if total.n < self.min_rows:
            raise ValueError(f"only {total.n} complete rows, {self.min_rows} are needed")
        return total, levels

    @property
    def total(self) -> Moments:
        return self._base[0]

    @property
    def levels(self) -> dict[str, int]:
        return self._base[1]

    @cached_property
    def residual_moments(self) -> Moments:
        """Co-moments of the variables net of all effects."""
        if len(self.fe) == 1:
            m = panel_moments(self.rows, self.cols, self.fe[0])
            return m.demeaned()
        return self._sweep()

    def _sweep(self) -> Moments:
        """Solve for the level effects on packed cells: the largest effect is eliminated, the others are the unknowns."""
        p = range(len(self.cols))
        order = sorted(self.fe, key=lambda f: -self.levels[f])
        rest = [self.levels[f] for f in order[1:]]
        if sum(rest) > BROADCAST_LEVELS * max(1, min(WIDER, VECTOR_COLUMNS // (len(self.cols) + 1))):
            return self._sweep_by_joins(order)
        keys = [f"_g{i}" for i in range(len(order))]
        mean = self.total.mean
        values = [f"_y{i}" for i in p]
        rows = self.rows.select(*[F.col(f"`{f}`").alias(k) for k, f in zip(keys, order)], *[(F.col(f"`{c}`") - F.lit(float(mean[i]))).alias(values[i]) for i, c in enumerate(self.cols)])
        named = {key: self.rows.select(F.col(f"`{f}`").alias(key)).distinct() for key, f in zip(keys[1:], order[1:])}
        packed = pack_cells(rows, keys[0], named, rest, values)
        scale = np.sqrt(np.maximum(np.diag(self.total.comoment) / self.total.n, 1e-300))
        solved = solve_effects(packed, scale, self.tolerance)
        self.sweeps, self._added, self.dof_exact = solved.steps, solved.added, solved.exact
        upper = solved.cross[np.triu_indices(len(self.cols))] + solved.inside
        return unpack(self.cols, self.total.n, np.zeros(len(self.cols)), upper.tolist())

    def _sweep_by_joins(self, order: list[str]) -> Moments:
        """The same with the level effects in tables, for effects with more levels than are sent to every executor.

        The largest effect is eliminated exactly (means of its levels), the others are the unknowns, each scaled by its level's
        weight. A step needs one pass over the cells, which are written once, and one small table per effect with
        the solution, the remainder and the direction; the number of steps follows the square root of what plain sweeps need.
        """
        self._order = order
        p = range(len(self.cols))
        keys = [f"_g{i}" for i in range(len(order))]
        pairs = [(i, j) for i in p for j in range(i, len(self.cols))]
        mean = self.total.mean
        start = moments_frame(self.rows, self.cols, order).withColumnsRenamed(dict(zip(order, keys)))
        deviations = [(F.col("mean")[i] - F.lit(float(mean[i]))).alias(f"r{i}") for i in p]
        cells = cut_lineage(start.select(*keys, "n", "comoment", *deviations))
        scale = np.sqrt(np.maximum(np.diag(self.total.comoment) / self.total.n, 1e-300))

        def zero(name: str) -> list:
            return [F.lit(0.0).alias(f"{name}{i}") for i in p]

        state = {}
        for key in keys[1:]:
            level = self._level_sums(self._net_of_first(cells, keys[0]), key).withColumnsRenamed({f"q{i}": f"s{i}" for i in p})
            state[key] = level.select(key, "n", *zero("z"), *[f"s{i}" for i in p], *[(F.col(f"s{i}") / F.col("n")).alias(f"p{i}") for i in p])
        best, since = math.inf, 0
        written: dict[str, DataFrame] = {}
        while True:
            self.sweeps += 1
            outdated: list[DataFrame] = []
            directed = self._combined(cells, state, "p").select(*keys, "n", *[F.col(f"e{i}").alias(f"r{i}") for i in p])
            moved = self._net_of_first(directed, keys[0])
            sums = np.zeros((4, len(self.cols)))
            longest = np.zeros(len(self.cols))
            for key in keys[1:]:
                last, state[key] = written.get(key), cut_lineage(state[key].join(self._level_sums(moved, key).drop("n"), key))
                outdated += [last] if last is not None else []
                written[key] = state[key]
                s, q, d = ([F.col(f"{c}{i}") for i in p] for c in "sqp")
                terms = {"pq": lambda i: d[i] * q[i], "ss": lambda i: s[i] * s[i] / F.col("n"), "sq": lambda i: s[i] * q[i] / F.col("n"), "qq": lambda i: q[i] * q[i] / F.col("n")}
                row = state[key].agg(*[F.sum(f(i)).alias(f"{t}{i}") for t, f in terms.items() for i in p], *[F.max(F.abs(d[i])).alias(f"most{i}") for i in p]).first()
                sums += np.array([[row[f"{t}{i}"] for i in p] for t in terms])
                longest = np.maximum(longest, [row[f"most{i}"] for i in p])
            pq, ss, sq, qq = sums
            live = pq > 1e-300
            step = np.where(live, ss / np.where(live, pq, 1.0), 0.0)
            left = np.maximum(ss - 2 * step * sq + step * step * qq, 0.0)
            turn = np.where(live & (ss > 0), left / np.where(ss > 0, ss, 1.0), 0.0)
            for key in keys[1:]:
                s = [F.col(f"s{i}") - F.lit(float(step[i])) * F.col(f"q{i}") for i in p]
                z = [(F.col(f"z{i}") + F.lit(float(step[i])) * F.col(f"p{i}")).alias(f"z{i}") for i in p]
                d = [(s[i] / F.col("n") + F.lit(float(turn[i])) * F.col(f"p{i}")).alias(f"p{i}") for i in p]
                state[key] = state[key].select(key, "n", *z, *[x.alias(f"s{i}") for i, x in enumerate(s)], *d)
            for table in outdated:
                drop_written(table)
            size = float(np.max(step * longest / scale))
            if size < self.tolerance:
                break
            best, since = (size, 0) if size < 0.5 * best else (best, since + 1)
            if since >= STALLED:
                raise RuntimeError(f"absorption stands at steps of {size:.3g} of a standard deviation after {self.sweeps} steps")

        solved = self._combined(cells, state, "z").select(*keys, "n", "comoment", *[(F.col(f"r{i}") - F.col(f"e{i}")).alias(f"r{i}") for i in p])
        for i, key in enumerate(keys[1:], 1):
            self._added += self.levels[order[i]] - max(components_by_joins(cells, other, key) for other in keys[:i])
        self.dof_exact = len(keys) == 2
        inside = [F.sum(F.col("comoment")[k]) for k in range(len(pairs))]
        across = [F.sum(F.col("n") * F.col(f"r{i}") * F.col(f"r{j}")) for i, j in pairs]
        row = self._net_of_first(solved, keys[0]).agg(F.array(*[u + v for u, v in zip(inside, across)]).alias("c")).first()
        return unpack(self.cols, self.total.n, np.zeros(len(self.cols)), row["c"])

    def _small(self, table: DataFrame, key: str) -> DataFrame:
        return F.broadcast(table) if self.levels[self._order[int(key[2:])]] <= BROADCAST_LEVELS else table

    def _combined(self, cells: DataFrame, state: dict[str, DataFrame], name: str) -> DataFrame:
        """Cells with the sum over all effects of ``name`` (``e0``, ``e1``, …)."""
        total = {i: F.lit(0.0) for i in range(len(self.cols))}
        for key, table in state.items():
            named = table.select(key, *[F.col(f"{name}{i}").alias(f"{key}_{i}") for i in total])
            cells = cells.join(self._small(named, key), key)
            total = {i: t + F.col(f"{key}_{i}") for i, t in total.items()}
        return cells.withColumns({f"e{i}": t for i, t in total.items()})

    def _net_of_first(self, cells: DataFrame, key: str) -> DataFrame:
        """Cell values less the means of their level of the first effect."""
        cols = range(len(self.cols))
        means = cells.groupBy(key).agg(*[(F.sum(F.col("n") * F.col(f"r{i}")) / F.sum("n")).alias(f"m{i}") for i in cols])
        joined = cells.join(self._small(means, key), key)
        return joined.withColumns({f"r{i}": F.col(f"r{i}") - F.col(f"m{i}") for i in cols}).drop(*[f"m{i}" for i in cols])

    def _level_sums(self, cells: DataFrame, key: str) -> DataFrame:
        return cells.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"r{i}")).alias(f"q{i}") for i in range(len(self.cols))])

    @cached_property
    def fit(self) -> Fit:
        """Slopes of the residualised regression; the constant is zero by construction."""
        return ols(self.residual_moments, self.y, self.xs)

    @property
    def absorbed_parameters(self) -> int:
        """Rank of the dummies of all effects: their levels less the redundant ones, one for each connected component of the graph of
        levels of two effects. Of three or more effects with many levels, the redundancies of each with one other are deducted
        (``dof_exact`` is False); those that only show among three at once are not."""
        if len(self.fe) > 1:
            self.residual_moments  # noqa: B018  finds them on its way
        return max(self.levels.values()) + self._added

    def degrees_of_freedom(self) -> DataFrame:
        """Levels of all effects, how many are redundant, the rank of their dummies, slopes, and what is left for the residuals."""
        levels, absorbed = sum(self.levels.values()), self.absorbed_parameters
        row = {"n": self.total.n, "levels": levels, "redundant": levels - absorbed, "absorbed": absorbed, "slopes": self.fit.rank}
        row |= {"df_resid": self.total.n - absorbed - self.fit.rank, "exact": self.dof_exact}
        return self._table([row], "n long, levels long, redundant long, absorbed long, slopes long, df_resid long, exact boolean")

    def _table(self, rows: list[dict], schema: str) -> DataFrame:
        names = [part.split()[0] for part in schema.split(", ")]
        return self.rows.sparkSession.createDataFrame([tuple(_number(r.get(c)) for c in names) for r in rows], schema)

    def coefficients(self) -> DataFrame:
        """Slopes; ``std_error`` counts slopes and constant only, ``std_error_dfadj`` the levels too."""
        dof = self.fit.n - self.fit.rank - self.absorbed_parameters
        rows = []
        for row, s in zip(self.fit.coefficient_rows(), self.fit.se(dof)):
            if row["variable"] == "_cons":
                continue
            if not row["omitted"]:
                t = row["coefficient"] / s if s > 0 else math.nan
                row |= {"std_error_dfadj": s, "t_dfadj": t, "p_dfadj": t_two_sided(t, dof)}
            rows.append(row)
        return self._table(rows, COEFFICIENT_SCHEMA + ", std_error_dfadj double, t_dfadj double, p_dfadj double")

    def summary(self) -> DataFrame:
        """R² within, R² overall (effects count as explained), N and levels absorbed."""
        fit, tss = self.fit, float(self.total.comoment[0, 0])
        return self._table(
            [
                {
                    "n": fit.n, "r2_within": fit.r2, "r2_overall": 1 - fit.ssr / tss if tss > 0 else math.nan,
                    "levels_absorbed": self.absorbed_parameters - 1, "ssr": fit.ssr,
                }
            ],
            "n long, r2_within double, r2_overall double, levels_absorbed long, ssr double",
        )

    def structure(self) -> DataFrame:
        """Levels, rows, rows per level and the high-dimension flag of each effect."""
        n = self.total.n
        return self._table(
            [
                {"fixed_effect": f, "levels": k, "rows": n, "rows_per_level": n / k, "high_dimensional": k > HIGH_DIMENSION}
                for f, k in self.levels.items()
            ],
            "fixed_effect string, levels long, rows long, rows_per_level double, high_dimensional boolean",
        )

    def tests(self) -> DataFrame:
        """Joint F-test of each effect on its own: y on xs with and without its levels."""
        small = ols(self.total, self.y, self.xs)
        rows = []
        for f in self.fe:
            full = ols(panel_moments(self.rows, self.cols, f).demeaned(), self.y, self.xs, const=False)
            num, den = self.levels[f] - 1, full.n - full.rank - self.levels[f]
            row = {"fixed_effect": f, "df_num": num, "df_den": den, "ssr_restricted": small.ssr, "ssr_full": full.ssr}
            if num > 0 and den > 0 and full.ssr > 0:
                stat = (small.ssr - full.ssr) / num / (full.ssr / den)
                row |= {"f_stat": stat, "p_value": f_sf(stat, num, den)}
            rows.append(row)
        return self._table(
            rows,
            "fixed_effect string, f_stat double, p_value double, df_num long, df_den long, ssr_restricted double, ssr_full double",
        )

    def comparison(self) -> DataFrame:
        """OLS and fixed-effects slopes side by side with difference and % change."""
        plain = ols(self.total, self.y, self.xs)
        rows = []
        for i, x in enumerate(self.xs):
            a, b = plain.beta[i], self.fit.beta[i]
            rows.append(
                {
                    "variable": x, "ols": a, "fixed_effects": b, "difference": a - b,
                    "percent_change": 100 * (a - b) / a if a else math.nan,
                }
            )
        return self._table(
            rows, "variable string, ols double, fixed_effects double, difference double, percent_change double"
        )


def areg(df: DataFrame, y: str, xs, fe) -> dict[str, DataFrame]:
    """All absorption tables."""
    a = Absorption(df, y, xs, fe)
    return {
        "structure": a.structure(),
        "tests": a.tests(),
        "coefficients": a.coefficients(),
        "summary": a.summary(),
        "comparison": a.comparison(),
    }
