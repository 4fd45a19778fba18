"""Information criteria of the linear model, its polynomial and its interaction extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from econspark.operators.ols import MIN_ROWS
from econspark.plans.moments import MomentSource
from econspark.plans.solver import ols
from econspark.schema import as_list, complete_cases

CRITERIA_SCHEMA = (
    "position int, model string, n long, params long, aic double, bic double, r2 double, adj_r2 double, "
    "f_stat double, f_p_value double, ssr double, mse double"
)


def information_criteria(df: DataFrame, y: str, xs, by=None, max_degree: int = 3) -> DataFrame:
    """AIC, BIC and fit of the base model, polynomials up to ``max_degree`` and pairwise interactions.

    All candidate models are sub-matrices of one cross-product matrix, so the data are read once.
    Columns are standardised first, within each group: every model spans the same space either way.
    """
    xs, by = as_list(xs), as_list(by)
    rows = complete_cases(df, [y, *xs], by)
    keys = [F.col(f"`{k}`") for k in by]
    stats = [f(f"`{x}`").alias(f"_{n}{i}") for i, x in enumerate(xs) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    if by:
        rows = rows.join(rows.groupBy(*keys).agg(*stats), by)
        at = lambda name: F.col(name)
    else:
        exact = rows.agg(*stats).first()
        at = lambda name: F.lit(exact[name])
    one = F.lit(1.0)
    z = {x: (F.col(f"`{x}`") - F.coalesce(at(f"_m{i}"), F.lit(0.0))) / F.when(at(f"_s{i}") > 0, at(f"_s{i}")).otherwise(one) for i, x in enumerate(xs)}
    cols = {f"_x{i}": z[x] for i, x in enumerate(xs)}
    powers: dict[int, list[str]] = {}
    for d in range(2, max_degree + 1):
        powers[d] = [f"_x{i}_p{d}" for i in range(len(xs))]
        cols |= {f"_x{i}_p{d}": F.pow(z[x], F.lit(float(d))) for i, x in enumerate(xs)}
    crosses = {f"_x{i}_x{j}": z[xs[i]] * z[xs[j]] for i in range(len(xs)) for j in range(i + 1, len(xs))}
    cols |= crosses

    base = [f"_x{i}" for i in range(len(xs))]
    designs = {"Base Linear": base}
    for d in range(2, max_degree + 1):
        designs[f"Polynomial (degree {d})"] = base + [c for e in range(2, d + 1) for c in powers[e]]
    if crosses:
        designs["With Interactions"] = base + list(crosses)

    wide = rows.select(*keys, F.col(f"`{y}`").alias("_y"), *[c.alias(a) for a, c in cols.items()])

    def criteria(m) -> list[dict]:
        if m.n < MIN_ROWS:
            return []
        out = []
        for i, (name, design) in enumerate(designs.items()):
            fit = ols(m, "_y", design)
            out.append(
                {
                    "position": i, "model": name, "n": m.n, "params": fit.n_params, "aic": fit.aic, "bic": fit.bic,
                    "r2": fit.r2, "adj_r2": fit.adj_r2, "f_stat": fit.f, "f_p_value": fit.f_p, "ssr": fit.ssr,
                    "mse": fit.mse,
                }
            )
        return out

    return MomentSource(wide, ["_y", *cols], by).solve(criteria, CRITERIA_SCHEMA)


def criteria_changes(table: DataFrame, by=None) -> DataFrame:
    """Change of AIC and BIC against the base model and whether that is better."""
    over = Window.partitionBy(*as_list(by))
    base = {c: F.max(F.when(F.col("position") == 0, F.col(c))).over(over) for c in ("aic", "bic")}
    out = table.withColumns({"delta_aic": F.col("aic") - base["aic"], "delta_bic": F.col("bic") - base["bic"]})

    def verdict(c: str):
        return F.when(F.col(c) < 0, "Better").otherwise("Worse")

    return out.filter("position > 0").select(
        *[F.col(f"`{k}`") for k in as_list(by)], "model", "delta_aic", verdict("delta_aic").alias("aic_verdict"),
        "delta_bic", verdict("delta_bic").alias("bic_verdict"),
    )


def best_models(table: DataFrame, by=None) -> DataFrame:
    """The model with the lowest AIC, the lowest BIC and the highest R²."""
    keys = as_list(by)
    best = table.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("criterion"),
                    pick("model", F.col(c)).alias("model"),
                    extreme(c).alias("value"),
                )
                for label, c, pick, extreme in (
                    ("AIC", "aic", F.min_by, F.min),
                    ("BIC", "bic", F.min_by, F.min),
                    ("R2", "r2", F.max_by, F.max),
                )
            ]
        ).alias("_rows")
    )
    return best.select(*[F.col(f"`{k}`") for k in keys], F.inline("_rows"))
