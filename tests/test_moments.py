from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from econspark.operators.absorb import Absorption
from econspark.operators.ols import Regression
from econspark.operators.panel import Panel
from econspark.plans.moments import collect_moments, merge, moments_frame, unpack
from econspark.plans.solver import ols


@pytest.mark.parametrize("p", [2, 5, 7, 8, 12])
@pytest.mark.parametrize("level", [0.0, 1e7])
def test_every_path_gives_the_same_moments(spark, p, level):
    rng = np.random.default_rng(p)
    x = rng.normal(size=(900, p)) * np.arange(1, p + 1) + level
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(4)
    m = collect_moments(df, cols)
    d = x - x.mean(axis=0)
    scale = np.sqrt(np.outer(np.diag(d.T @ d), np.diag(d.T @ d)))
    assert m.n == 900
    assert m.mean == pytest.approx(x.mean(axis=0), rel=1e-12, abs=1e-9)
    assert np.max(np.abs(m.comoment - d.T @ d) / scale) < 1e-9


def test_grouped_moments_add_up(spark):
    rng = np.random.default_rng(1)
    cols = [f"c{i}" for i in range(7)]
    pdf = pd.DataFrame(rng.normal(size=(500, 7)) + 5, columns=cols).assign(g=rng.integers(0, 6, 500))
    df = spark.createDataFrame(pdf)
    parts = [unpack(cols, r["n"], r["mean"], r["comoment"]) for r in moments_frame(df, cols, ["g"]).collect()]
    total, whole = merge(parts), collect_moments(df, cols)
    assert total.n == whole.n == 500
    assert total.comoment == pytest.approx(whole.comoment, rel=1e-9, abs=1e-8)


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1, 1e-3, 1e3] + [0, 5, -2e4]
    y = x @ [1.5, 200, -0.01] + 3 + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([y, x]), columns=["y", "a", "b", "c"]))
    fit = ols(collect_moments(df, ["y", "a", "b", "c"]), "y", ["a", "b", "c"])
    design = np.column_stack([np.ones(200), x])
    beta, ssr, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert fit.params == pytest.approx(beta, rel=1e-7)
    assert fit.ssr == pytest.approx(ssr[0], rel=1e-9)
    cov = np.linalg.inv(design.T @ design) * ssr[0] / 196
    assert fit.se() == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-5)


@pytest.mark.parametrize("k", [2, 5, 7])
def test_keyed_moments_keep_their_digits_at_any_level(spark, k):
    """Entity levels of 1e8 times the spread inside an entity, few and many columns."""
    rng = np.random.default_rng(k)
    entity = np.repeat(np.arange(30), 40)
    x = rng.normal(size=(1200, k)) + 1e8 * (entity[:, None] + 1) * (np.arange(k) % 2)
    y = x @ np.arange(1, k + 1) + 1e8 * entity + rng.normal(size=1200) * 1e-3
    cols = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([entity, y, x]), columns=["id", "y", *cols])).repartition(5)
    for table in (Absorption(df, "y", cols, ["id"]).coefficients(), Panel(df, "y", cols, "id", "y").coefficients("fixed")):
        got = {r["variable"]: r["coefficient"] for r in table.collect()}
        assert [got[c] for c in cols] == pytest.approx(range(1, k + 1), abs=2e-3)
    assert df.count() == 1200


def test_regression_by_group_far_from_zero(spark):
    rng = np.random.default_rng(4)
    g = np.repeat([0, 1], 300)
    x = rng.normal(size=(600, 6)) + np.where(g == 1, 1e7, 0.0)[:, None]
    y = x @ np.arange(1, 7) + rng.normal(size=600) * 1e-3
    cols = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([g, y, x]), columns=["g", "y", *cols]))
    for group in (0, 1):
        rows = Regression(df, "y", cols, by="g").coefficients().filter(F.col("g") == group).collect()
        got = {r["variable"]: r["coefficient"] for r in rows}
        assert [got[c] for c in cols] == pytest.approx(range(1, 7), abs=2e-3)


def test_a_thousand_columns_meet_in_tasks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1000)) + 1e3
    cols = [f"c{i}" for i in range(1000)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(7)
    m = collect_moments(df, cols)
    d = x - x.mean(axis=0)
    assert m.n == 400 and np.abs(m.comoment - d.T @ d).max() < 1e-6
    empty = collect_moments(df.where("false"), cols)
    assert empty.n == 0


def test_pairwise_correlations_of_wide_tables(spark):
    from econspark.operators.corr import correlation_pairs

    rng = np.random.default_rng(12)
    p = 75
    x = rng.normal(size=(600, p)) @ (np.eye(p) + 0.3 * rng.normal(size=(p, p))) + 1e6 * (np.arange(p) % 3)
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(p)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.3)
    pdf["c5"], pdf["c6"] = 0.1, np.nan
    pdf.loc[1:, "c7"] = np.nan
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(pdf).repartition(5)
    df = df.mapInArrow(counted, df.schema)
    got = {(r["var1"], r["var2"]): r for r in correlation_pairs(df).collect()}
    assert len(got) == p * (p - 1) // 2 and seen.value == 600
    want = pdf.corr(min_periods=2)
    for (a, b), r in got.items():
        both = pdf[a].notna() & pdf[b].notna()
        assert r["n"] == both.sum()
        if {a, b} & {"c5", "c6", "c7"}:
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want.loc[a, b], abs=1e-7)


def test_nearly_collinear_columns_keep_their_digits(spark):
    """Gram matrices see one column; the columns themselves tell two apart."""
    from fractions import Fraction

    rng = np.random.default_rng(7)
    n = 400
    a = rng.integers(0, 50, n)
    noise = rng.integers(0, 7, n)
    b = a * 1_000_000 + noise
    y = 3 * a - 2 * noise + rng.integers(0, 100, n)
    df = spark.createDataFrame(pd.DataFrame({"y": y.astype(float), "a": a.astype(float), "b": b.astype(float), "c": (2 * a + b).astype(float)})).repartition(5)
    ones = [Fraction(1)] * n
    cols = [ones, [Fraction(int(v)) for v in a], [Fraction(int(v)) for v in b]]
    gram = [[sum(u * v for u, v in zip(p, q)) for q in cols] + [sum(u * int(t) for u, t in zip(p, y))] for p in cols]
    for i in range(3):  # exact elimination
        gram[i] = [v / gram[i][i] for v in gram[i]]
        for k in range(3):
            if k != i:
                gram[k] = [v - gram[k][i] * w for v, w in zip(gram[k], gram[i])]
    want = [float(gram[i][3]) for i in range(3)]
    got = {r["variable"]: r for r in Regression(df, "y", ["a", "b"]).coefficients().collect()}
    assert [got[v]["coefficient"] for v in ("_cons", "a", "b")] == pytest.approx(want, rel=1e-6)
    design = np.column_stack([np.ones(n), a, noise])
    beta, ssr, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(np.linalg.inv(design.T @ design)[2, 2] * ssr[0] / (n - 3))
    assert got["b"]["std_error"] == pytest.approx(se, rel=1e-6)
    three = {r["variable"]: r for r in Regression(df, "y", ["a", "b", "c"]).coefficients().collect()}
    assert three["c"]["omitted"] and three["b"]["coefficient"] == pytest.approx(want[2], rel=1e-6)
    raw = {r["variable"]: r["coefficient"] for r in Regression(df, "y", ["a", "b"], const=False).coefficients().collect()}
    beta, *_ = np.linalg.lstsq(np.column_stack([a, noise]), y, rcond=None)
    assert raw["b"] == pytest.approx(beta[1], rel=1e-6)
