from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from econspark.functions.dist import norm_ppf, normal_quantile_sql
from econspark.operators.normality import block_weight, block_weight_column, shapiro_wilk, weight_constants


def test_normal_quantile_in_sql(spark):
    ps = [1e-300, 1e-20, 1e-6, 0.01, 0.07, 0.3, 0.5, 0.6, 0.93, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", F.expr(normal_quantile_sql("p")).alias("z"))
    for r in df.collect():
        assert r["z"] == pytest.approx(norm_ppf(r["p"]), rel=1e-8, abs=1e-12)


@pytest.mark.parametrize("n", [3, 5, 12, 3_999, 4_001, 9_000])
def test_weights_agree_with_the_sum_over_ranks(spark, n):
    """On both sides of the size from which the middle is summed in closed form."""
    blocks = sorted({(0, 1), (0, n), (1, 1), (n - 1, 1), (n // 2, 1), (n // 3, max(1, n // 5)), (n // 4, max(1, n // 2))})
    df = spark.createDataFrame(blocks, "before long, n long").select("before", "n", block_weight_column(n).alias("w"))
    a1, a2, divisor = weight_constants(n)
    edge = 1 if n <= 5 else 2
    for r in df.collect():
        want = 0.0
        for i in range(r["before"] + 1, r["before"] + r["n"] + 1):
            if i in (1, n):
                want += -a1 if i == 1 else a1
            elif edge == 2 and i in (2, n - 1):
                want += -a2 if i == 2 else a2
            elif n > 3:
                want += norm_ppf((i - 0.375) / (n + 0.25)) / divisor
        assert r["w"] == pytest.approx(want, rel=1e-6, abs=1e-6), r
        assert r["w"] == pytest.approx(block_weight(r["before"], r["n"], n), rel=1e-6, abs=1e-6)


def test_no_python_over_the_values(spark):
    df = spark.range(500).select(F.sin("id").alias("x"))
    plan = shapiro_wilk(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1  # p of the one result row
    assert shapiro_wilk(df.limit(2), "x").count() == 0
