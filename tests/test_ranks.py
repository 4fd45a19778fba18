from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from econspark.operators.tables import frequency
from econspark.plans import ranks
from econspark.plans.buckets import ordered_parts

PROBS = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]


def frame(spark, kind: str) -> pd.DataFrame:
    rng = np.random.default_rng(7)
    n = 4000
    values = {
        "spread": rng.normal(size=n),
        "heavy": np.where(rng.random(n) < 0.4, 3.0, rng.lognormal(0, 3, n)),
        "constant": np.full(n, 2.5),
    }[kind]
    # one group holds about two thirds of the rows
    group = np.where(rng.random(n) < 0.66, "big", rng.choice(["b", "c", "d"], n))
    return pd.DataFrame({"g": group, "v": values})


@pytest.mark.parametrize("kind", ["spread", "heavy", "constant"])
@pytest.mark.parametrize("method", ["selection", "percentile", "auto"])
def test_quantiles_match_pandas(spark, kind, method):
    pdf = frame(spark, kind)
    df = spark.createDataFrame(pdf).repartition(5)
    whole = ranks.quantiles(df, "v", PROBS, method=method).first()
    assert whole["n"] == len(pdf)
    assert whole["q"] == pytest.approx(pdf["v"].quantile(PROBS).tolist(), rel=1e-12)
    for row in ranks.quantiles(df, ["v"], PROBS, "g", method=method).collect():
        want = pdf.loc[pdf["g"] == row["g"], "v"]
        assert row["n"] == len(want)
        assert row["q"] == pytest.approx(want.quantile(PROBS).tolist(), rel=1e-12)


def test_selection_skips_missing_and_handles_tiny_tables(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (2.0,)], "x double")
    row = ranks.quantiles(df, "x", [0.5], method="selection").first()
    assert (row["n"], row["q"]) == (2, [1.5])
    empty = df.filter("x > 5 and not isnan(x)")
    assert ranks.quantiles(empty, "x", [0.5], method="selection").count() == 0
    assert ranks.quantiles(empty, "x", [0.5]).count() == 0


def test_mid_ranks_match_pandas(spark):
    pdf = frame(spark, "heavy")
    want = pdf.assign(r=pdf["v"].rank()).groupby(["g", "v"])["r"].first()
    rows = ranks.mid_ranks(spark.createDataFrame(pdf).repartition(4), "v", "g").collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r["mid_rank"] == want[(r["group"], r["value"])]
        assert r["total"] == len(pdf)


def test_row_numbers_and_changes(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.permutation(3000), "id": np.where(rng.random(3000) < 0.5, 0, rng.integers(1, 40, 3000)), "v": rng.normal(size=3000)})
    df = spark.createDataFrame(pdf).repartition(6)
    for r in ranks.row_numbers(df, "k").collect():
        assert r["row_index"] == r["k"] and r["total"] == 3000
    want = pdf.sort_values("k").groupby("id")["v"].diff().dropna()
    got = ranks.successive_changes(df, ["v"], "k", "id").toPandas()["v"]
    assert sorted(got) == pytest.approx(sorted(want), rel=1e-9)
    whole = pdf.sort_values("k")["v"].diff().dropna()
    assert sorted(ranks.successive_changes(df, ["v"], "k").toPandas()["v"]) == pytest.approx(sorted(whole), rel=1e-9)


def test_text_periods_and_a_hot_first_key(spark):
    n = 6000
    pdf = pd.DataFrame({"day": ["2020Q1" if i % 10 else f"2021Q{i % 4}" for i in range(n)], "k": np.arange(n)[::-1], "v": np.arange(n) ** 1.5})
    df = spark.createDataFrame(pdf).repartition(6)
    ordered = pdf.sort_values(["day", "k"]).reset_index(drop=True)
    got = {r["k"]: r["row_index"] for r in ranks.row_numbers(df, ["day", "k"]).collect()}
    assert got == {int(k): i for i, k in enumerate(ordered["k"])}
    changes = sorted(ranks.successive_changes(df, ["v"], ["day", "k"]).toPandas()["v"])
    assert changes == pytest.approx(sorted(ordered["v"].diff().dropna()), rel=1e-9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions are merged otherwise
    spread = ordered_parts(df.filter("day = '2020Q1'"), "day").groupBy("part").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 0.6 * n  # the one value lies in several parts


@pytest.mark.parametrize("levels", [6, 5000])
def test_running_frequencies_with_many_ties(spark, levels):
    df = spark.range(3 * levels).select((F.col("id") % levels).alias("level"))
    rows = sorted(frequency(df, "level").collect(), key=lambda r: r["cum_n"])
    assert [r["value"] for r in rows] == list(range(levels))
    assert [r["cum_n"] for r in rows] == [3 * (i + 1) for i in range(levels)]


@pytest.mark.parametrize("points", [2, 7, 50, 5000])
def test_spaced_order_statistics(spark, points):
    pdf = frame(spark, "heavy")
    rows = ranks.spaced_order_statistics(spark.createDataFrame(pdf).repartition(3), "v", points).orderBy("rank").collect()
    ordered, n, m = sorted(pdf["v"]), len(pdf), min(points, len(pdf))
    want = [i * (n - 1) // (m - 1) for i in range(m)]
    assert [r["rank"] - 1 for r in rows] == want
    assert [r["value"] for r in rows] == [ordered[k] for k in want]


def test_spaced_order_statistics_of_one_row(spark):
    rows = ranks.spaced_order_statistics(spark.createDataFrame([(4.0,)], "v double"), "v", 9).collect()
    assert [tuple(r) for r in rows] == [(1, 4.0, 1)]


def test_two_reads_give_moments_and_quantiles(spark):
    rng = np.random.default_rng(6)
    n = 60_000
    pdf = pd.DataFrame({"a": rng.normal(1e9, 2.0, n), "b": rng.integers(0, 4, n).astype(float), "c": np.full(n, 7.25), "d": rng.lognormal(0, 3, n), "it's `q`": np.where(rng.random(n) < 0.99, 0.0, rng.normal(size=n))})
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double")).withColumn("holes", F.when(F.rand(3) < 0.5, F.col("a"))).cache()
    cols, probs = [*pdf.columns, "none"], [0.0, 0.001, 0.25, 0.5, 0.7, 0.999, 1.0]
    cols = [c for c in cols if "`" not in c] + ["holes"]
    table = {r["variable"]: r for r in ranks.moments_and_quantiles(df, cols, probs).collect()}
    full = df.select(*cols).toPandas()
    for c in cols:
        r, v = table[c], full[c].dropna().to_numpy(float)
        assert (r["n_total"], r["n"]) == (n, len(v))
        if not len(v):
            assert r["q"] is None and r["mean"] is None and r["sd"] is None
            continue
        assert r["q"] == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12)
        assert (r["min"], r["max"]) == (v.min(), v.max()) and r["mean"] == pytest.approx(v.mean(), rel=1e-12)
        assert r["sd"] == pytest.approx(v.std(ddof=1), rel=1e-9, abs=1e-12)
        if v.std():
            z = (v - v.mean()) / v.std()
            assert r["skew_pop"] == pytest.approx((z**3).mean(), rel=1e-6, abs=1e-6) and r["kurt_pop"] == pytest.approx((z**4).mean() - 3, rel=1e-6, abs=1e-6)
        else:
            assert r["skew_pop"] is None and r["kurt_pop"] is None
    df.unpersist()


def test_brackets_too_wide_fall_back(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MOST_BRACKETED", 10)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021).cast("double").alias("v"))
    assert ranks.moments_and_quantiles(df, ["v"], [0.5]) is None
    values = np.sort((np.arange(50_000) * 7919 % 50_021).astype(float))
    assert ranks.quantiles(df, "v", [0.1, 0.5]).first()["q"] == pytest.approx(np.quantile(values, [0.1, 0.5]).tolist())


def test_quantiles_of_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),)] * 30_000 + [(float(i),) for i in range(40_000)], "v double")
    assert ranks.quantiles(df, "v", [0.0, 0.25, 0.9]).first()["q"][:2] == [0.0, 17_499.75]


def test_reads_of_the_table(spark):
    """Two reads and no more, jobs that run at once included."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(5000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 7).cast("double").alias("w"))
    df = df.mapInArrow(counted, df.schema)
    from econspark.operators import describe

    assert len(describe.detail(df).collect()) == 2 and seen.value == 2 * 5000
