from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from econspark.operators import corr, describe as D, group_tests as GT, groups as G, model_compare as MC, panel as P, tables as TB
from econspark.operators.absorb import Absorption
from econspark.operators.iv import InstrumentalVariables
from econspark.operators.margins import marginal_curves
from econspark.operators.normality import block_weight, shapiro_wilk, weight_constants
from econspark.operators.ols import Regression, error_metrics, goodness_of_fit, linktest, regress
from econspark.schema import categorical_columns, numeric_columns
from econspark.sources.readers import parse_numbers, read_csv, read_text_csv
from econspark.sources.writers import read_report, save_report, save_results
from tests.conftest import by_name, one


def test_text_numbers(spark):
    df = spark.createDataFrame(
        [(" 1.5 ", "1", "nan"), ("", "2", "1e3"), ("2.5", "abc", "3"), (None, "3", " ")], "a string, b string, c string"
    )
    out = by_name(D.summarize(df))
    assert (out["a"]["n"], out["a"]["mean"], out["a"]["max"]) == (2, 2.0, 2.5)
    assert out["b"]["n"] == 4 and out["b"]["mean"] is None
    assert (out["c"]["n"], out["c"]["mean"]) == (3, 501.5)
    assert [f.dataType.simpleString() for f in parse_numbers(df).schema] == ["double", "string", "double"]


def test_single_and_empty_rows(spark):
    row = spark.createDataFrame([(1.0,)], "x double")
    out = one(D.summarize(row))
    assert out["sd"] is None and out["mean"] == 1.0
    assert one(D.mean_ci(row))["ci_lower"] is None
    nothing = spark.createDataFrame([(None,), (None,)], "x double")
    assert one(D.summarize(nothing))["n"] == 0
    assert D.tabstat(nothing).count() == 0
    out = one(D.codebook_numeric(nothing))
    assert (out["n_valid"], out["n_missing"], out["unique"], out["mode"]) == (0, 2, 0, None)
    assert one(D.dataset_summary(nothing.limit(0)))["missing_pct"] is None


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (2.0,)], "x double")
    assert one(D.summarize(df))["mean"] == 1.5
    assert one(D.describe(df))["nulls"] == 2
    assert one(D.data_quality(df))["quality"] == "Poor"


def test_k2_needs_eight_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(7)], "x double")
    assert one(D.normality_test(df))["k2"] is None


def test_classification(spark, lineitem):
    assert "l_shipdate" not in numeric_columns(lineitem)
    got = categorical_columns(lineitem)
    assert got == categorical_columns(lineitem, approximate=False)
    assert {"l_returnflag", "l_linenumber"} <= set(got)


def test_dropped_edges_keep_labels(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 3 + [(3,)], "x int")
    rows = G.quantile_bins(df, "x", 4).groupBy("x", "bin", "bin_label").count().orderBy("x").collect()
    pdf = pd.Series([1] * 50 + [2] * 3 + [3])
    codes = pd.qcut(pdf, 4, labels=False, duplicates="drop")
    for r in rows:
        assert r["bin"] == codes[pdf == r["x"]].iloc[0] + 1
        assert r["bin_label"] == f"Q{r['bin']}"


@pytest.mark.parametrize("bins", [2, 4, 7])
def test_width_bins_match_pandas(spark, lineitem, bins):
    got = G.width_bins(lineitem, "l_extendedprice", bins).select("l_extendedprice", "bin").toPandas()
    want = pd.cut(got["l_extendedprice"], bins, labels=False) + 1
    assert (got["bin"] == want).all()


def test_crosstab_totals(lineitem):
    rows = TB.crosstab(lineitem, "l_returnflag", "l_linestatus").collect()
    n = lineitem.count()
    assert sum(r["n"] for r in rows if not r["row_total"] and not r["col_total"]) == n
    assert [r["n"] for r in rows if r["row_total"] and r["col_total"]] == [n]


def test_other_bucket(spark):
    df = spark.createDataFrame([(f"v{i:03d}",) for i in range(60) for _ in range(1 + i % 3)], "s string")
    rows = TB.unique_values(df, "s").collect()
    assert len(rows) == 50 and sum(r["n"] for r in rows) == df.count()
    assert max(r["cum_percent"] for r in rows) == pytest.approx(100)
    exactly = df.filter("s < 'v050'")
    assert not any(r["is_other"] for r in TB.unique_values(exactly, "s").collect())


def test_collapse_conserves_rows(orders):
    out = G.collapse(orders, "o_orderpriority", "o_totalprice", ["count", "sum", "median"])
    assert out.agg(F.sum("count_o_totalprice")).first()[0] == orders.count()
    with pytest.raises(ValueError):
        G.collapse(orders, "o_orderpriority", "o_totalprice", ["mode"])


def test_two_groups(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.0, 4.0, 4.0, 6.0, 8.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, x double")
    t = one(GT.t_test(df, "g", "x"))
    pooled = np.sqrt((np.var(a, ddof=1) + np.var(b, ddof=1)) / 2)
    assert t["cohens_d"] == pytest.approx((np.mean(a) - np.mean(b)) / pooled)
    assert t["t_stat"] == pytest.approx(t["cohens_d"] / np.sqrt(2 / 6))
    f = one(GT.anova(df, "g", "x"))
    assert f["f_stat"] == pytest.approx(t["t_stat"] ** 2) and f["p_value"] == pytest.approx(t["p_value"])
    u = one(GT.mann_whitney(df, "g", "x"))
    both = pd.Series(a + b).rank()
    assert u["u_stat"] == pytest.approx(both[:6].sum() - 21)
    assert GT.pairwise_tests(df.filter("g = 'a'"), "g", "x").count() == 0


def test_exact_sample_coefficients(sample):
    out = by_name(Regression(sample, "y", ["x1", "x2"]).coefficients())
    assert out["x1"]["coefficient"] == pytest.approx(0.8)
    assert out["x2"]["coefficient"] == pytest.approx(-0.35)
    assert out["_cons"]["coefficient"] == pytest.approx(1.75)
    s = one(Regression(sample, "y", ["x1", "x2"]).summary())
    assert s["r2"] == pytest.approx(1) and s["ssr"] == pytest.approx(0, abs=1e-9)


def test_collinear_columns_are_omitted(sample):
    out = by_name(Regression(sample, "y", ["id", "time", "x1"]).coefficients())
    assert out["x1"]["omitted"] and not out["id"]["omitted"]
    vif = by_name(Regression(sample, "y", ["id", "time", "x1"]).vif())
    assert vif["x1"]["vif"] == float("inf") and vif["x1"]["high"]


def test_too_few_rows(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(5)], "y double, x double")
    assert one(Regression(df, "y", "x").summary())["status"] == "insufficient"
    assert Regression(df, "y", "x").coefficients().count() == 0
    with pytest.raises(ValueError):
        Regression(df, "y", "y")


def test_regression_agrees_with_mllib(spark, lineitem):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    xs = ["l_quantity", "l_discount"]
    rows = VectorAssembler(inputCols=xs, outputCol="f").transform(lineitem)
    model = LinearRegression(featuresCol="f", labelCol="l_extendedprice", solver="normal").fit(rows)
    out = by_name(Regression(lineitem, "l_extendedprice", xs).coefficients())
    assert [out[x]["coefficient"] for x in xs] == pytest.approx(list(model.coefficients), rel=1e-6)
    assert [out[x]["std_error"] for x in xs] == pytest.approx(model.summary.coefficientStandardErrors[:2], rel=1e-6)


def test_grouped_diagnostics_equal_filtered_ones(lineitem):
    xs = ["l_quantity", "l_discount"]
    grouped = Regression(lineitem, "l_extendedprice", xs, by="l_returnflag")
    alone = Regression(lineitem.filter("l_returnflag = 'A'"), "l_extendedprice", xs)
    for table, key in (("heteroskedasticity", "test"), ("linktest", "variable"), ("vif", "variable"), ("added_variables", "variable")):
        left = by_name(getattr(grouped, table)().filter("l_returnflag = 'A'"), key)
        right = by_name(getattr(alone, table)(), key)
        for name, row in right.items():
            for col, v in row.items():
                if isinstance(v, float):
                    assert left[name][col] == pytest.approx(v, rel=1e-5, abs=1e-7), (table, name, col)
    assert one(grouped.reset().filter("l_returnflag = 'A'"))["f_stat"] == pytest.approx(one(alone.reset())["f_stat"], rel=1e-6)


def test_frisch_waugh(lineitem):
    r = Regression(lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    full, partial = by_name(r.coefficients()), by_name(r.added_variables())
    for x in r.xs:
        assert partial[x]["partial_slope"] == pytest.approx(full[x]["coefficient"], rel=1e-9)
    direct = by_name(corr.partial_correlations(lineitem, "l_extendedprice", "l_quantity", ["l_discount", "l_tax"]))
    assert direct["l_quantity"]["correlation"] == pytest.approx(partial["l_quantity"]["partial_r"], rel=1e-9)


def test_bundles_have_all_tables(lineitem):
    xs = ["l_quantity", "l_tax"]
    assert set(regress(lineitem, "l_extendedprice", xs, by="l_linestatus")) == {"summary", "coefficients", "vif", "heteroskedasticity", "reset", "residuals"}
    assert all(t.count() > 0 for t in linktest(lineitem, "l_extendedprice", xs).values())
    tables = goodness_of_fit(lineitem, "l_extendedprice", xs, order_by=["l_orderkey"])
    assert all(t.count() == 1 for t in tables.values())


def test_zero_outcomes_stay_out_of_relative_errors(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 4.0)], "y double, f double")
    out = one(error_metrics(df, "y", "f"))
    assert out["mape_pct"] == pytest.approx(25) and out["hit_rate_5"] == 50 and out["mae"] == pytest.approx(2 / 3)


def test_shapiro_weights_and_published_example(spark):
    for n in (3, 5, 11, 50, 5000, 20_000):
        weights = [block_weight(i, 1, n) for i in range(n)] if n <= 5000 else None
        if weights:
            assert sum(weights) == pytest.approx(0, abs=1e-9)
            assert sum(w * w for w in weights) == pytest.approx(1, abs=1e-6)
        # a block of tied ranks weighs as much as its ranks one by one
        assert block_weight(0, n, n) == pytest.approx(0, abs=1e-7)
    assert block_weight(4000, 9000, 20_000) == pytest.approx(sum(block_weight(i, 1, 20_000) for i in range(4000, 13_000)), rel=1e-8)
    assert weight_constants(10)[0] == pytest.approx(0.5739, abs=2e-4)
    # weights of eleven men, the example of Shapiro and Wilk (1965)
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    out = one(shapiro_wilk(spark.createDataFrame([(float(v),) for v in men], "x double"), "x"))
    assert out["w_stat"] == pytest.approx(0.79, abs=0.005)
    assert not out["normal"] and out["p_value"] < 0.01


def test_best_model_takes_highest_r2(lineitem):
    table = MC.information_criteria(lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    r2 = {r["model"]: r["r2"] for r in table.collect()}
    best = by_name(MC.best_models(table), "criterion")
    assert best["R2"]["model"] == max(r2, key=r2.get)


def test_marginal_curve_follows_slope(lineitem):
    slope = by_name(Regression(lineitem, "l_extendedprice", ["l_quantity", "l_tax"]).coefficients())["l_quantity"]["coefficient"]
    rows = marginal_curves(lineitem, "l_extendedprice", ["l_quantity", "l_tax"]).filter("variable = 'l_quantity'").orderBy("point").collect()
    assert len(rows) == 50
    assert (rows[-1]["fitted"] - rows[0]["fitted"]) / (rows[-1]["x"] - rows[0]["x"]) == pytest.approx(slope, rel=1e-9)


@pytest.fixture(scope="module")
def small_panel(spark):
    rows = [(1, 1, 2.0, 1.0), (1, 3, 5.0, 2.5), (2, 1, 1.0, 0.5), (2, 2, 4.0, 1.0), (2, 4, 3.0, 3.0)]
    rows += [(3, t, 1.5 * t + (t % 2), float(t * t) / 3) for t in range(1, 6)]
    return spark.createDataFrame(rows, "id int, t int, y double, x double")


def test_panel_against_pandas(small_panel):
    pdf = small_panel.toPandas()
    p = P.Panel(small_panel, "y", "x", "id", "t", min_rows=5)
    d = pdf[["y", "x"]] - pdf.groupby("id")[["y", "x"]].transform("mean")
    assert p.fixed.beta[0] == pytest.approx((d.x @ d.y) / (d.x @ d.x))
    m = pdf.groupby("id")[["y", "x"]].mean()
    assert p.between.beta[0] == pytest.approx(np.polyfit(m.x, m.y, 1)[0])
    f = pdf.sort_values(["id", "t"]).groupby("id")[["y", "x"]].diff().dropna()
    assert p.first_difference.beta[0] == pytest.approx(np.polyfit(f.x, f.y, 1)[0])
    assert p.pooled.beta[0] == pytest.approx(np.polyfit(pdf.x, pdf.y, 1)[0])
    theta = p.random.theta
    q = pdf[["y", "x"]] - theta * pdf.groupby("id")[["y", "x"]].transform("mean")
    assert p.random.fit.beta[0] == pytest.approx((q.x @ q.y) / (q.x @ q.x))
    total = p.moments.total
    assert total.comoment[1, 1] == pytest.approx(((pdf.x - pdf.x.mean()) ** 2).sum())


def test_large_levels_keep_their_digits(small_panel):
    shifted = small_panel.withColumn("y", F.col("y") + 1e9).withColumn("x", F.col("x") - 1e9)
    a = P.Panel(small_panel, "y", "x", "id", "t", min_rows=5)
    b = P.Panel(shifted, "y", "x", "id", "t", min_rows=5)
    assert b.fixed.beta[0] == pytest.approx(a.fixed.beta[0], rel=1e-5)
    assert b.between.beta[0] == pytest.approx(a.between.beta[0], rel=1e-5)


def test_singular_panel(sample):
    p = P.Panel(sample, "y", ["x1", "x2"], "id", "time")
    assert p.fixed.omitted == [False, True]
    s = one(p.structure())
    assert s["balanced"] and s["entities"] == 6 and s["periods"] == 5
    assert p.hausman().count() == 1


def test_leftover_rows_join_the_last_block(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    rows = P.with_panel_ids(df, "k", 5).collect()
    assert len({(r["entity_id"], r["time_id"]) for r in rows}) == 23
    assert sum(r["entity_id"] == 4 for r in rows) == 7


def test_one_way_absorption_is_the_within_estimator(small_panel):
    a = Absorption(small_panel, "y", "x", "id", min_rows=5)
    p = P.Panel(small_panel, "y", "x", "id", "t", min_rows=5)
    assert a.fit.beta[0] == pytest.approx(p.fixed.beta[0])
    assert a.fit.ssr == pytest.approx(p.fixed.ssr)


@pytest.mark.parametrize("fe", [["g", "h"], ["g", "h", "k"]])
def test_multi_way_absorption_matches_dummies(spark, fe):
    rng = np.random.default_rng(5)
    n = 240
    pdf = pd.DataFrame({"g": rng.integers(0, 7, n), "h": rng.integers(0, 5, n), "k": rng.integers(0, 4, n), "x": rng.normal(size=n)})
    pdf["x"] += 0.4 * pdf.g - 0.2 * pdf.h
    pdf["y"] = 1.7 * pdf.x + pdf.g - 2 * pdf.h + 0.5 * pdf.k + rng.normal(size=n)
    a = Absorption(spark.createDataFrame(pdf), "y", "x", fe)
    design = np.column_stack([pdf.x, np.ones(n), pd.get_dummies(pdf[fe].astype(str), drop_first=True).to_numpy(float)])
    beta, ssr, *_ = np.linalg.lstsq(design, pdf.y.to_numpy(), rcond=None)
    assert a.fit.beta[0] == pytest.approx(beta[0], rel=1e-6)
    assert a.fit.ssr == pytest.approx(ssr[0], rel=1e-6)


def test_two_stage_matches_numpy(spark):
    rng = np.random.default_rng(9)
    n = 300
    z1, z2, c, u = rng.normal(size=(4, n))
    x = 0.8 * z1 - 0.5 * z2 + 0.3 * c + u
    y = 2 * x + c + 1.5 * u + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "z1": z1, "z2": z2, "c": c}))
    ones = np.ones(n)
    zz, xx = np.column_stack([ones, z1, z2, c]), np.column_stack([ones, x, c])
    proj = zz @ np.linalg.lstsq(zz, xx, rcond=None)[0]
    b = np.linalg.solve(proj.T @ xx, proj.T @ y)
    resid = y - xx @ b
    se = np.sqrt(np.diag(np.linalg.inv(proj.T @ proj)) * (resid @ resid) / (n - 3))
    iv = InstrumentalVariables(df, "y", "x", ["z1", "z2"], "c")
    out = by_name(iv.coefficients())
    assert [out[k]["coefficient"] for k in ("_cons", "x", "c")] == pytest.approx(b, rel=1e-8)
    assert [out[k]["std_error"] for k in ("_cons", "x", "c")] == pytest.approx(se, rel=1e-8)
    e = resid - zz @ np.linalg.lstsq(zz, resid, rcond=None)[0]
    assert one(iv.overidentification())["sargan"] == pytest.approx(n * (1 - (e @ e) / (resid @ resid)), rel=1e-6)
    assert one(iv.endogeneity())["dwh_stat"] > 10
    assert InstrumentalVariables(df, "y", "x", "z1").overidentification().count() == 0


def test_results_and_csv_round_trip(spark, tmp_path, sample):
    written = save_results({"Panel: data": sample, "Panel data": sample}, str(tmp_path), "csv")
    assert len(set(written.values())) == 2
    back = read_csv(spark, written["Panel: data"])
    assert back.count() == 30 and back.schema["y"].dataType.simpleString() == "double"
    text = read_text_csv(spark, written["Panel data"])
    assert {f.dataType.simpleString() for f in text.schema} == {"string"}
    assert parse_numbers(text).schema["x1"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        save_results({}, str(tmp_path), "html")


def test_absorption_of_weakly_connected_effects(spark):
    """A chain: every firm shares workers only with the next one, so plain sweeps creep."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = [(w, f) for f in range(12) for w in (*range(6 * f, 6 * f + 6), 6 * f + 6) for _ in range(2)]
    pdf = pd.DataFrame(rows, columns=["worker", "firm"])
    pdf["x"] = rng.normal(size=len(pdf)) + 0.3 * pdf["firm"] + 0.01 * pdf["worker"]
    pdf["y"] = 2.0 * pdf["x"] + pdf["firm"] ** 1.5 - 0.2 * pdf["worker"] + rng.normal(size=len(pdf)) * 0.1
    a = Absorption(spark.createDataFrame(pdf), "y", "x", ["worker", "firm"])
    dummies = np.column_stack([pdf["x"], pd.get_dummies(pdf["worker"]).to_numpy(float), pd.get_dummies(pdf["firm"]).to_numpy(float)])
    want = np.linalg.lstsq(dummies, pdf["y"], rcond=None)[0][0]
    assert a.fit.beta[0] == pytest.approx(want, abs=1e-5)
    assert a.sweeps < 60  # plain sweeps need more than 2000


def _chain(rng, groups):
    """Effects in several connected components: levels of ``b`` are shared inside a group only."""
    rows = []
    for g in range(groups):
        for a in range(4 + g):
            for b in rng.choice(5, 3, replace=False):
                rows += [(10 * g + a, 100 * g + int(b), int(rng.integers(0, 3)))] * 2
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"])
    pdf["x"] = rng.normal(size=len(pdf)) + 0.1 * pdf.a
    pdf["y"] = 1.5 * pdf.x + 0.3 * pdf.a - 0.01 * pdf.b + pdf.c + rng.normal(size=len(pdf))
    return pdf


def _rank(pdf, fe):
    return np.linalg.matrix_rank(np.column_stack([pd.get_dummies(pdf[f]).to_numpy(float) for f in fe]))


@pytest.mark.parametrize(
    "way, fe",
    [*[(w, fe) for w in ("matrix", "gradients") for fe in (["a", "b"], ["b", "a"], ["a", "b", "c"], ["a", "a2"])], ("joins", ["a", "b"]), ("joins", ["a", "b", "c"])],
)
def test_absorbed_parameters_are_the_rank_of_the_dummies(spark, monkeypatch, way, fe):
    from econspark.operators import absorb
    from econspark.plans import effects

    if way != "matrix":
        monkeypatch.setattr(effects, "DENSE", 0)
    if way == "joins":
        monkeypatch.setattr(absorb, "BROADCAST_LEVELS", 0)
    pdf = _chain(np.random.default_rng(11), 4)
    pdf["a2"] = pdf.a // 2  # a nested effect
    a = Absorption(spark.createDataFrame(pdf).repartition(5), "y", "x", fe)
    dummies = np.column_stack([pd.get_dummies(pdf[f]).to_numpy(float) for f in fe])
    design = np.column_stack([pdf.x, dummies])
    beta, *_ = np.linalg.lstsq(design, pdf.y, rcond=None)
    ssr = float(((pdf.y - design @ beta) ** 2).sum())
    assert a.absorbed_parameters == _rank(pdf, fe)
    assert a.dof_exact == (len(fe) == 2 or way == "matrix")
    assert a.fit.beta[0] == pytest.approx(beta[0], abs=1e-6) and a.fit.ssr == pytest.approx(ssr, rel=1e-6)
    dof = one(a.degrees_of_freedom())
    assert dof["df_resid"] == len(pdf) - _rank(pdf, fe) - 1 and dof["levels"] == sum(pdf[f].nunique() for f in fe)


def test_packed_cells_keep_levels_whole(spark, monkeypatch):
    from econspark.plans import effects

    monkeypatch.setattr(effects, "PACK", 8)
    monkeypatch.setattr(effects, "PIECE", 7)
    pdf = _chain(np.random.default_rng(4), 6)
    design = np.column_stack([pdf.x, pd.get_dummies(pdf.a).to_numpy(float), pd.get_dummies(pdf.b).to_numpy(float)])
    beta, *_ = np.linalg.lstsq(design, pdf.y, rcond=None)
    for dense in (1024, 0):
        monkeypatch.setattr(effects, "DENSE", dense)
        a = Absorption(spark.createDataFrame(pdf).repartition(3), "y", "x", ["a", "b"])
        assert a.fit.beta[0] == pytest.approx(beta[0], abs=1e-6)
        assert a.absorbed_parameters == _rank(pdf, ["a", "b"])


def test_one_read_counts_every_column(spark):
    rng = np.random.default_rng(2)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pdf = pd.DataFrame({f"c{i}": rng.integers(0, i + 1, 300).astype(float) for i in range(500)})
    pdf.iloc[::7, 3] = np.nan
    pdf.iloc[:, 4] = -0.0
    pdf.iloc[0, 4] = 0.0
    df = spark.createDataFrame(pdf)
    df = df.mapInArrow(counted, df.schema)
    out = by_name(D.describe(df))
    assert seen.value == 300
    assert all(out[c]["unique"] == pdf[c].nunique() and out[c]["non_null"] == pdf[c].count() for c in pdf)
    assert out["c4"]["unique"] == 1 and out["c3"]["nulls"] == 43
    empty = by_name(D.describe(df.where("false").select("c1", "c2")))
    assert {(r["unique"], r["non_null"], r["nulls"]) for r in empty.values()} == {(0, 0, 0)}
    nested = D.describe(spark.createDataFrame([([1], "a"), (None, "a")], "x array<int>, s string"))
    assert {(r["variable"], r["non_null"], r["unique"]) for r in nested.collect()} == {("x", 1, None), ("s", 2, 1)}


def test_density_is_the_kernel_sum(spark):
    from econspark.operators.plotdata import density

    rng = np.random.default_rng(8)
    for values in (np.append(rng.normal(size=3000), 1e4), np.concatenate([rng.normal(0, 1e-3, 2000), rng.normal(50, 1e-3, 2000)]), rng.lognormal(0, 2, 5000), np.array([1.0, 1.0, 2.0])):
        got = sorted(density(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").collect())
        width = values.std(ddof=1) * len(values) ** -0.2
        x = np.linspace(values.min() - 3 * width, values.max() + 3 * width, 100)
        want = np.exp(-(((x[:, None] - values) / width) ** 2) / 2).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi))
        assert np.allclose([r["x"] for r in got], x) and np.allclose([r["density"] for r in got], want, rtol=1e-6, atol=1e-12 * want.max())
    assert density(spark.createDataFrame([(1.0,)], "v double"), "v").count() == 0


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "orc"])
def test_report_is_whole_or_not_there(spark, sample, tmp_path, format):
    path = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        read_report(spark, path)
    table, few = sample.select("id", "t" if "t" in sample.columns else "time", "y"), sample.select("group").limit(3)
    broken = table.withColumn("y", F.expr("CAST(raise_error('stop') AS DOUBLE)"))
    with pytest.raises(Exception, match="stop"):
        save_report({"First": table, "Broken": broken}, path, format)
    with pytest.raises(FileNotFoundError):
        read_report(spark, path)
    save_report({"All rows": table, "Few: rows": few}, path, format)
    with pytest.raises(Exception, match="stop"):
        save_report({"All rows": few, "Broken": broken}, path, format)
    back = read_report(spark, path)
    assert list(back) == ["All rows", "Few: rows"] and back["Few: rows"].count() == 3
    assert sorted(float(r["y"]) for r in back["All rows"].collect()) == pytest.approx(sorted(r["y"] for r in table.collect()))
    save_report({"Few: rows": few}, path, format)
    assert list(read_report(spark, path)) == ["Few: rows"]
    assert len([p for p in (tmp_path / "report").iterdir() if p.name.startswith("run-")]) == 1


def test_rows_collapse_to_cells_in_their_tasks(spark, monkeypatch):
    """One exchange of cells, small windows and packs, and a level of the largest effect that has most rows."""
    from econspark.operators import absorb
    from econspark.plans import effects

    plans = []
    cut = effects.cut_lineage
    monkeypatch.setattr(effects, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    monkeypatch.setattr(effects, "WINDOW", 400)
    monkeypatch.setattr(effects, "PACK", 60)
    monkeypatch.setattr(absorb, "BROADCAST_LEVELS", 10)  # 30 levels of two columns still travel as numbers
    monkeypatch.setattr(absorb.Absorption, "_sweep_by_joins", None)
    rng = np.random.default_rng(8)
    n = 6000
    pdf = pd.DataFrame({"a": np.where(rng.random(n) < 0.6, 3, rng.integers(0, 40, n)), "b": rng.integers(0, 30, n)})
    pdf["x"] = rng.normal(size=n) + 0.1 * pdf.b
    pdf["y"] = 1e4 + 2 * pdf.x + pdf.a - 3 * pdf.b + rng.normal(size=n)
    dummies = np.column_stack([pdf.x, pd.get_dummies(pdf.a).astype(float), pd.get_dummies(pdf.b).astype(float)])
    want, _, rank, _ = np.linalg.lstsq(dummies, pdf.y - 1e4, rcond=None)
    left = pdf.y - 1e4 - dummies @ want
    for kind in ("bigint", "string", "double"):
        a = absorb.Absorption(spark.createDataFrame(pdf).withColumn("a", F.col("a").cast(kind)).repartition(2), "y", "x", ["a", "b"])
        assert np.isclose(a.fit.beta[0], want[0], rtol=1e-9) and np.isclose(a.fit.ssr, (left**2).sum(), rtol=1e-9)
        assert a.absorbed_parameters + 1 == rank
    assert len(plans) == 3 and all(p.count("Exchange hashpartitioning(g") == 1 and "covar" not in p for p in plans)


def test_packed_rows_lie_in_small_row_groups(spark, monkeypatch):
    """A task's cells are not one page or row group, which would be held whole on writing and in every read; a balanced table has a plain solution."""
    import pyarrow.parquet as pq

    from econspark.operators.absorb import Absorption
    from econspark.plans import effects

    written = []
    cut = effects.cut_lineage
    monkeypatch.setattr(effects, "cut_lineage", lambda df: (written.append(cut(df)), written[-1])[1])
    monkeypatch.setattr(effects, "PACK", 1 << 15)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        k, m = 40_000, 50
        df = spark.range(k * m).selectExpr(f"id div {m} AS a", f"id % {m} AS b", "sin(id) AS x", "sin(id) + cos(id * id) AS y")
        got = Absorption(df, "y", "x", ["a", "b"]).summary().first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    i = np.arange(k * m).reshape(k, m)
    x, y = ((z - z.mean(0) - z.mean(1, keepdims=True) + z.mean()).ravel() for z in (np.sin(i), np.sin(i) + np.cos(i * i)))
    ssr = y @ y - (x @ y) ** 2 / (x @ x)
    assert got["n"] == k * m and got["levels_absorbed"] == k + m - 2
    assert np.isclose(got["ssr"], ssr, rtol=1e-9) and np.isclose(got["r2_within"], 1 - ssr / (y @ y), rtol=1e-9)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written[0].inputFiles()]
    sizes = [g.row_group(j).total_byte_size for g in groups for j in range(g.num_row_groups)]
    assert sum(sizes) > 16 * k * m and max(sizes) < 20 << 20
