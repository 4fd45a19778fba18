"""Panel estimators and absorbed fixed effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.descriptive import li
from catalog.sqlgen import Entry, chi2_sf, coefficient_union, entry, f_sf, norm_sf, ols_sql, t_two_sided, table
from econspark.operators import panel as P
from econspark.operators.absorb import Absorption
from econspark.operators.ols import Regression

Y, XS = "o_totalprice", ["qty", "disc"]
PANEL = (
    "(SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, qty, disc FROM orders JOIN "
    "(SELECT l_orderkey, sum(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"
)
COEF = dict(plain=["position", "variable"], sig=["coefficient", "std_error", "t_stat"], prob=["p_value"], digits=5, places=5)
FULL = COEF | {"sig": ["coefficient", "std_error", "t_stat", "ci_lower", "ci_upper"]}


def orders_panel(s: SparkSession, d: str) -> DataFrame:
    lines = li(s, d).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    return table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def panel(s: SparkSession, d: str) -> P.Panel:
    return P.Panel(orders_panel(s, d), Y, XS, "o_custkey", ["o_orderdate", "o_orderkey"])


def within(source: str, cols, g: str) -> str:
    return "SELECT " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {g}) AS {c}" for c in cols) + f" FROM {source}"


def means(source: str, cols, g: str) -> str:
    return "SELECT " + ", ".join(f"avg({c}) AS {c}" for c in cols) + f" FROM {source} GROUP BY {g}"


FE = ols_sql(within(PANEL, [Y, *XS], "o_custkey"), Y, XS, const=False, prefix="fe")
THETA = (
    ols_sql(means(PANEL, [Y, *XS], "o_custkey"), Y, XS, const=False, prefix="bw")
    + f", th AS (SELECT 1 - sqrt(se / (se + t * su)) AS theta, su AS sigma_u, se AS sigma_e FROM (SELECT ssr / (n - 2) AS su FROM bw), "
    f"(SELECT avg(pow(v, 2)) AS se FROM (SELECT {Y} - avg({Y}) OVER (PARTITION BY o_custkey) AS v FROM {PANEL})), "
    f"(SELECT count(*) * 1.0 / count(DISTINCT o_custkey) AS t FROM {PANEL}))"
)
QUASI = "SELECT " + ", ".join(f"{c} - theta * avg({c}) OVER (PARTITION BY o_custkey) AS {c}" for c in [Y, *XS]) + f" FROM {PANEL}, th"
RE = THETA + ", " + ols_sql(QUASI, Y, XS, const=False, prefix="re")
DIFFS = (
    "SELECT * FROM (SELECT " + ", ".join(f"{c} - lag({c}) OVER w AS {c}" for c in [Y, *XS])
    + f" FROM {PANEL} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE {Y} IS NOT NULL"
)


def adjusted(base: str, dof: str, small: str) -> str:
    """``base`` with errors rescaled from ``small`` to ``dof`` residual degrees of freedom."""
    t = "(t_stat / sqrt(small / dof2))"
    return (
        f"SELECT *, std_error * sqrt(small / dof2) AS std_error_dfadj, {t} AS t_dfadj, {t_two_sided(t, 'dof2')} AS p_dfadj "
        f"FROM (SELECT *, ({small})::DOUBLE AS small, ({dof})::DOUBLE AS dof2 FROM ({base}))"
    )


def fixed_sql() -> str:
    dof = f"(SELECT n - 2 FROM fe) - (SELECT count(DISTINCT o_custkey) FROM {PANEL})"
    return f"WITH {FE} {adjusted(coefficient_union(XS, 'fe', const=False), dof, '(SELECT n - 2 FROM fe)')}"


def hausman_sql() -> str:
    parts = (
        "SELECT fe.b_1 - re.b_1 AS d1, fe.b_2 - re.b_2 AS d2, "
        + ", ".join(f"fe.ssr / (fe.n - 2) * fe.v_{i}_{j} - re.ssr / (re.n - 2) * re.v_{i}_{j} AS g{i}{j}" for i, j in ((1, 1), (1, 2), (2, 2)))
        + " FROM fe, re"
    )
    stat = "((d1 * d1 * g22 - 2 * d1 * d2 * g12 + d2 * d2 * g11) / (g11 * g22 - g12 * g12))"
    return (
        f"WITH {FE}, {RE} SELECT {stat} AS chi2_stat, 2 AS df, {chi2_sf(f'greatest({stat}, 0.0)', '2')} AS p_value, "
        f"CASE WHEN g11 > 0 AND g11 * g22 - g12 * g12 > 0 THEN 'ok' ELSE 'not_psd' END AS status FROM ({parts})"
    )


def individual_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{x}' AS variable, (fe.b_{i} - re.b_{i}) / sqrt(fe.ssr / (fe.n - 2) * fe.v_{i}_{i} + re.ssr / (re.n - 2) * re.v_{i}_{i}) AS z_stat FROM fe, re"
        for i, x in enumerate(XS, 1)
    )
    return f"WITH {FE}, {RE} SELECT variable, z_stat, 2 * {norm_sf('abs(z_stat)')} AS p_value FROM ({rows})"


def comparison_sql() -> str:
    total = ols_sql(f"SELECT * FROM {PANEL}", Y, XS, prefix="po")
    between = ols_sql(means(PANEL, [Y, *XS], "o_custkey"), Y, XS, prefix="be")
    fd = ols_sql(DIFFS, Y, XS, prefix="fd")

    def row(name: str, prefix: str, const: bool) -> str:
        c = int(const)
        return f"SELECT '{name}' AS model, 1 - ssr / tss AS r2, 1 - (n - {c}.0) / (n - {2 + c}) * ssr / tss AS adj_r2, n FROM {prefix}"

    rows = [
        row("pooled", "po", True), row("fixed", "fe", False), row("random", "re", False), row("between", "be", True), row("first_difference", "fd", True),
    ]
    return f"WITH {total}, {FE}, {RE}, {between}, {fd} " + " UNION ALL ".join(rows)


STRUCTURE_SQL = (
    "SELECT count(*) AS entities, (SELECT count(DISTINCT o_orderdate) FROM orders) AS periods, sum(k)::BIGINT AS rows, min(k) = max(k) AS balanced, avg(k) AS mean_rows, "
    "stddev_samp(k) AS sd_rows, min(k) AS min_rows, quantile_cont(k, 0.25) AS p25, quantile_cont(k, 0.5) AS median, quantile_cont(k, 0.75) AS p75, max(k) AS max_rows "
    "FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey)"
)

# --- six regressors, two of them far from zero: levels of 1e8 and of the entity times 1e6 ---------

YW, XW = "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber", "far", "level"]
WIDE = (
    "(SELECT l_returnflag, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_linenumber::DOUBLE AS l_linenumber, "
    "1e8 + (l_partkey * 7 % 101)::DOUBLE AS far, 1e6 * l_suppkey + (l_orderkey * 3 % 17)::DOUBLE AS level FROM lineitem)"
)


def wide_lines(s: SparkSession, d: str) -> DataFrame:
    rows = li(s, d).withColumns({
        "l_linenumber": F.col("l_linenumber").cast("double"),
        "far": F.lit(1e8) + F.expr("l_partkey * 7 % 101").cast("double"),
        "level": F.lit(1e6) * F.col("l_suppkey") + F.expr("l_orderkey * 3 % 17").cast("double"),
    })
    return rows.select("l_returnflag", "l_suppkey", "l_orderkey", "l_shipdate", YW, *XW)


def wide_panel(s: SparkSession, d: str) -> P.Panel:
    return P.Panel(wide_lines(s, d), YW, XW, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"])


def slopes(df: DataFrame, *keys: str) -> DataFrame:
    return df.filter(F.col("variable").isin(*XW)).select(*keys, "variable", "coefficient", "std_error")


def slopes_sql(ctes: str, prefix: str, const: bool = False, by=()) -> str:
    keys = "".join(f"{k}, " for k in by)
    names = ", ".join(f"'{x}'" for x in XW)
    return f"WITH {ctes} SELECT {keys}variable, coefficient, std_error FROM ({coefficient_union(XW, prefix, const=const, by=by)}) WHERE variable IN ({names})"


FEW = ols_sql(within(WIDE, [YW, *XW], "l_suppkey"), YW, XW, const=False, prefix="fe")
THETAW = (
    ols_sql(means(WIDE, [YW, *XW], "l_suppkey"), YW, XW, const=False, prefix="bw")
    + f", th AS (SELECT 1 - sqrt(se / (se + t * su)) AS theta FROM (SELECT ssr / (n - 6) AS su FROM bw), "
    f"(SELECT avg(pow(v, 2)) AS se FROM (SELECT {YW} - avg({YW}) OVER (PARTITION BY l_suppkey) AS v FROM {WIDE})), "
    f"(SELECT count(*) * 1.0 / count(DISTINCT l_suppkey) AS t FROM {WIDE}))"
)
QUASIW = "SELECT " + ", ".join(f"{c} - theta * avg({c}) OVER (PARTITION BY l_suppkey) AS {c}" for c in [YW, *XW]) + f" FROM {WIDE}, th"
SLOPES = dict(plain=["variable"], sig=["coefficient", "std_error"], digits=5)

# --- absorption on lineitem ---------------------------------------------------------------------

AY, AX = "l_extendedprice", ["l_quantity", "l_discount"]
ONE = ["l_suppkey"]
TWO = ["l_suppkey", "l_partkey"]
SWEEPS = 12


def absorb(s: SparkSession, d: str, fe) -> Absorption:
    return Absorption(li(s, d), AY, AX, fe)


def swept(fe) -> str:
    """Rows with means of each effect removed in turn, often enough to converge."""
    rows = f"SELECT {', '.join(fe)}, {AY}, {', '.join(AX)} FROM lineitem"
    for _ in range(1 if len(fe) == 1 else SWEEPS):
        for f in fe:
            rows = f"SELECT {', '.join(fe)}, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {f}) AS {c}" for c in [AY, *AX]) + f" FROM ({rows})"
    return rows


#: Effects in seven components: a group of lines belongs to the suppliers of one remainder.
PARTED = ["l_suppkey", "line_group"]


def parted_lines(s: SparkSession, d: str) -> DataFrame:
    return li(s, d).withColumn("line_group", F.expr("l_suppkey % 7 * 100 + l_linenumber"))


PARTED_LINES = "(SELECT *, l_suppkey % 7 * 100 + l_linenumber AS line_group FROM lineitem)"
#: Levels of the second effect that a chain of levels of the first one ties together.
PARTED_SQL = f"""e AS (SELECT DISTINCT l_suppkey AS a, line_group AS b FROM {PARTED_LINES}),
tied AS (SELECT x.b AS b, y.b AS c FROM e x JOIN e y USING (a) GROUP BY ALL),
reach AS (SELECT DISTINCT b, b AS c FROM e UNION SELECT reach.b, tied.c FROM reach JOIN tied ON reach.c = tied.b),
parts AS (SELECT count(DISTINCT low) AS k FROM (SELECT b, min(c) AS low FROM reach GROUP BY b)),
d AS (SELECT count(DISTINCT a) + count(DISTINCT b) AS levels, any_value(k) AS redundant FROM e, parts)"""


def parted_dof_sql() -> str:
    return f"""WITH RECURSIVE {PARTED_SQL}, t AS (SELECT count(*) AS n FROM lineitem)
SELECT n, levels, redundant, levels - redundant AS absorbed, {len(AX)}::BIGINT AS slopes, n - levels + redundant - {len(AX)} AS df_resid, TRUE AS exact FROM t, d"""


def parted_coef_sql() -> str:
    rows = f"SELECT {', '.join(PARTED)}, {AY}, {', '.join(AX)} FROM {PARTED_LINES}"
    for _ in range(SWEEPS):
        for f in PARTED:
            rows = f"SELECT {', '.join(PARTED)}, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {f}) AS {c}" for c in [AY, *AX]) + f" FROM ({rows})"
    base = f"SELECT * FROM ({coefficient_union(AX, 'a', dof='(n - 3)')}) WHERE variable <> '_cons'"
    dof = "((SELECT n - 2 FROM a) - (SELECT levels - redundant FROM d))"
    return f"WITH RECURSIVE {PARTED_SQL}, {ols_sql(rows, AY, AX, prefix='a')} {adjusted(base, dof, '(SELECT n - 3 FROM a)')}"


def absorb_coef_sql(fe) -> str:
    levels = " + ".join(f"(SELECT count(DISTINCT {f}) - 1 FROM lineitem)" for f in fe)
    base = f"SELECT * FROM ({coefficient_union(AX, 'a', dof='(n - 3)')}) WHERE variable <> '_cons'"
    dof = f"(SELECT n - 3 FROM a) - ({levels})"
    return f"WITH {ols_sql(swept(fe), AY, AX, prefix='a')} {adjusted(base, dof, '(SELECT n - 3 FROM a)')}"


def absorb_summary_sql(fe) -> str:
    levels = " + ".join(f"(SELECT count(DISTINCT {f}) - 1 FROM lineitem)" for f in fe)
    return (
        f"WITH {ols_sql(swept(fe), AY, AX, prefix='a')} SELECT n, 1 - ssr / tss AS r2_within, 1 - ssr / (SELECT var_pop({AY}) * count(*) FROM lineitem) AS r2_overall, "
        f"({levels})::BIGINT AS levels_absorbed, ssr FROM a"
    )


def absorb_tests_sql() -> str:
    small = ols_sql(f"SELECT {AY}, {', '.join(AX)} FROM lineitem", AY, AX, prefix="s")
    ctes, rows = [small], []
    for i, f in enumerate(TWO):
        ctes.append(ols_sql(within("lineitem", [AY, *AX], f), AY, AX, const=False, prefix=f"w{i}"))
        g = f"(SELECT count(DISTINCT {f}) FROM lineitem)"
        rows.append(f"SELECT '{f}' AS fixed_effect, s.ssr AS ssr_restricted, w{i}.ssr AS ssr_full, {g} - 1 AS df_num, s.n - 2 - {g} AS df_den FROM s, w{i}")
    f_stat = "((ssr_restricted - ssr_full) / df_num / (ssr_full / df_den))"
    return f"WITH {', '.join(ctes)} SELECT *, {f_stat} AS f_stat FROM ({' UNION ALL '.join(rows)})"


def absorb_comparison_sql() -> str:
    small = ols_sql(f"SELECT {AY}, {', '.join(AX)} FROM lineitem", AY, AX, prefix="s")
    rows = " UNION ALL ".join(
        f"SELECT '{x}' AS variable, s.b_{i} AS ols, a.b_{i} AS fixed_effects, s.b_{i} - a.b_{i} AS difference, 100 * (s.b_{i} - a.b_{i}) / s.b_{i} AS percent_change FROM s, a"
        for i, x in enumerate(AX, 1)
    )
    return f"WITH {small}, {ols_sql(swept(ONE), AY, AX, prefix='a')} {rows}"


ABSORB = dict(plain=["variable"], sig=["coefficient", "std_error", "t_stat", "std_error_dfadj", "t_dfadj"], prob=["p_value", "p_dfadj"], digits=5, places=5)


def entries() -> list[Entry]:
    return [
        entry("panel_structure", lambda s, d: P.panel_structure(table(s, d, "orders"), "o_custkey", "o_orderdate"), STRUCTURE_SQL,
              plain=["entities", "periods", "rows", "balanced"], sig=["mean_rows", "sd_rows", "min_rows", "p25", "median", "p75", "max_rows"]),
        entry("rows_per_entity", lambda s, d: P.rows_per_entity(table(s, d, "events"), "user_id"), "SELECT user_id, count(*) AS rows FROM events GROUP BY user_id", plain=["user_id", "rows"]),
        entry(
            "within_transform", lambda s, d: P.demean(table(s, d, "orders"), "o_totalprice", "o_custkey"),
            "SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) AS o_totalprice_within FROM orders",
            plain=["o_orderkey"], prob=["o_totalprice_within"], places=3,
        ),
        entry("xtreg_pooled", lambda s, d: panel(s, d).coefficients("pooled"), f"WITH {ols_sql(f'SELECT * FROM {PANEL}', Y, XS)} {coefficient_union(XS)}", **FULL),
        entry("xtreg_fixed", lambda s, d: panel(s, d).coefficients("fixed"), fixed_sql(),
              plain=["position", "variable"], sig=["coefficient", "std_error", "t_stat", "std_error_dfadj", "t_dfadj"], prob=["p_value", "p_dfadj"], digits=5, places=5),
        entry("xtreg_random", lambda s, d: panel(s, d).coefficients("random"), f"WITH {RE} {coefficient_union(XS, 're', const=False)}", **FULL),
        entry("xtreg_between", lambda s, d: panel(s, d).coefficients("between"), f"WITH {ols_sql(means(PANEL, [Y, *XS], 'o_custkey'), Y, XS)} {coefficient_union(XS)}", **FULL),
        entry("xtreg_first_difference", lambda s, d: panel(s, d).coefficients("first_difference"), f"WITH {ols_sql(DIFFS, Y, XS)} {coefficient_union(XS)}", **FULL),
        entry("xtreg_random_parameters", lambda s, d: panel(s, d).random_parameters(), f"WITH {THETA} SELECT theta, sigma_u, sigma_e FROM th", sig=["theta", "sigma_u", "sigma_e"], digits=7),
        entry("xtreg_comparison", lambda s, d: panel(s, d).comparison(), comparison_sql(), plain=["model", "n"], prob=["r2", "adj_r2"]),
        entry("hausman_test", lambda s, d: panel(s, d).hausman(), hausman_sql(), plain=["df", "status"], sig=["chi2_stat"], prob=["p_value"], digits=4),
        entry("hausman_individual", lambda s, d: panel(s, d).hausman_individual(), individual_sql(), plain=["variable"], sig=["z_stat"], prob=["p_value"], digits=6),
        entry(
            "hausman_differences", lambda s, d: panel(s, d).coefficient_differences(),
            f"WITH {FE}, {RE} " + " UNION ALL ".join(
                f"SELECT '{x}' AS variable, fe.b_{i} AS fixed, re.b_{i} AS random, fe.b_{i} - re.b_{i} AS difference FROM fe, re" for i, x in enumerate(XS, 1)
            ),
            plain=["variable"], sig=["fixed", "random", "difference"], digits=5,
        ),
        entry("areg_one_way", lambda s, d: absorb(s, d, ONE).coefficients(), absorb_coef_sql(ONE), **ABSORB),
        entry("areg_two_way", lambda s, d: absorb(s, d, TWO).coefficients(), absorb_coef_sql(TWO), **(ABSORB | {"digits": 4, "places": 4})),
        entry("areg_two_way_dof", lambda s, d: Absorption(parted_lines(s, d), AY, AX, PARTED).degrees_of_freedom(), parted_dof_sql(),
              plain=["n", "levels", "redundant", "absorbed", "slopes", "df_resid", "exact"]),
        entry("areg_two_way_parted", lambda s, d: Absorption(parted_lines(s, d), AY, AX, PARTED).coefficients(), parted_coef_sql(), **(ABSORB | {"digits": 4, "places": 4})),
        entry("areg_summary", lambda s, d: absorb(s, d, ONE).summary(), absorb_summary_sql(ONE), plain=["n", "levels_absorbed"], sig=["ssr"], prob=["r2_within", "r2_overall"], digits=7),
        entry("areg_two_way_summary", lambda s, d: absorb(s, d, TWO).summary(), absorb_summary_sql(TWO), plain=["n", "levels_absorbed"], sig=["ssr"], prob=["r2_within", "r2_overall"], digits=6),
        entry(
            "areg_structure", lambda s, d: absorb(s, d, TWO).structure(),
            " UNION ALL ".join(f"SELECT '{f}' AS fixed_effect, count(DISTINCT {f}) AS levels, count(*) AS rows, count(*) * 1.0 / count(DISTINCT {f}) AS rows_per_level, count(DISTINCT {f}) > 50 AS high_dimensional FROM lineitem" for f in TWO),
            plain=["fixed_effect", "levels", "rows", "high_dimensional"], sig=["rows_per_level"],
        ),
        entry("areg_tests", lambda s, d: absorb(s, d, TWO).tests(), absorb_tests_sql(),
              plain=["fixed_effect", "df_num", "df_den"], sig=["f_stat", "ssr_restricted", "ssr_full"], digits=6),
        entry(
            "areg_test_p_value", lambda s, d: absorb(s, d, ONE).tests(),
            f"SELECT *, {f_sf('f_stat', 'df_num', 'df_den')} AS p_value FROM ({absorb_tests_sql()}) WHERE fixed_effect = 'l_suppkey'",
            plain=["fixed_effect", "df_num", "df_den"], prob=["p_value"], places=5,
        ),
        entry("areg_comparison", lambda s, d: absorb(s, d, ONE).comparison(), absorb_comparison_sql(), plain=["variable"],
              sig=["ols", "fixed_effects", "difference", "percent_change"], digits=5),
        entry("xtreg_fixed_wide", lambda s, d: slopes(wide_panel(s, d).coefficients("fixed")), slopes_sql(FEW, "fe"), **SLOPES),
        entry("xtreg_random_wide", lambda s, d: slopes(wide_panel(s, d).coefficients("random")).drop("std_error"),
              f"SELECT variable, coefficient FROM ({slopes_sql(THETAW + ', ' + ols_sql(QUASIW, YW, XW, const=False, prefix='re'), 're')})", plain=["variable"], sig=["coefficient"], digits=4),
        entry("areg_one_way_wide", lambda s, d: slopes(Absorption(wide_lines(s, d), YW, XW, ["l_suppkey"]).coefficients()).drop("std_error"),
              f"SELECT variable, coefficient FROM ({slopes_sql(FEW, 'fe')})", plain=["variable"], sig=["coefficient"], digits=5),
        entry("regress_by_wide", lambda s, d: slopes(Regression(wide_lines(s, d), YW, XW, by="l_returnflag").coefficients(), "l_returnflag"),
              slopes_sql(ols_sql(f"SELECT * FROM {WIDE}", YW, XW, by=["l_returnflag"], prefix="o"), "o", True, ["l_returnflag"]),
              plain=["l_returnflag", "variable"], sig=["coefficient", "std_error"], digits=5),
    ]
