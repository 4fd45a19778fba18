"""Binning, grouped summaries, collapse, group tests, correlation, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.descriptive import HOLED, MEASURES, holed_orders, li
from catalog.regression import FLAG, per_flag
from catalog.sqlgen import Entry, chi2_sf, entry, f_sf, norm_sf, ols_sql, sample_key, t_two_sided, table
from econspark.operators import corr as C, group_tests as GT, groups as G, panel as P
from econspark.plans import ranks

SUMMARY_COLS = ["mean", "sd", "min", "max", "median", "p25", "p75", "iqr", "cv_pct"]


def grouped_sql(source: str, group: str, var: str) -> str:
    return (
        f"SELECT {group} AS \"group\", count({var}) AS group_size, count({var}) AS n, avg({var}) AS mean, stddev_samp({var}) AS sd, "
        f"min({var}) AS min, max({var}) AS max, quantile_cont({var}, 0.5) AS median, quantile_cont({var}, 0.25) AS p25, "
        f"quantile_cont({var}, 0.75) AS p75, quantile_cont({var}, 0.75) - quantile_cont({var}, 0.25) AS iqr, "
        f"100.0 * stddev_samp({var}) / avg({var}) AS cv_pct FROM {source} WHERE {group} IS NOT NULL AND {var} IS NOT NULL GROUP BY {group}"
    )


def qcut_sql(source: str, col: str, q: int, label: str = "'Q' || bin", keep: str = "*") -> str:
    """Rows of ``source`` with ``bin`` (count of distinct edges below the value, at least 1) and ``label``."""
    edges = f"(SELECT list_distinct(quantile_cont({col}, [{', '.join(str(i / q) for i in range(q + 1))}])) AS e FROM {source})"
    return (
        f"(SELECT *, {label} AS label FROM (SELECT {keep}, greatest(1, len(list_filter(e, lambda v: v < {col}))) AS bin "
        f"FROM {source} AS src, {edges} AS edges WHERE {col} IS NOT NULL))"
    )


def cut_sql(source: str, col: str, bins: int) -> str:
    return (
        f"(SELECT *, 'Bin_' || bin AS label FROM (SELECT *, CAST(least({bins}, greatest(1, ceil(({col} - lo) / ((hi - lo) / {bins})))) AS INT) AS bin "
        f"FROM {source} AS src, (SELECT min({col}) AS lo, max({col}) AS hi FROM {source}) AS edges WHERE {col} IS NOT NULL))"
    )


TERCILE = "CASE bin WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END"


def tied_part(s: SparkSession, d: str) -> DataFrame:
    """A column in which half of the rows share one value."""
    return table(s, d, "part").select(
        "p_retailprice", F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(F.col("p_size")).alias("tied")
    )


TIED = "(SELECT p_retailprice, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE p_size END AS tied FROM part)"
KEYS = ["o_orderstatus", "o_orderpriority"]

COLLAPSE_SQL = (
    "SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS mean_o_totalprice, sum(o_totalprice) AS sum_o_totalprice, "
    "count(o_totalprice) AS count_o_totalprice, stddev_samp(o_totalprice) AS std_o_totalprice, min(o_totalprice) AS min_o_totalprice, "
    "max(o_totalprice) AS max_o_totalprice, quantile_cont(o_totalprice, 0.5) AS median_o_totalprice FROM orders GROUP BY ALL"
)
MEANS_SQL = "(SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS mean_o_totalprice FROM orders GROUP BY ALL)"


def stats_long(source: str, col: str, name: str) -> str:
    return (
        f"(UNPIVOT (SELECT count({col})::DOUBLE AS count, avg({col}) AS mean, stddev_samp({col}) AS sd, min({col})::DOUBLE AS min, "
        f"quantile_cont({col}, 0.25) AS p25, quantile_cont({col}, 0.5) AS p50, quantile_cont({col}, 0.75) AS p75, max({col})::DOUBLE AS max FROM {source}) "
        f"ON count, mean, sd, min, p25, p50, p75, max INTO NAME statistic VALUE {name})"
    )


def anova_sql(source: str, g: str, v: str) -> str:
    return (
        f"SELECT *, (ss_between / df_between) / (ss_within / df_within) AS f_stat, ss_between / (ss_between + ss_within) AS eta_squared, "
        f"{f_sf('(ss_between / df_between) / (ss_within / df_within)', 'df_between', 'df_within')} AS p_value FROM ("
        f"SELECT count(*) AS groups, sum(n)::BIGINT AS n, sum(n * pow(m - gm, 2)) AS ss_between, sum(w) AS ss_within, count(*) - 1 AS df_between, "
        f"(sum(n) - count(*))::BIGINT AS df_within FROM (SELECT count({v}) AS n, avg({v}) AS m, var_pop({v}) * count({v}) AS w FROM {source} GROUP BY {g}), "
        f"(SELECT avg({v}) AS gm FROM {source}))"
    )


def ranked(source: str, g: str, v: str) -> str:
    return (
        f"(SELECT {g} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {v}) AS t FROM {source})"
    )


def kruskal_sql(source: str, g: str, v: str) -> str:
    h = "(12.0 / (n * (n + 1.0)) * spread / (1 - ties / (pow(n, 3) - n)))"
    return (
        f"SELECT groups, n, groups - 1 AS df, {h} AS h_stat, {chi2_sf(h, 'groups - 1')} AS p_value FROM (SELECT count(*) AS groups, sum(k)::BIGINT AS n, "
        f"sum(k * pow(rm - (total + 1) / 2.0, 2)) AS spread, sum(tp) AS ties FROM (SELECT g, count(*) AS k, avg(r) AS rm, sum(pow(t, 2) - 1.0) AS tp FROM {ranked(source, g, v)} GROUP BY g), "
        f"(SELECT count(*) AS total FROM {source}))"
    )


def t_sql(source: str, g: str, v: str) -> str:
    return (
        f"SELECT *, {t_two_sided('t_stat', 'df')} AS p_value FROM (SELECT group_a, group_b, n_a, n_b, n_a + n_b - 2 AS df, "
        "(m_a - m_b) / sqrt((w_a + w_b) / (n_a + n_b - 2)) / sqrt(1.0 / n_a + 1.0 / n_b) AS t_stat, (m_a - m_b) / sqrt((w_a + w_b) / (n_a + n_b - 2)) AS cohens_d FROM "
        f"(SELECT min({g}) AS group_a, max({g}) AS group_b FROM {source}), "
        f"(SELECT count(*) AS n_a, avg({v}) AS m_a, var_pop({v}) * count(*) AS w_a FROM {source} WHERE {g} = (SELECT min({g}) FROM {source})), "
        f"(SELECT count(*) AS n_b, avg({v}) AS m_b, var_pop({v}) * count(*) AS w_b FROM {source} WHERE {g} = (SELECT max({g}) FROM {source})))"
    )


def mann_whitney_sql(source: str, g: str, v: str) -> str:
    z = "((greatest(u, na * nb - u) - na * nb / 2.0 - 0.5) / sqrt(na * nb / 12.0 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1.0)))))"
    return (
        f"SELECT group_a, group_b, na::BIGINT AS n_a, nb::BIGINT AS n_b, u AS u_stat, {z} AS z_stat, least(na, nb) <= 8 AND ties = 0 AS exact, least(1.0, 2 * {norm_sf(z)}) AS p_value FROM ("
        f"SELECT min(g) AS group_a, max(g) AS group_b, (count(*) FILTER (g = lo))::DOUBLE AS na, (count(*) FILTER (g = hi))::DOUBLE AS nb, "
        f"sum(r) FILTER (g = lo) - count(*) FILTER (g = lo) * (count(*) FILTER (g = lo) + 1) / 2.0 AS u, sum(pow(t, 2) - 1.0) AS ties "
        f"FROM {ranked(source, g, v)}, (SELECT min({g}) AS lo, max({g}) AS hi FROM {source}))"
    )


#: The first seven suppliers against all others, without ties.
FEW_SUPPLIERS = "(SELECT CASE WHEN s_suppkey <= 7 THEN 'first' ELSE 'other' END AS part, CAST(s_acctbal AS DOUBLE) + s_suppkey / 1e7 AS balance FROM supplier)"
#: U is the sum of seven whole numbers from 0 to the size of the larger group, in any order: how many ways there are for each sum,
#: by the value of the number added next.
EXACT_SQL = f"""WITH RECURSIVE t AS (SELECT * EXCLUDE (p_value) FROM ({mann_whitney_sql(FEW_SUPPLIERS, 'part', 'balance')})),
size AS (SELECT least(n_a, n_b) AS a, greatest(n_a, n_b) AS b, CAST(n_a * n_b - greatest(u_stat, n_a * n_b - u_stat) AS BIGINT) AS low FROM t),
ways AS (
  SELECT CAST(0 AS BIGINT) AS v, CAST(m AS BIGINT) AS used, CAST(0 AS BIGINT) AS total, CAST(1 AS HUGEINT) AS k FROM size, range(0, a + 1) AS r(m)
  UNION ALL
  SELECT v + 1, used + m, total + m * (v + 1), CAST(sum(k) AS HUGEINT) FROM ways, size, range(0, a - used + 1) AS r(m) WHERE v < b GROUP BY 1, 2, 3)
SELECT t.*, least(1.0, (SELECT 2.0 * sum(k) FILTER (total <= low) / sum(k) FROM ways, size WHERE v = b AND used = a)) AS p_value FROM t"""

PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
MARK = "CASE WHEN abs(r) >= 0.7 THEN '***' WHEN abs(r) >= 0.5 THEN '**' WHEN abs(r) >= 0.3 THEN '*' ELSE '' END"
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, regr_count({a}, {b})::BIGINT AS n, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS
)
MATRIX_SQL = (
    f"SELECT var1, var2, r FROM ({CORR_SQL}) UNION ALL SELECT var2, var1, r FROM ({CORR_SQL}) UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in MEASURES)
)


def few_suppliers(s: SparkSession, d: str) -> DataFrame:
    part, balance = F.when(F.col("s_suppkey") <= 7, "first").otherwise("other"), F.col("s_acctbal").cast("double") + F.col("s_suppkey") / 1e7
    return table(s, d, "supplier").select(part.alias("part"), balance.alias("balance"))


def holed_lines(s: SparkSession, d: str) -> DataFrame:
    return li(s, d).select(
        "l_extendedprice", "l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("line"), "l_tax"
    )


HOLED_LINES = "(SELECT l_extendedprice, l_quantity, nullif(l_linenumber, 3) AS line, l_tax FROM lineitem)"


def test_sql(source: str, y: str, xs) -> str:
    base = " UNION ALL ".join(
        f"SELECT '{y}' AS var1, '{x}' AS var2, regr_count({y}, {x})::BIGINT AS n, corr({y}, {x}) AS r FROM {source}" for x in xs
    )
    t = "r * sqrt((n - 2) / (1 - r * r))"
    p = t_two_sided(t, "n - 2")
    return f"SELECT var1, var2, n, r, {t} AS t_stat, {p} AS p_value, {p} < 0.05 AS significant FROM ({base})"


def partial_sql() -> str:
    """Correlations of residual columns, from the inverse of the cross-products of all variables."""
    y, x, c1, c2 = "l_extendedprice", "l_quantity", "l_discount", "l_tax"

    def block(a: str, b: str, ctrl: list[str], i: int) -> tuple[str, str]:
        # the inverse of the (a, b, controls) block gives r = −v_ab / sqrt(v_aa v_bb); the outcome is unused
        cols = [a, b, *ctrl]
        rows = f"SELECT {', '.join(cols)}, 0.0 + random() AS unused FROM lineitem"
        return ols_sql(rows, "unused", cols, prefix=f"p{i}"), f"(-v_1_2 / sqrt(v_1_1 * v_2_2))"

    cases = [
        (x, "Partial Correlation", f"{c1}, {c2}", x, y, [c1, c2]),
        (f"{x} | controls - {c1}", "Partial Correlation without control", c2, x, y, [c2]),
        (f"{x} | controls - {c2}", "Partial Correlation without control", c1, x, y, [c1]),
        (c1, "Partial Correlation of control", f"{x}, {c2}", c1, y, [x, c2]),
        (c2, "Partial Correlation of control", f"{x}, {c1}", c2, y, [x, c1]),
    ]
    ctes, parts = [], []
    for i, (name, kind, given, a, b, ctrl) in enumerate(cases):
        cte, r = block(a, b, ctrl, i)
        ctes.append(cte)
        p = t_two_sided("r * sqrt((n - 2) / (1 - r * r))", "n - 2")
        parts.append(
            f"SELECT '{name}' AS variable, '{kind}' AS type, '{given}' AS given, n, r AS correlation, {p} AS p_value, {p} < 0.05 AS significant "
            f"FROM (SELECT n, {r} AS r FROM p{i})"
        )
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(parts)


def entries() -> list[Entry]:
    orders = lambda s, d: table(s, d, "orders")
    grouped = dict(plain=["group", "group_size", "n"], sig=SUMMARY_COLS)
    return [
        entry(
            "bysort_quartiles", lambda s, d: G.bysort(li(s, d), "l_extendedprice", "l_quantity", "quartiles"),
            grouped_sql(qcut_sql("lineitem", "l_extendedprice", 4), "label", "l_quantity"), **grouped,
        ),
        entry(
            "bysort_quintiles", lambda s, d: G.bysort(orders(s, d), "o_totalprice", "o_custkey", "quintiles"),
            grouped_sql(qcut_sql("orders", "o_totalprice", 5), "label", "o_custkey"), **grouped,
        ),
        entry(
            "bysort_deciles", lambda s, d: G.bysort(table(s, d, "part"), "p_size", "p_retailprice", "deciles"),
            grouped_sql(qcut_sql("part", "p_size", 10), "label", "p_retailprice"), **grouped,
        ),
        entry(
            "bysort_tied_edges", lambda s, d: G.bysort(tied_part(s, d), "tied", "p_retailprice", "quantiles", 6),
            grouped_sql(qcut_sql(TIED, "tied", 6), "label", "p_retailprice"), **grouped,
        ),
        entry(
            "bysort_custom_bins", lambda s, d: G.bysort(li(s, d), "l_extendedprice", "l_quantity", "custom bins", 5),
            grouped_sql(cut_sql("lineitem", "l_extendedprice", 5), "label", "l_quantity"), **grouped,
        ),
        entry(
            "bysort_categories", lambda s, d: G.bysort(orders(s, d), "o_orderpriority", "o_totalprice", "categories"),
            grouped_sql("orders", "o_orderpriority", "o_totalprice"), **grouped,
        ),
        entry(
            "bysort_missing", lambda s, d: G.bysort(holed_orders(s, d), "priority", "total", "categories"),
            grouped_sql(HOLED, "priority", "total"), **grouped,
        ),
        entry(
            "bysort_reverse", lambda s, d: G.reverse_bysort(table(s, d, "part"), "p_size", "p_retailprice"),
            grouped_sql(qcut_sql("part", "p_retailprice", 3, TERCILE), "label", "p_size"), **grouped,
        ),
        entry(
            "group_means", lambda s, d: G.group_means(table(s, d, "part"), "p_brand", "p_retailprice"),
            "SELECT p_brand AS \"group\", count(*) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS sd, "
            "stddev_samp(p_retailprice) / sqrt(count(*)) AS std_error FROM part GROUP BY p_brand",
            plain=["group", "n"], sig=["mean", "sd", "std_error"],
        ),
        entry(
            "quantile_bin_counts",
            lambda s, d: G.quantile_bins(table(s, d, "events"), "value", 5).groupBy("bin", "bin_label").agg(F.count("*").alias("n")),
            f"SELECT bin, label AS bin_label, count(*) AS n FROM {qcut_sql('events', 'value', 5)} GROUP BY ALL",
            plain=["bin", "bin_label", "n"],
        ),
        entry(
            "collapse_orders", lambda s, d: G.collapse(orders(s, d), KEYS, "o_totalprice", G.AGGREGATES), COLLAPSE_SQL,
            plain=[*KEYS, "count_o_totalprice"], sig=[f"{f}_o_totalprice" for f in G.AGGREGATES if f != "count"],
        ),
        entry(
            "collapse_several", lambda s, d: G.collapse(li(s, d), "l_suppkey", ["l_quantity", "l_tax"], ["mean", "std"]),
            "SELECT l_suppkey, avg(l_quantity) AS mean_l_quantity, stddev_samp(l_quantity) AS std_l_quantity, avg(l_tax) AS mean_l_tax, "
            "stddev_samp(l_tax) AS std_l_tax FROM lineitem GROUP BY l_suppkey",
            plain=["l_suppkey"], sig=["mean_l_quantity", "std_l_quantity", "mean_l_tax", "std_l_tax"],
        ),
        entry(
            "collapse_missing", lambda s, d: G.collapse(holed_orders(s, d), "priority", "total", ["mean", "count", "sum", "min"]),
            f"SELECT priority, avg(total) AS mean_total, count(total) AS count_total, sum(total) AS sum_total, min(total) AS min_total FROM {HOLED} WHERE priority IS NOT NULL GROUP BY priority",
            plain=["priority", "count_total"], sig=["mean_total", "sum_total", "min_total"],
        ),
        entry("collapse_dense", _dense, DENSE_SQL, plain=["size_bin", "brand", "count_p_retailprice"], sig=["mean_p_retailprice"]),
        entry(
            "collapse_summary",
            lambda s, d: G.collapse_summary(orders(s, d), G.collapse(orders(s, d), KEYS, "o_totalprice"), KEYS, ["o_totalprice"]),
            "SELECT count(*) AS original_rows, (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)) AS collapsed_rows, "
            "count(*) / (SELECT count(*)::DOUBLE FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)) AS reduction_factor, "
            "2::BIGINT AS grouping_variables, 1::BIGINT AS aggregated_variables FROM orders",
            plain=["original_rows", "collapsed_rows", "grouping_variables", "aggregated_variables"], sig=["reduction_factor"],
        ),
        entry(
            "group_size_distribution", lambda s, d: G.group_size_distribution(orders(s, d), "o_custkey"),
            "SELECT count(*) AS groups, min(k) AS min, max(k) AS max, avg(k) AS mean, quantile_cont(k, 0.5) AS median, stddev_samp(k) AS sd, "
            "quantile_cont(k, 0.25) AS p25, quantile_cont(k, 0.75) AS p75 FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey)",
            plain=["groups"], sig=["min", "max", "mean", "median", "sd", "p25", "p75"],
        ),
        entry(
            "aggregation_comparison",
            lambda s, d: G.aggregation_comparison(orders(s, d), G.collapse(orders(s, d), KEYS, "o_totalprice"), "o_totalprice"),
            f"SELECT statistic, original, collapsed FROM {stats_long('orders', 'o_totalprice', 'original')} JOIN {stats_long(MEANS_SQL, 'mean_o_totalprice', 'collapsed')} USING (statistic)",
            plain=["statistic"], sig=["original", "collapsed"],
        ),
        entry(
            "collapsed_statistics",
            lambda s, d: G.table_statistics(G.collapse(orders(s, d), "o_custkey", "o_totalprice", ["mean", "count"]), ["mean_o_totalprice", "count_o_totalprice"]),
            " UNION ALL ".join(
                f"SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c})::DOUBLE AS min, quantile_cont({c}, 0.25) AS p25, "
                f"quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c})::DOUBLE AS max FROM "
                "(SELECT avg(o_totalprice) AS mean_o_totalprice, count(o_totalprice) AS count_o_totalprice FROM orders GROUP BY o_custkey)"
                for c in ("mean_o_totalprice", "count_o_totalprice")
            ),
            plain=["variable", "count"], sig=["mean", "sd", "min", "p25", "p50", "p75", "max"], digits=8,
        ),
        entry(
            "group_pivot", lambda s, d: G.group_pivot(orders(s, d), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"]),
            "SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS \"F\", avg(o_totalprice) FILTER (o_orderstatus = 'O') AS \"O\", "
            "avg(o_totalprice) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority",
            plain=["o_orderpriority"], sig=["F", "O", "P"],
        ),
        entry("anova_priority", lambda s, d: GT.anova(orders(s, d), "o_orderpriority", "o_totalprice"), anova_sql("orders", "o_orderpriority", "o_totalprice"),
              plain=["groups", "n", "df_between", "df_within"], sig=["ss_between", "ss_within", "f_stat", "eta_squared"], prob=["p_value"], digits=7),
        entry("kruskal_wallis_priority", lambda s, d: GT.kruskal_wallis(orders(s, d), "o_orderpriority", "o_totalprice"), kruskal_sql("orders", "o_orderpriority", "o_totalprice"),
              plain=["groups", "n", "df"], sig=["h_stat"], prob=["p_value"], digits=7),
        entry("kruskal_wallis_ties", lambda s, d: GT.kruskal_wallis(li(s, d), "l_returnflag", "l_quantity"), kruskal_sql("lineitem", "l_returnflag", "l_quantity"),
              plain=["groups", "n", "df"], sig=["h_stat"], prob=["p_value"], digits=7),
        entry("t_test_status", lambda s, d: GT.t_test(li(s, d), "l_linestatus", "l_extendedprice"), t_sql("lineitem", "l_linestatus", "l_extendedprice"),
              plain=["group_a", "group_b", "n_a", "n_b", "df"], sig=["t_stat", "cohens_d"], prob=["p_value"], digits=7),
        entry("mann_whitney_status", lambda s, d: GT.mann_whitney(li(s, d), "l_linestatus", "l_quantity"), mann_whitney_sql("lineitem", "l_linestatus", "l_quantity"),
              plain=["group_a", "group_b", "n_a", "n_b", "exact"], sig=["u_stat", "z_stat"], prob=["p_value"], digits=7),
        entry("mann_whitney_exact", lambda s, d: GT.mann_whitney(few_suppliers(s, d), "part", "balance"), EXACT_SQL,
              plain=["group_a", "group_b", "n_a", "n_b", "exact"], sig=["u_stat", "z_stat"], prob=["p_value"], digits=6),
        entry(
            "comparison_tests", lambda s, d: GT.comparison_tests(orders(s, d), "o_orderstatus", "o_totalprice"),
            f"SELECT 'One-way ANOVA' AS test, f_stat AS statistic, p_value, eta_squared AS effect_size FROM ({anova_sql('orders', 'o_orderstatus', 'o_totalprice')}) UNION ALL "
            f"SELECT 'Kruskal-Wallis H', h_stat, p_value, NULL FROM ({kruskal_sql('orders', 'o_orderstatus', 'o_totalprice')})",
            plain=["test"], sig=["statistic", "effect_size"], prob=["p_value"], digits=7,
        ),
        entry(
            "pairwise_tests", lambda s, d: GT.pairwise_tests(li(s, d), "l_linestatus", "l_tax"),
            f"SELECT 'Independent t-test' AS test, t_stat AS statistic, p_value FROM ({t_sql('lineitem', 'l_linestatus', 'l_tax')}) UNION ALL "
            f"SELECT 'Mann-Whitney U', u_stat, p_value FROM ({mann_whitney_sql('lineitem', 'l_linestatus', 'l_tax')}) UNION ALL "
            f"SELECT 'Cohen''s d', cohens_d, NULL FROM ({t_sql('lineitem', 'l_linestatus', 'l_tax')})",
            plain=["test"], sig=["statistic"], prob=["p_value"], digits=7,
        ),
        entry("correlation_pairs", lambda s, d: C.correlation_pairs(li(s, d), MEASURES), f"SELECT *, {MARK} AS strength FROM ({CORR_SQL})",
              plain=["var1", "var2", "n", "strength"], prob=["r"], places=8),
        entry("correlation_matrix", lambda s, d: C.correlation_matrix(li(s, d), MEASURES), MATRIX_SQL, plain=["var1", "var2"], prob=["r"], places=8),
        entry(
            "correlation_wide", lambda s, d: C.correlation_wide(li(s, d), MEASURES),
            "SELECT var1, " + ", ".join(f"max(CASE WHEN var2 = '{c}' THEN r END) AS {c}" for c in MEASURES) + f" FROM ({MATRIX_SQL}) GROUP BY var1",
            plain=["var1"], prob=MEASURES, places=8,
        ),
        entry(
            "correlation_summary", lambda s, d: C.correlation_summary(li(s, d), MEASURES),
            f"SELECT count(r) AS count, avg(r) AS mean, stddev_pop(r) AS sd, min(r) AS min, max(r) AS max FROM ({CORR_SQL})",
            plain=["count"], prob=["mean", "sd", "min", "max"], places=8,
        ),
        entry("correlation_tests", lambda s, d: C.correlation_tests(holed_lines(s, d), "l_extendedprice", ["l_quantity", "line", "l_tax"]),
              test_sql(HOLED_LINES, "l_extendedprice", ["l_quantity", "line", "l_tax"]),
              plain=["var1", "var2", "n", "significant"], prob=["r", "t_stat", "p_value"]),
        entry("partial_correlations", lambda s, d: C.partial_correlations(li(s, d), "l_extendedprice", "l_quantity", ["l_discount", "l_tax"]), partial_sql(),
              plain=["variable", "type", "given", "n", "significant"], prob=["correlation", "p_value"]),
        entry("partial_correlations_by_flag", lambda s, d: C.partial_correlations(li(s, d), "l_extendedprice", "l_quantity", ["l_discount", "l_tax"], by=FLAG), per_flag(partial_sql()),
              plain=[FLAG, "variable", "type", "given", "n", "significant"], prob=["correlation", "p_value"]),
        entry(
            "row_index_entities",
            lambda s, d: P.with_panel_ids(orders(s, d), ["o_orderdate", "o_orderkey"], 7).select("o_orderkey", "entity_id", "time_id"),
            "SELECT o_orderkey, least(r // len, 6)::INT AS entity_id, r - least(r // len, 6) * len AS time_id FROM "
            "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, (count(*) OVER ()) // 7 AS len FROM orders)",
            plain=["o_orderkey", "entity_id", "time_id"],
        ),
        entry("hash_groups", lambda s, d: P.with_hash_group(orders(s, d), "o_orderkey", 8).groupBy("group_id").agg(F.count("*").alias("n")),
              f"SELECT (('0x' || substr({sample_key('o_orderkey')}, 1, 8))::BIGINT % 8)::INT AS group_id, count(*) AS n FROM orders GROUP BY 1", plain=["group_id", "n"]),
        entry(
            "row_index_text_key", lambda s, d: ranks.row_numbers(orders(s, d), ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "row_index", "total"),
            "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS row_index, count(*) OVER () AS total FROM orders",
            plain=["o_orderkey", "row_index", "total"],
        ),
        entry(
            "mid_ranks_quantity",
            lambda s, d: ranks.mid_ranks(li(s, d), "l_quantity", "l_returnflag"),
            "SELECT l_returnflag AS \"group\", l_quantity AS value, count(*) AS n, any_value(t) AS ties, any_value(r) AS mid_rank FROM "
            "(SELECT l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_quantity) AS t, "
            "rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem) GROUP BY 1, 2",
            plain=["group", "value", "n", "ties"], sig=["mid_rank"],
        ),
        entry(
            "quantiles_by_selection",
            lambda s, d: ranks.quantiles(orders(s, d), ["o_totalprice", "o_custkey"], [0.01, 0.1, 0.5, 0.99], "o_orderpriority", method="selection").select(
                "o_orderpriority", "variable", "n", *[F.col("q")[i].alias(f"q{i}") for i in range(4)]
            ),
            " UNION ALL ".join(
                f"SELECT o_orderpriority, '{c}' AS variable, count(*) AS n, quantile_cont({c}, 0.01) AS q0, quantile_cont({c}, 0.1) AS q1, "
                f"quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.99) AS q3 FROM orders GROUP BY o_orderpriority"
                for c in ("o_totalprice", "o_custkey")
            ),
            plain=["o_orderpriority", "variable", "n"], sig=["q0", "q1", "q2", "q3"],
        ),
        entry(
            "quantiles_approximate",
            lambda s, d: _within_accuracy(s, d),
            "SELECT 'l_extendedprice' AS variable, count(*) AS n, true AS within_0, true AS within_1, true AS within_2 FROM lineitem",
            plain=["variable", "n", "within_0", "within_1", "within_2"],
        ),
    ]


def _dense(s: SparkSession, d: str) -> DataFrame:
    """Collapse with empty combinations kept: one brand has small sizes only."""
    part = table(s, d, "part")
    brand = F.when((F.col("p_brand") == "Brand#1") & (F.col("p_size") > 12), "larger sizes").otherwise(F.col("p_brand"))
    rows = G.quantile_bins(part, "p_size", 4, "size_bin").select("size_bin", brand.alias("brand"), "p_retailprice")
    out = G.collapse(rows, ["size_bin", "brand"], "p_retailprice", ["mean", "count"])
    levels = {"size_bin": out.select("size_bin").distinct(), "brand": out.select("brand").distinct()}
    return G.dense_groups(out, levels, ["count_p_retailprice"])


_DENSE_ROWS = "(SELECT * REPLACE (CASE WHEN p_brand = 'Brand#1' AND p_size > 12 THEN 'larger sizes' ELSE p_brand END AS p_brand) FROM part)"
_DENSE_BINS = qcut_sql(_DENSE_ROWS, "p_size", 4)
DENSE_SQL = (
    f"WITH r AS (SELECT bin AS size_bin, p_brand AS brand, p_retailprice FROM {_DENSE_BINS}) "
    "SELECT a.size_bin, b.brand, avg(p_retailprice) AS mean_p_retailprice, count(p_retailprice) AS count_p_retailprice "
    "FROM (SELECT DISTINCT size_bin FROM r) AS a CROSS JOIN (SELECT DISTINCT brand FROM r) AS b "
    "LEFT JOIN r ON r.size_bin = a.size_bin AND r.brand = b.brand GROUP BY a.size_bin, b.brand"
)


def _within_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Do the approximate quantiles lie within one part in the accuracy of their ranks, to the next row?"""
    probs, accuracy = [0.25, 0.5, 0.75], 10_000
    found = ranks.quantiles(li(s, d), ["l_extendedprice"], probs, accuracy=accuracy).first()
    x, n = F.col("l_extendedprice"), F.count("l_extendedprice")
    within = [
        ((F.count(F.when(x < q, 1)) <= n * (p + 1 / accuracy) + 1) & (F.count(F.when(x <= q, 1)) >= n * (p - 1 / accuracy) - 1)).alias(f"within_{i}")
        for i, (p, q) in enumerate(zip(probs, found["q"]))
    ]
    return li(s, d).agg(F.lit(found["variable"]).alias("variable"), n.alias("n"), *within)
