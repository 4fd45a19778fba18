"""Descriptive statistics, frequencies, rows, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.sqlgen import Entry, entry, sample_key, shapiro_sql, t_crit_95, table
from econspark.operators import describe as D, normality, rows as R, tables as TB
from econspark.session import ensure_checkpoint_dir
from econspark.sources.readers import parse_numbers, read_csv, read_text_csv
from econspark.sources.writers import read_report, save_report, save_results

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES, "l_returnflag", "l_linestatus", "l_shipdate",
]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]
PART_TEXT = ["p_name", "p_brand", "p_type"]


def union(cols, template: str) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


def li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def holed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with missing totals, as NULL and as NaN, and missing priorities."""
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, None)
        .when(F.col("o_orderkey") % 11 == 0, float("nan"))
        .otherwise(F.col("o_totalprice"))
        .alias("total"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"),
    )


HOLED = (
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS total, "
    "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders)"
)


def messy_part(spark: SparkSession, d: str) -> DataFrame:
    """Part with every cell as padded text and some empty cells."""
    p = table(spark, d, "part")
    return p.select(
        F.concat(F.lit(" \t"), F.col("p_retailprice").cast("string"), F.lit(" \u00a0\r\n")).alias("price"),
        F.when(F.col("p_partkey") % 4 == 0, " \t\n").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("mixed"),
        F.col("p_brand").alias("brand"),
    )


def csv_round_trip(spark: SparkSession, d: str, text: bool) -> DataFrame:
    """Part written as CSV into the shared folder and read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    written = save_results({"Part list": table(spark, d, "part")}, folder, "csv")["Part list"]
    back = parse_numbers(read_text_csv(spark, written)) if text else read_csv(spark, written)
    return D.summarize(back)


def report_round_trip(spark: SparkSession, d: str, format: str) -> DataFrame:
    """Part and the sizes of its brands as one report in the shared folder, both tables read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    part = table(spark, d, "part")
    save_report({"Part list": part, "Brands": part.groupBy("p_brand").count()}, folder, format)
    back = read_report(spark, folder)
    return D.summarize(back["Part list"]).unionByName(D.summarize(back["Brands"].withColumnRenamed("p_brand", "brand")))


SUMMARY_SQL = "SELECT '{c}' AS variable, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c}) AS min, max({c}) AS max FROM "
TEXT_SQL = "SELECT '{c}' AS variable, count({c}) AS n, NULL AS mean, NULL AS sd, NULL AS min, NULL AS max FROM "
STATS = ["mean", "sd", "min", "max"]
BRANDS = "(SELECT p_brand AS brand, count(*) AS count FROM part GROUP BY p_brand)"
REPORT_SUMMARY = (
    f"{union(PART_NUMBERS, SUMMARY_SQL + 'part')} UNION ALL {union(PART_TEXT, TEXT_SQL + 'part')} UNION ALL {union(['count'], SUMMARY_SQL + BRANDS)} UNION ALL {union(['brand'], TEXT_SQL + BRANDS)}"
)
PART_SUMMARY = f"{union(PART_NUMBERS, SUMMARY_SQL + 'part')} UNION ALL {union(PART_TEXT, TEXT_SQL + 'part')}"

TABSTAT_SQL = (
    "SELECT {k}'{c}' AS variable, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c}) AS min, "
    "max({c}) AS max, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.25) AS p25, "
    "quantile_cont({c}, 0.75) AS p75, max({c}) - min({c}) AS range, "
    "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, stddev_samp({c}) / avg({c}) AS cv FROM {t}"
)
TABSTAT_COLS = ["mean", "sd", "min", "max", "median", "p25", "p75", "range", "iqr", "cv"]


def tabstat_sql(cols, source: str, by: str = "") -> str:
    sql = union(cols, TABSTAT_SQL.replace("{t}", source).replace("{k}", f"{by}, " if by else ""))
    return " UNION ALL ".join(f"{part} GROUP BY {by}" for part in sql.split(" UNION ALL ")) if by else sql


SKEW_POP = "(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5))"
KURT_POP = "(avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3)"
CENTRED = "(SELECT {c}, avg({c}) OVER () AS m FROM lineitem)"
SHAPE_CLASS = (
    "CASE WHEN abs(skew_pop) < 0.5 THEN 'Approximately symmetric' WHEN skew_pop > 0.5 THEN "
    "'Right-skewed (positive skew)' ELSE 'Left-skewed (negative skew)' END AS skew_class, "
    "CASE WHEN abs(kurt_pop) < 0.5 THEN 'Approximately normal' WHEN kurt_pop > 0.5 THEN "
    "'Heavy-tailed (leptokurtic)' ELSE 'Light-tailed (platykurtic)' END AS kurtosis_class"
)
DETAIL_SQL = f"SELECT *, {SHAPE_CLASS} FROM (" + union(
    MEASURES,
    "SELECT '{c}' AS variable, count(*) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c}) AS min, max({c}) AS max, "
    + ", ".join(f"quantile_cont({{c}}, {p / 100}) AS p{p}" for p in D.DETAIL_PERCENTS)
    + f", {SKEW_POP} AS skew_pop, {KURT_POP} AS kurt_pop FROM {CENTRED}",
) + ")"

K2_SQL = """
SELECT variable, n, z_skew, z_kurt, z_skew * z_skew + z_kurt * z_kurt AS k2,
       exp(-(z_skew * z_skew + z_kurt * z_kurt) / 2) AS p_value,
       exp(-(z_skew * z_skew + z_kurt * z_kurt) / 2) >= 0.05 AS normal
FROM (SELECT *, asinh(y * sqrt((w2 - 1) / 2)) / sqrt(0.5 * ln(w2)) AS z_skew,
             (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z_kurt
FROM (SELECT *, -1 + sqrt(2 * (beta2 - 1)) AS w2, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a
FROM (SELECT variable, n, g1 * sqrt((r + 1) * (r + 3) / (6 * (r - 2))) AS y,
             3 * (r * r + 27 * r - 70) * (r + 1) * (r + 3) / ((r - 2) * (r + 5) * (r + 7) * (r + 9)) AS beta2,
             (g2 + 3 - 3 * (r - 1) / (r + 1)) / sqrt(24 * r * (r - 2) * (r - 3) / (pow(r + 1, 2) * (r + 3) * (r + 5))) AS x,
             6 * (r * r - 5 * r + 2) / ((r + 7) * (r + 9)) * sqrt(6 * (r + 3) * (r + 5) / (r * (r - 2) * (r - 3))) AS b1
FROM (""" + union(
    MEASURES,
    f"SELECT '{{c}}' AS variable, count(*) AS n, CAST(count(*) AS DOUBLE) AS r, {SKEW_POP} AS g1, {KURT_POP} AS g2 FROM {CENTRED}",
) + "))))"

FENCES = (
    "SELECT '{c}' AS variable, count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}"
)


def outlier_sql(cols, source: str) -> str:
    parts = []
    for c in cols:
        f = FENCES.replace("{c}", c).replace("{t}", source)
        parts.append(
            f"SELECT variable, n, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, "
            f"(SELECT count(*) FROM {source} AS s WHERE s.{c} < q1 - 1.5 * (q3 - q1) OR s.{c} > q3 + 1.5 * (q3 - q1)) AS n_outliers "
            f"FROM ({f})"
        )
    return " UNION ALL ".join(parts)


def spread_events(spark: SparkSession, d: str) -> DataFrame:
    """Event values cubed, which puts many outside the fences."""
    return table(spark, d, "events").select("event_id", "event_type", F.pow("value", F.lit(3.0)).alias("cube"))


TYPES = {
    "l_orderkey": ("numeric", "bigint"), "l_partkey": ("numeric", "bigint"), "l_suppkey": ("numeric", "bigint"),
    "l_linenumber": ("numeric", "int"), "l_quantity": ("numeric", "double"), "l_extendedprice": ("numeric", "double"),
    "l_discount": ("numeric", "double"), "l_tax": ("numeric", "double"), "l_returnflag": ("string", "string"),
    "l_linestatus": ("string", "string"), "l_shipdate": ("string", "timestamp_ntz"),
}


def describe_sql() -> str:
    parts = []
    for c, (kind, storage) in TYPES.items():
        parts.append(
            f"SELECT '{c}' AS variable, '{kind}' || CASE WHEN count(DISTINCT {c}) <= 20 THEN ' (categorical)' ELSE '' END AS type, "
            f"'{storage}' AS storage, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
            f"100.0 * (count(*) - count({c})) / count(*) AS null_pct, count(DISTINCT {c}) AS \"unique\" FROM lineitem"
        )
    return " UNION ALL ".join(parts)


CODEBOOK_NUM = union(
    PART_NUMBERS,
    "SELECT '{c}' AS variable, count(*) AS n_total, count(*) - count({c}) AS n_missing, "
    "100.0 * (count(*) - count({c})) / count(*) AS missing_pct, count({c}) AS n_valid, count(DISTINCT {c}) AS \"unique\", "
    "min({c}) AS min, max({c}) AS max, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS sd, "
    "(SELECT v FROM (SELECT {c} AS v, count(*) AS k FROM part GROUP BY {c}) ORDER BY k DESC, v LIMIT 1) AS mode, "
    "skewness({c}) AS skew_adj, kurtosis({c}) AS kurt_adj, quantile_cont({c}, 0.25) AS p25, "
    "quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM part",
)
CODEBOOK_CAT = union(
    PART_TEXT,
    "SELECT '{c}' AS variable, sum(k)::BIGINT AS n_total, 0::BIGINT AS n_missing, 0.0 AS missing_pct, sum(k)::BIGINT AS n_valid, "
    "count(*) AS \"unique\", arg_max(v, k * 100000 - r) AS most_common, max(k) AS most_common_n, "
    "100.0 * max(k) / sum(k) AS most_common_pct, arg_min(v, k * 100000 + r) AS least_common, min(k) AS least_common_n, "
    "100.0 * min(k) / sum(k) AS least_common_pct, max(length(v)) AS max_length, min(length(v)) AS min_length FROM "
    "(SELECT {c} AS v, count(*) AS k, row_number() OVER (ORDER BY {c}) AS r FROM part GROUP BY {c})",
)


def frequency_sql(source: str, c: str) -> str:
    return (
        f"SELECT value, n, 100.0 * n / sum(n) OVER () AS percent, CAST(sum(n) OVER w AS BIGINT) AS cum_n, "
        f"100.0 * sum(n) OVER w / sum(n) OVER () AS cum_percent "
        f"FROM (SELECT {c} AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) "
        f"WINDOW w AS (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING)"
    )


CROSSTAB_SQL = (
    "SELECT row_value, col_value, n, row_total, col_total, 100.0 * n / "
    "sum(CASE WHEN col_total = 1 THEN n END) OVER (PARTITION BY row_total, row_value) AS row_percent FROM ("
    "SELECT {r} AS row_value, {k} AS col_value, count(*) AS n, grouping({r})::INT AS row_total, grouping({k})::INT AS col_total "
    "FROM {t} WHERE {r} IS NOT NULL AND {k} IS NOT NULL GROUP BY CUBE ({r}, {k}))"
)


def crosstab_sql(t: str, r: str, k: str) -> str:
    return CROSSTAB_SQL.replace("{t}", t).replace("{r}", r).replace("{k}", k)


UNIQUE_VALUES = """
WITH c AS (SELECT p_name AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS r FROM part GROUP BY p_name),
s AS (SELECT value, n, false AS is_other, r FROM c WHERE r <= 49 OR (SELECT count(*) FROM c) <= 50
      UNION ALL SELECT 'Other', sum(n)::BIGINT, true, 100000 FROM c WHERE r > 49 HAVING (SELECT count(*) FROM c) > 50)
SELECT value, n, is_other, 100.0 * n / sum(n) OVER () AS percent,
       CAST(sum(n) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n,
       100.0 * sum(n) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cum_percent FROM s
"""

TOP_CATEGORIES = """
WITH c AS (SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY p_brand)
SELECT value, n, false AS is_other FROM c WHERE r <= 20
UNION ALL SELECT 'Other', sum(n)::BIGINT, true FROM c WHERE r > 20 HAVING count(*) > 0
"""

MISSING_TOTAL = "count(*) - count(total) + count(*) - count(priority)"


def entries() -> list[Entry]:
    return [
        entry(
            "summarize_lineitem",
            lambda s, d: D.summarize(li(s, d)),
            f"{union(LINE_COLUMNS[:8], SUMMARY_SQL + 'lineitem')} UNION ALL {union(LINE_COLUMNS[8:], TEXT_SQL + 'lineitem')}",
            plain=["variable", "n"], sig=STATS,
        ),
        entry(
            "summarize_by_returnflag",
            lambda s, d: D.summarize(li(s, d), MEASURES, by="l_returnflag"),
            " UNION ALL ".join(
                f"SELECT l_returnflag, '{c}' AS variable, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, "
                f"min({c}) AS min, max({c}) AS max FROM lineitem GROUP BY l_returnflag"
                for c in MEASURES
            ),
            plain=["l_returnflag", "variable", "n"], sig=STATS,
        ),
        entry(
            "summarize_text_numbers",
            lambda s, d: D.summarize(messy_part(s, d)),
            "SELECT 'price' AS variable, count(*) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS sd, "
            "min(p_retailprice) AS min, max(p_retailprice) AS max FROM part UNION ALL "
            "SELECT 'size', count(*), avg(p_size), stddev_samp(p_size), min(p_size), max(p_size) FROM part WHERE p_partkey % 4 <> 0 "
            "UNION ALL SELECT 'mixed', count(*), NULL, NULL, NULL, NULL FROM part UNION ALL SELECT 'brand', count(*), NULL, NULL, NULL, NULL FROM part",
            plain=["variable", "n"], sig=STATS,
        ),
        entry(
            "parse_text_columns",
            lambda s, d: D.summarize(parse_numbers(messy_part(s, d)), ["price", "size"]),
            "SELECT 'price' AS variable, count(*) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS sd, "
            "min(p_retailprice) AS min, max(p_retailprice) AS max FROM part UNION ALL "
            "SELECT 'size', count(*), avg(p_size), stddev_samp(p_size), min(p_size), max(p_size) FROM part WHERE p_partkey % 4 <> 0",
            plain=["variable", "n"], sig=STATS,
        ),
        *[entry(f"report_{f}", lambda s, d, f=f: report_round_trip(s, d, f), REPORT_SUMMARY, plain=["variable", "n"], sig=STATS) for f in ("parquet", "json", "orc")],
        entry("csv_scan", lambda s, d: csv_round_trip(s, d, False), PART_SUMMARY, plain=["variable", "n"], sig=STATS),
        entry("csv_text_scan", lambda s, d: csv_round_trip(s, d, True), PART_SUMMARY, plain=["variable", "n"], sig=STATS),
        entry(
            "summarize_missing",
            lambda s, d: D.summarize(holed_orders(s, d)),
            f"SELECT 'o_orderkey' AS variable, count(o_orderkey) AS n, avg(o_orderkey) AS mean, stddev_samp(o_orderkey) AS sd, "
            f"min(o_orderkey) AS min, max(o_orderkey) AS max FROM {HOLED} UNION ALL "
            f"SELECT 'total', count(total), avg(total), stddev_samp(total), min(total), max(total) FROM {HOLED} UNION ALL "
            f"SELECT 'priority', count(priority), NULL, NULL, NULL, NULL FROM {HOLED}",
            plain=["variable", "n"], sig=STATS,
        ),
        entry(
            "mean_confidence",
            lambda s, d: D.mean_ci(li(s, d), MEASURES),
            "SELECT variable, n, mean, e AS std_error, mean - t * e AS ci_lower, mean + t * e AS ci_upper, 2 * t * e AS ci_width, t * e AS precision "
            "FROM (SELECT *, " + t_crit_95("n - 1") + " AS t FROM (" + union(
                MEASURES, "SELECT '{c}' AS variable, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) / sqrt(count({c})) AS e FROM lineitem"
            ) + "))",
            plain=["variable", "n"], sig=["mean", "std_error", "ci_lower", "ci_upper", "ci_width", "precision"], digits=8,
        ),
        entry(
            "tabstat_lineitem", lambda s, d: D.tabstat(li(s, d), MEASURES), tabstat_sql(MEASURES, "lineitem"),
            plain=["variable", "n"], sig=TABSTAT_COLS,
        ),
        entry(
            "tabstat_by_status", lambda s, d: D.tabstat(table(s, d, "orders"), ["o_totalprice", "o_custkey"], by="o_orderstatus"),
            tabstat_sql(["o_totalprice", "o_custkey"], "orders", "o_orderstatus"),
            plain=["o_orderstatus", "variable", "n"], sig=TABSTAT_COLS,
        ),
        entry(
            "tabstat_transposed",
            lambda s, d: D.transpose_stats(D.tabstat(li(s, d), ["l_quantity", "l_tax"])),
            "SELECT statistic, max(CASE WHEN variable = 'l_quantity' THEN value END) AS l_quantity, "
            "max(CASE WHEN variable = 'l_tax' THEN value END) AS l_tax FROM (UNPIVOT (SELECT variable, n::DOUBLE AS n, mean, sd, "
            "min::DOUBLE AS min, max::DOUBLE AS max, median, p25, p75, range, iqr, cv FROM (" + tabstat_sql(["l_quantity", "l_tax"], "lineitem") + ")) "
            "ON n, mean, sd, min, max, median, p25, p75, range, iqr, cv INTO NAME statistic VALUE value) GROUP BY statistic",
            plain=["statistic"], sig=["l_quantity", "l_tax"],
        ),
        entry(
            "tabstat_variation",
            lambda s, d: D.variation_summary(D.tabstat(li(s, d), ["l_orderkey", "l_linenumber", *MEASURES])),
            "SELECT CASE WHEN cv IS NULL THEN 'Unknown' WHEN cv < 0.1 THEN 'Low Variation (CV < 0.1)' WHEN cv < 0.5 THEN "
            "'Medium Variation (CV 0.1-0.5)' ELSE 'High Variation (CV > 0.5)' END AS variation_group, count(*) AS variables, "
            "avg(mean) AS mean, avg(sd) AS sd, avg(cv) AS cv FROM (" + tabstat_sql(["l_orderkey", "l_linenumber", *MEASURES], "lineitem") + ") GROUP BY 1",
            plain=["variation_group", "variables"], sig=["mean", "sd", "cv"],
        ),
        entry(
            "detail_lineitem", lambda s, d: D.detail(li(s, d), MEASURES), DETAIL_SQL,
            plain=["variable", "n", "skew_class", "kurtosis_class"],
            sig=["mean", "sd", "min", "max", *[f"p{p}" for p in D.DETAIL_PERCENTS]], prob=["skew_pop", "kurt_pop"],
        ),
        entry(
            "normality_k2", lambda s, d: D.normality_test(li(s, d), MEASURES), K2_SQL,
            plain=["variable", "n", "normal"], sig=["k2"], prob=["z_skew", "p_value"], digits=6, places=5,
        ),
        entry(
            "outliers_events", lambda s, d: D.outliers(spread_events(s, d), ["cube"]),
            outlier_sql(["cube"], "(SELECT pow(value, 3.0) AS cube FROM events)"),
            plain=["variable", "n", "n_outliers"], sig=["q1", "q3", "iqr", "lower", "upper"], digits=8,
        ),
        entry(
            "outlier_values", lambda s, d: D.outlier_values(spread_events(s, d), "cube", "event_id"),
            "SELECT event_id, cube FROM (SELECT event_id, pow(value, 3.0) AS cube FROM events) AS e, "
            "(SELECT quantile_cont(pow(value, 3.0), 0.25) AS q1, quantile_cont(pow(value, 3.0), 0.75) AS q3 FROM events) AS q "
            "WHERE cube < q1 - 1.5 * (q3 - q1) OR cube > q3 + 1.5 * (q3 - q1) ORDER BY event_id LIMIT 5",
            plain=["event_id"], sig=["cube"], digits=8,
        ),
        entry(
            "describe_lineitem", lambda s, d: D.describe(li(s, d)), describe_sql(),
            plain=["variable", "type", "storage", "non_null", "nulls", "unique"], prob=["null_pct"],
        ),
        entry(
            "dataset_summary", lambda s, d: D.dataset_summary(holed_orders(s, d)),
            f"SELECT count(*) AS observations, 3::BIGINT AS variables, 2::BIGINT AS numeric_variables, 1::BIGINT AS string_variables, "
            f"3::BIGINT AS column_types, {MISSING_TOTAL} AS missing_values, 100.0 * ({MISSING_TOTAL}) / (3 * count(*)) AS missing_pct FROM {HOLED}",
            plain=["observations", "variables", "numeric_variables", "string_variables", "column_types", "missing_values"], prob=["missing_pct"],
        ),
        entry(
            "column_sizes", lambda s, d: D.column_sizes(table(s, d, "documents")),
            "SELECT variable, bytes, bytes / 1048576.0 AS megabytes FROM (SELECT 'doc_id' AS variable, 8 * count(*) AS bytes FROM documents UNION ALL "
            "SELECT 'n_chars', 8 * count(*) FROM documents UNION ALL "
            + union(["text", "lang", "source"], "SELECT '{c}', CAST(sum(strlen({c})) AS BIGINT) FROM documents") + ")",
            plain=["variable", "bytes"], sig=["megabytes"],
        ),
        entry(
            "data_quality", lambda s, d: D.data_quality(holed_orders(s, d)),
            f"SELECT variable, type, missing_pct, CASE WHEN missing_pct < 5 THEN 'Good' WHEN missing_pct < 20 THEN 'Fair' ELSE 'Poor' END AS quality "
            f"FROM (SELECT 'o_orderkey' AS variable, 'Integer' AS type, 0.0 AS missing_pct UNION ALL "
            f"SELECT 'total', 'Float', 100.0 * (count(*) - count(total)) / count(*) FROM {HOLED} UNION ALL "
            f"SELECT 'priority', 'String', 100.0 * (count(*) - count(priority)) / count(*) FROM {HOLED})",
            plain=["variable", "type", "quality"], prob=["missing_pct"],
        ),
        entry(
            "codebook_numeric", lambda s, d: D.codebook_numeric(table(s, d, "part")), CODEBOOK_NUM,
            plain=["variable", "n_total", "n_missing", "n_valid", "unique"],
            sig=["min", "max", "mean", "median", "sd", "mode", "p25", "p75", "iqr"], prob=["missing_pct", "skew_adj", "kurt_adj"],
        ),
        entry(
            "codebook_categorical", lambda s, d: D.codebook_categorical(table(s, d, "part")), CODEBOOK_CAT,
            plain=["variable", "n_total", "n_missing", "n_valid", "unique", "most_common", "most_common_n", "least_common", "least_common_n", "max_length", "min_length"],
            prob=["missing_pct", "most_common_pct", "least_common_pct"],
        ),
        entry(
            "data_information", lambda s, d: R.data_information(table(s, d, "orders")),
            " UNION ALL ".join(
                f"SELECT '{c}' AS variable, '{t}' AS type, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"unique\" FROM orders"
                for c, t in zip(ORDER_COLUMNS, ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"])
            ),
            plain=["variable", "type", "non_null", "nulls", "unique"],
        ),
        entry(
            "categorical_levels",
            lambda s, d: D.distinct_counts(li(s, d), LINE_COLUMNS).filter("unique <= 20"),
            "SELECT * FROM (" + union(LINE_COLUMNS, "SELECT '{c}' AS variable, count(DISTINCT {c}) AS \"unique\" FROM lineitem") + ") WHERE \"unique\" <= 20",
            plain=["variable", "unique"],
        ),
        entry(
            "frequency_priority", lambda s, d: TB.frequency(table(s, d, "orders"), "o_orderpriority"),
            frequency_sql("orders", "o_orderpriority"), plain=["value", "n", "cum_n"], prob=["percent", "cum_percent"],
        ),
        entry(
            "frequency_missing", lambda s, d: TB.frequency(holed_orders(s, d), "priority"),
            frequency_sql(HOLED, "priority"), plain=["value", "n", "cum_n"], prob=["percent", "cum_percent"],
        ),
        entry(
            "frequency_source", lambda s, d: TB.frequency(table(s, d, "documents"), "source"),
            frequency_sql("documents", "source"), plain=["value", "n", "cum_n"], prob=["percent", "cum_percent"],
        ),
        entry(
            "frequency_role", lambda s, d: TB.frequency(table(s, d, "conversations"), "role"),
            frequency_sql("conversations", "role"), plain=["value", "n", "cum_n"], prob=["percent", "cum_percent"],
        ),
        entry(
            "crosstab_flag_status", lambda s, d: TB.crosstab(li(s, d), "l_returnflag", "l_linestatus"),
            crosstab_sql("lineitem", "l_returnflag", "l_linestatus"),
            plain=["row_value", "col_value", "n", "row_total", "col_total"], prob=["row_percent"],
        ),
        entry(
            "crosstab_labels", lambda s, d: TB.crosstab(table(s, d, "labels"), "quality", "toxic"),
            crosstab_sql("labels", "quality", "toxic"),
            plain=["row_value", "col_value", "n", "row_total", "col_total"], prob=["row_percent"],
        ),
        entry(
            "crosstab_wide", lambda s, d: TB.crosstab_wide(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]),
            "SELECT coalesce(o_orderpriority, 'Total') AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", "
            "count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\", count(*) AS \"Total\" "
            "FROM orders GROUP BY ROLLUP (o_orderpriority)",
            plain=["o_orderpriority", "F", "O", "P", "Total"],
        ),
        entry(
            "crosstab_wide_percent",
            lambda s, d: TB.crosstab_wide(table(s, d, "documents"), "source", "lang", _langs(s, d), percent=True).unpivot(
                ["source"], [*_langs(s, d), "Total"], "lang", "row_percent"
            ).filter("row_percent is not null"),
            "SELECT coalesce(row_value, 'Total') AS source, coalesce(col_value, 'Total') AS lang, row_percent FROM (" + crosstab_sql("documents", "source", "lang") + ")",
            plain=["source", "lang"], prob=["row_percent"],
        ),
        entry("unique_values", lambda s, d: TB.unique_values(table(s, d, "part"), "p_name"), UNIQUE_VALUES,
              plain=["value", "n", "is_other", "cum_n"], prob=["percent", "cum_percent"]),
        entry("top_categories", lambda s, d: TB.top_categories(table(s, d, "part"), "p_brand"), TOP_CATEGORIES, plain=["value", "n", "is_other"]),
        entry(
            "list_head", lambda s, d: R.head(table(s, d, "orders"), ["o_orderdate", "o_orderkey"]),
            "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10",
            plain=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], sig=["o_totalprice"],
        ),
        entry(
            "list_tail", lambda s, d: R.tail(table(s, d, "orders"), ["o_orderdate", "o_orderkey"]),
            "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10",
            plain=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], sig=["o_totalprice"],
        ),
        entry("list_sample", lambda s, d: R.sample_rows(table(s, d, "orders"), "o_orderkey").select(*ORDER_COLUMNS),
              f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders ORDER BY {sample_key('o_orderkey')}, o_orderkey LIMIT 10", plain=[c for c in ORDER_COLUMNS if c != "o_totalprice"], sig=["o_totalprice"]),
        entry("shapiro_wilk_balance", lambda s, d: normality.shapiro_wilk(table(s, d, "customer"), "c_acctbal"), shapiro_sql("SELECT * FROM customer", "c_acctbal"),
              plain=["n", "normal"], sig=["w_stat"], prob=["p_value"], digits=6, places=5),
    ]


def _langs(s: SparkSession, d: str) -> list[str]:
    rows = TB.value_counts(table(s, d, "documents"), "lang").orderBy("value").collect()
    return [r["value"] for r in rows]
