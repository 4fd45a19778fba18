"""Numbers behind the figures, and streaming summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.descriptive import MEASURES, TOP_CATEGORIES, li
from catalog.grouping import CORR_SQL
from catalog.regression import LINES, XS, Y, reg, with_fit
from catalog.sqlgen import Entry, entry, ols_sql, sample_key, t_crit, t_two_sided, table
from econspark.functions.dist import normal_quantile_sql
from econspark.operators import plotdata as L
from econspark.session import ensure_checkpoint_dir
from econspark.streaming.summaries import stream_summarize, windowed_summarize, write_available


def histogram_sql(source: str, c: str, bins: str) -> str:
    return (
        f"WITH lim AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, {bins} AS k FROM {source}) "
        f"SELECT b.i::INT AS bin, lo + (b.i - 1) * (hi - lo) / k AS lower, CASE WHEN b.i = k THEN hi ELSE lo + b.i * (hi - lo) / k END AS upper, "
        f"(SELECT count(*) FROM {source} AS s WHERE s.{c} IS NOT NULL AND least(k, floor((s.{c} - lo) / ((hi - lo) / k)) + 1) = b.i) AS n "
        f"FROM lim, range(1, 100) AS b(i) WHERE b.i <= k"
    )


def bins_sql(source: str, c: str, limit: int) -> str:
    return f"least({limit}, (SELECT count(DISTINCT {c}) FROM {source}))"


HIST = dict(plain=["bin", "n"], sig=["lower", "upper"], digits=10)

GROUPED_HIST = """
WITH g AS (SELECT o_orderpriority AS "group", count(*) AS group_n, avg(o_totalprice) AS group_mean, stddev_samp(o_totalprice) AS group_sd,
                  min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(20, count(DISTINCT o_totalprice)) AS k FROM orders GROUP BY 1),
c AS (SELECT g."group", least(k, floor((o_totalprice - lo) / ((hi - lo) / k)) + 1) AS bin, count(*) AS n FROM orders JOIN g ON o_orderpriority = g."group" GROUP BY 1, 2)
SELECT "group", bin::INT AS bin, lo + (bin - 1) * (hi - lo) / k AS lower, CASE WHEN bin = k THEN hi ELSE lo + bin * (hi - lo) / k END AS upper,
       coalesce(n, 0) AS n, group_n, group_mean, group_sd FROM (SELECT *, unnest(range(1, k::INT + 1)) AS bin FROM g) LEFT JOIN c USING ("group", bin)
"""


def box_sql(source: str, c: str, by: str = "") -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    q = (
        f"(SELECT {key}count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM {source}{group})"
    )
    inside = f"s.{c} >= q1 - 1.5 * (q3 - q1) AND s.{c} <= q3 + 1.5 * (q3 - q1)"
    join = f"USING ({by})" if by else "ON true"
    return (
        f"SELECT {key}'{c}' AS variable, any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, min(s.{c}) FILTER ({inside}) AS whisker_lo, "
        f"max(s.{c}) FILTER ({inside}) AS whisker_hi, count(*) FILTER (NOT ({inside})) AS n_outliers FROM {source} AS s JOIN {q} AS q {join}{group}"
    )


BOX = dict(sig=["q1", "median", "q3", "whisker_lo", "whisker_hi"])

def density_sql(source: str, v: str) -> str:
    """The kernel summed over all rows."""
    return f"""
WITH d AS (SELECT {v} AS v FROM {source}),
st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS w FROM d),
g AS (SELECT i::INT AS point, lo - 3 * w + i * ((hi + 3 * w) - (lo - 3 * w)) / 99 AS x, w, n FROM st, range(0, 100) AS r(i))
SELECT point, any_value(x) AS x, sum(exp(-pow((x - v) / w, 2) / 2)) / any_value(n * w * sqrt(2 * pi())) AS density FROM g, d GROUP BY point
"""


OUTLIER = "CASE WHEN c_custkey = 1 THEN 1e6 ELSE c_acctbal END"


def scatter_sql() -> str:
    def part(x: str) -> str:
        r = f"corr({Y}, {x})"
        p = t_two_sided(f"{r} * sqrt((count(*) - 2) / (1 - pow({r}, 2)))", "count(*) - 2")
        return f"SELECT '{x}' AS variable, count(*) AS n, {r} AS r, {p} AS p_value, {p} < 0.05 AS significant, regr_slope({Y}, {x}) AS slope, regr_intercept({Y}, {x}) AS intercept FROM lineitem"

    return " UNION ALL ".join(part(x) for x in XS)


def qq(s: SparkSession, d: str) -> DataFrame:
    return L.qq_points(table(s, d, "customer"), "c_acctbal", 400)


QQ_SQL = """
WITH r AS (SELECT c_acctbal AS observed, row_number() OVER (ORDER BY c_acctbal) AS rank, count(*) OVER () AS n FROM customer)
SELECT rank, observed FROM r WHERE rank IN (SELECT floor(i * (m.n - 1) / (least(400, m.n) - 1.0))::BIGINT + 1 FROM (SELECT count(*) AS n FROM customer) AS m, range(0, 400) AS g(i) WHERE i < m.n)
"""


QQ_POINTS_SQL = (
    "SELECT rank, observed, " + normal_quantile_sql("p") + " AS theoretical FROM (SELECT *, CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n) "
    f"ELSE (rank - 0.3175) / (n + 0.365) END AS p FROM ({QQ_SQL}), (SELECT count(*)::DOUBLE AS n FROM customer))"
)
LINE_KEY = "l_orderkey, l_linenumber, l_partkey"
LINE_DIGEST = sample_key("l_orderkey", "l_linenumber", "l_partkey")


def residual_points_sql() -> str:
    ctes, fit = with_fit("SELECT p_partkey, p_size, p_retailprice FROM part", "p_retailprice", ["p_size"])
    return f"WITH {ctes} SELECT p_partkey, p_size, fitted, residual FROM ({fit}) ORDER BY {sample_key('p_partkey')}, p_partkey LIMIT 500"


def avplot_points_sql() -> str:
    a = ols_sql(f"SELECT l_quantity, l_discount, {Y} FROM lineitem", "l_quantity", ["l_discount"], prefix="a")
    b = ols_sql(f"SELECT l_quantity, l_discount, {Y} FROM lineitem", Y, ["l_discount"], prefix="b")
    return (
        f"WITH {a}, {b} SELECT {LINE_KEY}, l_quantity - (SELECT b_0 FROM a) - (SELECT b_1 FROM a) * l_discount AS x_residual, "
        f"{Y} - (SELECT b_0 FROM b) - (SELECT b_1 FROM b) * l_discount AS y_residual FROM lineitem ORDER BY {LINE_DIGEST}, {LINE_KEY} LIMIT 500"
    )


def residual_histogram_sql() -> str:
    ctes, fit = with_fit(f"SELECT l_quantity, {Y} FROM lineitem", Y, ["l_quantity"])
    return (
        f"WITH {ctes}, e AS ({fit}), lim AS (SELECT min(residual) AS lo, max(residual) AS hi FROM e), "
        "c AS (SELECT least(20, floor((residual - lo) / ((hi - lo) / 20)) + 1) AS bin, count(*) AS n FROM e, lim GROUP BY 1) "
        "SELECT i::INT AS bin, lo + (i - 1) * (hi - lo) / 20 AS lower, lo + i * (hi - lo) / 20 AS upper, coalesce(n, 0) AS n FROM lim, range(1, 21) AS g(i) LEFT JOIN c ON c.bin = g.i"
    )


def avplot_line_sql() -> str:
    a = ols_sql(f"SELECT l_quantity, l_discount, {Y} FROM lineitem", "l_quantity", ["l_discount"], prefix="a")
    b = ols_sql(f"SELECT l_quantity, l_discount, {Y} FROM lineitem", Y, ["l_discount"], prefix="b")
    rows = (
        f"SELECT l_quantity - (SELECT b_0 FROM a) - (SELECT b_1 FROM a) * l_discount AS ex, {Y} - (SELECT b_0 FROM b) - (SELECT b_1 FROM b) * l_discount AS ey FROM lineitem"
    )
    return (
        f"WITH {a}, {b}, p AS ({rows}), l AS (SELECT min(ex) AS lo, max(ex) AS hi, regr_slope(ey, ex) AS s, count(*) AS n, regr_sxx(ey, ex) AS sxx, regr_syy(ey, ex) AS syy FROM p), "
        "grid AS (SELECT *, i::INT AS point, lo + i * (hi - lo) / 99.0 AS x FROM l, range(0, 100) AS g(i)), "
        f"band AS (SELECT *, s * x AS fitted, {t_crit('n - 2', 0.95)} * sqrt((syy - s * s * sxx) / (n - 2) * (1.0 / n + x * x / sxx)) AS reach FROM grid) "
        "SELECT point, x, fitted, fitted - reach AS lower_95, fitted + reach AS upper_95 FROM band"
    )


# --- streams -------------------------------------------------------------------------------------


def events_stream(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(s: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(s)}/{name}-{uuid.uuid4().hex}"


def streamed_summary(s: SparkSession, d: str) -> DataFrame:
    """Complete-mode summary per event type; each batch replaces the stored result."""
    out = _folder(s, "stream-summary")
    result = stream_summarize(events_stream(s, d), ["value"], by="event_type")

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    write_available(result, "complete", _folder(s, "stream-state")).foreachBatch(store).start().awaitTermination()
    return s.read.parquet(out)


def streamed_windows(s: SparkSession, d: str) -> DataFrame:
    """Append-mode windows: those that the watermark has closed."""
    out = _folder(s, "stream-windows")
    result = windowed_summarize(events_stream(s, d), "value", "ts", "1 day", by="event_type", watermark="10 minutes")
    write_available(result, "append", _folder(s, "stream-state")).format("parquet").option("path", out).start().awaitTermination()
    return s.read.schema(result.schema).parquet(out)


def streamed_open_windows(s: SparkSession, d: str) -> DataFrame:
    """Complete-mode windows: closed and open ones."""
    out = _folder(s, "stream-all-windows")
    result = windowed_summarize(events_stream(s, d), "value", "ts", "1 day", by="event_type", watermark="10 minutes")

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    write_available(result, "complete", _folder(s, "stream-state")).foreachBatch(store).start().awaitTermination()
    return s.read.parquet(out)


WINDOW_SQL = (
    "SELECT * FROM (SELECT date_trunc('day', ts) AS day, event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max "
    "FROM events GROUP BY 1, 2) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
)


def entries() -> list[Entry]:
    orders = lambda s, d: table(s, d, "orders")
    return [
        entry("histogram_price", lambda s, d: L.histogram(li(s, d), Y), histogram_sql("lineitem", Y, bins_sql("lineitem", Y, 30)), **HIST),
        entry("histogram_few_values", lambda s, d: L.histogram(li(s, d), "l_linenumber"), histogram_sql("lineitem", "l_linenumber", bins_sql("lineitem", "l_linenumber", 30)), **HIST),
        entry("histogram_by_priority", lambda s, d: L.grouped_histogram(orders(s, d), "o_orderpriority", "o_totalprice"), GROUPED_HIST,
              plain=["group", "bin", "n", "group_n"], sig=["lower", "upper", "group_mean", "group_sd"], digits=10),
        entry("histogram_group_sizes", lambda s, d: L.group_size_histogram(orders(s, d), "o_custkey"),
              histogram_sql("(SELECT count(*) AS size FROM orders GROUP BY o_custkey)", "size", bins_sql("(SELECT count(*) AS size FROM orders GROUP BY o_custkey)", "size", 30)), **HIST),
        entry("box_stats", lambda s, d: L.box_stats(table(s, d, "events"), "value"), box_sql("events", "value"), plain=["variable", "n", "n_outliers"], **BOX),
        entry("box_stats_by_type", lambda s, d: L.box_stats(table(s, d, "events"), "value", "event_type"), box_sql("events", "value", "event_type"),
              plain=["event_type", "variable", "n", "n_outliers"], **BOX),
        entry("category_bars", lambda s, d: L.category_bars(table(s, d, "part"), "p_brand"), TOP_CATEGORIES, plain=["value", "n", "is_other"]),
        entry("mean_bars", lambda s, d: L.mean_bars(orders(s, d), "o_orderpriority", "o_totalprice"),
              "SELECT o_orderpriority AS \"group\", count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) / sqrt(count(*)) AS std_error FROM orders GROUP BY 1",
              plain=["group", "n"], sig=["mean", "std_error"]),
        entry("scatter_points", lambda s, d: L.scatter(orders(s, d), "o_totalprice", "o_custkey", "o_orderkey", 1000)["points"],
              f"SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY {sample_key('o_orderkey')}, o_orderkey LIMIT 1000", plain=["o_orderkey", "o_custkey"], sig=["o_totalprice"]),
        entry("scatter_statistics", lambda s, d: L.scatter_statistics(li(s, d), Y, XS), scatter_sql(), plain=["variable", "n", "significant"],
              sig=["slope", "intercept"], prob=["r", "p_value"], digits=6),
        entry("correlation_heat_map", lambda s, d: L.heat_map(li(s, d), MEASURES), f"SELECT var2 AS var1, var1 AS var2, r FROM ({CORR_SQL})", plain=["var1", "var2"], prob=["r"], places=8),
        entry("density_balance", lambda s, d: L.density(table(s, d, "customer"), "c_acctbal"), density_sql("customer", "c_acctbal"), plain=["point"], sig=["x", "density"], digits=6),
        entry("density_outlier", lambda s, d: L.density(table(s, d, "customer").select(F.expr(OUTLIER).alias("v")), "v"), density_sql("customer", OUTLIER),
              plain=["point"], sig=["x"], prob=["density"], digits=6, places=10),
        entry("pair_grid_points", lambda s, d: L.pair_grid(li(s, d), ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey"], 1000)["points"],
              f"SELECT {LINE_KEY}, l_quantity, l_discount, l_tax FROM lineitem ORDER BY {LINE_DIGEST}, {LINE_KEY} LIMIT 1000", plain=["l_orderkey", "l_linenumber", "l_partkey"], sig=["l_quantity", "l_discount", "l_tax"]),
        entry("residual_points", lambda s, d: L.residual_points(table(s, d, "part"), "p_retailprice", "p_size", "p_partkey", 500), residual_points_sql(), plain=["p_partkey", "p_size"], sig=["fitted"], prob=["residual"], digits=7, places=5),
        entry("residual_histogram", lambda s, d: L.residual_histogram(li(s, d), Y, "l_quantity"), residual_histogram_sql(), plain=["bin", "n"], sig=["lower", "upper"], digits=6),
        entry("qq_observed", qq, QQ_SQL, plain=["rank"], sig=["observed"]),
        entry("qq_theoretical", qq, QQ_POINTS_SQL, plain=["rank"], sig=["observed"], prob=["theoretical"], places=8),
        entry("qq_line", lambda s, d: L.qq_line(qq(s, d)), f"SELECT regr_slope(observed, theoretical) AS slope, regr_intercept(observed, theoretical) AS intercept, corr(observed, theoretical) AS r FROM ({QQ_POINTS_SQL})",
              sig=["slope", "intercept"], prob=["r"], digits=7),
        entry("group_heat_map", lambda s, d: L.heat_cells(orders(s, d), "o_orderpriority", "o_orderstatus", "o_totalprice"),
              "SELECT o_orderpriority AS row_value, o_orderstatus AS col_value, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1, 2",
              plain=["row_value", "col_value", "n"], sig=["mean"]),
        entry("avplot_points", lambda s, d: L.added_variable_points(li(s, d), Y, "l_quantity", ["l_discount"], ["l_orderkey", "l_linenumber", "l_partkey"], 500), avplot_points_sql(),
              plain=["l_orderkey", "l_linenumber", "l_partkey"], prob=["x_residual", "y_residual"], places=4),
        entry("avplot_line", lambda s, d: L.added_variable_line(li(s, d), Y, "l_quantity", ["l_discount"]), avplot_line_sql(), plain=["point"], sig=["x"], prob=["fitted", "lower_95", "upper_95"], digits=6, places=4),
        entry("predictions_total", lambda s, d: reg(s, d).predictions.agg(F.count("*").alias("n"), F.sum("fitted").alias("fitted"), F.sum(F.col("residual") * F.col("residual")).alias("ssr")),
              f"WITH {ols_sql(LINES, Y, XS)} SELECT n, n * mean_y AS fitted, ssr FROM o", plain=["n"], sig=["fitted", "ssr"], digits=8),
        entry("stream_summarize", streamed_summary,
              "SELECT event_type, 'value' AS variable, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max FROM events GROUP BY event_type",
              plain=["event_type", "variable", "n"], sig=["mean", "sd", "min", "max"]),
        entry("stream_windows", lambda s, d: streamed_windows(s, d).withColumn("day", F.date_format("window_start", "yyyy-MM-dd")),
              f"SELECT strftime(day, '%Y-%m-%d') AS day, event_type, n, mean, sd, min, max FROM ({WINDOW_SQL})",
              plain=["day", "event_type", "n"], sig=["mean", "sd", "min", "max"]),
        entry("stream_all_windows", lambda s, d: streamed_open_windows(s, d).withColumn("day", F.date_format("window_start", "yyyy-MM-dd")),
              "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2",
              plain=["day", "event_type", "n"], sig=["mean", "sd", "min", "max"]),
    ]
