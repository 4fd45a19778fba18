"""Exact quantiles, mid-ranks, row numbers and neighbours without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from econspark.plans.buckets import OrderBuckets, bucket_count, fit_buckets, from_sketch, ordered_parts, part_offsets, sketch
from econspark.schema import as_list, check_columns, drop_missing, number

# A hash map of at most this many distinct (group, column, value) entries may sit in one task.
SMALL_DISTINCT = 20_000
# Rank targets up to this many rows are shipped to every executor; larger sets are joined by shuffle.
SMALL_TARGETS = 500_000
# Size parameter of the sketches of whole columns; what the brackets of all columns hold is sorted up to a bound a column.
LEAST_SKETCH, MOST_SKETCH = 16_384, 65_535
MOST_BRACKETED = 50_000_000


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column) with a value: ``by…, variable, value``."""
    keys = [F.col(f"`{k}`") for k in by]
    if len(cols) == 1:
        rows = df.select(*keys, F.lit(cols[0]).alias("variable"), number(df, cols[0]).alias("value"))
    else:
        pairs = [F.struct(F.lit(c).alias("variable"), number(df, c).alias("value")) for c in cols]
        rows = df.select(*keys, F.inline(F.array(*pairs)))
    return rows.filter(F.col("value").isNotNull())


def quantiles(
    df: DataFrame,
    cols: str | Sequence[str],
    probs: Sequence[float],
    by: str | Sequence[str] | None = None,
    *,
    accuracy: int | None = None,
    method: str = "auto",
) -> DataFrame:
    """Quantiles with linear interpolation: ``by…, variable, n, q`` (``q`` in the order of ``probs``).

    Whole columns go through ``moments_and_quantiles``, two reads. With groups, or where brackets would hold too many
    rows, a first pass takes a sketch and a distinct estimate per column. Columns with few distinct values
    go through the built-in exact ``percentile``, whose hash map then stays small. For the others rows
    are counted per bucket, only the buckets that hold a wanted rank are kept, and just those are
    put in order. ``accuracy`` asks for ``percentile_approx`` instead; ``method`` can force
    ``"percentile"`` or ``"selection"``.
    """
    cols, by = as_list(cols), as_list(by)
    check_columns(df, [*cols, *by])
    keys = [F.col(f"`{k}`") for k in by]
    probs = [float(p) for p in probs]
    if not by and accuracy is None and method == "auto":
        found = moments_and_quantiles(df, cols, probs)
        if found is not None:
            return found.select("variable", "n", "q").filter("n > 0")
    names = [f"_v{i}" for i in range(len(cols))]
    rows = drop_missing(df, by).select(*keys, *[number(df, c).alias(v) for c, v in zip(cols, names)])

    def wide(chosen: list[int], quantile) -> DataFrame:
        parts = [
            F.struct(F.lit(cols[i]).alias("variable"), F.count(names[i]).alias("n"), quantile(names[i]).alias("q"))
            for i in chosen
        ]
        table = rows.groupBy(*keys).agg(F.array(*parts).alias("_rows")).select(*keys, F.inline("_rows"))
        return table.filter("n > 0")

    everything = list(range(len(cols)))
    if accuracy is not None:
        return wide(everything, lambda v: F.percentile_approx(v, probs, accuracy))
    fixed = ", ".join(f"{p!r}D" for p in probs)

    def exact(v: str):
        return F.expr(f"percentile({v}, array({fixed}))")

    if method == "percentile":
        return wide(everything, exact)

    buckets = bucket_count(rows)
    probe = rows.agg(
        F.approx_count_distinct(F.struct(*keys), 0.05).alias("groups") if by else F.lit(1).alias("groups"),
        *[
            F.approx_count_distinct(F.when(F.col(v).isNotNull(), F.struct(*keys, v)) if by else v, 0.05).alias(f"d{v}")
            for v in names
        ],
        *[sketch(v, buckets).alias(f"p{v}") for v in names],
    ).first()
    few = [i for i, v in enumerate(names) if method == "auto" and probe[f"d{v}"] <= SMALL_DISTINCT]
    many = [i for i in everything if i not in few]
    frames = []
    if few:
        frames.append(wide(few, exact))
    if many:
        placed = rows
        for i in many:
            placed = from_sketch(probe[f"p{names[i]}"]).assign(placed, names[i], f"_b{i}")
        parts = [
            F.struct(F.lit(cols[i]).alias("variable"), F.col(f"_b{i}").alias("bucket"), F.col(names[i]).alias("value"))
            for i in many
        ]
        if len(parts) == 1:
            bucketed = placed.select(*keys, parts[0].alias("_r")).select(*keys, "_r.*")
        else:
            bucketed = placed.select(*keys, F.inline(F.array(*parts)))
        bucketed = bucketed.filter(F.col("value").isNotNull())
        frames.append(_select_ranks(bucketed, [*by, "variable"], probs, probe["groups"] * len(many)))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def moments_and_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], extras: Sequence[Column] = ()):
    """Moments and exact quantiles of whole columns in two reads: ``variable, n_total, n, mean, sd, min, max, skew_pop, kurt_pop, q``.

    The first read runs at once and gives each column a mergeable sketch (KLL). A bracket of two values, some ten standard errors of the sketch to
    either side, is put around every wanted order statistic. The second read adds up rows between the brackets, and by value rows
    within them, a few of a thousand; counts tell the ranks. Powers of the distance from the sketched median, which is within one standard deviation
    of the mean, ride along and give the moments. None where the brackets would hold too many rows for one sort.
    With ``extras``, any aggregates of ``df``, the result is their row, from the first read, and the table.
    """
    names = [f"_v{i}" for i in range(len(cols))]
    k = MOST_SKETCH if len(cols) <= 8 else LEAST_SKETCH
    reach = 4 * 2.446 / k**0.9433  # four times the error that 99 of 100 sketches keep
    points = [0.5, *[x for p in probs for x in (max(0.0, p - reach), min(1.0, p + reach))]]
    at = ", ".join(f"{x!r}D" for x in points)
    taken = df.select("*" if extras else F.lit(0).alias("_"), *[number(df, c).alias(v) for c, v in zip(cols, names)])
    sketches = [F.expr(f"CASE WHEN count({v}) > 0 THEN kll_sketch_get_quantile_double(kll_sketch_agg_double({v}, {k}), array({at})) END").alias(f"p{v}") for v in names]
    first = taken.agg(*extras, *[F.count(v).alias(f"n{v}") for v in names], *sketches).first()
    if max(first[f"n{v}"] for v in names) * 2 * reach * len(probs) > MOST_BRACKETED:
        return None

    cells, ranks, placed = [], {}, taken
    for i, v in enumerate(names):
        n, found = first[f"n{v}"], first[f"p{v}"]
        if n * reach <= 8:  # a small table lies in its brackets whole
            placed = placed.withColumn(f"_z{i}", F.lit(1))
        else:
            splits: list[float] = []  # zones with odd numbers are brackets
            for lo, hi in sorted(zip(found[1::2], found[2::2])):
                beyond = math.nextafter(hi, math.inf)
                if splits and lo <= splits[-1]:
                    splits[-1] = max(splits[-1], beyond)
                else:
                    splits += [lo, beyond]
            if math.isinf(splits[0]) or math.isinf(splits[-1]):  # more infinite values than a bracket is wide
                return None
            placed = OrderBuckets((-math.inf, *splits, math.inf)).assign(placed, v, f"_z{i}")
        middle = found[0] if n and math.isfinite(found[0]) else 0.0
        zone = f"CASE WHEN {v} IS NOT NULL THEN _z{i} END"
        cells.append(f"struct({i} AS i, {zone} AS zone, CASE WHEN _z{i} % 2 = 1 THEN {v} END AS value, {v} AS v, {v} - {middle!r}D AS d)")
        for j, q in enumerate(p * (n - 1) for p in probs):
            ranks[i, j] = (math.floor(q), math.ceil(q), q - math.floor(q)) if n else None

    long = placed.select(F.inline(F.expr(f"array({', '.join(cells)})")))
    counts = long.groupBy("i", "zone", "value").agg(
        F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), *[F.sum(F.expr("*".join(["d"] * e))).alias(f"s{e}") for e in range(1, 5)]
    )
    present = "CASE WHEN zone IS NOT NULL THEN n ELSE 0 END"
    upto = f"sum({present}) OVER (PARTITION BY i ORDER BY zone, value ROWS UNBOUNDED PRECEDING)"
    ranked = counts.selectExpr("*", f"{upto} - {present} AS lo", f"{upto} AS hi")
    # A wanted rank outside its bracket must not pass for a NULL.
    value = "CASE WHEN zone % 2 = 0 THEN raise_error('a quantile lies outside its bracket') ELSE value END"
    picks = []
    for j in range(len(probs)):
        for side, name in enumerate(("below", "above")):
            cases = " ".join(f"WHEN i = {i} AND lo <= {ranks[i, j][side]} AND hi > {ranks[i, j][side]} THEN {value}" for i in range(len(cols)) if ranks[i, j])
            picks.append(F.expr(f"max(CASE {cases} END)" if cases else "max(CAST(NULL AS DOUBLE))").alias(f"{name}{j}"))
    q = ", ".join(
        f"below{j} + CASE i " + " ".join(f"WHEN {i} THEN {ranks[i, j][2]!r}D" for i in range(len(cols)) if ranks[i, j]) + f" ELSE 0D END * (above{j} - below{j})"
        if any(ranks[i, j] for i in range(len(cols))) else "CAST(NULL AS DOUBLE)"
        for j in range(len(probs))
    )
    sums = [F.sum(f"s{e}").alias(f"s{e}") for e in range(1, 5)]
    table = ranked.groupBy("i").agg(F.sum("n").alias("n_total"), F.coalesce(F.max("hi"), F.lit(0)).alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), *sums, *picks)
    middle = "CASE i " + " ".join(f"WHEN {i} THEN {first[f'p{v}'][0]!r}D" for i, v in enumerate(names) if first[f"n{v}"] and math.isfinite(first[f"p{v}"][0])) + " ELSE 0D END"
    table = table.selectExpr("*", "s1 / n AS m1", f"{middle} AS middle" if "WHEN" in middle else "0D AS middle")
    table = table.selectExpr("*", "greatest(s2 - n * m1 * m1, 0D) AS m2", "s3 - 3 * m1 * s2 + 2 * n * m1 * m1 * m1 AS m3", "s4 - 4 * m1 * s3 + 6 * m1 * m1 * s2 - 3 * n * m1 * m1 * m1 * m1 AS m4")
    named = "CASE i " + " ".join(f"WHEN {i} THEN {_text(c)}" for i, c in enumerate(cols)) + " END"
    table = table.selectExpr(
        f"{named} AS variable", "n_total", "n", "middle + m1 AS mean", "CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END AS sd", "min", "max",
        "CASE WHEN m2 > 0 THEN sqrt(CAST(n AS DOUBLE)) * m3 / (m2 * sqrt(m2)) END AS skew_pop", "CASE WHEN m2 > 0 THEN n * m4 / (m2 * m2) - 3 END AS kurt_pop",
        f"CASE WHEN n > 0 THEN array({q}) END AS q",
    )
    return (first, table) if extras else table


def _text(name: str) -> str:
    escaped = name.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _select_ranks(bucketed: DataFrame, group: list[str], probs: list[float], n_groups: int) -> DataFrame:
    """Order statistics by buckets. Rank expressions are SQL text: there are several per quantile."""
    keys = ", ".join(f"`{g}`" for g in group)
    cells_by = [*group, "bucket"]
    position = [f"({p!r}D * (n - 1))" for p in probs]
    ranks = [r for q in position for r in (f"floor({q})", f"ceil({q})")]
    cells = (
        bucketed.groupBy(*cells_by)
        .agg(F.count("value").alias("cell_n"))
        .selectExpr(
            *[f"`{c}`" for c in cells_by],
            "cell_n",
            f"sum(cell_n) OVER (PARTITION BY {keys} ORDER BY bucket ROWS UNBOUNDED PRECEDING) - cell_n AS before",
            f"sum(cell_n) OVER (PARTITION BY {keys}) AS n",
        )
    )
    wanted = " OR ".join(f"({r} >= before AND {r} < before + cell_n)" for r in ranks)
    targets = cells.filter(wanted).select(*cells_by, "before", "n")
    if n_groups * 2 * len(probs) <= SMALL_TARGETS:
        targets = F.broadcast(targets)
    counted = (
        bucketed.join(targets, cells_by)
        .groupBy(*cells_by, "before", "n", "value")
        .agg(F.count("*").alias("value_n"))
    )
    running = f"sum(value_n) OVER (PARTITION BY {keys}, bucket ORDER BY value ROWS UNBOUNDED PRECEDING)"
    ranked = counted.withColumn("lo", F.expr(f"before + {running} - value_n"))
    picks = [
        F.expr(f"max(CASE WHEN {r} >= lo AND {r} < lo + value_n THEN value END) AS r{i}") for i, r in enumerate(ranks)
    ]
    picked = ranked.groupBy(*group, "n").agg(*picks)
    q = ", ".join(f"r{2 * i} + ({x} - floor({x})) * (r{2 * i + 1} - r{2 * i})" for i, x in enumerate(position))
    return picked.selectExpr(*[f"`{g}`" for g in group], "n", f"array({q}) AS q")


def quantile_row(df: DataFrame, col: str, probs: Sequence[float], **options) -> DataFrame:
    """Ungrouped quantiles of one column: a single row ``n, q``."""
    return quantiles(df, col, probs, **options).select("n", "q")


def mid_ranks(df: DataFrame, value: str, group: str) -> DataFrame:
    """Average ranks of ``value`` over the whole table, as counts per (group, value).

    Result: ``group, value, n`` (rows of that group with that value), ``ties`` (rows with that value
    in any group), ``mid_rank`` and ``total`` (all rows).
    """
    rows = drop_missing(df, [group]).select(
        F.col(f"`{group}`").alias("group"), number(df, value).alias("value")
    ).filter(F.col("value").isNotNull())
    buckets = fit_buckets(rows, F.col("value"))
    counts = buckets.assign(rows.groupBy("group", "value").agg(F.count("*").alias("n")), "value")
    cell = Window.partitionBy("bucket")
    ranked = counts.select(
        "group",
        "value",
        "n",
        "bucket",
        F.sum("n").over(Window.partitionBy("bucket", "value")).alias("ties"),
        F.sum("n").over(
            cell.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        ).alias("upto"),
    )
    offsets = _bucket_offsets(buckets.assign(rows, "value"))
    return ranked.join(F.broadcast(offsets), "bucket").select(
        "group",
        "value",
        "n",
        "ties",
        (F.col("before") + F.col("upto") - (F.col("ties") - 1) / 2).alias("mid_rank"),
        "total",
    )


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the number of rows below them: ``value, n, before, total``."""
    rows = df.select(number(df, value).alias("value")).filter(F.col("value").isNotNull())
    buckets = fit_buckets(rows, F.col("value"))
    counts = buckets.assign(rows.groupBy("value").agg(F.count("*").alias("n")), "value")
    upto = F.sum("n").over(
        Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    offsets = _bucket_offsets(buckets.assign(rows, "value"))
    return (
        counts.withColumn("upto", upto)
        .join(F.broadcast(offsets), "bucket")
        .select("value", "n", (F.col("before") + F.col("upto") - F.col("n")).alias("before"), "total")
    )


def _bucket_offsets(bucketed: DataFrame) -> DataFrame:
    """Rows before each bucket; at most MAX_BUCKETS rows, so one window over all of them is small."""
    cells = bucketed.groupBy("bucket").agg(F.count("*").alias("cell_n"))
    upto = F.sum("cell_n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("cell_n").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return cells.select("bucket", (upto - F.col("cell_n")).alias("before"), total.alias("total"))


def row_numbers(df: DataFrame, order_by: str | Sequence[str], out: str = "row_index") -> DataFrame:
    """0-based position of each row in the order of ``order_by`` plus ``total``, the row count."""
    order_by = as_list(order_by)
    check_columns(df, order_by)
    order = [f"`{c}`" for c in order_by]
    parts = ordered_parts(df, *order, part="_part", tie="_tie")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie"))
    return (
        parts.withColumn("_within", within)
        .join(F.broadcast(part_offsets(parts, F.count("*"), "_part")), "_part")
        .withColumn(out, F.col("before") + F.col("_within") - 1)
        .drop("_part", "_tie", "_within", "before")
    )


def successive_changes(
    df: DataFrame,
    values: Sequence[str],
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Change of ``values`` from one row to the next in order: ``partition_by…, values…``.

    Rows lie in range partitions of the keys and the whole order. Changes inside a partition come from ``lag``; the change
    across a border comes from the last and first row of the partitions, a table with one row per key and
    partition that holds it. A key with a large share of the rows is spread over its share of the partitions.
    """
    order_by, keys = as_list(order_by), as_list(partition_by)
    check_columns(df, [*order_by, *keys, *values])
    point = F.struct(*[F.col(f"`{v}`").cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    kept = [F.col(f"`{k}`") for k in keys]
    rows = df.select(*kept, F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order_by)]).alias("order"), point.alias("point"))
    rows = ordered_parts(rows, *kept, "order", part="_part", tie="_tie")
    rows = rows.select(*kept, "_part", F.struct("order", "_tie").alias("pos"), "point")

    previous = F.lag("point").over(Window.partitionBy(*keys, "_part").orderBy("pos"))
    inside = rows.withColumn("prev", previous).filter(F.col("prev").isNotNull())
    edges = rows.groupBy(*keys, "_part").agg(
        F.min_by("point", "pos").alias("point"), F.max_by("point", "pos").alias("last")
    )
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("_part"))
    border = edges.withColumn("prev", before).filter(F.col("prev").isNotNull())

    changes = [
        (F.col(f"point.v{i}") - F.col(f"prev.v{i}")).alias(v) for i, v in enumerate(values)
    ]
    return inside.select(*kept, *changes).unionByName(border.select(*kept, *changes))


def spaced_order_statistics(df: DataFrame, value: str, points: int) -> DataFrame:
    """``rank, value, total`` at up to ``points`` evenly spaced ranks, the first and last included.

    Every distinct value knows how many rows lie below it and hence which of the wanted ranks, if
    any, fall on it.
    """
    table = value_ranks(df, value).withColumn("last", F.col("total") - 1)
    m = F.least(F.lit(points).cast("long"), F.col("total"))
    table = table.withColumn("steps", F.greatest(m - 1, F.lit(0)))
    # rank i is floor(i · last / steps); whole-number arithmetic keeps it exact
    first = F.expr("(before * steps + last - 1) DIV last")
    after = F.expr("((before + n) * steps + last - 1) DIV last - 1")
    hits = F.when(F.col("last") == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.expr("CASE WHEN first <= after THEN sequence(first, after) ELSE array() END")
    )
    table = table.withColumns({"first": F.when(F.col("last") > 0, first), "after": F.when(F.col("last") > 0, after)})
    rank = F.when(F.col("steps") > 0, F.expr("(i * last) DIV steps")).otherwise(F.lit(0).cast("long")) + 1
    return table.withColumn("i", F.explode(hits)).filter("i <= steps").select(rank.alias("rank"), "value", "total")
