"""Tests that compare groups: ANOVA, Kruskal–Wallis, t, Mann–Whitney, effect sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from econspark.functions.dist import chi2_sf_col, f_sf_col, mann_whitney_exact_col, norm_sf_col, t_two_sided_col
from econspark.plans.ranks import mid_ranks
from econspark.schema import drop_missing, number

EXACT_ROWS = 8  # a group up to this size is tested by the exact distribution of U


def group_moments(df: DataFrame, group: str, var: str) -> DataFrame:
    """``group, n, mean, m2`` per group, m2 = Σ(x−x̄)²."""
    v = number(df, var)
    rows = drop_missing(df, [group]).filter(v.isNotNull())
    return rows.groupBy(F.col(f"`{group}`").alias("group")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")
    )


def anova(df: DataFrame, group: str, var: str) -> DataFrame:
    """One-way ANOVA: k, n, sums of squares, F, p and η²."""
    g = group_moments(df, group, var)
    # Σ n (m − m̄)² equals n times the weighted variance of the means; regr_* has no weights, so
    # the grand mean comes first, as a scalar of the small table
    grand = g.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    sums = g.withColumn("dev", F.col("mean") - grand).agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("dev") * F.col("dev")).alias("ss_between"),
        F.sum("m2").alias("ss_within"),
    )
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    out = sums.filter(F.col("groups") >= 2).select(
        "groups",
        "n",
        "ss_between",
        "ss_within",
        df1.alias("df_between"),
        df2.alias("df_within"),
        ((F.col("ss_between") / df1) / (F.col("ss_within") / df2)).alias("f_stat"),
        (F.col("ss_between") / (F.col("ss_between") + F.col("ss_within"))).alias("eta_squared"),
    )
    p = f_sf_col(F.col("f_stat"), F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    return out.withColumn("p_value", p)


def kruskal_wallis(df: DataFrame, group: str, var: str) -> DataFrame:
    """H with tie correction, degrees of freedom and p.

    Mid-ranks come as counts per distinct value, so the tables here have one row per (group, value).
    """
    ranks = mid_ranks(df, var, group)
    first = F.col("n") / F.col("ties")  # each tied value contributes its t³ − t once in total
    per_group = ranks.groupBy("group").agg(
        F.sum("n").alias("n"),
        F.max("total").cast("double").alias("total"),
        F.sum(F.col("n") * F.col("mid_rank")).alias("rank_sum"),
        F.sum(first * (F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties"))).alias("tie_part"),
    )
    # centred form of Σ R²/n, which keeps its digits for many rows
    off = F.col("rank_sum") / F.col("n") - (F.col("total") + 1) / 2
    sums = per_group.agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum("tie_part").alias("tie_sum"),
        F.sum(F.col("n") * off * off).alias("spread"),
    )
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("spread")
    correction = 1 - F.col("tie_sum") / (F.pow(n, F.lit(3.0)) - n)
    out = sums.filter(F.col("groups") >= 2).select(
        "groups", "n", (F.col("groups") - 1).alias("df"), (h / correction).alias("h_stat")
    )
    return out.withColumn("p_value", chi2_sf_col(F.col("h_stat"), F.col("df").cast("double")))


def _two_groups(df: DataFrame, group: str, var: str) -> DataFrame:
    """One row with the moments of exactly two groups, a before b in sort order."""
    g = group_moments(df, group, var)
    row = F.struct("group", "n", "mean", "m2")
    return (
        g.agg(F.count("*").alias("groups"), F.min(row).alias("a"), F.max(row).alias("b"))
        .filter("groups = 2")
        .drop("groups")
    )


def t_test(df: DataFrame, group: str, var: str) -> DataFrame:
    """Pooled two-sample t-test and Cohen's d; empty unless there are exactly two groups."""
    g = _two_groups(df, group, var)
    dof = F.col("a.n") + F.col("b.n") - 2
    pooled = F.sqrt((F.col("a.m2") + F.col("b.m2")) / dof)
    diff = F.col("a.mean") - F.col("b.mean")
    out = g.select(
        F.col("a.group").cast("string").alias("group_a"),
        F.col("b.group").cast("string").alias("group_b"),
        F.col("a.n").alias("n_a"),
        F.col("b.n").alias("n_b"),
        dof.alias("df"),
        F.when(pooled > 0, diff / (pooled * F.sqrt(1 / F.col("a.n") + 1 / F.col("b.n")))).alias("t_stat"),
        F.when(pooled > 0, diff / pooled).otherwise(0.0).alias("cohens_d"),
    )
    return out.withColumn("p_value", t_two_sided_col(F.col("t_stat"), F.col("df").cast("double")))


def mann_whitney(df: DataFrame, group: str, var: str) -> DataFrame:
    """U of the first group, z with tie and continuity correction, two-sided p.

    The exact distribution of U where a group has at most EXACT_ROWS rows and no two values tie (``exact``), else the normal approximation.
    """
    ranks = mid_ranks(df, var, group)
    per_group = ranks.groupBy("group").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("mid_rank")).alias("rank_sum"),
        F.sum(F.col("n") / F.col("ties") * (F.pow(F.col("ties").cast("double"), 3) - F.col("ties"))).alias("tie_part"),
    )
    row = F.struct("group", "n", "rank_sum")
    two = per_group.agg(
        F.count("*").alias("groups"), F.min(row).alias("a"), F.max(row).alias("b"), F.sum("tie_part").alias("tie_sum")
    ).filter("groups = 2")
    na, nb = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    n = na + nb
    u = F.col("a.rank_sum") - na * (na + 1) / 2
    spread = F.sqrt(na * nb / 12 * (n + 1 - F.col("tie_sum") / (n * (n - 1))))
    larger = F.greatest(u, na * nb - u)
    out = two.select(
        F.col("a.group").cast("string").alias("group_a"),
        F.col("b.group").cast("string").alias("group_b"),
        F.col("a.n").alias("n_a"),
        F.col("b.n").alias("n_b"),
        u.alias("u_stat"),
        ((larger - na * nb / 2 - 0.5) / spread).alias("z_stat"),
        ((F.least(na, nb) <= EXACT_ROWS) & (F.col("tie_sum") == 0)).alias("exact"),
    )
    some = lambda c: F.when(F.col("exact"), F.col(c).cast("double"))
    exact = mann_whitney_exact_col(some("u_stat"), some("n_a"), some("n_b"))
    return out.withColumn("p_value", F.coalesce(exact, F.least(F.lit(1.0), 2 * norm_sf_col(F.col("z_stat")))))


def comparison_tests(df: DataFrame, group: str, var: str) -> DataFrame:
    """ANOVA and Kruskal–Wallis as two rows: test, statistic, p, effect size."""
    a = anova(df, group, var).select(
        F.lit("One-way ANOVA").alias("test"),
        F.col("f_stat").alias("statistic"),
        "p_value",
        F.col("eta_squared").alias("effect_size"),
    )
    k = kruskal_wallis(df, group, var).select(
        F.lit("Kruskal-Wallis H").alias("test"),
        F.col("h_stat").alias("statistic"),
        "p_value",
        F.lit(None).cast("double").alias("effect_size"),
    )
    return a.unionByName(k)


def pairwise_tests(df: DataFrame, group: str, var: str) -> DataFrame:
    """t-test, Mann–Whitney U and Cohen's d as three rows; empty unless there are two groups."""
    t = t_test(df, group, var)
    none = F.lit(None).cast("double").alias("p_value")
    rows = t.select(F.lit("Independent t-test").alias("test"), F.col("t_stat").alias("statistic"), "p_value")
    u = mann_whitney(df, group, var)
    rows = rows.unionByName(
        u.select(F.lit("Mann-Whitney U").alias("test"), F.col("u_stat").alias("statistic"), "p_value")
    )
    return rows.unionByName(t.select(F.lit("Cohen's d").alias("test"), F.col("cohens_d").alias("statistic"), none))
