"""URL rules, indexed by their rarest literal token.

A rule names a host (it and all subdomains; empty: any host) and the beginning of a path, in which ``*`` stands for
any characters. Every rule becomes one regular expression over ``host + path`` and a list of the literal tokens that any
fitting URL holds as whole tokens. The rule is filed under the token that fewest URLs have. A URL looks
up its own tokens and runs only the expressions found there. Rules without a whole token are tried on every URL.
All steps are DataFrame operations; the work is done once per distinct URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, need

TOKEN_BREAK = "[^0-9A-Za-z]+"
#: Rule tables up to this many rows are broadcast (at most some 20 MB); larger ones are joined as Spark sees fit.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"
    #: Own rules of a caller outrank shorter ones by length alone; rules of a lower tier only speak where no higher one fits.
    tier: int = 1

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def regex(self) -> str:
        """Java expression over host + path, matched from the start."""
        host = rf"(?:[^/]*\.)?{_quoted(self.host)}" if self.host else "[^/]*"
        return f"(?s)^{host}{'.*'.join(_quoted(p) for p in self.path.split('*'))}"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that stand between breaks on both sides in every fitting URL."""
        found: set[str] = set()
        body = f"{'.' + self.host if self.host else '*'}{self.path}*"
        for piece in re.split(r"(\*)", body):
            for m in re.finditer(r"[0-9A-Za-z]+", piece):
                if m.start() > 0 and m.end() < len(piece):
                    found.add(m[0])
        return sorted(found)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/ ])", r"\\\1", text)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``tier`` and ``verdict``.

    Of the fitting rules the highest tier wins, then the longest text, then the first text in order. Rows whose URL is
    null, empty or fits no rule get a null rule and the default verdict. Repeated rows stay. Columns of ``pages``
    with the names of result columns are replaced.
    """
    need(pages, url)
    spark = pages.sparkSession
    out = ("host", "path", "rule", "tier", "verdict")
    pages = pages.drop(*[c for c in out if c != url])
    if len({(r.tier, r.text) for r in rules}) < len(rules):
        raise ValueError("two rules of a tier have the same host and path")
    site = pages.select(F.col(url).alias("_u")).where("_u is not null").distinct().select("_u", F.concat(url_host(F.col("_u")), url_path(F.col("_u"))).alias("_s"))
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    table = spark.createDataFrame(
        [(r.text, r.action, r.regex, r.tier, r.tokens) for r in rules],
        "_rule string, _action string, _regex string, _tier int, _tokens array<string>",
    )
    said = site.select("_u", "_s", F.explode(F.array_distinct(F.split("_s", TOKEN_BREAK))).alias("_token"))
    of_rules = table.select("_tier", "_rule", F.explode("_tokens").alias("_token"))
    held = said.join(small(of_rules.select("_token").distinct()), "_token").groupBy("_token").agg(F.count("*").alias("_n"))
    rarest = (
        of_rules.join(held, "_token", "left")
        .groupBy("_tier", "_rule")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("t")))["t"].alias("_token"))
    )
    index = table.drop("_tokens").join(rarest, ["_tier", "_rule"], "left")
    candidates = said.join(small(index.where("_token is not null")), "_token").drop("_token")
    if any(not r.tokens for r in rules):  # as many rows more as such rules and URLs have to be compared anyway
        loose = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("_rule", "_action", "_regex", "_tier"), (r.text, r.action, r.regex, r.tier), strict=True)]) for r in rules if not r.tokens]
        candidates = candidates.unionByName(site.select("_u", "_s", F.inline(F.array(*loose))))
    best = (
        candidates.where(F.expr("_s rlike _regex"))
        .groupBy("_u")
        .agg(F.min(F.struct((-F.col("_tier")).alias("a"), (-F.length("_rule")).alias("b"), F.col("_rule").alias("rule"), F.col("_action").alias("action"))).alias("_b"))
    )
    return pages.join(best, F.col(url) == F.col("_u"), "left").select(
        *[F.col(f"`{c}`") for c in pages.columns],
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
        F.col("_b.rule").alias("rule"),
        (-F.col("_b.a")).alias("tier"),
        F.coalesce("_b.action", F.lit(default)).alias("verdict"),
    )
