"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (good or not) are counted per host. A host's rate is drawn to that of its registered domain, the
domain's to that of its suffix, and the suffix's to that of all pages: at each level the rates of the units are taken as
draws from a beta distribution around their parent's rate, whose strength is estimated from how much more they scatter than
binomial draws would. A host is blocked if the lower bound of its posterior rate is under a threshold. Hosts without any
outcome have the posterior of their domain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import staged

#: Suffixes of two labels under which names are registered; a parameter, as such lists grow.
TWO_LABELS = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")
THRESHOLD = 0.6
#: Standard deviations between the posterior mean and its bound (one side, 95 %).
DEVIATIONS = 1.645
LEAST_SCATTER, MOST_SCATTER = 1e-4, 0.5

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next /, ?, # or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def suffix_of(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_labels), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> Column:
    """The registered domain: the suffix and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_labels), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one.

    A rule is a verdict and a host with a path behind it; it fits its host and all subdomains if the path starts with its path. For
    lists of up to some hundred rules, which become one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _scatter(units: DataFrame) -> float:
    """How much the rates of units (n, good, parent) scatter beyond binomial draws: the correlation of two pages of one unit."""
    m, n = F.col("parent"), F.col("n")
    excess = F.sum((F.col("good") - n * m) ** 2 - n * m * (1 - m))
    found = units.agg(excess.alias("x"), F.sum(n * (n - 1) * m * (1 - m)).alias("y")).first()
    raw = found["x"] / found["y"] if found["y"] else LEAST_SCATTER
    return min(MOST_SCATTER, max(LEAST_SCATTER, raw))


def host_posteriors(outcomes: DataFrame, hosts: DataFrame, two_labels: Sequence[str] = TWO_LABELS) -> DataFrame:
    """(host, n, good, rate, bound) for each distinct host of `hosts` (host).

    outcomes: (host, good), good 0 or 1, one row per labelled page, or per `pages` of them if there is such a column; null hosts or
    outcomes are left out. rate and bound are the posterior mean and its lower bound. Without any outcome every rate is 0.5 and
    every bound null.
    """
    seen = outcomes.where(F.col("host").isNotNull() & F.col("good").isNotNull())
    pages = F.col("pages") if "pages" in outcomes.columns else F.lit(1)
    seen = seen.groupBy("host").agg(F.sum(pages.cast("bigint")).alias("n"), F.sum(pages * F.col("good").cast("bigint")).alias("good"))
    every = hosts.where(F.col("host").isNotNull()).select("host").distinct().join(seen, "host", "full")
    host = F.col("host")
    every = every.fillna(0, ["n", "good"]).select(
        "host", domain_of(host, two_labels).alias("domain"), suffix_of(host, two_labels).alias("suffix"), "n", "good"
    )
    every = staged(every, "hosts")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    whole = every.agg(*sums).first()
    mean = (whole["good"] + 0.5) / (whole["n"] + 1.0) if whole["n"] else 0.5

    def shrunk(units, scatter):
        strength = 1.0 / scatter - 1.0
        return (F.col("good") + strength * F.col("parent")) / (F.col("n") + strength)

    suffixes = every.groupBy("suffix").agg(*sums).withColumn("parent", F.lit(mean))
    suffixes = suffixes.select("suffix", shrunk(suffixes, _scatter(suffixes)).alias("parent"))
    domains = staged(every.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix"), "domains")
    domains = domains.select("domain", shrunk(domains, _scatter(domains)).alias("parent"))
    units = staged(every.join(domains, "domain"), "host-rates")
    scatter = _scatter(units)
    strength = 1.0 / scatter - 1.0
    a, b = F.col("good") + strength * F.col("parent"), F.col("n") - F.col("good") + strength * (1.0 - F.col("parent"))
    rate = a / (a + b)
    bound = rate - DEVIATIONS * F.sqrt(rate * (1.0 - rate) / (a + b + 1.0))
    bound = bound if whole["n"] else F.lit(None).cast("double")
    return units.select("host", "n", "good", rate.alias("rate"), bound.alias("bound"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    url_col: str = "url",
    threshold: float = THRESHOLD,
    two_labels: Sequence[str] = TWO_LABELS,
) -> DataFrame:
    """All columns of `pages`, with host, path, rule and verdict (allow or block); columns of these names are replaced.

    A rule's verdict stands; without one the host's posterior decides, and without any outcome nothing speaks against a page. Null urls and urls without `://` have an empty host, which is
    judged like any other. Every row gives one row. An empty table gives an empty table.
    """
    url = F.col(url_col)
    out = pages.withColumns({"_host": host_of(url), "_path": path_of(url)})
    rule, says = rule_of(F.col("_host"), F.col("_path"), rules)
    out = out.withColumns({"_rule": rule, "_says": says})
    bounds = host_posteriors(outcomes, out.select(F.col("_host").alias("host")), two_labels)
    bounds = bounds.select(F.col("host").alias("_host"), F.col("bound").alias("_bound"))
    out = out.join(bounds, "_host", "left")
    method = F.when(F.col("_bound") < threshold, "block").otherwise("allow")
    names = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"), "verdict": F.coalesce("_says", method)}
    return out.select(*[F.col(c) for c in pages.columns if c not in names], *[v.alias(k) for k, v in names.items()])
