"""Empirical-Bayes host reputation: page outcomes shrunk from suffix to registered domain to host.

A host with few labelled pages says little about its next page, so its share of good pages is drawn towards
that of its registered domain, which is drawn towards its public suffix, which is drawn towards all pages.
Each step is a beta-binomial posterior: with the parent's mean ``m`` and a prior weight ``k`` of that many pages,
``good`` of ``n`` pages give Beta(k m + good, k (1 - m) + n - good). The weight of a level is estimated over its
groups by moments: with S the between-group sum of squares, the intra-group correlation ``r`` is what exceeds
the binomial share, and ``k = 1 / r - 1`` within fixed bounds. A page is blocked when the lower posterior bound of
its host, mean minus ``Z`` standard deviations, is below ``MIN_BOUND``. A host without labelled pages is judged by
what its nearest known parent predicts.

All counts are aggregates with partial sums before the shuffle. The tables of levels have one row per group and
are joined by key, so a host that holds a third of all pages is split by Spark's skew handling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lociary.llm.common import store

#: Public suffixes of two labels beside the one-label default; a parameter of the operator.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")

Z = 1.645
MIN_BOUND = 0.6
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
MAX_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block; ``rule`` is a host and the beginning of a path, like ``example.org/es/``."""

    verdict: str
    rule: str


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), two).otherwise(last) if two_label else last


def domain_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix with one label before it; the host itself where it has no more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(two) if two_label else two


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none does. Of two of one length the first in byte order."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.rule), r.rule), reverse=True):
        name, slash, rest = rule.rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule.rule).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _weight(groups: DataFrame) -> float:
    """The prior weight of one level from its groups (n, good, parent mean m)."""
    row = groups.filter("n > 0").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * (F.try_divide("good", "n") - F.col("m")) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("inside"),
    ).first()
    if not row["groups"] or row["total"] <= row["groups"] or not row["inside"]:
        return MOST_WEIGHT
    # around a given parent mean, E[between] = share * (groups + r * (total - groups))
    share = row["inside"] / row["total"]
    r = (row["between"] - share * row["groups"]) / (share * (row["total"] - row["groups"]))
    return round(min(max(1 / r - 1, LEAST_WEIGHT), MOST_WEIGHT), 6) if r > 0 else MOST_WEIGHT


def _level(groups: DataFrame, key: str) -> DataFrame:
    """Posterior of every group of one level from its counts and its parent's mean m."""
    k = F.lit(_weight(groups))
    alpha, beta = k * F.col("m") + F.col("good"), k * (1 - F.col("m")) + F.col("n") - F.col("good")
    return groups.select(key, "n", "good", alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("mean"))


def _with_parent(groups: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    return groups.join(parents.select(parent, F.col("mean").alias("m")), parent)


def host_posteriors(pages: DataFrame, outcomes: DataFrame, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``host, n, good, alpha, beta, mean`` of every host of ``pages (page_id, url)``.

    ``outcomes (page_id, good)``: good is 1 or 0; null outcomes and outcomes of unknown pages count for nothing,
    repeated outcomes count as often as they occur. Without any outcome every host has the mean one half.
    """
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"))
    seen = outcomes.select("page_id", F.col("good").cast("long").alias("good")).dropna().groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")
    )
    counted = hosts.join(seen, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    by_host = store(
        counted.withColumn("domain", domain_of(F.col("host"), two_label)).withColumn("suffix", suffix_of(F.col("host"), two_label)), "hosts"
    )
    counts = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    total = by_host.agg(*counts).first()
    overall = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    suffixes = _level(by_host.groupBy("suffix").agg(*counts).withColumn("m", F.lit(overall)), "suffix")
    domains = _level(_with_parent(by_host.groupBy("domain", "suffix").agg(*counts), suffixes, "suffix"), "domain")
    return _level(_with_parent(by_host, domains, "domain"), "host")


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    *,
    z: float = Z,
    min_bound: float = MIN_BOUND,
    two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, bound`` for every row of ``pages (page_id, url)``.

    A rule decides where one fits; elsewhere the verdict is block if the lower posterior bound of the host is
    below ``min_bound``, else allow. Null urls and urls without ``://`` have an empty host, which is a host like any
    other. Repeated rows stay as many rows; other columns are ignored; an empty table gives an empty table.
    """
    posterior = host_posteriors(pages, outcomes, two_label)
    total = F.col("alpha") + F.col("beta")
    spread = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    bounds = posterior.select("host", F.round(F.col("mean") - F.lit(z) * spread, 9).alias("bound"))
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).join(bounds, "host", "left")
    ruled = judged.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") < min_bound, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), "bound")
