"""URL filters: rules, and empirical-Bayes host reputation.

Labelled pages count as bad or good outcomes of their host.  The bad rate of a
suffix is shrunk to that of all pages, a registered domain's (one label more) to
its suffix, and a host's to its domain, each by a beta prior whose strength is
fitted to how much the group rates scatter (method of moments).  A host is blocked
when the lower bound of its posterior bad rate (mean minus ``Z`` standard
deviations) exceeds ``TIMES`` times the rate of all pages, ``MAX_BAD`` at most;
hosts without labels have their domain's posterior.  A rule that fits decides
before the reputation.

Where no labels are given, pages are labelled by what they hold: the quality
labellers vote on the extracted main text, and their votes' weak label (the
labellers' accuracies are estimated over all pages) is the outcome.

DataFrame functions but for the votes; what is gathered is one row per host,
counted map-side.

Defined cases: null urls and urls without ``://`` have empty host and path, fit
no rule and, as one host of their own, follow its reputation; without labels
nothing is blocked but by rule; the longest fitting rule wins; repeated rows are
judged alike and all count as outcomes; pages without text (or null) are labelled
like any other; other columns pass through.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, html_extract, quality

#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MAX_BAD, TIMES, Z = 0.5, 2.0, 1.64
_MIN_STRENGTH, _MAX_STRENGTH = 1.0, 1000.0
#: Labels that make a two-letter country label a suffix of two (``co.uk``); and hosts whose subdomains are registered by others.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")
SHARED_HOSTS = ("blogspot.com", "github.io", "wordpress.com")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffix(host_col: Column) -> Column:
    """The part of a host under which domains are registered: its last label, or two."""
    two = F.substring_index(host_col, ".", -2)
    country = two.rlike(r"^(" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}$")
    return F.when(country | two.isin(*SHARED_HOSTS), two).otherwise(F.substring_index(host_col, ".", -1))


def domain(host_col: Column, suffix_col: Column) -> Column:
    """The registered domain: the suffix and one label more, or the host where it has none."""
    before = F.substring(host_col, F.lit(1), F.length(host_col) - F.length(suffix_col) - 1)
    return F.when(host_col == suffix_col, host_col).otherwise(
        F.concat(F.substring_index(before, ".", -1), F.lit("."), suffix_col))


def rule(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    out = F.lit(None).cast("string")
    for name, _ in sorted(rules, key=lambda r: len(r[0])):
        at = name.index("/")
        h, p = name[:at], name[at:]
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def _strength(groups: DataFrame) -> float:
    """Prior strength from groups (n, bad, mean: the parent's rate): scatter beyond binomial noise."""
    rate = F.col("bad") / F.col("n")
    noise = F.col("mean") * (1 - F.col("mean"))
    s = groups.where("n > 0").agg(F.sum(F.col("n") * F.pow(rate - F.col("mean"), 2)).alias("scatter"),
                                  F.sum(noise).alias("noise"), F.sum(F.col("n") * noise).alias("total"))
    scatter, low, total = (x or 0.0 for x in s.first())                  # one row
    between = (scatter - low) / (total - low) if total > low else 0.0    # correlation inside groups
    return min(_MAX_STRENGTH, max(_MIN_STRENGTH, 1 / between - 1)) if between > 0 else _MAX_STRENGTH


def reputation(outcomes: DataFrame) -> DataFrame:
    """``host``, ``mean``, ``bound``, ``whole`` from ``outcomes`` (host, bad: 1, 0, or null where not labelled)."""
    hosts = common.stage(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
        .withColumn("suffix", suffix(F.col("host"))).withColumn("domain", domain(F.col("host"), F.col("suffix"))), "hosts")
    total = hosts.agg(F.sum("bad"), F.sum("n")).first()                    # one row
    whole = total[0] / total[1] if total[1] else 0.0
    level = common.stage(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
                         .withColumn("mean", F.lit(float(whole))), "suffixes")
    suffixes = level.select("suffix", _posterior(_strength(level)).alias("mean"))
    level = common.stage(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
                         .join(suffixes, "suffix"), "domains")
    domains = level.select("domain", _posterior(_strength(level)).alias("mean"))
    level = common.stage(hosts.join(domains, "domain"), "hosts-up")
    strength = _strength(level)
    mean = _posterior(strength)
    return level.select("host", mean.alias("mean"),
                        (mean - Z * F.sqrt(mean * (1 - mean) / (F.col("n") + strength + 1))).alias("bound"),
                        F.lit(float(whole)).alias("whole"))


def _posterior(strength: float) -> Column:
    return (strength * F.col("mean") + F.col("bad")) / (strength + F.col("n"))


def judge(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", rules=RULES, max_bad: float = MAX_BAD,
          times: float = TIMES) -> DataFrame:
    """``row`` (the input row as a struct), ``host``, ``path``, ``rule``, ``verdict``, ``bad_rate``, ``bound``.

    ``outcomes``: host and bad (1, 0), one row per labelled page.
    """
    common.prepare(pages.sparkSession)
    urls = pages.select(F.struct("*").alias("row"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    seen = outcomes.select("host", "bad").union(urls.select("host", F.lit(None).cast("int")))
    known = common.stage(reputation(seen), "reputation")
    judged = urls.join(common.broadcast_if_small(known, 96), "host", "left") \
        .withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for name, verdict in rules:
        ruled = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(ruled)
    own = F.when(F.col("bound") > F.least(F.lit(max_bad), times * F.col("whole")), "block").otherwise("allow")
    return judged.select("row", "host", "path", "rule", F.coalesce(ruled, own).alias("verdict"),
                         F.col("mean").alias("bad_rate"), "bound")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _votes_on_pages(html: pa.Array) -> pa.Array:
    return pa.array([quality.votes(html_extract.main_text(h.as_py())) for h in html], pa.list_(pa.int32()))


def page_outcomes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``bad`` of every page: 1 where a labeller finds fault with its main text and the weak label is bad."""
    spark = pages.sparkSession
    common.prepare(spark)
    voted = common.stage(pages.select(host(F.col(url_col)).alias("host"), _votes_on_pages(F.col(html_col)).alias("votes")),
                         "page-votes")
    seen = voted.groupBy("votes").count().collect()                        # at most 3 ** 7 patterns
    if not seen:
        return voted.select("host", F.lit(0).alias("bad"))
    patterns, counts = np.array([r.votes for r in seen]), np.array([r["count"] for r in seen], float)
    good = quality.fit_labels(patterns, counts).posterior(patterns)
    bad = (good < 0.5) & (patterns < 0).any(axis=1)
    table = spark.createDataFrame([(list(map(int, p)), int(b)) for p, b in zip(patterns, bad)], "votes array<int>, bad int")
    return voted.join(F.broadcast(table), "votes").select("host", "bad")
