"""Empirical-Bayes host reputation with rule overrides (URL filter)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``target`` is host and path prefix, such as ``example.net/en/``."""

    verdict: str
    target: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2]


@dataclass(frozen=True)
class Prior:
    """Limits and defaults of the prior strengths, which are fitted to the outcomes level by level.

    weakest, strongest: bounds of a fitted strength (pseudo-outcomes that a level lends to the one below
    it). unknown: the strength where no unit has two outcomes, so that nothing can be fitted.
    z: width of the posterior bound in standard deviations. block_above: a host is blocked when
    the lower bound of its bad rate is above this."""

    weakest: float = 1.0
    strongest: float = 1000.0
    unknown: float = 10.0
    z: float = 1.645
    block_above: float = 0.5


# fixed values: second-level labels under which two-letter country domains register names
SECOND_LEVEL = "ac co com edu gov go mil ne net nom or org sch".split()


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def public_suffix(host: Column) -> Column:
    """The last label of a host, or the last two where names are registered a level lower (``co.uk``); a
    port doesn't count."""
    name = F.regexp_replace(host, ":.*", "")
    last = F.substring_index(name, ".", -1)
    second = F.substring_index(F.substring_index(name, ".", -2), ".", 1)
    deep = (F.length(last) == 2) & second.isin(SECOND_LEVEL) & F.contains(name, F.lit("."))
    return F.when(deep, F.substring_index(name, ".", -2)).otherwise(last)


def registered_domain(host: Column) -> Column:
    """The public suffix and the label before it, if there is one."""
    name = F.regexp_replace(host, ":.*", "")
    return F.when(F.contains(public_suffix(host), F.lit(".")), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a (verdict, target) struct; null where none does. A rule's
    host fits itself and its subdomains; its path must begin the url's path."""
    out = F.lit(None).cast("struct<verdict:string,target:string>")
    for rule in sorted(rules, key=lambda r: (len(r.target), r.target)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.verdict).alias("verdict"), F.lit(rule.target).alias("target"))).otherwise(out)
    return out


def shrink(units: DataFrame, prior: Prior) -> DataFrame:
    """``units`` (n, bad_n, expected; one row for each suffix, domain or host) with ``strength``, the fitted
    strength of the beta prior around ``expected``, and ``mean``, the posterior mean.

    The strength is fitted by moments: with means p and correlation r = 1 / (strength + 1) between two
    outcomes of a unit, the squares of bad_n - n*p add up to sum n*p*(1-p) * (1 + (n-1)*r) on average."""
    n, p = F.col("n"), F.col("expected")
    v = n * p * (1 - p)
    moments = units.agg(F.sum((F.col("bad_n") - n * p) ** 2).alias("found"), F.sum(v).alias("least"), F.sum((n - 1) * v).alias("pairs"))
    r = F.when(F.col("pairs") > 0, (F.col("found") - F.col("least")) / F.col("pairs"))
    bounded = F.greatest(F.least(r, F.lit(1 / (prior.weakest + 1))), F.lit(1 / (prior.strongest + 1)))
    strength = F.coalesce(F.when(r.isNotNull(), 1 / bounded - 1), F.lit(prior.unknown)).alias("strength")
    return units.join(F.broadcast(moments.select(strength))).withColumn("mean", (F.col("bad_n") + F.col("strength") * p) / (n + F.col("strength")))  # one row


def host_reputation(outcomes: DataFrame, prior: Prior = Prior()) -> DataFrame:
    """Posterior of the bad rate for each host that has labelled outcomes.

    ``outcomes``: (host, bad 0/1), one row for each labelled page; rows with a null are left out, repeated
    rows count each. The corpus rate is the prior mean of a suffix, a suffix's posterior mean that of its
    registered domains, a domain's that of its hosts; every level is a beta-binomial whose strength is fitted to the
    units of that level. Counts are summed first to hosts (map-side combined, so a host with a third
    of the pages costs a row for each task) and then upwards over the host table. An empty table gives no
    rows.

    Returns (host, n, bad_n, mean, lower): ``lower`` = mean - z * sd of the host's beta posterior.
    """
    # each level is read for its moments and again for its means: written, so that plans don't double
    scratch = Scratch(outcomes.sparkSession, "reputation")
    hosts = (
        outcomes.where("host IS NOT NULL AND bad IS NOT NULL").groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("bigint").alias("bad_n"))
        .withColumn("domain", registered_domain(F.col("host")))
        .withColumn("suffix", public_suffix(F.col("host")))
    )
    add = lambda frame, *keys: frame.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad_n").alias("bad_n"))
    below = lambda frame, key: frame.select(key, F.col("mean").alias("expected"))
    hosts = scratch.keep(hosts, "hosts")
    domains = scratch.keep(add(hosts, "suffix", "domain"), "domains")
    suffixes = scratch.keep(add(domains, "suffix"), "suffixes")
    total = suffixes.agg(((F.sum("bad_n") + 1.0) / (F.sum("n") + 2.0)).alias("expected"))
    suffixes = scratch.keep(shrink(scratch.keep(suffixes.join(F.broadcast(total)), "suffixes"), prior), "suffix-means")  # one row
    domains = scratch.keep(shrink(scratch.keep(domains.join(below(suffixes, "suffix"), "suffix"), "domains"), prior), "domain-means")
    hosts = shrink(scratch.keep(hosts.join(below(domains, "domain"), "domain"), "hosts"), prior)
    mean, size = F.col("mean"), F.col("n") + F.col("strength")
    return hosts.select("host", "n", "bad_n", "mean", (mean - prior.z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], prior: Prior = Prior()) -> DataFrame:
    """Verdict of every page url.

    ``pages``: page_id, url (other columns are ignored); ``outcomes``: (page_id, bad 0/1), in which
    repeated rows of a page count once with the worst outcome and null outcomes don't count.

    Returns page_id, host, path, rule, verdict, lower: the rule's verdict where a rule fits, else
    ``block`` where the posterior lower bound of the host's bad rate is above ``prior.block_above``,
    else ``allow``. A null url or one without ``://`` has empty host and path and is judged by the
    outcomes of that empty host. A host without outcomes is allowed (``lower`` null). Repeated page
    rows stay repeated; long urls are taken whole; an empty table gives no rows. A bound that equals the limit
    does not block.
    """
    parsed = pages.select("page_id", "url").select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    marks = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = parsed.dropDuplicates(["page_id"]).join(marks, "page_id").select("host", "bad")
    known = host_reputation(labelled, prior).select("host", F.round("lower", 9).alias("lower"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return (
        parsed.join(known, "host", "left")
        .withColumn("hit", rule)
        .select(
            "page_id",
            "host",
            "path",
            F.col("hit.target").alias("rule"),
            F.coalesce(F.col("hit.verdict"), F.when(F.col("lower") > prior.block_above, "block").otherwise("allow")).alias("verdict"),
            "lower",
        )
    )
