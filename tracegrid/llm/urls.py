"""URL filters by empirical-Bayes host reputation; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.session import discard, materialise, tidy

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BOUND, Z, LEAST_STRENGTH, MOST_STRENGTH = 0.5, 1.0, 2.0, 100.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without :// or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    blank = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), blank), F.coalesce(path, blank)


def parents(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, its user and port left out. The suffix is the last label, or the last two where a
    country's label follows one of seven common second labels (co.uk); the domain has one label more. An address is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address, two = bare.rlike(r"^[0-9]+([.][0-9]+){3}$|^\["), bare.rlike(r"(^|[.])(ac|co|com|edu|gov|net|org)[.][a-z][a-z]$")
    domain = F.when(address, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return domain, F.when(address, "[address]").when(two, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))


def matched_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Verdict and name (host and path prefix) of the longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        verdict, name = F.when(fits, kind).otherwise(verdict), F.when(fits, rule_host + rule_path).otherwise(name)
    return verdict, name


def strength(n: str, bad: str, prior: str) -> Column:
    """Beta-binomial prior strength by moments over child groups: how alike children are beyond chance, within fixed bounds."""
    weight, p = F.col(n), F.col(prior)
    spread = F.sum(F.pow(F.col(bad) - weight * p, 2))
    within = F.sum(weight * p * (1 - p))
    pairs = F.sum(weight * (weight - 1) * p * (1 - p))
    rho = F.try_divide(spread - within, pairs)
    return F.coalesce(F.when(rho <= 0, F.lit(MOST_STRENGTH)).otherwise(F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), F.try_divide(F.lit(1.0), rho) - 1))), F.lit(MOST_STRENGTH))


def reputations(urls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, posterior mean and sd of a bad outcome for every host of urls (page_id, host); outcomes: page_id, bad (boolean).

    The suffix's rate is shrunk to the rate of all, the domain's to the suffix's, the host's to the domain's; each level's prior
    strength comes from the level's own counts. Counts are summed with map-side combine, so a host of very many pages is one row a
    task. The hosts are written once and each level is read from there; of a level only its prior strength comes to the driver."""
    judged = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = urls.join(judged, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    domain, suffix = parents(F.col("host"))
    hosts = materialise(counted.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("b").alias("db"))
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("sn"), F.sum("b").alias("sb"))
    with tidy(urls.sparkSession):
        total = hosts.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("p0")).first()["p0"]
        level = level.withColumn("p0", F.lit(total))
        k = level.agg(strength("sn", "sb", "p0")).first()[0]
        level = domains.join(level.select("suffix", ((F.col("sb") + k * total) / (F.col("sn") + k)).alias("p1")), "suffix")
        level = materialise(level, "domains")
        k = level.agg(strength("dn", "db", "p1")).first()[0]
        level = hosts.join(level.select("domain", "suffix", ((F.col("db") + k * F.col("p1")) / (F.col("dn") + k)).alias("p2")), ["domain", "suffix"])
        level = materialise(level, "hosts")
        k = level.agg(strength("n", "b", "p2")).first()[0]
    discard(hosts)
    mean, size = (F.col("b") + k * F.col("p2")) / (F.col("n") + k), F.col("n") + k
    return level.select("host", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (size + 1)).alias("sd"), "n")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, bound: float = BOUND, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation per row of pages (page_id, url).

    A url that a rule fits gets the longest rule's verdict; any other is blocked where the posterior lower bound of its host's bad
    outcomes (mean - z sd) is at least bound. A null url or one without :// has an empty host, which is judged like a host.
    Repeated rows are judged alike; outcomes of unknown pages count for nothing; without outcomes every host has the prior 0.5
    and is allowed."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdict, name = matched_rule(F.col("host"), F.col("path"), rules)
    known = reputations(urls, outcomes)
    poor = F.round(F.col("mean") - z * F.col("sd"), 9) >= bound
    return urls.join(known, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(poor, "block").otherwise("allow")).alias("verdict"), F.round("mean", 6).alias("reputation")
    )
