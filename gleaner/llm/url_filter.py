"""URL filters: rules, and empirical-Bayes reputation of hosts, in DataFrame
operations only.

Labelled pages give each host a number of bad outcomes out of n.  A suffix's
rate is shrunk towards the rate of all pages, a registered domain's towards
its suffix's, a host's towards its domain's.  The prior of a level is a beta
with the mean of the level above; its variance is what that mean's posterior
leaves open, and how much the members of a level differ.  The latter is
estimated from the outcomes, for each level: the correlation of a beta-binomial
by the method of moments.  A page without a rule is blocked if the lower bound
of its host's posterior (mean less ``z`` standard deviations) is above
``most_bad``.  Hosts without labels have the posterior of the closest level
that has some.  For its reputation a host counts without user name, port and
final dots; an address has no domain but itself.

Rules are a table: a host's names (itself, and what follows each of its dots)
are looked up there, and each page takes the longest of its host's rules whose
path it begins with.

Edge cases.  A null url, or one without ``://``, has an empty host and path,
fits no rule, and is judged by the rate of all pages, as are urls whose host is
empty.  Labels whose id or outcome is null, or whose page is unknown, don't
count; if a page has several the worst counts.  Pages that repeat an id are
judged one by one, and each counts as an outcome.  Where no member of a level
has two outcomes, its correlation is ``unknown``.  Without labels all rates are
1/2 with no evidence, so nothing is blocked.  Of rules of one length that fit
the last by name holds; long urls need no special treatment.  Other columns are
not read, so none can clash.  No pages give no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import input_columns, lowered, pinned

#: Suffixes of two parts under which names are registered, where no others are
#: given; under all the rest one part is the suffix.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def host(url: Column) -> Column:
    after = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return lowered(after)


def _after(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def path(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(_after(url), "#", 1), "?", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise("")


def site(host: Column) -> Column:
    """What a host's reputation is kept under."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*\z", "")
    return F.regexp_replace(bare, r"\.+\z", "")


def _address(site: Column) -> Column:
    return site.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}\z|\[)")


def suffix(site: Column, two_part: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    """The last part of a site, or its last two; addresses have one of their own."""
    two = F.substring_index(site, ".", -2)
    return F.when(_address(site), F.lit("[]")).when(two.isin(*two_part), two).otherwise(F.substring_index(site, ".", -1))


def domain(site: Column, two_part: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    """The registered domain: the suffix and one part more."""
    two = F.substring_index(site, ".", -2)
    return F.when(_address(site), site).when(two.isin(*two_part), F.substring_index(site, ".", -3)).otherwise(two)


def rule_table(spark: SparkSession, rules: dict[str, str]) -> DataFrame:
    """rule, verdict of a list that is a parameter."""
    listed = json.dumps([{"rule": r, "verdict": v} for r, v in rules.items()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<rule: string, verdict: string>>")))


def rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules (the longest first, then the last by name) of the hosts
    that rules (rule "host/path", verdict) fit by their names."""
    parts = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    named = hosts.where("host <> ''").select("host", F.explode(names).alias("name"))
    at = F.instr("rule", "/")
    listed = rules.select(F.substring_index("rule", "/", 1).alias("name"), F.struct(F.length("rule").alias("length"), "rule", F.substring(F.col("rule"), at, F.length("rule")).alias("start"), "verdict").alias("r"))
    return named.join(listed, "name").groupBy("host").agg(F.sort_array(F.collect_list("r"), asc=False).alias("rules"))


def reputation(sites: DataFrame, total: DataFrame, unknown: float = 1 / 21, least: float = 1e-4, most: float = 0.5) -> dict[str, DataFrame]:
    """For suffix, domain and site the posterior (a, b) of each that has outcomes.

    sites: suffix, domain, site, k bad of n; total: a, b of all pages, one row.
    A level's correlation is from least to most.
    """
    found, above, keys = {}, total, []
    for level in ("suffix", "domain", "site"):
        rows = sites.groupBy(*keys, level).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
        # total and the correlation are one row each.
        rows = rows.join(above, keys) if keys else rows.crossJoin(F.broadcast(above))
        rows = rows.withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).withColumn("v", F.col("mean") * (1 - F.col("mean")))
        more = F.sum((F.col("k") - F.col("n") * F.col("mean")) ** 2 - F.col("n") * F.col("v"))
        whole = F.sum(F.col("n") * (F.col("n") - 1) * F.col("v"))
        alike = rows.agg(F.when(whole > 0, F.greatest(F.lit(least), F.least(F.lit(most), more / whole))).otherwise(unknown).alias("alike"))
        rows = rows.crossJoin(F.broadcast(alike))
        strength = 1 / F.least(F.lit(0.99), F.col("alike") + 1 / (F.col("a") + F.col("b") + 1)) - 1
        keys = [*keys, level]
        above = pinned(rows.select(*keys, (strength * F.col("mean") + F.col("k")).alias("a"), (strength * (1 - F.col("mean")) + F.col("n") - F.col("k")).alias("b")))
        found[level] = above
    return found


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    rules: dict[str, str] | DataFrame,
    unknown: float = 1 / 21,
    z: float = 1.645,
    most_bad: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    outcome_id: str = "page_id",
    outcome_col: str = "bad",
    two_part: tuple[str, ...] = TWO_PART_SUFFIXES,
) -> DataFrame:
    """id, host, path, rule, verdict, bound (lower bound of the rate of bad
    pages) of every page; outcomes: id and 0 or 1.

    rules: "host/path" to "allow" or "block", or a table of rule and verdict.
    two_part: the suffixes of two parts, from a public-suffix list, at most 20,000.
    """
    if len(two_part) > 20_000:
        raise ValueError("at most 20,000 suffixes")
    rules = rule_table(pages.sparkSession, rules) if isinstance(rules, dict) else rules
    rows = pages.select(*input_columns(pages, id=id_col, url=url_col))
    rows = rows.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = outcomes.select(*input_columns(outcomes, of=outcome_id, bad=outcome_col)).where("of is not null and bad is not null")
    known = known.groupBy("of").agg(F.max("bad").alias("bad"))
    level = {"site": site(F.col("host"))} | {"domain": domain(F.col("site"), two_part), "suffix": suffix(F.col("site"), two_part)}

    def with_levels(hosts: DataFrame) -> DataFrame:
        return hosts.withColumn("site", level["site"]).withColumns({k: level[k] for k in ("domain", "suffix")})

    # Hosts are far fewer than pages: each is counted, and judged, once.
    counted = rows.join(known, rows["id"] == known["of"]).groupBy("host").agg(F.sum("bad").alias("k"), F.count(F.lit(1)).alias("n"))
    counted = pinned(with_levels(counted).groupBy("suffix", "domain", "site").agg(F.sum("k").alias("k"), F.sum("n").alias("n")))
    total = counted.agg((F.coalesce(F.sum("k"), F.lit(0)) + 1.0).alias("a"), (F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)) + 1.0).alias("b"))
    seen = pinned(with_levels(rows.select("host").distinct()))
    judged = seen
    for name, found in reputation(counted.where("site <> ''"), total, unknown).items():
        judged = judged.join(found.select(name, F.struct("a", "b").alias(f"of_{name}")), name, "left")
    judged = judged.crossJoin(F.broadcast(total.select(F.struct("a", "b").alias("of_all")))).select("host", F.coalesce("of_site", "of_domain", "of_suffix", "of_all").alias("p"))
    mean, n = F.col("p.a") / (F.col("p.a") + F.col("p.b")), F.col("p.a") + F.col("p.b")
    judged = judged.select("host", (mean - z * F.sqrt(mean * (1 - mean) / (n + 1))).alias("bound"))
    judged = judged.join(rules_of(seen.select("host"), rules), "host", "left")
    # Written first, so that Spark can split a host of very many pages in the join.
    out = rows.join(pinned(judged), "host")
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), F.lit(0))
    method = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    return out.withColumn("r", first).select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "bound")
