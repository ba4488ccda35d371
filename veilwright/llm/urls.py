"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Rules are compiled into the plan, so their number is bounded.
MAX_RULES = 1000
#: A host is blocked if the rate of bad pages is above CUT with about 95 % posterior probability.
CUT, Z = 0.5, 1.645
#: Suffixes of two labels are these names below these countries; the whole public list is not at hand.
SECOND = "ac co com edu gob gov go ne net nom or org"
COUNTRIES = "ar au bd br cn co cy eg es gr hk id il in jp ke kr mx my ng nz pe ph pk pl pt sa sg th tr tw ua ug uk uy ve vn za"
_TWO = rf"(^|\.)({SECOND.replace(' ', '|')})\.({COUNTRIES.replace(' ', '|')})$"
_ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"
#: The suffix that all numeric addresses share.
ADDRESSES = "[ip]"
#: Weight of the overall rate in a suffix's rate, in pages.
ROOT = 2.0


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def owner_of(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host, without user and port; an address is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    two = name.rlike(_TWO)
    suffix = F.when(name.rlike(_ADDRESS), F.lit(ADDRESSES)).otherwise(F.when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1)))
    domain = F.when(name.rlike(_ADDRESS), name).otherwise(F.when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2)))
    return suffix, domain


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/es/``, and its verdict; nulls if none does.

    A rule's host stands for itself and its subdomains; its path is a prefix. Of equally long
    rules the first in order of text wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name = verdict = F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def reputation(pages: DataFrame, outcomes: DataFrame, key: str = "id", cut: float = CUT, z: float = Z) -> DataFrame:
    """(host, n, bad, rate, spread, blocked) for each host of ``pages``.

    ``outcomes`` has (key, bad): a page's label, 1 if it was found bad. Rates are shrunk down a
    tree: a suffix (last part of the host, or last two as in SECOND and COUNTRIES) towards the
    overall rate, a registered domain (one part more) towards its suffix, a host towards its domain. Each step is a beta-binomial
    posterior whose prior mean is the parent's rate; its strength is 1 / rho - 1, with rho the
    correlation within groups of that level by the method of moments. A host is blocked if the
    lower bound of its posterior, mean - z * deviation, is above ``cut``. Hosts without labels
    have their domain's rate.
    """
    hosts = pages.join(outcomes, key, "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    suffix, domain = owner_of(F.col("host"))
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    hosts = staged(hosts, "hosts")
    tops = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = ((tops["k"] or 0) + 1.0) / ((tops["n"] or 0) + 2.0)
    rates = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select("suffix", ((F.col("k") + F.lit(ROOT * base)) / (F.col("n") + F.lit(ROOT))).alias("m"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(staged(rates, "suffixes"), "suffix")
    domains = staged(domains, "domains")
    s = _strength(domains)
    domains = domains.select("domain", ((F.col("k") + s * F.col("m")) / (F.col("n") + s)).alias("m"))
    hosts = staged(hosts.join(staged(domains, "domain-rates"), "domain"), "host-rates")
    s = _strength(hosts)
    a = F.col("k") + s * F.col("m")
    b = F.col("n") - F.col("k") + s * (1 - F.col("m"))
    rate, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", F.col("k").alias("bad"), rate.alias("rate"), spread.alias("spread"), (rate - z * spread > cut).alias("blocked"))


def _strength(groups: DataFrame) -> float:
    v = F.col("m") * (1 - F.col("m"))
    miss = F.col("k") - F.col("n") * F.col("m")
    row = groups.agg(F.sum(miss * miss - F.col("n") * v).alias("over"), F.sum(F.col("n") * (F.col("n") - 1) * v).alias("pairs")).first()
    rho = row["over"] / row["pairs"] if row["pairs"] else 0.0
    return 1 / min(max(rho, 1e-3), 0.5) - 1


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", outcome_id: str = "page_id", bad_col: str = "bad") -> DataFrame:
    """(id, host, path, rule, verdict) for each page; ``rules`` are (allow or block, host/path).

    A null url and one without ``://`` have an empty host and path. Rows with a null id or no
    outcome count for no host's rate; of several outcomes for an id the worst counts. Repeated
    rows are returned each and count each. Other columns are ignored.
    """
    read = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = staged(read, "urls")
    known = outcomes.where(F.col(outcome_id).isNotNull() & F.col(bad_col).isNotNull()).groupBy(F.col(outcome_id).alias("id")).agg(F.max(bad_col).cast("long").alias("bad"))
    blocked = reputation(rows.select("id", "host"), known).where("blocked").select("host", "blocked")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.join(staged(blocked, "blocked"), "host", "left")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict")
    )


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: ``filter_urls`` over ``pages``, with the labels of equal ids as outcomes.
URLS_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), o AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, list_extract(string_split(host, '.'), -1) AS suffix,
    CASE WHEN len(string_split(host, '.')) > 1 THEN list_extract(string_split(host, '.'), -2) || '.' ELSE '' END || list_extract(string_split(host, '.'), -1) AS domain
  FROM u LEFT JOIN o USING (page_id) GROUP BY host
), g AS (SELECT (sum(k) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) AS base FROM h
), s AS (SELECT suffix, (sum(k) + 2.0::DOUBLE * any_value(base)) / (sum(n) + 2.0::DOUBLE) AS m FROM h, g GROUP BY suffix
), d AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h JOIN s USING (suffix) GROUP BY domain, suffix
), ds AS (
  SELECT 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.001), 0.5) - 1 AS w FROM d
), dm AS (SELECT domain, (k + w * m) / (n + w) AS m FROM d, ds
), hm AS (SELECT host, n, k, m FROM h JOIN dm USING (domain)
), hs AS (
  SELECT 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.001), 0.5) - 1 AS w FROM hm
), ab AS (SELECT host, k + w * m AS a, n - k + w * (1 - m) AS b FROM hm, hs
), bad_hosts AS (SELECT host FROM ab WHERE a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN host IN (SELECT host FROM bad_hosts) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
