"""URL filter (operator 11, native): rules first, then the reputation of the host.

A rule (host, path, verdict) fits its host and all subdomains where the path starts with the
rule's; the longest fitting rule decides. Pages that a rule decides are the labelled outcomes
(blocked or not) from which hosts without a rule are judged, by empirical Bayes:

* every host belongs to a registered domain, that to a suffix, that to the whole table;
* a child's share of blocked pages has a beta prior whose mean is its parent's posterior mean
  and whose strength is one number per level, fitted by moments from how far the children's
  counts scatter around their parents (beta-binomial overdispersion);
* a host is blocked when the lower posterior bound of its blocked share, mean minus
  ``DEVIATIONS`` standard deviations, is at least ``BLOCK_FROM``. By Cantelli's inequality the
  share is above that bound with probability 0.8 or more, whatever the form of the posterior.

Only (host, labelled, blocked) counts are shuffled, added up before the shuffle, so a host
with a third of all pages is one row a task; domains and suffixes are sums over host rows. The
blocked hosts come back to the pages by a broadcast of a checked size, or a salted join beyond.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule
fits and whose reputation is that of the empty host; repeated rows count as often as they
stand; without any labelled page nothing is blocked but by rules; an empty table gives an empty
result. Other columns pass through; those called host, path, rule or verdict, in any case, are
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm.joins import BROADCAST_ROWS, attach
from abode.session import materialize

# The contract's rules (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Second-level labels under which two-letter country suffixes register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
BLOCK_FROM = 0.5
DEVIATIONS = 2.0
STRENGTHS = (0.5, 1000.0)  # bounds of a prior's strength, in pages
FLAT = 2.0                 # strength where no child has two labelled pages
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
DIGITS = 9                 # decimals at which a bound is compared
OWN = ("host", "path", "rule", "verdict")


def host_of(url):
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host, path, rules=RULES):
    """(rule text, verdict) columns of the longest fitting rule, null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _bare(host):
    """Host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host):
    """Public suffix of a host: the last label, or two under a country code; an address is its own."""
    bare = _bare(host)
    two = F.regexp_extract(bare, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), bare).when(two != "", two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host):
    """Registered domain: the suffix and one label before it."""
    bare, suffix = _bare(host), suffix_of(host)
    before = F.substring(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1)
    return F.when(bare == suffix, bare).otherwise(F.concat(F.substring_index(before, ".", -1), F.lit("."), suffix))


def _strength(children: DataFrame):
    """Strength of the prior of ``children`` (n labelled, k blocked, m mean of their parent): one number."""
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    scatter = F.sum((k - n * m) * (k - n * m) / (m * (1 - m))) - F.sum(n)
    rho = F.round(scatter / F.sum(n * (n - 1)), DIGITS)
    low, high = STRENGTHS
    fitted = F.when(F.sum(n * (n - 1)) > 0, 1 / F.least(F.greatest(rho, F.lit(1 / (1 + high))), F.lit(1 / (1 + low))) - 1)
    return children.agg(F.coalesce(fitted, F.lit(FLAT))).scalar()


def _posterior(children: DataFrame, name: str) -> DataFrame:
    """Add the prior's strength and the posterior mean called ``name``."""
    out = children.withColumn("s", _strength(children))
    return out.withColumn(name, (F.col("s") * F.col("m") + F.col("k")) / (F.col("s") + F.col("n")))


def reputations(outcomes: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(host, n labelled, k blocked) -> host, domain, suffix, n, k, block_share, block_bound; one row per host."""
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = materialize(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"),
                                     F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k")), "url-hosts")
    both = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*both), "url-domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*both), "url-suffixes")
    root = suffixes.agg((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).scalar()
    up = materialize(_posterior(suffixes.withColumn("m", root), "m_suffix").select("suffix", F.col("m_suffix").alias("m")), "url-suffix-means")
    domains = attach(domains, up, "suffix", F.col("domain"), bound)
    up = materialize(_posterior(domains, "m_domain").select("domain", F.col("m_domain").alias("m")), "url-domain-means")
    hosts = _posterior(attach(hosts, up, "domain", F.col("host"), bound), "block_share")
    deviation = F.sqrt(F.col("block_share") * (1 - F.col("block_share")) / (F.col("s") + F.col("n") + 1))
    return hosts.select("host", "domain", "suffix", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "block_share",
                        F.round(F.col("block_share") - DEVIATIONS * deviation, DIGITS).alias("block_bound"))


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", block_from: float = BLOCK_FROM, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Add host, path, rule and verdict (allow or block) to ``pages``."""
    others = [c for c in pages.columns if c.lower() not in OWN]
    rows = pages.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in others]).alias("_row"),
                        host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    text, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "_ruled": ruled})
    outcomes = rows.groupBy("host").agg(F.count("_ruled").alias("n"), F.count(F.when(F.col("_ruled") == "block", 1)).alias("k"))
    bad = reputations(outcomes, bound).where(F.col("block_bound") >= block_from).select("host", F.lit("block").alias("_judged"))
    judged = attach(rows, materialize(bad, "url-blocked-hosts"), "host", F.col("path"), bound)
    return judged.select(*[F.col(f"_row.`{c}`") for c in others], "host", "path", "rule",
                         F.coalesce("_ruled", "_judged", F.lit("allow")).alias("verdict"))


def oracle(rules=RULES) -> str:
    """DuckDB SQL of the query."""
    whens = [(h, p, v) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    fit = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    rule = "CASE " + " ".join(f"WHEN {fit.format(h, p)} THEN '{h + p}'" for h, p, _ in whens) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fit.format(h, p)} THEN '{v}'" for h, p, v in whens) + " END"
    low, high = STRENGTHS
    second = "|".join(SECOND_LEVEL)

    def strength(table, mean):
        return (f"(SELECT coalesce(CASE WHEN sum(n * (n - 1)) > 0 THEN 1 / least(greatest(round((sum((k - n * {mean}) * (k - n * {mean}) / ({mean} * (1 - {mean}))) - sum(n))"
                f" / sum(n * (n - 1)), {DIGITS}), {1 / (1 + high)}::DOUBLE), {1 / (1 + low)}::DOUBLE) - 1 END, {FLAT}::DOUBLE) FROM {table})")

    return rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
r AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM u),
h0 AS (SELECT host, count(ruled)::DOUBLE AS n, (count(*) FILTER (ruled = 'block'))::DOUBLE AS k,
  regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM r GROUP BY host),
h1 AS (SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN bare
  WHEN regexp_extract(bare, '(?:^|\.)((?:{second})\.[a-z]{{2}})$', 1) <> '' THEN regexp_extract(bare, '(?:^|\.)((?:{second})\.[a-z]{{2}})$', 1)
  ELSE string_split(bare, '.')[-1] END AS suffix FROM h0),
h2 AS (SELECT *, CASE WHEN bare = suffix THEN bare ELSE string_split(left(bare, length(bare) - length(suffix) - 1), '.')[-1] || '.' || suffix END AS domain FROM h1),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h2 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM d0) AS m FROM d0 GROUP BY suffix),
s1 AS (SELECT suffix, (s * m + k) / (s + n) AS m FROM (SELECT *, {strength('s0', 'm')} AS s FROM s0)),
d1 AS (SELECT d0.*, s1.m FROM d0 JOIN s1 USING (suffix)),
d2 AS (SELECT domain, (s * m + k) / (s + n) AS m FROM (SELECT *, {strength('d1', 'm')} AS s FROM d1)),
h3 AS (SELECT h2.*, d2.m FROM h2 JOIN d2 USING (domain)),
h4 AS (SELECT host, s + n AS size, (s * m + k) / (s + n) AS share FROM (SELECT *, {strength('h3', 'm')} AS s FROM h3)),
h5 AS (SELECT host, round(share - {DEVIATIONS} * sqrt(share * (1 - share) / (size + 1)), {DIGITS}) >= {BLOCK_FROM} AS bad FROM h4)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN h5 USING (host)"""
