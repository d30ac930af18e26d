"""Operator 8 [native]: URL rules and empirical-Bayes host reputation, in DataFrame expressions only.

Labelled page outcomes (1: bad) are counted by host, registered domain and suffix. At each level the beta prior of a
node has its parent's posterior mean and a strength fitted by moments to the spread of the nodes around their
parents, so a host with few pages stays near its domain. A page is blocked if the lower posterior bound of its host's
bad rate is over a limit. Hosts without outcomes take their domain's posterior, unknown domains their suffix's, and
unknown suffixes the overall rate.

Outcomes come from a table by any key that pages carry, and from a condition on the page itself, such as a host name
that holds a term of a seed list.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Suffixes of two labels under which domains are registered; a parameter, as the public list is long and changes.
TWO_LABEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Terms of host names that count as a bad outcome of each page; a parameter of the query.
SEEDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez")
SEED_HEAD, SEED_TAIL = r"(^|[.-])(", r")([.-]|$)"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or other urls."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (then the one with the longer host) and its verdict, as null where none fits."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def site_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; an address or a single label is its own."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    two = F.substring_index(name, ".", -2)
    address = name.rlike(r"^(\d+\.){3}\d+$") | name.startswith("[")
    wide = two.isin(*TWO_LABEL)
    suffix = F.when(address, name).when(wide, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address | (n < 2), name).when(wide, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(nodes: DataFrame) -> float:
    """Moment estimate of the prior's strength from n, k and the parent's mean m."""
    spread = F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2) / F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-9))
    row = nodes.where("n > 0").agg(F.sum(spread).alias("q"), F.count("*").alias("j"), F.sum(F.col("n") - 1).alias("f")).first()
    if not row["f"] or row["q"] is None:
        return 1e6
    rho = min(max((row["q"] - row["j"]) / row["f"], 1e-6), 0.5)
    return (1 - rho) / rho


def seeded(host: Column, terms: Sequence[str]) -> Column:
    """True for hosts with one of ``terms`` between dots and hyphens of their name."""
    return host.rlike(SEED_HEAD + "|".join(re.escape(t) for t in terms) + SEED_TAIL) if terms else F.lit(False)


def counted(pages: DataFrame, outcomes: DataFrame, on: str = "page_id", bad: Column | None = None) -> DataFrame:
    """host, n, k: labelled outcomes of every host's pages, and those of them that are bad.

    ``outcomes``: ``on``, bad (0 or 1; null: none); several outcomes of a key count each, for every page that has the
    key. A page for which ``bad`` holds (a column over the pages' own columns and ``host``) has one bad outcome more.
    Equal pages of a host and key are added up in the tasks before any shuffle; pages without a key are spread over
    keys that no outcome has.
    """
    key = F.coalesce(F.col(on).cast("string"), F.concat(F.lit("?"), F.pmod(F.xxhash64("url"), F.lit(1 << 20)).cast("string")))
    host = host_of(F.col("url"))
    seen = pages.withColumn("host", host).select(key.alias("_key"), "host", F.coalesce(bad, F.lit(False)).cast("long").alias("_seed") if bad is not None else F.lit(0).cast("long").alias("_seed"))
    seen = seen.groupBy("_key", "host", "_seed").agg(F.count("*").alias("c"))
    known = outcomes.where(F.col("bad").isNotNull() & F.col(on).isNotNull()).select(F.col(on).cast("string").alias("_key"), F.col("bad").cast("long").alias("bad"))
    known = known.groupBy("_key").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    total = lambda c: F.sum(F.col("c") * (F.coalesce(F.col(c), F.lit(0)) + F.col("_seed"))).alias(c)
    return seen.join(known, "_key", "left").groupBy("host").agg(total("n"), total("k"))


def reputation(counts: DataFrame, z: float = 1.645) -> DataFrame:
    """host, domain, suffix, n, k, mean and bound (lower, ``z`` deviations below) of the bad rate of every host of ``counted``."""
    domain, suffix = site_of(F.col("host"))
    hosts = staged(counts.withColumns({"domain": domain, "suffix": suffix}), "hosts")

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrunk(nodes: DataFrame, name: str) -> DataFrame:
        s = _strength(nodes)
        return nodes.withColumn(name, (F.col("k") + s * F.col("m")) / (F.col("n") + s)).withColumn("total", F.col("n") + F.lit(s))

    domains = summed(hosts, "domain", "suffix")
    suffixes = summed(domains, "suffix")
    all_of = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = (all_of["k"] or 0) / all_of["n"] if all_of["n"] else 0.0
    top = shrunk(suffixes.withColumn("m", F.lit(float(overall))), "mean").select("suffix", F.col("mean").alias("m"))
    mid = staged(shrunk(domains.join(top, "suffix"), "mean").select("domain", "suffix", F.col("mean").alias("m")), "domains")
    low = shrunk(hosts.join(mid, ["domain", "suffix"]), "mean")
    deviation = F.sqrt(F.greatest(F.col("mean") * (1 - F.col("mean")), F.lit(0.0)) / (F.col("total") + 1))
    return low.select("host", "domain", "suffix", "n", "k", "mean", (F.col("mean") - z * deviation).alias("bound"))


def judge(pages: DataFrame, known: DataFrame, rules: Sequence[Rule], limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the bound of the host's bad rate for every row of ``pages``.

    ``known``: ``reputation`` of the hosts. Repeated rows are judged each; null urls have an empty host, judged as any
    other. The reputations are staged, so that the join with the pages can split the rows of a host that holds a third
    of them.
    """
    known = staged(known.select("host", "bound"), "reputation")
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return cut.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")


QUERY_RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)

QUERY_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), o AS (
  SELECT CAST(doc_id AS VARCHAR) AS carried, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS k
  FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT host, regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS carried,
         CASE WHEN regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|porn|spam|warez)([.-]|$)') THEN 1 ELSE 0 END AS seed
  FROM p
), h AS (
  SELECT host, sum(coalesce(o.n, 0) + seed)::DOUBLE AS n, sum(coalesce(o.k, 0) + seed)::DOUBLE AS k,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
  FROM c LEFT JOIN o USING (carried) GROUP BY host
), hs AS (
  SELECT host, n, k, string_split(name, '.') AS l, name,
         array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS domain,
         string_split(name, '.')[-1] AS suffix
  FROM h
), d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hs GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
g AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0 END AS m FROM s),
s0 AS (SELECT s.*, g.m FROM s, g),
s1 AS (SELECT CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 1e-6 ELSE least(greatest((sum(n * pow(k / n - m, 2) / greatest(m * (1 - m), 1e-9)) - count(*)) / sum(n - 1), 1e-6), 0.5) END AS r FROM s0 WHERE n > 0),
s2 AS (SELECT suffix, (k + (1 - r) / r * m) / (n + (1 - r) / r) AS m FROM s0, s1),
d0 AS (SELECT d.*, s2.m FROM d JOIN s2 USING (suffix)),
d1 AS (SELECT CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 1e-6 ELSE least(greatest((sum(n * pow(k / n - m, 2) / greatest(m * (1 - m), 1e-9)) - count(*)) / sum(n - 1), 1e-6), 0.5) END AS r FROM d0 WHERE n > 0),
d2 AS (SELECT domain, suffix, (k + (1 - r) / r * m) / (n + (1 - r) / r) AS m FROM d0, d1),
h0 AS (SELECT hs.host, hs.n, hs.k, d2.m FROM hs JOIN d2 USING (domain, suffix)),
h1 AS (SELECT CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 1e-6 ELSE least(greatest((sum(n * pow(k / n - m, 2) / greatest(m * (1 - m), 1e-9)) - count(*)) / sum(n - 1), 1e-6), 0.5) END AS r FROM h0 WHERE n > 0),
h2 AS (SELECT host, (k + (1 - r) / r * m) / (n + (1 - r) / r) AS mean, n + (1 - r) / r AS total FROM h0, h1),
b AS (SELECT host, mean - 1.645 * sqrt(greatest(mean * (1 - mean), 0) / (total + 1)) AS bound FROM h2),
r AS (
  SELECT p.*, b.bound,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p LEFT JOIN b USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
