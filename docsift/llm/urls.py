"""Operator 5: URL filter by rules, then by empirical-Bayes host reputation.

Labelled page outcomes are counted per host. Good rates shrink from host to registered domain to suffix to all pages,
through beta-binomial priors whose strengths come from the counts (method of moments). A host is blocked when the upper
posterior bound of its good rate is below ``min_good``: only hosts that are surely bad go.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule, and the reputation of the empty
host; a page without an outcome counts for no host; null labels are no outcome; several label rows of a page are one
outcome, good only if all are. Repeated pages are judged alike; a null page_id has no outcome and stays null; ties of
rules go to block. Empty tables give an empty result. No text is read, urls of any length are. Extra columns, whatever
their names, do not reach the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import broadcast_if_small, cut, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path prefix

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))
#: Second-level public suffixes that count with the last label, the usual ones; callers may pass their own.
SECOND_LEVEL = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
MIN_GOOD, Z, MAX_STRENGTH = 0.5, 1.6449, 1000.0
#: With few labelled pages the strength stays near the usual one: it weighs as much as DOUBT of the data's variance.
USUAL_STRENGTH, DOUBT = 10.0, 5.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; of equally long ones block wins, then the smaller text."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def suffix_and_domain(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column]:
    """Public suffix and registered domain, without a port. A number as last label (an address) is its own domain."""
    bare = F.regexp_replace(host, r":\d*$", "")
    last, two, three = (F.regexp_extract(bare, p, 0) for p in (r"[^.]*$", r"[^.]*\.[^.]*$", r"[^.]*\.[^.]*\.[^.]*$"))
    second = two.isin(*second_level)
    number = last.rlike(r"^\d+$")
    suffix = F.when(number, F.lit("")).when(second, two).otherwise(last)
    domain = F.when(number, bare).when(second & (three != ""), three).when(~second & (two != ""), two).otherwise(bare)
    return suffix, domain


def _strength(groups: DataFrame, prior: str) -> DataFrame:
    """One row: the prior strength that explains how far the groups' rates scatter round their priors."""
    p, n, k = F.col(prior), F.col("n").cast("double"), F.col("k").cast("double")
    sums = groups.agg(F.sum((k - n * p) * (k - n * p)).alias("seen"), F.sum(n * p * (1 - p)).alias("drawn"), F.sum(n * (n - 1) * p * (1 - p)).alias("pairs"))
    zero = F.lit(0.0)
    rho = (F.coalesce(F.col("seen"), zero) - F.coalesce(F.col("drawn"), zero) + DOUBT / (1 + USUAL_STRENGTH)) / (F.coalesce(F.col("pairs"), zero) + DOUBT)
    rho = F.least(F.greatest(rho, F.lit(1 / (1 + MAX_STRENGTH))), F.lit(0.5))
    return sums.select((1 / rho - 1).alias("strength"))


def _shrink(groups: DataFrame, prior: str, out: str, keep: list[str]) -> DataFrame:
    """Adds out, the posterior mean, and strength. The joined side is one row."""
    one = F.broadcast(_strength(groups.where("n > 0"), prior))
    return groups.crossJoin(one).withColumn(out, (F.col("k") + F.col("strength") * F.col(prior)) / (F.col("n") + F.col("strength"))).select(*keep, prior, out, "k", "n", "strength")


def host_reputation(pages: DataFrame, labels: DataFrame, z: float = Z, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """(host, n_labelled, good_rate, upper_bound) for every host of the pages.

    pages: page_id, host. Counts are combined on the map side before they shuffle; joins are between tables of hosts,
    domains and suffixes, never of pages, and only of labelled pages with labels.
    """
    outcome = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy("doc_id").agg(F.min(((F.coalesce(F.col("quality"), F.lit(1)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")).alias("good"))
    counted = pages.select("page_id", "host").join(outcome, F.col("page_id") == F.col("doc_id"), "left")
    hosts = counted.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k"))
    suffix, domain = suffix_and_domain(F.col("host"), second_level)
    hosts = cut(hosts.withColumns({"suffix": suffix, "domain": domain}))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    root = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("p0"))
    suffixes = cut(_shrink(suffixes.crossJoin(F.broadcast(root)), "p0", "p1", ["suffix"]))
    under = domains.join(broadcast_if_small(suffixes.select(F.col("suffix").alias("s"), "p1")), F.col("suffix") == F.col("s"))
    domains = cut(_shrink(under, "p1", "p2", ["domain"]))
    under = hosts.select("host", "domain", "n", "k").join(broadcast_if_small(domains.select(F.col("domain").alias("d"), "p2")), F.col("domain") == F.col("d"))
    ranked = _shrink(under, "p2", "p3", ["host"])
    a, b = F.col("k") + F.col("strength") * F.col("p2"), F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("p2"))
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return ranked.select("host", F.col("n").alias("n_labelled"), F.col("p3").alias("good_rate"), (F.col("p3") + z * spread).alias("upper_bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_good: float = MIN_GOOD, z: float = Z, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_labelled, good_rate, upper_bound."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rep = cut(host_reputation(parts, labels, z, second_level))
    rep = broadcast_if_small(rep.withColumnRenamed("host", "h"))
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("upper_bound") < min_good, F.lit("block")).otherwise(F.lit("allow"))
    joined = parts.join(rep, F.col("host") == F.col("h"), "left")
    return joined.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.col("n_labelled").cast("long").alias("n_labelled"), F.round("good_rate", 6).alias("good_rate"), F.round("upper_bound", 6).alias("upper_bound"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcome AS (SELECT doc_id, min((coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0)::INT) AS good FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
hosts0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::BIGINT AS k, regexp_replace(host, ':\d*$', '') AS bare FROM parts LEFT JOIN outcome ON page_id = doc_id GROUP BY host),
hosts1 AS (SELECT *, regexp_extract(bare, '[^.]*$') AS last1, regexp_extract(bare, '[^.]*\.[^.]*$') AS last2, regexp_extract(bare, '[^.]*\.[^.]*\.[^.]*$') AS last3 FROM hosts0),
hosts2 AS (SELECT *, last2 IN ('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'net.au', 'or.jp', 'org.au', 'org.uk') AS second, regexp_matches(last1, '^\d+$') AS num FROM hosts1),
hosts AS (SELECT host, n, k, CASE WHEN num THEN '' WHEN second THEN last2 ELSE last1 END AS suffix,
    CASE WHEN num THEN bare WHEN second AND last3 <> '' THEN last3 WHEN NOT second AND last2 <> '' THEN last2 ELSE bare END AS domain FROM hosts2),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2)::DOUBLE FROM domains) AS p FROM domains GROUP BY suffix),
m1 AS (SELECT 1 / least(greatest((coalesce(sum((k - n * p) * (k - n * p)), 0.0::DOUBLE) - coalesce(sum(n * p * (1 - p)), 0.0::DOUBLE) + 5.0::DOUBLE / 11) / (coalesce(sum(n * (n - 1) * p * (1 - p)), 0.0::DOUBLE) + 5.0::DOUBLE), 1.0::DOUBLE / 1001), 0.5::DOUBLE) - 1 AS m FROM suffixes WHERE n > 0),
s1 AS (SELECT suffix, (k + m * p) / (n + m) AS p1 FROM suffixes, m1),
d0 AS (SELECT domain, n, k, p1 AS p FROM domains JOIN s1 USING (suffix)),
m2 AS (SELECT 1 / least(greatest((coalesce(sum((k - n * p) * (k - n * p)), 0.0::DOUBLE) - coalesce(sum(n * p * (1 - p)), 0.0::DOUBLE) + 5.0::DOUBLE / 11) / (coalesce(sum(n * (n - 1) * p * (1 - p)), 0.0::DOUBLE) + 5.0::DOUBLE), 1.0::DOUBLE / 1001), 0.5::DOUBLE) - 1 AS m FROM d0 WHERE n > 0),
d1 AS (SELECT domain, (k + m * p) / (n + m) AS p2 FROM d0, m2),
h0 AS (SELECT host, n, k, p2 AS p FROM hosts JOIN d1 USING (domain)),
m3 AS (SELECT 1 / least(greatest((coalesce(sum((k - n * p) * (k - n * p)), 0.0::DOUBLE) - coalesce(sum(n * p * (1 - p)), 0.0::DOUBLE) + 5.0::DOUBLE / 11) / (coalesce(sum(n * (n - 1) * p * (1 - p)), 0.0::DOUBLE) + 5.0::DOUBLE), 1.0::DOUBLE / 1001), 0.5::DOUBLE) - 1 AS m FROM h0 WHERE n > 0),
h1 AS (SELECT host, n, (k + m * p) / (n + m) AS mean, k + m * p AS a, n - k + m * (1 - p) AS b FROM h0, m3),
rep AS (SELECT host, n::BIGINT AS n_labelled, mean AS good_rate, mean + 1.6449::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper_bound FROM h1),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN upper_bound < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
    n_labelled, round(good_rate, 6) AS good_rate, round(upper_bound, 6) AS upper_bound
FROM ruled LEFT JOIN rep USING (host)
"""
