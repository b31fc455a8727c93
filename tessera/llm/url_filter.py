"""URL filters by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes give each host k bad pages of n. Rates are shrunk through beta-binomial
priors from suffix to registered domain to host: at every level the prior's mean is the level above
and its strength is estimated from how far the groups of the level differ (moments). A host is
blocked if the lower posterior bound of its bad rate is over a threshold. Allow and block rules by host
and path come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: One-sided 90 % bound, the bad rate it must exceed, and the limits of a prior's strength.
Z, BAD_RATE, WEAKEST, STRONGEST = 1.2816, 0.25, 1.0, 10000.0
#: Suffixes of several labels where no other list is given (OP4_SQL has the same); every other suffix
#: is the last label.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def read_suffixes(table_: DataFrame) -> list[str]:
    """The suffixes of several labels in a table (suffix) of a public suffix list's lines. Wildcards
    and exceptions (``*.ck``, ``!www.ck``) and comments are left out."""
    name = F.translate(F.trim("suffix"), _UPPER, _LOWER)
    rows = table_.select(name.alias("suffix")).where(F.col("suffix").rlike(r"^[^*!/. ][^*! ]*[.][^*! ]*[^*!. ]$")).distinct().collect()
    return sorted(r.suffix for r in rows)


def suffix_domain(host: Column, suffixes: list[str] = SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain by the longest of ``suffixes`` that fits, else by the last label;
    an IPv4 address is its own domain under the suffix ``ip``."""
    ip = host.rlike(r"^[0-9]+([.][0-9]+){3}$")
    suffix, domain = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        last = F.substring_index(host, ".", -n)
        fits = last.isin([s for s in suffixes if s.count(".") + 1 == n])
        suffix, domain = F.when(fits, last).otherwise(suffix), F.when(fits, F.substring_index(host, ".", -n - 1)).otherwise(domain)
    return F.when(ip, "ip").otherwise(suffix), F.when(ip, host).otherwise(domain)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """The longest rule that fits (``what`` 0) or its verdict (1); null if none does."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit((h + p, verdict)[what])).otherwise(out)
    return out


def _strength(groups: DataFrame, total_n: float, total_k: float) -> float:
    """Strength of the beta prior that explains the spread of the groups' rates (n, k)."""
    m = total_k / total_n if total_n else 0.0
    if not 0 < m < 1:
        return STRONGEST
    r = groups.agg(F.count("*").alias("g"), F.sum((F.col("k") - F.col("n") * m) ** 2 / F.col("n")).alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")).head()
    spread = total_n - r.q / total_n - (r.g - 1)
    if spread <= 0:
        return STRONGEST
    rho = (r.s / (m * (1 - m)) - (r.g - 1)) / spread
    return STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, 1 / rho - 1))


def host_reputation(outcomes: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(host, n, k, rate, low): posterior bad rate and its lower bound for each host of ``outcomes``
    (host, bad 0 or 1; null ``bad`` is unlabelled and counts for nothing).

    Three sums over groups reach the driver, one row each. Empty outcomes give an empty table.
    """
    host = F.col("host")
    suffix, domain = suffix_domain(host, suffixes)
    labelled = F.when(F.col("bad").isNotNull(), 1)
    hosts = outcomes.groupBy("host").agg(F.count(labelled).cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    hosts = stored(hosts.withColumn("suffix", suffix).withColumn("domain", domain), "hosts")
    whole = hosts.agg(F.sum("n"), F.sum("k")).head()
    n, k = whole[0] or 0.0, whole[1] or 0.0
    up = lambda by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops, domains = stored(up(["suffix"]), "suffixes"), stored(up(["suffix", "domain"]), "domains")
    some = F.col("n") > 0
    s0, s1, s2 = (_strength(x.where(some), n, k) for x in (tops, domains, hosts))
    m = (k + 0.5) / (n + 1)
    shrunk = lambda prior, s: (F.col("k") + prior * s) / (F.col("n") + s)
    tops = tops.select("suffix", shrunk(F.lit(m), s0).alias("up0"))
    domains = domains.join(tops, "suffix").select("suffix", "domain", shrunk(F.col("up0"), s1).alias("up1"))
    out = hosts.join(domains, ["suffix", "domain"]).select("host", "n", "k", shrunk(F.col("up1"), s2).alias("rate"))
    low = F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + s2 + 1))
    return stored(out.withColumn("low", low), "reputation")


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict, rate and low.

    ``outcomes`` (page_id, bad) holds at most one row for each labelled page. The verdict is the
    longest fitting rule's, else ``block`` if the host's lower bound is over BAD_RATE, else ``allow``.
    Null urls have an empty host and path, and share the empty host's reputation. Repeated pages
    are judged each; a null page_id has no outcome. Extra columns are ignored.
    """
    host, path = host_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = pages.join(outcomes.select("page_id", "bad"), "page_id", "left").select("host", "bad")
    out = pages.join(host_reputation(seen, suffixes).select("host", "rate", "low"), "host", "left")
    own = rule_of(F.col("host"), F.col("path"), rules, 1)
    method = F.when(F.col("low") > BAD_RATE, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules, 0).alias("rule"), F.coalesce(own, method).alias("verdict"), "rate", "low")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of the pages whose document is labelled: a page shows the document whose
    doc_id ends its url's path; it is bad if that has quality 0 or toxic 1."""
    _, path = host_path(F.col("url"))
    number = F.regexp_extract(path, "/([0-9]{1,18})(/|[.]html)?$", 1)
    shown = pages.where("page_id is not null").select("page_id", F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id is not null")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return shown.join(own, "doc_id").groupBy("page_id").agg(F.max("bad").alias("bad"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter(pages, labelled_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), o AS (
  SELECT page_id, max(bad) AS bad FROM p JOIN l ON TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(/|[.]html)?$', 1) AS BIGINT) = l.doc_id GROUP BY page_id
), h0 AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, string_split(host, '.') AS s, regexp_full_match(host, '[0-9]+([.][0-9]+){3}') AS ip
  FROM p LEFT JOIN o USING (page_id) GROUP BY host
), h1 AS (
  SELECT *, array_to_string(s[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'co.in') AS two FROM h0
), h AS (
  SELECT host, n, k, CASE WHEN ip THEN 'ip' WHEN two THEN array_to_string(s[-2:], '.') ELSE s[-1] END AS suffix,
    CASE WHEN ip THEN host WHEN two THEN array_to_string(s[-3:], '.') ELSE array_to_string(s[-2:], '.') END AS domain FROM h1
), s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix, domain),
t AS (SELECT sum(n) AS n, sum(k) AS k FROM h),
g AS (SELECT 0 AS lv, n, k FROM s WHERE n > 0 UNION ALL SELECT 1, n, k FROM d WHERE n > 0 UNION ALL SELECT 2, n, k FROM h WHERE n > 0),
x AS (
  SELECT lv, any_value(t.n) AS tn, any_value(t.k / t.n) AS m, count(*) AS g, sum((g.k - g.n * t.k / t.n) ** 2 / g.n) AS s, sum(g.n * g.n) AS q FROM g, t GROUP BY lv
), r AS (SELECT lv, m, tn - q / tn - (g - 1) AS spread, (s / (m * (1 - m)) - (g - 1)) / (tn - q / tn - (g - 1)) AS rho FROM x),
z AS (
  SELECT coalesce(max(CASE WHEN lv = 0 THEN st END), 10000) AS s0, coalesce(max(CASE WHEN lv = 1 THEN st END), 10000) AS s1, coalesce(max(CASE WHEN lv = 2 THEN st END), 10000) AS s2
  FROM (SELECT lv, CASE WHEN NOT (m > 0 AND m < 1) OR spread <= 0 OR rho <= 0 THEN 10000 ELSE least(10000, greatest(1, 1 / rho - 1)) END AS st FROM r)
), a AS (SELECT suffix, (s.k + (t.k + 0.5) / (t.n + 1) * s0) / (s.n + s0) AS up FROM s, t, z),
b AS (SELECT suffix, domain, (d.k + a.up * s1) / (d.n + s1) AS up FROM d JOIN a USING (suffix), z),
c AS (SELECT host, h.n, s2, (h.k + b.up * s2) / (h.n + s2) AS rate FROM h JOIN b USING (suffix, domain), z),
v AS (
  SELECT page_id, host, path, CASE WHEN rate - 1.2816 * sqrt(rate * (1 - rate) / (n + s2 + 1)) > 0.25 THEN 'block' ELSE 'allow' END AS method,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN c USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN method WHEN rule IN ('org/', 'com/fr/') THEN 'allow' ELSE 'block' END AS verdict FROM v
"""
