"""URL filter with Empirical-Bayes host reputation.

Labelled page outcomes (1: bad, 0: good) are counted per host. Rates shrink from host to registered domain to
suffix to the whole: at each level the children of a parent are taken as beta-binomial with the parent's rate as
mean, and the prior's strength is the moment estimate from how far the children scatter beyond chance. A host is
blocked when the lower bound of its posterior bad rate is above a limit. Listed rules come first: the longest one
that fits decides.

Edge cases: a url that is null or has no ``://`` has an empty host and path, no rule fits it, and it shares the
reputation of the empty host; hosts without outcomes have their parent's rate; without any outcome everything that
no rule blocks is allowed; repeated rows are each judged, and outcomes count once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.llm.common import ascii_lower
from foldmark.session import materialize, small_side

#: Fixed values: (rule, verdict) of the contract.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "com.cn", "com.mx")
LIMIT = 0.5  # a host is blocked if its bad rate is above this
WEAK = 2.0  # observations that a prior counts for where its strength cannot be told
Z = 1.645  # with this many posterior standard deviations


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def parents_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the last label, or two for the listed suffixes, and one label before it."""
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).isin(*TWO_LABEL_SUFFIXES)
    domain = F.when(two, F.regexp_extract(host, r"((?:[^.]+\.)?[^.]+\.[^.]+)$", 1)).otherwise(F.regexp_extract(host, r"((?:[^.]+\.)?[^.]+)$", 1))
    suffix = F.when(two, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(F.regexp_extract(host, r"([^.]+)$", 1))
    return domain, suffix


def _strength(units: DataFrame, mean: str) -> float:
    """Weight of the prior in observations, by moments; ``units`` has n, k and the prior's mean."""
    n, m = F.col("n"), F.col(mean)
    seen = units.filter("n > 0").agg(
        F.sum(n).cast("double"),
        F.sum(n * n).cast("double"),
        F.sum((F.col("k") - n * m) * (F.col("k") - n * m) / n),
        F.sum(m * (1 - m)),
        F.sum(n * m * (1 - m)),
    ).first()
    total, squares, scatter, chance, spread = (x or 0.0 for x in seen)
    if total <= 0 or spread <= 0 or total * total <= squares:
        return WEAK
    excess = (scatter - chance) / (spread / total * (total - squares / total))
    share = min(max(excess, 0.001), 0.5)
    return (1 - share) / share


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """(host, bound) from (host, n, k): lower bound of the posterior bad rate of each host."""
    domain, suffix = parents_of(F.col("host"))
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "urls")
    total, bad = hosts.agg(F.sum("n"), F.sum("k")).first()
    overall = ((bad or 0) + 0.5) / ((total or 0) + 1.0)
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    parent = hosts.groupBy("suffix").agg(*sums).withColumns({"prior": F.lit(overall), "known": F.lit((total or 0) + 1.0)})
    tables = []
    for level in ("suffix", "domain", "host"):
        if level != "suffix":
            own = hosts.groupBy("suffix", "domain").agg(*sums) if level == "domain" else hosts
            key = "suffix" if level == "domain" else "domain"
            above = tables[-1].select(F.col(key), F.col("rate").alias("prior"), F.col("total").alias("known"))
            parent = own.join(small_side(above), key)
        parent = materialize(parent, "urls")
        m = _strength(parent, "prior")
        weight = m * F.col("known") / (m + F.col("known"))  # a prior weighs no more than what is known of the parent
        total = weight + F.col("n")
        tables.append(parent.withColumn("rate", (weight * F.col("prior") + F.col("k")) / total).withColumn("total", total).drop("prior", "known"))
    rate = F.col("rate")
    return tables[-1].select("host", (rate - z * F.sqrt(rate * (1 - rate) / (F.col("total") + 1))).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule and verdict per row of ``pages``; ``outcomes`` has host and bad (0 or 1)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counts = outcomes.filter("bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    names = split.select("host").distinct().withColumns({"n": F.lit(0).cast("long"), "k": F.lit(0).cast("long")})
    hosts = counts.unionByName(names).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    blocked = reputation(hosts, z).filter(F.col("bound") > limit).select(F.col("host").alias("_host"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = split.join(small_side(blocked), F.col("host") == F.col("_host"), "left")
    method = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def shown_document(url: Column) -> Column:
    """The number that ends the path of a page, which is the doc_id of what the page shows."""
    return F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("long")


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose document is labelled: bad if its quality is 0 or it is toxic."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    known = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(bad).cast("long").alias("bad"))
    shown = pages.select(host_of(F.col("url")).alias("host"), shown_document(F.col("url")).alias("_shown"))
    return shown.join(known, F.col("_shown") == F.col("_doc")).select("host", "bad")


def _level(name: str, of: str, above: str, key: str) -> str:
    return f"""
{name}_p AS (SELECT c.*, a.rate AS prior, a.total AS known FROM {of} c JOIN {above} a USING ({key})),
{name}_x AS (SELECT sum(n)::DOUBLE AS t, sum(n * n)::DOUBLE AS s2, sum((k - n * prior) * (k - n * prior) / n) AS sc, sum(prior * (1 - prior)) AS ch, sum(n * prior * (1 - prior)) AS sp FROM {name}_p WHERE n > 0),
{name}_y AS (SELECT CASE WHEN coalesce(t, 0) <= 0 OR sp <= 0 OR t * t <= s2 THEN NULL ELSE least(greatest((sc - ch) / (sp / t * (t - s2 / t)), 0.001), 0.5) END AS share FROM {name}_x),
{name}_m AS (SELECT CASE WHEN share IS NULL THEN {WEAK} ELSE (1 - share) / share END::DOUBLE AS m FROM {name}_y),
{name}_w AS (SELECT p.*, m * known / (m + known) AS weight FROM {name}_p p, {name}_m),
{name} AS (SELECT * EXCLUDE (prior, known, weight), (weight * prior + k) / (weight + n) AS rate, weight + n AS total FROM {name}_w)"""


_TWO = "('" + "','".join(TWO_LABEL_SUFFIXES) + "')"
ORACLE = f"""
WITH p AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
lab AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT host, bad FROM p JOIN lab ON try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html)?/?$', 1) AS BIGINT) = lab.doc_id WHERE bad IS NOT NULL),
h0 AS (SELECT host, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM (SELECT host, 1 AS n, bad AS k FROM o UNION ALL SELECT DISTINCT host, 0, 0 FROM p) GROUP BY host),
h1 AS (SELECT *, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) IN {_TWO} AS two FROM h0),
h2 AS (SELECT host, n, k, CASE WHEN two THEN regexp_extract(host, '((?:[^.]+\\.)?[^.]+\\.[^.]+)$', 1) ELSE regexp_extract(host, '((?:[^.]+\\.)?[^.]+)$', 1) END AS domain,
    CASE WHEN two THEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) ELSE regexp_extract(host, '([^.]+)$', 1) END AS suffix FROM h1),
world AS (SELECT DISTINCT suffix, (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) FROM h2) AS rate,
    (SELECT coalesce(sum(n), 0) + 1.0::DOUBLE FROM h2) AS total FROM h2),
s0 AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h2 GROUP BY suffix),
d0 AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h2 GROUP BY suffix, domain),
{_level('s', 's0', 'world', 'suffix')},{_level('dm', 'd0', 's', 'suffix')},{_level('hm', 'h2', 'dm', 'domain')},
bad_hosts AS (SELECT host FROM hm WHERE rate - {Z} * sqrt(rate * (1 - rate) / (total + 1)) > {LIMIT}),
f AS (SELECT page_id, host, path,
    (host = 'org' OR ends_with(host, '.org')) AS org, (host = 'com' OR ends_with(host, '.com')) AS com, (host = 'example.org' OR ends_with(host, '.example.org')) AS eo FROM p),
r AS (SELECT *, CASE WHEN eo AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN eo AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN com AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM bad_hosts) THEN 'block' ELSE 'allow' END AS verdict FROM r"""
