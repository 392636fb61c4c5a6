"""URL filters: rules first, then an empirical-Bayes reputation of the host. [native]

Labelled page outcomes (1: bad) are counted by host, registered domain and suffix. The suffix is the last label of the
host, or the last two where they are one of ``second_level`` (a registry's own, as in co.uk); the registered domain
has one label more; ports are left out, and an IP address is a domain of its own. Each level shrinks to the posterior
mean of the level above, without its own counts, with a beta prior whose strength is estimated from the spread of that
level's rates (beta-binomial moments). A page without a rule is blocked if its host's bad rate is above ``limit`` with
a posterior probability of ``SURE`` at least, summed over ``STEPS`` points of the beta density. A host that was never
labelled has its domain's prior, which is wide.

Only counts per host leave the scan, and are kept as a table; one row of sums per level reaches the driver.

Nulls: a null url, or one without ``://``, has an empty host and path, which is a host like any
other. Null outcomes don't count; several outcomes of a page count as its worst. Repeated rows
are judged, and counted, each. Empty tables give empty results; without outcomes the prior is even.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.store import cut

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"
LIMIT, SURE, STEPS = 0.5, 0.95, 256
#: Suffixes of two labels under which names are registered.
SECOND_LEVEL = (
    "ac.jp", "ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx",
    "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.cn", "org.uk",
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Rules are a short list, one branch each."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def strength(groups: int, n: float, squares: float, p: float, spread: float) -> float:
    """alpha + beta of a beta-binomial by moments: spread is the sum of n_i (rate_i - p)**2."""
    inner = p * (1 - p)
    free = n - squares / n - (groups - 1) if n else 0.0
    rho = (spread - inner * (groups - 1)) / (inner * free) if free > 0 and inner > 0 else 0.0
    return 1 / min(max(rho, 0.001), 0.5) - 1


def chance_above(mean: Column, weight: Column, limit: float) -> Column:
    """P(rate > limit) of a beta with this mean and weight, by the density at the middles of STEPS intervals."""
    x = lambda j: (j + F.lit(0.5)) / F.lit(float(STEPS))
    logs = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda j: (mean * weight - 1) * F.ln(x(j)) + ((1 - mean) * weight - 1) * F.ln(1 - x(j)))
    mass = lambda some: F.aggregate(some, F.lit(0.0), lambda t, y: t + y)
    density = F.transform(logs, lambda y: F.exp(y - F.array_max(logs)))
    return mass(F.transform(density, lambda y, j: F.when(x(j) > limit, y).otherwise(0.0))) / mass(density)


def registered(host: Column, second_level: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    label = lambda k: F.substring_index(name, ".", -k)
    two, address = label(2).isin(*second_level), name.rlike("^[0-9.]+$")
    return F.when(address, name).when(two, label(3)).otherwise(label(2)), F.when(address, "").when(two, label(2)).otherwise(label(1))


def reputations(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """host, mean of its bad rate and the chance that it is above the limit, for each host of pages (page_id, host)."""
    known = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    domain, suffix = registered(F.col("host"), second_level)
    hosts = cut(seen.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    levels = {"host": hosts}
    for level, above in (("domain", "host"), ("suffix", "domain")):
        keys = [level] + (["suffix"] if level == "domain" else [])
        levels[level] = levels[above].groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    rate, p = (bad + 1) / (n + 2), bad / n if n else 0.0
    kappa = {}
    for level, rows in levels.items():
        k, squares, spread = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * (F.col("bad") / F.col("n") - p) * (F.col("bad") / F.col("n") - p)), F.lit(0.0))).first()
        kappa[level] = strength(k, n, squares, p, spread)
    # what is known of the others of a level is the prior of one
    others = lambda above, prior: (F.col(f"{above}_bad") - F.col("bad") + F.lit(kappa[above]) * prior) / (F.col(f"{above}_n") - F.col("n") + F.lit(kappa[above]))
    upper = lambda level: levels[level].withColumnsRenamed({"n": f"{level}_n", "bad": f"{level}_bad"})
    domains = levels["domain"].join(upper("suffix"), "suffix").withColumn("domain_prior", others("suffix", F.lit(rate)))
    found = hosts.join(domains.select("domain", F.col("n").alias("domain_n"), F.col("bad").alias("domain_bad"), "domain_prior"), "domain")
    weight = F.col("n") + F.lit(kappa["host"])
    found = found.withColumn("mean", (F.col("bad") + F.lit(kappa["host"]) * others("domain", F.col("domain_prior"))) / weight)
    return found.select("host", "mean", chance_above(F.col("mean"), weight, limit).alias("chance"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT, second_level: Sequence[str] = SECOND_LEVEL, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    known = reputations(rows.select("page_id", "host"), outcomes, limit, second_level).select("host", "chance")
    method = F.when(F.col("chance") >= SURE, "block").otherwise("allow")
    return rows.join(known, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the row of ``labels`` with its id: bad if of low quality or toxic."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return filter_urls(pages, outcomes)


def _oracle() -> str:
    fits = lambda t: f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')"
    order = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in order) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in order) + " END"
    kappa = lambda level: f"""k_{level} AS (SELECT 1 / least(greatest(coalesce(CASE WHEN n - sq / n - (k - 1) > 0 AND p * (1 - p) > 0 THEN (spread - p * (1 - p) * (k - 1)) / (p * (1 - p) * (n - sq / n - (k - 1))) END, 0), 0.001), 0.5) - 1 AS kappa
  FROM (SELECT count(*) AS k, sum(l.n * l.n) AS sq, sum(l.n * (l.bad / l.n - g.p) * (l.bad / l.n - g.p)) AS spread, any_value(g.n) AS n, any_value(g.p) AS p FROM {level} l, g WHERE l.n > 0))"""  # noqa: E731
    two = "array_to_string(parts[-2:], '.') IN (" + ", ".join(f"'{x}'" for x in SECOND_LEVEL) + ")"
    x = f"((j + 0.5::DOUBLE) / {STEPS}.0::DOUBLE)"
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
named AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM u LEFT JOIN o USING (page_id) GROUP BY host),
host AS (SELECT host, n, bad, CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN name WHEN {two} THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
  CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN '' WHEN {two} THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM named),
domain AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM host GROUP BY domain),
suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domain GROUP BY suffix),
g AS (SELECT sum(n) AS n, sum(bad) / sum(n) AS p, (sum(bad) + 1) / (sum(n) + 2) AS rate FROM host),
{kappa('host')}, {kappa('domain')}, {kappa('suffix')},
md AS (SELECT domain, d.n, d.bad, (s.bad - d.bad + kappa * rate) / (s.n - d.n + kappa) AS prior FROM domain d JOIN suffix s USING (suffix), g, k_suffix),
mh AS (SELECT host, h.n + k_host.kappa AS weight, (h.bad + k_host.kappa * (d.bad - h.bad + k_domain.kappa * prior) / (d.n - h.n + k_domain.kappa)) / (h.n + k_host.kappa) AS m FROM host h JOIN md d USING (domain), k_host, k_domain),
logs AS (SELECT host, list_transform(range(0, {STEPS}), lambda j: (m * weight - 1) * ln({x}) + ((1 - m) * weight - 1) * ln(1 - {x})) AS y FROM mh),
sure AS (SELECT host, list_sum(list_transform(range(0, {STEPS}), lambda j: CASE WHEN {x} > {LIMIT} THEN exp(y[j + 1] - list_max(y)) ELSE 0 END)) / list_sum(list_transform(y, lambda v: exp(v - list_max(y)))) AS chance FROM logs)
SELECT page_id, host, path, {rule} AS rule, coalesce({said}, CASE WHEN chance >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN sure USING (host)
"""


ORACLE = _oracle()
