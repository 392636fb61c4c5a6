import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import urls as U

CASES = [
    ("https://WWW.Example.com/en/x?y", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://x.net/es/1#a", "x.net", "/es/1", "net/es/", "block"),
    ("ftp://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://subnet/fr/", "subnet", "/fr/", None, "allow"),
    ("http://a.org?x://b.com/", "a.org", "", None, "allow"),
    ("no scheme.com/en/", "", "", None, "allow"),
    ("x://y://z.net/es/", "y:", "//z.net/es/", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://É.com/a", "É.com", "/a", "com/", "allow"),
]


def pages(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return df.withColumns({c: F.lit(1) for c in ("host", "rule", "verdict", "bad", "n", "mean")})


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, bad int")


def test_rules(spark):
    got = {r["page_id"]: tuple(r)[1:] for r in U.filter_urls(pages(spark, [c[0] for c in CASES]), outcomes(spark, [])).collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[1:], case


def test_reputation_shrinks_and_blocks(spark):
    urls = [f"http://bad.x.org/{i}" for i in range(40)] + [f"http://good.y.org/{i}" for i in range(400)] + ["http://rare.z.org/1", "http://new.x.org/1"]
    marks = [(i, 1) for i in range(35)] + [(i, 0) for i in range(40, 400)] + [(440, 1), (440, None), (0, 0)]
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(pages(spark, urls), outcomes(spark, marks)).collect()}
    assert {got[i] for i in range(40)} == {"block"} and {got[i] for i in range(40, 440)} == {"allow"}
    assert got[440] == "allow"  # one bad page proves little
    means = {r["host"]: r for r in U.reputations(pages(spark, urls).select("page_id", U.host_of(F.col("url")).alias("host")), outcomes(spark, marks)).collect()}
    assert means["good.y.org"]["mean"] < 0.05 < means["rare.z.org"]["mean"] < means["bad.x.org"]["mean"] and means["new.x.org"]["chance"] < U.SURE <= means["bad.x.org"]["chance"]


def test_against_numpy(spark):
    marks = [(i, int(i % 5 == 0 or i < 6)) for i in range(30)]
    urls = [f"http://h{i % 4}.d{i % 2}.org/" for i in range(30)]
    got = {r["host"]: r for r in U.reputations(pages(spark, urls).select("page_id", U.host_of(F.col("url")).alias("host")), outcomes(spark, marks)).collect()}
    hosts = {}
    for (i, bad), u in zip(marks, urls):
        hosts.setdefault(u[7:-1], []).append(bad)
    n, s = 30, sum(b for _, b in marks)

    def kappa(groups):
        p = s / n
        return U.strength(len(groups), n, sum(len(g) ** 2 for g in groups), p, sum(len(g) * (sum(g) / len(g) - p) ** 2 for g in groups))

    domains = {d: [b for h, g in hosts.items() if h.endswith(d) for b in g] for d in ("d0.org", "d1.org")}
    ks, kd, kh = kappa([sum(domains.values(), [])]), kappa(domains.values()), kappa(hosts.values())
    for h, g in hosts.items():
        d = domains[h[3:]]
        top = (s - sum(d) + ks * (s + 1) / (n + 2)) / (n - len(d) + ks)
        middle = (sum(d) - sum(g) + kd * top) / (len(d) - len(g) + kd)
        weight = len(g) + kh
        mean = (sum(g) + kh * middle) / weight
        x = (np.arange(U.STEPS) + 0.5) / U.STEPS
        density = x ** (mean * weight - 1) * (1 - x) ** ((1 - mean) * weight - 1)
        assert got[h]["mean"] == pytest.approx(mean) and got[h]["chance"] == pytest.approx(density[x > U.LIMIT].sum() / density.sum())
        drawn = np.random.default_rng(1).beta(mean * weight, (1 - mean) * weight, 200_000)
        assert got[h]["chance"] == pytest.approx((drawn > U.LIMIT).mean(), abs=0.01)


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.org": ("y.org", "org"), "y.org:8080": ("y.org", "org"), "10.0.0.7": ("10.0.0.7", ""), "10.0.0.7:80": ("10.0.0.7", ""), "co.uk": ("co.uk", "co.uk"), "local": ("local", "local"), "": ("", "")}
    domain, suffix = U.registered(F.col("host"), U.SECOND_LEVEL)
    for r in spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect():
        assert (r["d"], r["s"]) == hosts[r["host"]], r["host"]


def test_repeated_pages_are_judged_each(spark):
    df = pages(spark, ["http://a.org/", "http://a.org/"])
    assert U.filter_urls(df.unionByName(df), outcomes(spark, [(0, 1)])).count() == 4


def test_empty_and_native(spark):
    assert U.filter_urls(pages(spark, ["x"]).limit(0), outcomes(spark, [])).collect() == []
    plan = U.filter_urls(pages(spark, ["http://a.org/"]), outcomes(spark, [(0, 1)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
