import math

import pytest

from codeloom.llm import hosts as H


@pytest.mark.parametrize(
    ("url", "parts"),
    [
        ("https://Blog.A.example.com/x", ("blog.a.example.com", "example.com", "com")), ("http://user:p@a.b.co.uk:80/1", ("a.b.co.uk", "b.co.uk", "co.uk")), ("ftp://localhost", ("localhost", "localhost", "localhost")),
        ("https://co.uk/", ("co.uk", "co.uk", "co.uk")), ("https://a.com./7?x=1", ("a.com", "a.com", "com")), ("no url", (None, None, None)), ("", (None, None, None)), (None, (None, None, None)), ("http:///x", (None, None, None)),
    ],
)
def test_parts(spark, url, parts):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(url,)], "url string").select(*[c.alias(n) for n, c in H.host_parts(F.col("url")).items()]).collect()[0]
    assert tuple(r) == parts


def test_suffix_rules(spark):
    from pyspark.sql import functions as F

    rules = H.read_suffixes(["// comment", "", "com", "co.uk", "*.ck", "!www.ck", "a.b.c"])
    assert rules == ("co.uk", "*.ck", "!www.ck", "a.b.c")
    want = {"x.y.co.uk": ("y.co.uk", "co.uk"), "p.q.r.ck": ("q.r.ck", "r.ck"), "z.www.ck": ("www.ck", "ck"), "www.ck": ("www.ck", "ck"), "r.ck": ("r.ck", "r.ck"), "ck": ("ck", "ck"), "s.t.a.b.c": ("t.a.b.c", "a.b.c"), "b.c": ("b.c", "c"), "m.n.com": ("n.com", "com")}
    parts = H.host_parts(F.col("url"), rules)
    found = spark.createDataFrame([(f"http://{h}/",) for h in want], "url string").select(parts["host"].alias("h"), parts["domain"].alias("d"), parts["suffix"].alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in found} == want


def brute(pages, labels):
    """Rates by host, with loops."""
    bad = {}
    for doc, quality, toxic in labels:
        if doc is not None and (quality is not None or toxic is not None):
            bad[doc] = max(bad.get(doc, 0), int(toxic == 1 or quality == 0))
    hosts = {}
    for _, host, doc in pages:
        h = hosts.setdefault(host, [0, 0])
        if doc in bad:
            h[0] += 1
            h[1] += bad[doc]
    def domain(h): return ".".join(h.split(".")[-2:])
    def suffix(h): return h.split(".")[-1]
    def group(key):
        out = {}
        for h, (n, b) in hosts.items():
            g = out.setdefault(key(h), [0, 0])
            g[0] += n
            g[1] += b
        return out
    def fit(units):
        spread = sum((b - n * m) ** 2 for n, b, m in units) - sum(n * m * (1 - m) for n, b, m in units)
        extra = sum(n * (n - 1) * m * (1 - m) for n, b, m in units)
        rho = spread / extra if extra > 0 else None
        return min(max(1 / rho - 1, 1), 1000) if rho is not None and rho > 0 else 1000
    n, b = (sum(x[i] for x in hosts.values()) for i in (0, 1))
    top = b / n if n else 0.5
    s = group(suffix)
    w = fit([(n, b, top) for n, b in s.values()])
    s = {k: (b + w * top) / (n + w) for k, (n, b) in s.items()}
    d = {k: (n, b, s[suffix(k)]) for k, (n, b) in group(domain).items()}
    w = fit(d.values())
    d = {k: (b + w * m) / (n + w) for k, (n, b, m) in d.items()}
    h = {k: (n, b, d[domain(k)]) for k, (n, b) in hosts.items()}
    w = fit(h.values())
    out = {}
    for k, (n, b, m) in h.items():
        mean = (b + w * m) / (n + w)
        out[k] = (n, b, round(mean, 9), round(max(0, mean - H.Z * math.sqrt(mean * (1 - mean) / (n + w + 1))), 9))
    return out


def test_filter_equals_brute_force(spark):
    pages, doc = [], 0
    for host, n in (("a.spam.com", 60), ("b.spam.com", 30), ("a.good.com", 80), ("x.good.org", 20), ("new.spam.com", 0), ("lone.net", 3)):
        for _ in range(max(n, 1)):
            pages.append((len(pages), host, doc if n else 10**6))
            doc += 1
    labels = [(i, int("spam" not in pages[i][1] or i % 9 == 0), int(i % 13 == 0)) for i in range(doc - 4)] + [(3, None, None), (4, 0, None), (None, 0, 1)]
    urls = [(i, f"https://{h}/en/{d}{('', '?page=2', '#top', '.html', '/')[i % 5]}", "x") for i, h, d in pages]
    urls += [(900, None, ""), (901, "nonsense", ""), (None, f"https://a.good.com/{10**6}", "")]
    pages_df = spark.createDataFrame([(*u, 1, 2) for u in urls], "page_id long, url string, html string, bad int, n int")
    labels_df = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, host int")
    found = H.filter_urls(pages_df, labels_df).collect()
    want = brute([*pages, (None, "a.good.com", 10**6)], labels)
    assert len(found) == len(urls)
    for r in found:
        if r.page_id in (900, 901):
            assert (r.host, r.rate, r.keep) == (None, None, True)
        else:
            assert (r.labelled, r.bad) == want[r.host][:2] and r.rate == pytest.approx(want[r.host][2], abs=2e-9) and r.lower == pytest.approx(want[r.host][3], abs=2e-9)
            assert r.keep == (want[r.host][3] <= H.THRESHOLD)
    kept = {r.host: r.keep for r in found if r.host}
    assert not kept["a.spam.com"] and kept["a.good.com"]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "https://a.com/1")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    (r,) = H.filter_urls(pages, labels).collect()
    assert (r.labelled, r.bad, r.rate, r.keep) == (0, 0, None, True)
    assert H.filter_urls(pages.where("false"), labels).collect() == []
