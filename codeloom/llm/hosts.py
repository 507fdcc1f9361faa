"""URL filter by empirical-Bayes host reputation.

Pages whose document is labelled are trials, bad ones (toxic, or of low quality) successes.
Rates are beta-binomial, each level's prior centred on the posterior mean of the level above:
corpus -> public suffix -> registered domain -> host. The weight of a prior, as a number of
pseudo-pages, is fitted over all units of its level by the method of moments. A host
is dropped if even the lower bound of its posterior rate lies above the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tables import checkpoint

#: Suffixes of more than one label under which anyone can register a domain. Only the commonest: pass `read_suffixes(path)` of a full list.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "com.ar", "github.io", "blogspot.com")
#: The rate of bad pages that is tolerated; standard deviations of the bound; the range of a prior's weight.
THRESHOLD, Z, LEAST_WEIGHT, MOST_WEIGHT = 0.3, 1.645, 1.0, 1000.0


def read_suffixes(lines: Iterable[str]) -> tuple[str, ...]:
    """Rules of more than one label from the lines of a public suffix list, `*.x` and `!a.x` among them; comments and blank lines are skipped."""
    rules = [line.split()[0].lower() for line in lines if line.strip() and not line.startswith("//")]
    return tuple(r for r in rules if "." in r)


def host_parts(url: Column, rules: tuple[str, ...] = SECOND_LEVEL) -> dict[str, Column]:
    """host, domain and suffix of a URL, lower case; null for a string without scheme and host. The suffix is the longest that
    a rule names (`*.x`: any label in front of x; `!a.x`: not a.x), else the last label; the domain has a label more. A host
    without a label more is its own domain."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.when(host != "", F.regexp_replace(host, r"\.+$", ""))
    plain, wild, but = [r for r in rules if r[:1] not in "*!"], [r[2:] for r in rules if r[:2] == "*."], [r[1:] for r in rules if r[:1] == "!"]
    most = max([1, *[len(r.split(".")) for r in plain], *[len(r.split(".")) + 1 for r in wild]])
    last = lambda n: F.substring_index(host, ".", -n)
    labels = F.lit(1)
    for n in range(2, most + 1):
        hit = F.lit(False)
        if here := [r for r in plain if r.count(".") == n - 1]:
            hit = last(n).isin(*here)
        if here := [r for r in wild if r.count(".") == n - 2]:
            hit = hit | (last(n - 1).isin(*here) & (last(n) != last(n - 1)))
        if here := [r for r in but if r.count(".") == n - 1]:
            hit = hit & ~last(n).isin(*here)
        labels = F.when(hit, n).otherwise(labels)
    suffix, domain = last(1), last(2)
    for n in range(2, most + 1):
        suffix, domain = F.when(labels == n, last(n)).otherwise(suffix), F.when(labels == n, last(n + 1)).otherwise(domain)
    return {"host": host, "domain": domain, "suffix": suffix}


def _weight(units: DataFrame) -> float:
    """The prior weight for units (bad, n, mean of the prior): moments of a beta-binomial around given means."""
    spread = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2))
    plain = F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean")))
    extra = F.sum(F.col("n") * (F.col("n") - 1) * F.col("mean") * (1 - F.col("mean")))
    rho = (spread - plain) / F.when(extra > 0, extra)  # correlation of two pages of one unit
    weight = F.when(rho > 0, 1 / rho - 1).otherwise(MOST_WEIGHT)
    return units.agg(F.least(F.greatest(F.coalesce(weight, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)).alias("weight")).collect()[0][0]


def reputation(trials: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad, mean, sd) for trials (host, domain, suffix, bad 0/1 or null if unlabelled).

    Hosts are counted once and written to the shared folder; the levels above are made of that table, and of each level one number, its weight, comes to the driver."""
    spark = trials.sparkSession
    hosts = checkpoint(spark, trials.where("host is not null").groupBy("host", "domain", "suffix").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")))
    total = hosts.agg((F.sum("bad") / F.when(F.sum("n") > 0, F.sum("n"))).alias("mean")).collect()[0][0]

    def level(units: DataFrame, keys: list[str]) -> DataFrame:
        weight = F.lit(_weight(units))
        scored = units.withColumns({"mean": (F.col("bad") + weight * F.col("mean")) / (F.col("n") + weight), "weight": weight})
        return scored if not keys else checkpoint(spark, scored.select(*keys, "mean"))

    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = level(hosts.groupBy("suffix").agg(*add).withColumn("mean", F.lit(total).cast("double")), ["suffix"])
    domains = level(hosts.groupBy("domain", "suffix").agg(*add).join(suffixes, "suffix"), ["domain"])
    scored = level(hosts.join(domains, "domain"), [])
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    return scored.select("host", "domain", "suffix", "n", F.col("bad").cast("long").alias("bad"), "mean", sd.alias("sd"))


def filter_urls(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, z: float = Z, rules: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """(page_id, host, domain, suffix, labelled, bad, rate, lower, keep) for every row of pages.

    A page's document is the first number among its URL's path segments. Of several labels
    of one document it is bad if any says so; toxic = 1 or quality = 0 is bad, nulls say nothing.
    labelled and bad count the host's pages, rate and lower are its posterior mean and bound,
    mean - z * sd, rounded to 9 digits. A null URL, or one without a host, has nulls there and
    is kept, as is a page of a host without labels unless its domain speaks against it; without any label
    in the corpus rates are null and all is kept. Null
    page ids and repeated rows are kept, and count; other columns are ignored."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic").isNull() & F.col("quality").isNull(), None).otherwise((F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).cast("int"))).alias("bad"))
    number = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^/?#]*?)*?/([0-9]{1,18})(?:[./?#]|$)", 1)
    parts = pages.select("page_id", "url").withColumns(host_parts(F.col("url"), rules)).withColumn("doc_id", F.when(number != "", number.cast("long")))
    trials = parts.select("host", "domain", "suffix", "doc_id").where("doc_id is not null").join(marks, "doc_id").select("host", "domain", "suffix", "bad")
    unlabelled = parts.select("host", "domain", "suffix", F.lit(None).cast("int").alias("bad")).distinct()
    scores = reputation(trials.unionByName(unlabelled))
    lower = F.when(F.col("mean").isNotNull(), F.greatest(F.lit(0.0), F.col("mean") - z * F.col("sd")))
    return parts.join(scores.select("host", "n", "bad", "mean", "sd"), "host", "left").select(
        "page_id", "host", "domain", "suffix", F.col("n").alias("labelled"), "bad", F.round("mean", 9).alias("rate"), F.round(lower, 9).alias("lower"), F.coalesce(lower <= threshold, F.lit(True)).alias("keep")
    )
