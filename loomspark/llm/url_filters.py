"""URL filters: fixed rules first, then empirical-Bayes host reputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import drop_stored, free_name, most_frequent, store


@dataclass(frozen=True)
class UrlRule:
    """Fits a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
#: Suffixes of two labels under which domains are registered, the usual ones; any other suffix has one label.
#: A longer list is handed in as `suffixes`.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn")
#: A prior's strength, in pages, is held between these.
STRENGTH = (1.0, 1000.0)
LEVELS = ("suffix", "domain", "host")
#: Hosts with the most pages that every task knows, and their greatest length; pages of other hosts are joined by a shuffle.
MOST_KNOWN, LONGEST_KNOWN = 20_000, 255


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), pattern, k)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matched(host: Column, path: Column, rules: tuple[UrlRule, ...], field: str) -> Column:
    """field of the longest rule that fits, else null; of rules of one length the one with the longer host."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        out = F.when(r.fits(host, path), F.lit(getattr(r, field))).otherwise(out)
    return out


def strength(groups: DataFrame) -> float:
    """Pages a prior counts for, by the method of moments over groups (n, good) of a level."""
    s = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("good").alias("y"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("yy")).first()
    if not s.n or s.k < 2 or not 0 < s.y < s.n:
        return STRENGTH[1]
    p = s.y / s.n
    var, free = p * (1 - p), s.n - s.n2 / s.n - (s.k - 1)
    rho = ((s.yy - s.n * p * p) - var * (s.k - 1)) / (var * free) if free > 0 else 0.0
    return min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1]) if rho > 0 else STRENGTH[1]


def posteriors(hosts: DataFrame) -> DataFrame:
    """hosts (host, domain, suffix, n, good, …) with a and b of each host's beta posterior; n and good may be 0.

    Each level's counts shrink towards the mean of the level above with that level's own prior strength: all pages, suffix,
    registered domain, host.  Only levels with labelled pages say how strong a prior is.
    """
    add = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    labelled = hosts.filter("n > 0")
    domains = add(labelled, "suffix", "domain")
    suffixes = add(domains, "suffix")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    k = dict(zip(LEVELS, map(strength, (suffixes, domains, labelled)), strict=True))
    shrunk = lambda level, above: (F.col("good") + F.lit(k[level]) * above) / (F.col("n") + k[level])
    s = suffixes.select("suffix", shrunk("suffix", F.lit((total.good + 1) / (total.n + 2))).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("domain", shrunk("domain", F.col("suffix_mean")).alias("domain_mean"))
    prior = F.coalesce("domain_mean", F.coalesce(F.col("suffix_mean"), F.lit((total.good + 1) / (total.n + 2))))
    a, b = F.col("good") + prior * k["host"], F.col("n") - F.col("good") + (1 - prior) * k["host"]
    return hosts.join(d, "domain", "left").join(s, "suffix", "left").withColumn("a", a).withColumn("b", b)


def url_filters(
    pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[UrlRule, ...] = RULES, z: float = 1.645, least: float = 0.5, url: str = "url",
    suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES, most_known: int = MOST_KNOWN,
) -> DataFrame:
    """pages with host, path, rule (text of the longest rule that fits, else null) and verdict, besides the posterior's mean and upper bound.

    labelled has (host, good 0/1) rows; without it the pages that a rule decides are the labelled outcomes.  A page that no
    rule fits is blocked where even the upper bound of its host's posterior (mean + z standard deviations) is below least.
    Null urls and those without :// have an empty host and path and are judged by the reputation of the empty host; a very
    long url is read to its end, and an empty table gives an empty table.  Repeated rows stay and count as often as they
    occur; columns of pages named like the new ones are replaced, others of any name don't matter.
    """
    spark = pages.sparkSession
    host, path = host_and_path(pages[url])
    new = ("host", "path", "rule", "verdict", "mean", "upper")
    kept = pages.drop(*[c for c in new if c != url])
    ruled = free_name(pages, "ruled")
    judged = kept.withColumn("host", host).withColumn("path", path)
    judged = judged.withColumn("rule", matched(F.col("host"), F.col("path"), rules, "text")).withColumn(ruled, matched(F.col("host"), F.col("path"), rules, "verdict"))
    # A host with most of the pages is added up before it is moved; all that follows reads these sums.
    own = labelled is None
    n = F.sum(F.col(ruled).isNotNull().cast("long")) if own else F.lit(0).cast("long")
    good = F.sum((F.coalesce(F.col(ruled), F.lit("")) == "allow").cast("long")) if own else F.lit(0).cast("long")
    sums = judged.groupBy("host").agg(F.count("*").alias("pages"), n.alias("n"), good.alias("good"))
    if labelled is not None:
        also = labelled.groupBy("host").agg(F.lit(0).cast("long").alias("pages"), F.count("*").alias("n"), F.sum("good").cast("long").alias("good"))
        sums = sums.unionByName(also).groupBy("host").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = store(sums.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)), "hosts")
    mean = F.col("a") / (F.col("a") + F.col("b"))
    spread = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    bounds = store(posteriors(hosts).filter("pages > 0").select("host", "pages", mean.alias("mean"), (mean + z * spread).alias("upper")), "bounds")
    drop_stored(spark, hosts)
    # Pages of large hosts stay where they are; these hosts are bounded in number and length.
    known = F.broadcast(most_frequent(bounds.filter(F.length("host") <= LONGEST_KNOWN), "pages", most_known).drop("pages"))
    large = judged.join(known, "host")
    small = judged.join(known.select("host"), "host", "left_anti").join(bounds.drop("pages"), "host", "left")
    verdict = F.coalesce(ruled, F.when(F.col("upper") < least, "block").otherwise("allow"))
    return large.unionByName(small).withColumn("verdict", verdict).select(*kept.columns, *new)
