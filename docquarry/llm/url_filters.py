"""URL filters: host rules first, then the reputation of a host, shrunk by empirical Bayes from host to registered domain to suffix.

Pages may carry an outcome (bad or not; null where nobody judged them). Outcomes are counted by host; each level's share of bad pages is a beta-binomial posterior whose prior has the parent's mean and a strength that the level's own spread tells (method of moments over all hosts, domains or suffixes). A host is blocked where the lower bound of its posterior (mean less ``z`` standard deviations of the beta distribution) lies above ``limit``: few outcomes leave a host at its domain's share with a wide bound, so it stays allowed.

Everything is DataFrame functions. Pages are counted by host with partial aggregation before the shuffle, all levels work on the counted hosts (written once by ``cut``), and the verdicts go back by one join on the host, whose side of pages adaptive execution can split where a host is hot. Three single-row aggregates (the strengths) come to the driver. Rules meet hosts, not pages: each counted host gets the rules of itself and of the hosts above it, whatever their number.

A url that is null or has no ``://`` has an empty host and path, fits no rule and is judged as the host '' by its own outcomes. Ports and user names stay part of a host, and only the levels above it disregard them. Repeated pages count as often as they are there; extra columns are ignored; an empty table gives an empty result. Of two equal rules with different verdicts, block wins. Without any outcome every share is one half and no bound lies above a limit of one half or more; smaller limits still hold then.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Suffixes of two labels under which domains are registered; others have one label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in")
#: Least and greatest correlation of outcomes inside a group; the strength of a prior is 1 / rho - 1.
RHO = (0.001, 0.5)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' where there is none."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def bare(host: Column) -> Column:
    """A host without user name, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?\.?$", "")


def suffix_of(host: Column) -> Column:
    """The part under which domains are registered: two labels for those of ``SUFFIXES``, else the last one; '' for addresses of digits."""
    h = bare(host)
    return F.when(h.rlike(r"^[0-9.]*$|:"), F.lit("")).when(F.substring_index(h, ".", -2).isin(*SUFFIXES), F.substring_index(h, ".", -2)).otherwise(F.substring_index(h, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label and the suffix; the host itself where it has no more."""
    h, s = bare(host), suffix_of(host)
    return F.when(s == "", h).when(s.contains("."), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def above(host: Column) -> Column:
    """The host and every host above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def count_outcomes(pages: DataFrame, url: str = "url", bad: str = "bad") -> DataFrame:
    """(host, n_pages, n, k): pages, judged pages and bad ones of each host."""
    judged = F.col(bad).cast("boolean")
    return pages.select(host_of(F.col(url)).alias("host"), judged.alias("bad")).groupBy("host").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n"), F.count_if("bad").alias("k"))


def strength(groups: DataFrame, mean: Column) -> float:
    """Strength of the prior of a level by the method of moments: groups (n, k), and the mean of the parent of each.

    Under a beta-binomial, the squared deviation of a group's share from its parent's mean m is m(1-m)(1 + (n-1) rho) / n; summed over all groups, weighted by n, that gives rho.
    """
    v = mean * (1 - mean)
    row = groups.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, F.lit(2)) - v).alias("a"), F.sum((F.col("n") - 1) * v).alias("b")).first()
    rho = row.a / row.b if row.b else RHO[1]
    rho = min(max(rho, RHO[0]), RHO[1])
    return round(1 / rho - 1, 6)


def reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """Counted hosts with domain, suffix, their posterior mean and its lower bound."""
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    level = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = F.lit(((total.k or 0) + 1) / ((total.n or 0) + 2))

    def shrink(groups: DataFrame, parent: Column, name: str) -> DataFrame:
        s = F.lit(strength(groups, parent))
        return groups.withColumns({name: (F.col("k") + s * parent) / (F.col("n") + s), f"{name}_strength": s})

    suffixes = shrink(level("suffix"), root, "suffix_mean").select("suffix", "suffix_mean")
    domains = shrink(level("domain", "suffix").join(suffixes, "suffix"), F.col("suffix_mean"), "domain_mean").select("domain", "suffix", "domain_mean")
    found = shrink(hosts.join(domains, ["domain", "suffix"]), F.col("domain_mean"), "mean")
    m, weight = F.col("mean"), F.col("n") + F.col("mean_strength")
    return found.select("host", "domain", "suffix", "n_pages", "n", "k", "mean", (m - z * F.sqrt(m * (1 - m) / (weight + 1))).alias("bound"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules of it and of all hosts above it. ``rules`` has rule (host and path, like ``org/``) and verdict."""
    at = F.locate("/", F.col("rule"))
    parts = rules.select(
        F.when(at > 0, F.substr("rule", F.lit(1), at - 1)).otherwise(F.col("rule")).alias("of"), F.when(at > 0, F.substr("rule", at)).otherwise(F.lit("")).alias("path"), "rule", "verdict",
    )
    one = F.struct(F.length("rule").alias("size"), F.col("path"), F.col("rule"), F.col("verdict"))
    return hosts.where("host <> ''").select("host", F.explode(above(F.col("host"))).alias("of")).join(parts, "of").groupBy("host").agg(F.collect_list(one).alias("rules"))


def judge(pages: DataFrame, rules: DataFrame, limit: float = 0.25, z: float = 1.645, key: str = "page_id", url: str = "url", bad: str = "bad") -> DataFrame:
    """Each page's host, path, rule (the longest that fits, else null) and verdict (the rule's; else block where the host's lower bound is above ``limit``), with the host's posterior."""
    hosts = cut(count_outcomes(pages, url, bad))
    known = reputation(hosts, z).join(rules_by_host(hosts, rules), "host", "left").select("host", "n", "k", "mean", "bound", "rules")
    split = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r.path))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r.verdict.alias("verdict"), r.rule.alias("rule"))))
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return (
        split.join(known, "host", "left").withColumn("best", best)
        .select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"), "n", "k", "mean", "bound")
    )
