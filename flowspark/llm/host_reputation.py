"""URL filters: rules first, then an empirical-Bayes reputation of the host. DataFrame operations only.

Labelled page outcomes are the verdicts of the rules (or any 0/1 column). They are
counted per host, registered domain and suffix. Each level's rate is shrunk to the
level above with the weight of a beta prior; how strong the prior is comes from the
data: the spread of the groups around their parents, beyond what chance gives, fixes
the beta-binomial correlation of the level. A host is blocked if the lower bound of
its posterior rate is above `THRESHOLD`, so a host nobody has labelled follows its
domain, and is let through unless that is surely bad.

Pages are counted per host before the shuffle. The host table is broadcast if its
counted rows allow, otherwise joined by shuffle, where Spark splits a hot host.

Defined cases: a null url or one without `://` has the empty host and path, fits no
rule and shares the reputation of that empty host (its suffix's and domain's too);
repeated rows and ids are judged one by one; without any label all rates are the
prior of one half and nothing is blocked; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import LOWER, UPPER, save

Z = 1.645
THRESHOLD = 0.5
LEAST_CORRELATION, MOST_CORRELATION = 0.01, 0.99
BROADCAST_HOSTS = 200_000

#: Second-level labels under which countries register names.
COUNTRY_SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed by the contract of the query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def longest_rule(rules: tuple[Rule, ...], answer: str) -> Column:
    """`name` or `verdict` of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        found = F.when(_fits(rule), F.lit(getattr(rule, answer))).otherwise(found)
    return found


def _levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host name; an address is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    parts = F.split(name, "\\.")
    n = F.size(parts)
    second = F.get(parts, n - 2)
    long_suffix = (n >= 3) & (F.length(F.get(parts, n - 1)) == 2) & second.isin(*COUNTRY_SECOND_LEVELS)
    taken = F.when(long_suffix, 2).otherwise(1)
    address = name.rlike(r"^[0-9.]+$") | name.startswith("[")
    last = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(address, name).otherwise(last(taken + 1)), F.when(address, name).otherwise(last(taken))


def _shrunk(groups: DataFrame, key: str, parent: str | None, parents: DataFrame) -> DataFrame:
    """`groups` (key, n, bad, ...) with the strength of their prior and their shrunk `rate`.

    `parents` has one `up` (the rate above) per `parent`, or is one row for all groups.
    """
    joined = groups.crossJoin(F.broadcast(parents)) if parent is None else groups.join(parents, parent)
    by_chance = F.col("n") * F.col("up") * (1 - F.col("up"))
    off = F.col("bad") - F.col("n") * F.col("up")
    spread = joined.agg(F.sum(off * off - by_chance).alias("top"), F.sum((F.col("n") - 1) * by_chance).alias("bottom"))
    raw = F.when(F.col("bottom") > 0, F.col("top") / F.col("bottom")).otherwise(F.lit(0.5))
    correlation = F.greatest(F.lit(LEAST_CORRELATION), F.least(F.lit(MOST_CORRELATION), raw))
    spread = spread.select((1 / correlation - 1).alias("strength"))
    joined = joined.crossJoin(F.broadcast(spread))
    return joined.withColumn("rate", (F.col("bad") + F.col("strength") * F.col("up")) / (F.col("n") + F.col("strength")))


def reputation(labelled: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound) from rows (host, bad), where `bad` is 0, 1 or null."""
    domain, suffix = _levels(F.col("host"))
    hosts = labelled.groupBy("host").agg(F.count("bad").cast("double").alias("n"),
                                         F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = save(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    everything = hosts.agg(*sums).select(((F.coalesce("bad", F.lit(0.0)) + 0.5) / (F.coalesce("n", F.lit(0.0)) + 1)).alias("up"))
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*sums), "suffix", None, everything)
    domains = _shrunk(hosts.groupBy("domain", "suffix").agg(*sums), "domain", "suffix",
                      suffixes.select("suffix", F.col("rate").alias("up")))
    own = _shrunk(hosts, "host", "domain", domains.select("domain", F.col("rate").alias("up")))
    a = F.col("strength") * F.col("up") + F.col("bad")
    b = F.col("strength") * (1 - F.col("up")) + F.col("n") - F.col("bad")
    own = own.select("host", "n", "bad", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    deviation = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return own.select("host", "n", "bad", mean.alias("mean"), (mean - F.lit(Z) * deviation).alias("bound"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, page_id: str = "page_id",
          url: str = "url", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, host, path, rule, mean, bound, verdict): a row per row of `pages`."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": longest_rule(rules, "name"), "by_rule": longest_rule(rules, "verdict")})
    known = save(reputation(rows.select("host", (F.col("by_rule") == "block").cast("int").alias("bad"))), "reputation")
    names = known.select(F.col("host").alias("known_host"), "mean", "bound")
    if names.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        names = F.broadcast(names)
    rows = rows.join(names, F.col("host") == F.col("known_host"))
    by_host = F.when(F.col("bound") > F.lit(threshold), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", "mean", "bound", F.coalesce("by_rule", by_host).alias("verdict"))
