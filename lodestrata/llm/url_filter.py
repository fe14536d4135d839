"""Block and allow lists for URLs by hashed host-suffix and path-prefix expressions; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Most bytes of rules that are sent to all executors; a longer list is joined by shuffle.
BROADCAST_RULES = 200_000


def url_host(url: F.Column) -> F.Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: F.Column) -> F.Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def hashed(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) with each expression's SHA-256 and the digest's first 8 hex digits."""
    out = rules.select("host", "path", "verdict", F.concat("host", "path").alias("rule"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"))
    return out.withColumn("short", F.substring("digest", 1, 8))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages.

    A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
    rule's; the longest rule wins (then the longer host, then block before allow), and without one the default holds.

    Each distinct (host, path) is expanded into its host suffixes, by whole labels, and its path's prefixes, of every
    length that some rule has (one row of facts about the rules). Expressions meet rules on the first 8 hex digits of
    their SHA-256; the whole digest confirms. Every expression meets at most a few rules, so no row multiplies; the many
    pages of a frequent host are one (host, path) here, or share its suffix, and are matched back by an equi-join that adaptive execution splits.

    A null URL or one without :// has an empty host and path, which fit no rule with a host. Null ids and repeated rows are kept
    as rows; null rules fit nothing; an empty table gives no rows; other columns are not looked at.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rules = hashed(rules.dropna(subset=["host", "path", "verdict"]).where("host != ''").dropDuplicates(["host", "path", "verdict"]))
    facts = rules.agg(F.collect_set(F.length("path")).alias("lengths"), F.count(F.lit(1)).alias("n"), F.sum(F.length("rule") + 100).alias("bytes")).first()
    lengths = F.array(*[F.lit(n) for n in sorted(facts.lengths)]) if facts.lengths else F.array().cast("array<int>")
    labels = F.split("host", r"\.", -1)
    n_labels = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n_labels), lambda k: F.array_join(F.slice(labels, k, n_labels), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    ways = rows.where("host != ''").select("host", "path").distinct()
    ways = ways.select("host", "path", F.explode(suffixes).alias("_h"), prefixes.alias("_ps")).select("host", "path", "_h", F.explode("_ps").alias("_p"))
    ways = ways.select("host", "path", F.sha2(F.concat_ws("\n", "_h", "_p"), 256).alias("_d")).withColumn("short", F.substring("_d", 1, 8))
    side = rules.select("short", "digest", "rule", "verdict", F.length("rule").alias("_n"), F.length("host").alias("_hn"))
    if (facts.bytes or 0) <= BROADCAST_RULES:
        side = F.broadcast(side)
    fits = ways.join(side, "short").where("_d = digest")
    best = fits.groupBy("host", "path").agg(F.max(F.struct("_n", "_hn", F.col("verdict").alias("v"), F.col("rule").alias("r"))).alias("b"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("b.r").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))
