"""URL filters: host-suffix x path-prefix expressions against a rule table.

Every URL is expanded into the expressions a rule could have: each suffix of the host that begins at
a label, combined with each prefix of the path whose length some rule path has.  Expressions meet the
rules in an equi-join on a short prefix of their SHA-256 digest; full digests and the strings
themselves are then compared, and the longest matching rule of a URL wins.

Only DataFrame functions.  The work is done on distinct (host, path) pairs, so a host that holds a
third of all rows is reduced on the map side before it is shuffled.  The rule side is broadcast only when
a count shows it has at most ``MAX_BROADCAST_RULES`` rows; beyond, the same join is shuffled and hot
expressions are left to the skew-join rule, which splits their partitions.

Null URLs and URLs without ``://`` have an empty host and path.  They and URLs no rule fits get a null
rule and the verdict ``default``.  Repeated rows stay; an empty table gives an empty result; of a
rule given twice with different verdicts, ``block`` holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, fits

#: The rules of the registered query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MAX_BROADCAST_RULES = 100_000
#: Hex digits of the digest prefix that the join uses (32 bits).
PREFIX_DIGITS = 8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased.  Path: on to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    rows = [(h, p, v) for h, p, v in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (columns page_id, url).

    ``rules`` has host, path, verdict; the host is compared in lower case, the path as it is.
    """
    rules = rules.where("host is not null and path is not null").groupBy(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    rules = rules.withColumn("rule", F.concat("r_host", "r_path")).withColumn("r_digest", F.sha2("rule", 256))
    rules = rules.withColumn("short", F.substring("r_digest", 1, PREFIX_DIGITS))
    # At most one number for each length a path may have: a bounded list whatever the rule count.
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    # A host has no slash and a path begins with one, so both together name the pair.
    urls = urls.withColumn("url_key", F.concat("host", "path"))
    distinct = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(sizes, lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    terms = distinct.select("host", "path", "n", F.explode(pairs).alias("e")).select("host", "path", "n", F.col("e.h").alias("e_host"), F.col("e.p").alias("e_path"))
    terms = terms.withColumn("digest", F.sha2(F.concat("e_host", "e_path"), 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    side = F.broadcast(rules) if fits(rules, MAX_BROADCAST_RULES) else rules
    hits = terms.join(side, "short").where((F.col("digest") == F.col("r_digest")) & (F.col("e_host") == F.col("r_host")) & (F.col("e_path") == F.col("r_path")))
    # A longer host or path makes a longer rule; equal lengths can't both fit unless host and path
    # trade characters, where the longer host holds.
    order = F.struct(F.length("rule"), F.length("r_host"))
    hit = F.max_by(F.struct("rule", F.col("r_verdict").alias("verdict")), order).alias("hit")
    best = cut(hits.groupBy(F.concat("host", "path").alias("url_key")).agg(F.max("n").alias("n"), hit), "rules")
    # One popular url, or all that have no host, may hold a third of the rows: such keys do not go through the shuffle.
    out = attach(urls, "url_key", best, "hit")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
