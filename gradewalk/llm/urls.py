"""URL filters: a blocked Bloom filter over the listed urls, then an exact hash join.

Every url is probed with each (host suffix, path prefix) that a rule could be.  The filter is a table
of blocks, each of four 64-bit words with one bit a key in each word; a probe whose bits are all set
is a possible hit, and only possible hits reach the exact join with the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm.common import literal_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both are empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, ``host/path``) pairs."""
    return literal_table(spark, rules, ["verdict", "rule"])


def _words(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * w).bitwiseAND(63).cast("int")) for w in range(WORDS)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table: block and its words."""
    marked = keys.select(F.pmod(F.xxhash64("rule"), F.lit(n_blocks)).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(_words(F.col("rule")))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", bits_per_rule: int = 16, broadcast_rules: int = 200_000) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    ``rules`` has ``rule`` (host and path written together, as ``example.com/en/``) and ``verdict``.
    A rule fits its host and all subdomains where the url's path starts with the rule's.  The longest
    rule wins; of two rules with the same text, block wins over allow (the greater verdict).  Null and
    malformed urls fit no rule and get ``default``.  Repeated rows stay repeated.  Rules that are null are dropped.
    Columns of ``pages`` named like the four added ones are replaced.

    Distinct urls are judged once, so a host with a third of the rows costs no more than its distinct
    urls.  Filter and rules are broadcast only where the counted rules are ``broadcast_rules`` at most;
    beyond, the same equi-joins shuffle.
    """
    listed = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    slash = F.instr("rule", "/")
    sizes = listed.select(F.when(slash > 0, F.length("rule") - slash + 1).otherwise(0).alias("size"))
    found = sizes.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    n_blocks = max(1, -(-found["n"] * bits_per_rule // (64 * WORDS)))
    small = F.broadcast if found["n"] <= broadcast_rules else (lambda df: df)
    host, path = host_and_path(F.col(url))
    judged = pages.withColumns({"host": host, "path": path})
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in found["sizes"])), lambda p: p.isNotNull())
    probes = (
        judged.select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        .select("host", "path", F.concat("suffix", "prefix").alias("rule"))
    ) if found["sizes"] else judged.select("host", "path", F.lit("").alias("rule")).limit(0)
    probes = probes.withColumns({"block": F.pmod(F.xxhash64("rule"), F.lit(n_blocks))} | {f"m{i}": w for i, w in enumerate(_words(F.col("rule")))})
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    possible = probes.join(small(bloom_blocks(listed, n_blocks)), "block").where(hit).select("host", "path", "rule")
    best = (
        possible.join(small(listed), "rule")
        .groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    kept = judged.drop("rule", "verdict")
    return kept.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
