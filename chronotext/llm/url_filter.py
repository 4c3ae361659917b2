"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join, in SQL functions alone.

A rule is a host and the beginning of a path.  A url's candidates are its host and all parent domains, each with those
beginnings of its path that have the length of a rule's path.  Each candidate is looked up in a Bloom filter whose bits for
one key lie in one 64-bit block, kept as a table of blocks; the few candidates that pass meet the rules themselves in an
exact hash join, which removes the false positives, and the longest rule wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.shared import free

#: The rules of the registered query: (verdict, host, path).  Fixed values.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Bits that a key sets in its block; keys a block is meant for; most blocks of a filter (12 bytes each, so the filter is at most 13 MB).
BITS, KEYS, MOST_BLOCKS = 5, 4, 1 << 20
#: Rules that are broadcast at most; longer lists are joined by a shuffle of what passed the filter.
RULES_TO_BROADCAST = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """BITS bits of a 64-bit word, each chosen by six bits of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), (one(i) for i in range(BITS)))


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, word) of the filter over ``rules`` (host, path); only blocks that hold a key."""
    key = _key(F.col("host"), F.col("path"))
    return rules.select(_block(key, blocks).alias("block"), _mask(key).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def candidates(pages: DataFrame, lengths: list[int]) -> DataFrame:
    """(host, path, r_host, r_path): the rules that could fit a url."""
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in lengths)), lambda p: p.isNotNull())
    rows = pages.filter("host <> ''").select("host", "path", F.explode(hosts).alias("r_host"), starts.alias("starts"))
    return rows.select("host", "path", "r_host", F.explode("starts").alias("r_path"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (like ``net/``, else null) and verdict: the longest fitting rule's, else ``default``.

    ``rules`` has verdict, host and path; a list of urls to block is a table of rules.  Of equally long rules the one with
    the longer host wins, then the smaller text.  Null urls and urls without :// have empty hosts, which no rule fits; they
    are dealt out by partition in the join back, so any number of them needs no large task.  Each distinct (host, path) is
    judged once and joined back, so repeated rows cost nothing extra.  Columns named host, path, rule and verdict are
    replaced, all others kept, whatever their names; an empty table gives an empty one.
    """
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").filter("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    about = rules.agg(F.count("*"), F.collect_set(F.length("path"))).first()
    blocks = min(MOST_BLOCKS, max(8, about[0] // KEYS))
    out = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not about[0]:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    key = _key(F.col("r_host"), F.col("r_path"))
    tried = candidates(out.select("host", "path").filter("host <> ''").distinct(), sorted(about[1])).withColumn("block", _block(key, blocks)).withColumn("mask", _mask(key))
    # The filter's size is bounded by MOST_BLOCKS.
    passed = tried.join(F.broadcast(bloom(rules, blocks)), "block").filter(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
    listed = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict")).groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))
    listed = F.broadcast(listed) if about[0] <= RULES_TO_BROADCAST else listed.hint("shuffle_hash")
    exact = passed.join(listed, ["r_host", "r_path"])
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_host")
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(key.alias("rule"), "verdict"), rank).alias("best"))
    h, p, salt, found = free(out.columns, "_host", "_path", "_salt", "_best")
    best = best.select(F.col("host").alias(h), F.col("path").alias(p), F.lit(-1).alias(salt), F.col("best").alias(found))
    own = free([*out.columns, h, p, salt, found], "_own")[0]
    rows = out.withColumn(own, F.when(F.col("host") == "", F.spark_partition_id()).otherwise(-1))
    got = rows.join(best.hint("shuffle_merge"), (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)) & (F.col(own) == F.col(salt)), "left")
    return got.select(*out.columns, F.col(f"{found}.rule").alias("rule"), F.coalesce(F.col(f"{found}.verdict"), F.lit(default)).alias("verdict"))


def listed(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules (verdict, host, path) as a table of literals."""
    values = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in rule) + ")" for rule in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, host, path)")


def oracle() -> str:
    """The same verdicts in DuckDB's SQL over ``pages``."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return rf"""WITH r(v, h, p) AS (VALUES {values}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
      FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f ON u.host = f.host AND u.path = f.path"""
