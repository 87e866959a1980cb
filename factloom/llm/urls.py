"""op2: URL verdicts by a blocked Bloom filter of listed keys and an exact join of its possible hits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Rules of the production list: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Listed canonical URLs; one that ends in / after its host stands for the host and all its subdomains.
LISTED = tuple(f"{name}.example.{top}/" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Bits of the filter for each key, and its blocks at most (some 100 bytes each in a broadcast); with more keys than fit, bits a key grow fewer.
BITS_A_KEY, BROADCAST_BLOCKS = 16, 1 << 18
#: Listed keys that may be broadcast to the exact join.
BROADCAST_KEYS = 200_000
#: Odd multipliers of the eight words of a block, from the published split-block design of the Parquet format (fixed values).
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _block(key, blocks: int):
    return F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(blocks)).cast("int")


def _mask(key, word: int):
    low = F.xxhash64(key).bitwiseAND(0x7FFFFFFF)
    bit = F.shiftright((low * SALTS[word]).bitwiseAND(0xFFFFFFFF), 27)
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The non-empty blocks of a blocked Bloom filter over keys.key: block, w0..w7 (32 bits each)."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*[F.bit_or(_mask(F.col("key"), i)).alias(f"w{i}") for i in range(8)])


def possible_hits(rows: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter: one block is looked up for each."""
    kept = rows.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filter_blocks), "block")
    for i in range(8):
        kept = kept.where(F.col(f"w{i}").bitwiseAND(_mask(F.col("key"), i)) != 0)
    return kept.drop("block", *[f"w{i}" for i in range(8)])


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules: verdict, host, path; a rule fits its host and all subdomains if the url's path starts with the rule's; the
    longest wins (of equal length the first in order). listed: url, canonical (lower-case host and path without a last
    slash); `host/` lists a whole host with its subdomains. A url that no rule fits is blocked if it or its host is
    listed, else allowed. Both tables may be of any size; repeated and null entries change nothing.

    Each distinct url is expanded to the keys that a rule or listing could have (suffixes of the host, alone and with
    path prefixes as long as some rule's path; the canonical url). The filter, at most BROADCAST_BLOCKS blocks, drops
    nearly all keys; what passes is joined exactly, so a false positive changes nothing. Null urls and urls without ://
    have an empty host and path and are allowed. Repeated rows and null page_ids are judged like others; an empty table
    gives no rows; other columns are not read.
    """
    n = rules.count() + listed.count()
    lengths = [r.n for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    rule = F.concat("host", "path")
    keys = rules.select(F.concat(F.lit("r "), rule).alias("key"), rule.alias("rule"), "verdict").union(
        listed.select(F.when(F.col("url").rlike("^[^/]*/$"), F.concat(F.lit("h "), F.rtrim("url", F.lit("/")))).otherwise(F.concat(F.lit("u "), "url")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    )
    keys = keys.where("key is not null").distinct()
    blocks = min(BROADCAST_BLOCKS, max(1, math.ceil(n * BITS_A_KEY / 256)))
    host = F.translate(F.regexp_extract("url", _URL, 1), _UPPER, _LOWER)
    urls = pages.select("url").where("url is not null").distinct().select("url", host.alias("host"), F.regexp_extract("url", _URL, 2).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.substring("path", 1, k) for k in lengths]), lambda p: F.lit(False)) if not lengths else F.array_compact(
        F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths])
    )
    by_rule = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r "), s, p))))
    canonical = F.concat(F.lit("u "), F.col("host"), F.regexp_replace("path", "/$", ""))
    by_host = F.transform(suffixes, lambda s: F.concat(F.lit("h "), s))
    tried = urls.where("host <> ''").select("url", F.explode(F.array_distinct(F.concat(by_rule, by_host, F.array(canonical)))).alias("key"))
    hits = possible_hits(tried, bloom_blocks(keys, blocks), blocks).join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, "key")
    best = F.min(F.when(F.col("rule").isNotNull(), F.struct(-F.length("rule"), F.col("rule"), F.col("verdict")))).alias("best")
    judged = hits.groupBy("url").agg(best).select("url", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("block")).alias("verdict"))
    own = lambda part: F.coalesce(F.regexp_extract("url", _URL, part), F.lit(""))
    return pages.select("page_id", "url").join(judged, "url", "left").select(
        "page_id", F.translate(own(1), _UPPER, _LOWER).alias("host"), own(2).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    return judge_urls(read(spark, sf_dir, "pages"), rules, listed)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


OP2_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_values(RULES)}),
listed(url) AS (VALUES {_values((u,) for u in LISTED)}),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '{_URL}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '{_URL}', 2), '') AS path
  FROM pages),
u AS (SELECT DISTINCT host, path FROM p),
fit AS (
  SELECT u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS n
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)),
hit AS (
  SELECT DISTINCT u.host, u.path, true AS blocked
  FROM u JOIN listed ON CASE WHEN regexp_matches(url, '^[^/]*/$') THEN u.host || '/' = url OR ends_with(u.host || '/', '.' || url) ELSE u.host || regexp_replace(u.path, '/$', '') = url END
  WHERE u.host <> '')
SELECT p.page_id, p.host, p.path, fit.rule,
  CASE WHEN fit.rule IS NOT NULL THEN fit.verdict WHEN hit.blocked THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path AND fit.n = 1 LEFT JOIN hit ON hit.host = p.host AND hit.path = p.path
"""
