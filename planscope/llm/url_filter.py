"""URL filter: host/path rules, then a blocked Bloom filter of listed URLs with an exact join behind it.

The listed canonical URLs are hashed into a blocked Bloom filter: each URL selects one 64-bit block and
``bits`` bits in it. The filter is a table ``(block, word)`` of at most ``max_blocks`` rows (1 MB at the
default), built with ``bit_or`` and broadcast within that proven bound whatever the size of the list.
URLs whose bits are all set are possible hits; only they enter the exact hash join with the list, which
removes the false positives. Everything is DataFrame operations.

Defined cases: a null url, and one without ``://``, has empty host and path, fits no rule, is on no list
and gets the default verdict. Repeated urls and repeated list rows give one output row per input row.
An empty list or table works. Columns of the input other than those named here are kept in
``filter_urls`` unless they clash with its own outputs, which then replace them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planscope.llm.common import ascii_lower

Rule = tuple[str, str, str]  # verdict, host, path


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and path without a trailing slash; scheme, query and fragment are dropped."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), else null. The rules are configuration, a few
    hundred at most: they become one CASE expression, longest rule first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block_and_mask(key: Column, blocks: int, bits: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    g = F.xxhash64(F.lit("bits"), key)
    # 6 bits of g choose each bit of the 64-bit block
    mask = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(bits)],
    )
    return F.pmod(h, F.lit(blocks)), mask


def bloom_table(listed: DataFrame, key: str, blocks: int, bits: int) -> DataFrame:
    """(block, word) of the blocked Bloom filter over ``listed[key]``; at most ``blocks`` rows."""
    block, mask = _block_and_mask(F.col(key), blocks, bits)
    return listed.where(F.col(key).isNotNull()).groupBy(block.alias("__block")).agg(F.bit_or(mask).alias("__word"))


def may_contain(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, *, blocks: int = 1 << 16, bits: int = 4) -> DataFrame:
    """``rows`` whose key may be among the wanted keys: a semi-join by the Bloom filter alone, without a shuffle.
    With more keys than the filter holds it lets more through, but never drops a wanted row."""
    assert blocks <= 1 << 20, "the broadcast filter is bounded by 2**20 blocks"
    block, mask = _block_and_mask(F.col(key), blocks, bits)
    bloom = bloom_table(wanted, wanted_key, blocks, bits)
    rows = rows.where(F.col(key).isNotNull())
    probed = rows.withColumns({"__b": block, "__m": mask}).join(F.broadcast(bloom), F.col("__b") == F.col("__block"))
    return probed.where(F.col("__word").bitwiseAND(F.col("__m")) == F.col("__m")).select(*[F.col(f"`{c}`") for c in rows.columns])


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url",
    key_col: str = "canonical_url", blocks: int = 1 << 16, bits: int = 4,
) -> DataFrame:
    """``pages`` with host, path, canonical_url, rule, possible_hit, listed and verdict.

    ``listed`` has canonical URLs in ``key_col``. 2**16 blocks of 64 bits hold about half a million URLs at
    a few per cent of false positives; raise ``blocks`` for longer lists (2**20 blocks are 16 MB).
    """
    assert blocks <= 1 << 20, "the broadcast filter is bounded by 2**20 blocks"
    own = ["host", "path", "canonical_url", "rule", "possible_hit", "listed", "verdict"]
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in own]
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("canonical_url", F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(None)).otherwise(canonical(F.col("host"), F.col("path"))))
    block, mask = _block_and_mask(F.col("canonical_url"), blocks, bits)
    bloom = bloom_table(listed, key_col, blocks, bits)
    rows = rows.withColumns({"__b": F.when(F.col("canonical_url").isNotNull(), block), "__m": mask})
    rows = rows.join(F.broadcast(bloom), F.col("__b") == F.col("__block"), "left")
    hit = F.coalesce(F.col("__word").bitwiseAND(F.col("__m")) == F.col("__m"), F.lit(False))
    rows = rows.withColumn("possible_hit", hit).drop("__b", "__m", "__block", "__word")
    exact = listed.where(F.col(key_col).isNotNull()).select(F.col(key_col).alias("__key")).distinct().withColumn("__on", F.lit(True))
    # only possible hits have a join key, so the rest never meets the list
    rows = rows.withColumn("__probe", F.when(F.col("possible_hit"), F.col("canonical_url")))
    sure = rows.where(F.col("__probe").isNotNull()).join(exact, F.col("__probe") == F.col("__key"), "left")
    rows = sure.unionByName(rows.where(F.col("__probe").isNull()).withColumns({"__key": F.lit(None).cast("string"), "__on": F.lit(None).cast("boolean")}))
    rows = rows.withColumns({"listed": F.coalesce(F.col("__on"), F.lit(False)), "__rule": rule_of(F.col("host"), F.col("path"), rules)})
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.withColumns({"rule": F.col("__rule.rule"), "verdict": verdict}).drop("__probe", "__key", "__on", "__rule")


#: The rules of the query.
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Host names whose pages make up the query's list of unwanted URLs.
UNWANTED = ["adult-x", "spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets"]
_LISTED = r"(^|\.)(" + "|".join(UNWANTED) + r")\."


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs of all pages on unwanted hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    listed = pages.where(host.rlike(_LISTED)).select(canonical(host, path).alias("canonical_url"))
    return filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


ORACLE = rf"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
c AS (SELECT *, CASE WHEN host = '' AND path = '' THEN NULL
  ELSE regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical_url FROM p),
l AS (SELECT DISTINCT canonical_url FROM c WHERE regexp_matches(host, '{_LISTED}')),
rules(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM (SELECT DISTINCT host, path FROM c) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path)
SELECT page_id, c.host, c.path, f.rule, coalesce(f.action, CASE WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  c.canonical_url, l.canonical_url IS NOT NULL AS listed
FROM c LEFT JOIN f ON c.host = f.host AND c.path = f.path LEFT JOIN l ON c.canonical_url = l.canonical_url
"""
