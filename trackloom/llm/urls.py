"""Operator 7: URL filters, in DataFrame functions only.

A blocked Bloom filter of the listed canonical URLs (one 256-bit block per URL, eight
bits set in it) passes possible hits to an exact hash join that removes false
positives.  The filter is a table of blocks: it is broadcast while its number of
blocks, known before, stays below a bound, and is joined by block number beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import LOWER, UPPER, materialize, read_table

#: The rules of op7's contract (fixed values): verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Hosts whose pages op7 lists, a stand-in for a spam list (parameter).
LISTED_HOSTS = "pills|casino|poker|loans"
#: A block takes about 56 bytes as a row, so that at most 3.7 MB are broadcast.
MOST_BROADCAST_BLOCKS = 65_536


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first ``://`` up to / ? # or the end, and the
    path from there up to ? # or the end; both empty for null and where there is no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, parts, 1), UPPER, LOWER), F.regexp_extract(whole, parts, 2)


def canonical(url: Column) -> Column:
    """Host without www., m. or blog., then the path without a closing slash, .html or
    index page; scheme, query and fragment do not count.  Null without a host."""
    host, path = host_and_path(url)
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(host, path))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host, its subdomains and the start of a path: name, verdict."""
    name = verdict = None
    for said, rh, rp in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rh) | host.endswith("." + rh)) & path.startswith(rp)
        name = F.when(fits, rh + rp) if name is None else name.when(fits, rh + rp)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return name, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: Column, i: int) -> Column:
    """The bit of the block's i-th 32-bit word that ``url`` sets."""
    place = F.shiftrightunsigned(F.xxhash64(url, F.lit(1)), 5 * i).bitwiseAND(F.lit(31)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom_blocks(urls: DataFrame, blocks: int) -> DataFrame:
    """The filter of ``urls`` (url): rows (block, w0 .. w7), one for each block in use."""
    return urls.groupBy(_block(F.col("url"), blocks).alias("block")).agg(*(F.bit_or(_bit(F.col("url"), i)).alias(f"w{i}") for i in range(8)))


def filter_urls(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, bits_per_url: int = 16) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, canonical_url), one for each row of ``pages``.

    ``listed`` (url): canonical URLs to block; nulls in it are left out.  A fitting rule
    decides; else block if the page's canonical URL is listed, else allow.  Null URLs and
    those without ``://`` have empty host and path, fit no rule and are allowed.  Rows
    with equal ids or URLs are judged one by one; empty tables give no rows.  URLs may be of
    any length; further columns are not read.
    """
    listed = materialize(listed.select("url").where("url is not null").distinct())
    blocks = max(1, -(-listed.count() * bits_per_url // 256))
    table = bloom_blocks(listed, blocks)
    if blocks <= MOST_BROADCAST_BLOCKS:
        table = F.broadcast(table)

    url = F.col(url_col)
    host, path = host_and_path(url)
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical(url).alias("canonical_url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "said": said, "at": _block(F.col("canonical_url"), blocks)})
    hit = F.lit(True)
    for i in range(8):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(F.col("canonical_url"), i)) != 0)
    judged = judged.join(table, F.col("at") == F.col("block"), "left")
    judged = judged.withColumn("maybe", F.col("canonical_url").isNotNull() & F.col("said").isNull() & F.coalesce(hit, F.lit(False)))

    # Possible hits meet the list by URL.  All other rows pass the same join by keys of their
    # own, so that pages are read once and no key gathers them.
    exact = listed.select(F.col("url").alias("key"), F.lit(True).alias("maybe"), F.lit("block").alias("listed"))
    own = F.xxhash64("page_id", "host", "path").cast("string")
    met = judged.withColumn("key", F.when(F.col("maybe"), F.col("canonical_url")).otherwise(own)).join(exact, ["key", "maybe"], "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("said", "listed", F.lit("allow")).alias("verdict"), "canonical_url")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page; the list holds the canonical URLs of pages on spam hosts."""
    pages = read_table(spark, sf_dir, "pages")
    listed = pages.select(canonical(F.col("url")).alias("url")).where(F.col("url").rlike(rf"^[^/]*({LISTED_HOSTS})"))
    return filter_urls(pages, listed)


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
                   || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') END AS canonical_url
  FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM canon)
SELECT page_id, host, path, rule, canonical_url,
       CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN canonical_url IS NOT NULL AND regexp_matches(canonical_url, '^[^/]*(pills|casino|poker|loans)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""
