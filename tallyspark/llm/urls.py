"""URL filters in DataFrame operations only: rules on hosts and paths, and a list of canonical URLs.

The list is folded into a blocked Bloom filter: a table of blocks, each with four 64-bit words of which a URL sets one
bit each, so a URL touches one row. The number of blocks follows the counted list, one for every URLS_PER_BLOCK URLs, up
to MOST_BLOCKS; so its size has a bound (10 MB) and it is broadcast. A list too long for that only lets more false
positives through. URLs that may be listed go to an exact join with the list, which removes the false positives; all
others never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: (verdict, host, path); the longest that fits wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: No list comes with the data. The stand-in for a published one has the canonical URLs of all pages on these sites, and
#: of single pages of any other site: those whose digest begins like this, a sixteenth.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DIGEST = "7"
#: Blocks of the filter at most: 40 bytes a row.
MOST_BLOCKS = 1 << 18
URLS_PER_BLOCK = 8
WORDS = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, path without a last slash, query without tracking parameters; null without `://`."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*[?]([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.when(_rest(url).isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as `host` + `path`, verdict) of the longest rule that fits; both null if none does."""
    name = verdict = None
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)) if name is None else name.when(fits, F.lit(rule_host + rule_path))
        verdict = F.when(fits, F.lit(decision)) if verdict is None else verdict.when(fits, F.lit(decision))
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def number_of_blocks(listed: int) -> int:
    return min(MOST_BLOCKS, 1 << max(0, -(-listed // URLS_PER_BLOCK) - 1).bit_length())


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """One bit in each word of the key's block."""
    bits = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word_0 .. word_3) of a table (canonical): at most `blocks` rows."""
    keyed = listed.select(_block(F.col("canonical"), blocks).alias("block"), *(m.alias(f"mask_{i}") for i, m in enumerate(_masks(F.col("canonical")))))
    return keyed.groupBy("block").agg(*(F.bit_or(f"mask_{i}").alias(f"word_{i}") for i in range(WORDS)))


def probed(parsed: DataFrame, urls: DataFrame) -> DataFrame:
    """The rows of `parsed` with `possible`: may its canonical_url be one of the listed `urls`?"""
    blocks = number_of_blocks(urls.count())
    words = F.broadcast(checkpointed(bloom_filter(urls, blocks)))  # at most MOST_BLOCKS rows
    key = F.col("canonical_url")
    hit = F.lit(True)
    for i, m in enumerate(_masks(key)):
        hit = hit & (F.col(f"word_{i}").bitwiseAND(m) == m)
    met = parsed.withColumn("probe", _block(key, blocks)).join(words, F.col("probe") == F.col("block"), "left")
    return met.select(*parsed.columns, F.coalesce(hit, F.lit(False)).alias("possible"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for each row of `pages` (page_id, url).

    The verdict is the rule's, else block for a listed URL and allow for any other. A null url, or one without `://`,
    has empty host and path, fits no rule and is never listed. `listed` (canonical) may repeat and hold nulls; an
    empty list blocks nothing and an empty table of pages gives an empty result. Repeated pages each get a row; URLs may
    be of any length; other columns are ignored, whatever their names.
    """
    urls = checkpointed(listed.where("canonical is not null").select("canonical").distinct())
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical_url"))
    flagged = probed(parsed, urls)
    exact = flagged.where("possible").join(urls.withColumn("listed", F.lit(True)), F.col("canonical_url") == F.col("canonical"), "left")
    columns = ["page_id", "host", "path", F.coalesce(F.col("listed"), F.lit(False)).alias("listed")]
    both = exact.select(*columns).unionByName(flagged.where("not possible").select("page_id", "host", "path", F.lit(False).alias("listed")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def listed_urls(pages: DataFrame) -> DataFrame:
    """(canonical) of the pages on LISTED_SITES, and of those whose digest begins with LISTED_DIGEST."""
    sites = "|".join(LISTED_SITES)
    name = canonical(F.col("url"))
    return pages.where(host_of(F.col("url")).rlike(rf"(^|[.])({sites})[.]") | F.md5(name).startswith(LISTED_DIGEST)).select(name.alias("canonical"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """judge() of all `pages` against listed_urls(); its edge cases hold."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed_urls(pages))


OP5_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parsed AS (
  SELECT page_id, rest,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
queried AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS query FROM parsed),
keyed AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM queried),
listing AS (SELECT DISTINCT canonical FROM keyed WHERE canonical IS NOT NULL AND (regexp_matches(host, '(^|[.])({"|".join(LISTED_SITES)})[.]') OR starts_with(md5(canonical), '{LISTED_DIGEST}'))),
rules(decision, rhost, rpath) AS (VALUES {", ".join(f"('{d}', '{h}', '{p}')" for d, h, p in RULES)}),
fitting AS (
  SELECT k.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(decision, length(rhost || rpath)) AS decision
  FROM keyed k JOIN rules r ON (k.host = rhost OR ends_with(k.host, '.' || rhost)) AND starts_with(k.path, rpath) GROUP BY k.page_id)
SELECT k.page_id, k.host, k.path, f.rule, l.canonical IS NOT NULL AS listed,
       coalesce(f.decision, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN fitting f ON k.page_id = f.page_id LEFT JOIN listing l ON k.canonical = l.canonical
"""
