"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

DataFrame operations only. The filter is a table of 256-bit blocks, each held in four longs. A URL reads one
block, so a probe is one equi-join on the block number; possible hits go to an exact hash join with the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PER_BLOCK, bloom_blocks, bloom_hit, materialise, table

#: (verdict, host, path): a policy of bounded size, which the caller writes down.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The largest filter that is broadcast (blocks of 40 bytes), and the largest list (of URLs) whose exact join is a broadcast one.
BROADCAST_BLOCKS, BROADCAST_URLS = 100_000, 20_000


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL; all are empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical(host: Column, path: Column, query: Column) -> Column:
    """host, path without final slashes, and the query without tracking parameters (utm_*, ref); no scheme, no fragment."""
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")), "&")
    return F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Each row of pages with host, path, rule (host + path of the longest rule that fits, or null) and verdict.

    listed: one string column of canonical URLs to block; nulls, empty strings and repeats don't count. A rule fits its
    host and all subdomains if the path starts with the rule's path; of two rules of equal length the later in text
    order wins. Without a rule, a listed URL is blocked and any other allowed. A null URL or one without `://` has empty
    host and path; such a URL, and any other without a host, is in no list and is allowed. Repeated rows are judged
    alike; other columns of pages are dropped.
    """
    name = listed.columns[0]
    keys = materialise(listed.select(F.col(name).alias("_listed")).filter(F.col("_listed") != "").distinct(), "listed-urls")
    size = keys.count()
    blocks = max(1, -(-size // PER_BLOCK))
    rows = pages.select(*keep, F.col(url_col).alias("_url"))
    host, path, query = url_parts(F.col("_url"))
    rows = rows.select(*keep, host.alias("host"), path.alias("path"), query.alias("_query"))
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    rows = rows.select(*keep, "host", "path", best.alias("_best"), canonical(F.col("host"), F.col("path"), F.col("_query")).alias("_canon"))
    # Rows that need no probe are spread over block numbers that no block has.
    open_ = F.col("_best").isNull() & (F.col("host") != "")
    block = F.when(open_, F.pmod(F.xxhash64("_canon"), F.lit(blocks))).otherwise(-1 - F.pmod(F.xxhash64(*keep, "path"), F.lit(1 << 20)))
    filt = bloom_blocks(keys, "_listed", blocks)
    filt = F.broadcast(filt) if blocks <= BROADCAST_BLOCKS else filt
    probed = rows.withColumn("_block", block).join(filt, "_block", "left").withColumn("_maybe", open_ & bloom_hit(F.col("_canon")))
    say = lambda otherwise: (*keep, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), otherwise).alias("verdict"))
    exact = F.when(F.col("_listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    on = F.col("_maybe") & (F.col("_canon") == F.col("_listed"))
    if size <= BROADCAST_URLS:
        return probed.join(F.broadcast(keys), on, "left").select(*say(exact))
    # A longer list is hashed to its tasks, and only possible hits are moved there: pages are read twice for that.
    clear = probed.filter(~F.col("_maybe")).select(*say(F.lit("allow")))
    return clear.unionByName(probed.filter("_maybe").join(keys, on, "left").select(*say(exact)))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: the canonical URLs of the pages whose id is divisible by 20. It grows with the crawl."""
    host, path, query = url_parts(F.col("_url"))
    return pages.filter("page_id % 20 = 0").select(F.col("url").alias("_url")).filter(host != "").select(canonical(host, path, query).alias("url"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules and by a list that grows with the crawl."""
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, listed_urls(pages))


SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                     lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')) AS query
  FROM u),
c AS (
  SELECT page_id, url, host, path,
         host || regexp_replace(path, '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canon
  FROM p),
rules(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT page_id, url, host, path FROM c)
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, url),
listed AS (SELECT DISTINCT canon AS listed FROM c WHERE page_id % 20 = 0 AND host <> '')
SELECT c.page_id, c.host, c.path, fit.rule,
       coalesce(fit.action, CASE WHEN listed.listed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON c.page_id = fit.page_id AND c.url = fit.url
LEFT JOIN listed ON c.canon = listed.listed AND c.host <> ''
"""
