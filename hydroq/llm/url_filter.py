"""URL rules and a block list: a blocked Bloom filter of the listed canonical URLs, then an exact join of its hits.

The filter is a table: one row of eight 64-bit words for each block of 512 bits. A URL's hash names its block and one bit
in each word. A page whose eight bits are set is a possible hit; only those meet the list itself.
"""

import math

from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import small_side, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
BITS_PER_URL = 16
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

# Verdict, host and path of the rules.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url):
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url):
    """Host without ``www.`` and port, path without closing slash, and the sorted query without tracking fields; null without host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":[0-9]*$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    fields = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    asked = F.concat_ws("&", F.array_sort(F.filter(fields, lambda x: (x != "") & ~x.rlike(TRACKING))))
    return F.when(host != "", F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def rule_of(host, path, rules):
    """The longest rule that fits, as (rule, verdict) columns; null without one."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ranked]
    first = lambda values: F.coalesce(F.lit(None).cast("string"), *[F.when(fit, F.lit(v)) for fit, v in zip(fits, values)])
    return first([h + p for _, h, p in ranked]), first([v for v, _, _ in ranked])


def block_of(url, blocks):
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bits_of(url):
    """One bit in each of the words, from a second hash."""
    second = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]


def bloom(listed, url_col, blocks):
    """(block, w0 ... w7): the words of each block in use, combined on the map side."""
    bits = listed.select(block_of(F.col(url_col), blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(bits_of(F.col(url_col)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def judge(pages, listed, rules=(), id_col="page_id", url_col="url", listed_col="url"):
    """(page_id, host, path, rule, verdict, listed) for every row of ``pages``.

    verdict: that of the longest fitting rule, else block if the canonical URL is one of ``listed``, else allow. A null url or
    one without ``://`` has an empty host and path, no rule and is never listed. Repeated rows are judged alike;
    an empty list blocks nothing; empty pages give no rows. Columns other than id and url stay out.
    """
    known = stage(listed.select(canonical(F.col(listed_col).cast("string")).alias("known")).where("known is not null").distinct(), "listed")
    blocks = max(1, math.ceil(known.count() * BITS_PER_URL / (64 * WORDS)))
    words = small_side(stage(bloom(known, "known", blocks), "bloom"))
    url = F.coalesce(F.col("url"), F.lit(""))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    own = own.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    met = F.lit(True)
    for k, bit in enumerate(bits_of(F.col("canon"))):
        met = met & (F.col(f"w{k}").bitwiseAND(bit) == bit)
    # pages without canonical URL have no block; they are dealt out by their own hash instead of meeting at null
    probe = own.withColumn("probe", F.when(F.col("canon").isNull(), -1 - F.pmod(F.xxhash64("page_id"), F.lit(1 << 20))).otherwise(block_of(F.col("canon"), blocks)))
    probed = probe.join(words, F.col("probe") == F.col("block"), "left").withColumn("possible", F.coalesce(met, F.lit(False)))
    hits = probed.where("possible").join(known, F.col("canon") == F.col("known"), "left").withColumn("listed", F.col("known").isNotNull())
    rest = probed.where("not possible").withColumn("listed", F.lit(False))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    columns = ["page_id", "host", "path", "listed"]
    both = hits.select(columns).unionByName(rest.select(columns))
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


@query(
    "op4_url_filter",
    r"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS asked
  FROM pages
), canon AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':[0-9]*$', '') AS bare FROM cut
), named AS (
  SELECT *, CASE WHEN bare <> '' THEN bare || regexp_replace(path, '/+$', '') || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS url FROM canon
), judged AS (
  SELECT page_id, host, path, url IN (SELECT url FROM named WHERE page_id % 50 = 0 AND url IS NOT NULL) AS hit,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM named
)
SELECT page_id, host, path, rule, coalesce(hit, false) AS listed,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN hit THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""",
)
def op4(spark, sf_dir):
    """All pages against the rules and against the URLs of the pages whose id is divisible by 50."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, pages.where("page_id % 50 = 0"), RULES)
