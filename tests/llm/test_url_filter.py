import re

from hydroq.llm import url_filter


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    host, path, asked = (m[1], m[2], m[3] or "") if m else ("", "", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fields = sorted(f for f in asked.split("&") if f and not re.match(url_filter.TRACKING, f))
    bare = re.sub(r":[0-9]*$", "", re.sub(r"^www\.", "", host))
    return host, path, bare + re.sub(r"/+$", "", path) + ("?" + "&".join(fields) if fields else "") if bare else None


def brute(pages, listed, rules):
    known = {parts(u)[2] for u in listed} - {None}
    out = []
    for i, url in pages:
        host, path, canon = parts(url)
        fits = sorted((r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: -len(r[1] + r[2]))
        verdict = fits[0][0] if fits else "block" if canon in known else "allow"
        out.append((i, host, path, fits[0][1] + fits[0][2] if fits else None, verdict, canon in known))
    return sorted(out, key=repr)


URLS = [
    "http://WWW.Example.org/es/1?b=2&a=1&utm_source=x#f", "https://example.org/es", "https://sub.example.org/en/12", "https://notexample.org/en/12", "http://a.com/fr/1", "http://a.com:80/de/1/", "http://a.com/de",
    "http://b.net/x?ref=1&q=2", "https://www.b.net/x/?q=2#top", "http://b.net/y", "b.net/x", "", None, "://", "http://", "http:///p", "http://org/x", "http://x.org", "http://x.net?u=http://y.com/de/", "ftp://É.net/Ä?&&",
    "http://b.net/x?q=2\n", "a://b://c.net/d", "http://b.net/" + "z" * 5000,
]


def test_equals_brute_force(spark):
    pages = [(k, u) for k, u in enumerate(URLS)] + [(7, URLS[7]), (None, URLS[8]), (900, URLS[0])] + [(1000 + k, f"http://h{k % 90}.net/p{k % 70}?x={k % 3}&ref={k}") for k in range(600)]
    listed = ["https://www.b.net/x?q=2", None, "no", "http://b.net/x/?q=2", URLS[0]] + [f"https://www.h{k}.net/p{k % 70}/?x={k % 3}" for k in range(0, 90, 2)]
    frame = spark.createDataFrame([(i, u, "net", "<html>") for i, u in pages], "page_id long, url string, host string, html string").repartition(3)
    for given in (listed, []):
        got = url_filter.judge(frame, spark.createDataFrame([(u, 1) for u in given], "url string, page_id int"), url_filter.RULES).collect()
        assert sorted(map(tuple, got), key=repr) == brute(pages, given, url_filter.RULES)


def test_no_rules_and_no_pages(spark):
    frame = spark.createDataFrame([(1, "http://a.com/de/1")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(frame, frame).collect()] == [(1, "a.com", "/de/1", None, "block", True)]
    assert url_filter.judge(frame.limit(0), frame, url_filter.RULES).count() == 0


def test_the_filter_passes_few_others(spark):
    """The share of unlisted URLs that meet the exact list stays small, and every listed one passes."""
    from pyspark.sql import functions as F

    listed = spark.range(20_000).select(F.concat(F.lit("h.net/"), "id").alias("u"))
    blocks = 20_000 * url_filter.BITS_PER_URL // 512
    words = url_filter.bloom(listed, "u", blocks)
    asked = spark.range(40_000).select("id", F.concat(F.lit("h.net/"), "id").alias("u"))
    met = F.lit(True)
    for k, bit in enumerate(url_filter.bits_of(F.col("u"))):
        met = met & (F.col(f"w{k}").bitwiseAND(bit) == bit)
    hits = asked.join(words, url_filter.block_of(F.col("u"), blocks) == F.col("block")).where(met)
    assert hits.where("id < 20000").count() == 20_000
    assert hits.where("id >= 20000").count() < 200
