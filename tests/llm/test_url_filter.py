import re

from pyspark.sql import functions as F

from placesearch.llm import url_filter as U

SMALL = "/root/testdata/sf0.01"
URLS = ["https://WWW.Example.com/en/1?x#y", "http://example.com/en/", "http://example.com/EN/", "https://a.net/es/x",
        "https://net/fr/", "http://anet/fr/", "ftp://x.com", "http://x.com?q=/en/", "x.com/en/", None, "", "://",
        "http://a.org/#/b", "http://b.org/p?u=http://c.com/", "http://ÄB.com/ü", "http://x.www.example.com/en/a",
        "http://wwwexample.com/en/", "http://a.com/" + "long/" * 50_000, "https://x.com\n/a"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def test_parts_and_rules(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame(list(enumerate(URLS, 10**6)) + [(None, URLS[0])], "page_id long, url string")
    both = pages.unionByName(odd).withColumn("host", F.lit("clash"))
    want = sorted(str((r.page_id, *plain(r.url)[:3])) for r in both.collect())
    found = U.filter_urls(both)
    assert sorted(str((r.page_id, r.host, r.path, r.rule)) for r in found.collect()) == want
    ruled = {r.page_id: plain(r.url)[3] for r in both.collect()}
    assert all(r.verdict == (ruled[r.page_id] or r.verdict) and r.verdict in ("allow", "block") for r in found.collect())


def test_models_learn_the_difference(spark):
    examples = U.judged_by_rules(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).filter("ruled IS NOT NULL").withColumn(
        "accepted", F.col("ruled") == "allow")
    part = F.crc32(F.col("page_id").cast("string").cast("binary")) % 3
    model = U.train(examples.filter(part != 0))
    told = U.with_difference(examples.filter(part == 0), model).toPandas()
    right = ((told["difference"] * model.slope + model.offset >= 0) == told["accepted"]).mean()
    assert right > 0.95


def test_chances_sum_to_one(spark):
    import numpy as np
    import pyarrow as pa
    examples = spark.createDataFrame([("ab.com", "/x", True), ("cd.net", "/y", False)], "host string, path string, accepted boolean")
    model = U.count(examples)
    data, _ = U._symbols(pa.array(["ab"]))
    every = np.concatenate([np.append(data[:U.ORDER], c) for c in range(256)]).astype(np.uint8)
    at = np.arange(256) * (U.ORDER + 1) + U.ORDER
    total = np.exp(U._log_chances(model, every, at)).sum(axis=1)
    assert np.allclose(total, 1, atol=0.02)


def test_empty_and_one_sided(spark):
    df = spark.createDataFrame([(1, "http://x.com/a"), (2, "http://y.org/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.filter_urls(df).collect()}[1] == "allow"
    assert U.filter_urls(df.limit(0)).count() == 0
