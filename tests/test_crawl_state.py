"""The crawl cache's deltas, and fetching as a stream: batches in proportion, replays, restarts, busy hosts."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from answerscope.sources import crawl
from answerscope.streaming import polite_fetch
from answerscope.streaming.crawl_cache import CrawlCache
from tests.test_sources import Answer


def batch(spark, rows):
    """(key, good, day, body)"""
    df = spark.createDataFrame([(k, 200 if good else 500, f"2025-03-{day:02}", body) for k, good, day, body in rows], "key string, http_status int, fetched_at string, body string")
    none = F.lit("")
    return df.select("key", F.col("key").alias("url"), F.col("key").alias("final_url"), "http_status", none.alias("fetch_error"), none.alias("content_type"), none.alias("encoding"), "fetched_at", F.col("body").cast("binary").alias("body"))


def state(df):
    return {r.key: (r.http_status == 200, r.fetched_at[-2:], r.body and r.body.decode()) for r in df.collect()}


def size(path: Path) -> int:
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_deltas_merge_like_one_table(spark, tmp_path):
    """Against the same choice over all rows, batch after batch, through compactions; every row in one place."""
    import random

    rng = random.Random(3)
    cache, seen = CrawlCache(spark, f"file://{tmp_path}/cache", fanout=2), {}
    assert cache.read().count() == 0 and cache.good_keys().count() == 0
    for n in range(7):
        rows = [(f"k{rng.randint(0, 12)}", rng.random() < 0.5, rng.randint(1, 28), f"b{n}-{k}") for k in range(rng.choice([0, 1, 9]))]
        rows = list({(k, g, d): (k, g, d, b) for k, g, d, b in rows}.values())
        rows = [(k, g, d, b if g else None) for k, g, d, b in rows]
        rows += rows[:1]  # a repeated attempt
        for k, g, d, b in rows:
            seen[k] = max(seen.get(k, (False, "", "")), (g, f"{d:02}", (n, b or "")))
        assert cache.add(batch(spark, rows), n)
        got = state(cache.read())
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in seen.items()} and cache.read().count() == len(got)
        assert {k: v[2] or "" for k, v in got.items()} == {k: v[2][1] for k, v in seen.items()}
        assert {r.key for r in cache.good_keys().collect()} == {k for k, v in got.items() if v[0]}
    assert not cache.add(batch(spark, [("new", True, 1, "x")]), 6) and "new" not in state(cache.read())  # a replay
    manifest = cache._manifest()
    assert len(manifest["deltas"]) <= 3 and manifest["batch"] == 6


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    big = [(f"k{n}", True, 1, f"{n}" * 2000) for n in range(300)]
    cache = CrawlCache(spark, f"file://{tmp_path}/cache")
    cache.add(batch(spark, big), 0)
    before = size(tmp_path / "cache")
    cache.add(batch(spark, [("k1", True, 2, "new")]), 1)
    assert size(tmp_path / "cache") - before < before / 5
    assert state(cache.read())["k1"] == (True, "02", "new") and cache.read().count() == 300
    plan = cache.read()._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan  # bodies stay where they are


def test_half_written_deltas_are_not_seen(spark, tmp_path):
    cache = CrawlCache(spark, f"file://{tmp_path}/cache")
    cache.add(batch(spark, [("a", True, 1, "x")]), 0)
    cache._write(batch(spark, [("b", True, 1, "y")]), "d1-0")  # the writer ends before its manifest
    assert set(state(cache.read())) == {"a"}
    assert cache.add(batch(spark, [("c", True, 1, "z")]), 1) and set(state(cache.read())) == {"a", "c"}


def test_merged_moves_no_bodies(spark, tmp_path):
    batch(spark, [("a", True, 1, "x"), ("a", True, 1, "x"), ("a", False, 9, None), ("b", False, 1, None), ("b", False, 3, None), ("c", True, 2, "z")]).write.parquet(f"{tmp_path}/in")
    got = crawl.merged(spark.read.parquet(f"{tmp_path}/in"))
    assert state(got) == {"a": (True, "01", "x"), "b": (False, "03", None), "c": (True, "02", "z")} and got.count() == 3


def test_bodies_are_sent_on_in_bounded_frames(spark):
    urls = spark.createDataFrame([(f"https://one.example/{k}",) for k in range(40)], "url string")

    def site():
        return lambda url, timeout: Answer(404) if url.endswith("robots.txt") else Answer(200, "x" * 1000, url=url)

    assert crawl.fetch_all(urls, site, delay=0, workers=1, most_bytes=3000).where("length(body) = 1000").count() == 40


def counting_site(log: str):
    """Writes down every page that is asked for; /busy answers 429 at first."""

    def make():
        def get(url, timeout):
            asked = Path(log)
            first = url not in asked.read_text().split() if asked.exists() else True
            with asked.open("a") as f:
                f.write(url + "\n")
            if url.endswith("/robots.txt"):
                return Answer(200, "User-agent: *\nDisallow: /secret")
            if url.endswith("/busy") and first:
                return Answer(429, headers={"Retry-After": "0"})
            return Answer(200, url, url=url)

        return get

    return make


def run_until(query, done, seconds=150):
    end = time.time() + seconds
    while time.time() < end and not done():
        if query.exception():
            raise query.exception()
        time.sleep(0.5)
    query.stop()
    assert done()


def test_hosts_are_fetched_as_streams(spark, tmp_path):
    """A host of many pages doesn't hold others up, a restart asks for nothing twice, and new requests for known pages are none."""
    session, log = polite_fetch.polite_session(spark), f"{tmp_path}/log"
    cache = CrawlCache(spark, f"file://{tmp_path}/cache")
    put = lambda name, urls: spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/requests/{name}")
    big = [f"https://big.example/{k}" for k in range(60)]
    small = ["https://a.example/1", "https://a.example/busy", "https://a.example/secret", "https://b.example/1"]
    put("n=1", big + small)

    def start():
        stream = session.readStream.schema("url string").parquet(f"{tmp_path}/requests/*")
        return polite_fetch.fetch_politely(stream, cache, f"file://{tmp_path}/ck", counting_site(log), delay=0, quantum=7, trigger="0 seconds")

    keys = lambda: {r.url for r in cache.read().select("url").collect()}
    run_until(start(), lambda: keys() >= set(small))
    assert len(keys()) < len(big + small)  # the large host was still under way
    put("n=2", ["https://a.example/1", "https://c.example/1"])
    run_until(start(), lambda: keys() == {*big, *small, "https://c.example/1"})
    asked = Path(log).read_text().split()
    twice = {u for u in asked if asked.count(u) > 1}
    assert {u for u in twice if not u.startswith("https://big.")} == {"https://a.example/busy"} and len(twice) <= 1 + 7 + 1
    rows = {r.url: r for r in cache.read().collect()}
    assert rows["https://a.example/secret"].fetch_error == "robots_disallowed" and rows["https://a.example/busy"].http_status == 200
    assert "https://a.example/secret" not in asked
