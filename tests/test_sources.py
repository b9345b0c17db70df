import hashlib
import json
import zlib
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from answerscope.functions import pages as P
from answerscope.operators import facts, quality, reshape
from answerscope.plans import schemas
from answerscope.plans.config import Config
from answerscope.sources import answers as A
from answerscope.sources import crawl, files
from answerscope.sources.pdf import extract_pdf
from answerscope.streaming import crawl_cache
from tests.tea_answers import CFG, tables

ARTICLE = """<html><head><title>Leaf &amp; root</title><script type="application/ld+json">{"@graph": [{"@type": ["BlogPosting", "Thing"], "datePublished": "2025-02-03T04:05"},
 {"publisher": {"@type": "Organization"}}]}</script><script type="application/ld+json">{broken</script></head><body><nav>Menu</nav><article><p>""" + "leaf " * 70 + "</p></article></body></html>"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 'x, "y"\nz', 2), ("b", 1, None, None), ("NA", 2, "null", 3)], schemas.SCHEMAS["sentences"])
    files.write_csv(df, f"{tmp_path}/t")
    back = files.read_csv(spark, f"{tmp_path}/t", "sentences")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    files.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    assert json.loads(files.records_json(df.where("sent_idx = 1")))[0] == {"answer_id": "b", "sent_idx": 1, "text": None, "n_words": None}


def test_yaml(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("run_date: '2025-03-31'\nlow_n_answers: 2\n")
    (tmp_path / "b.yaml").write_text("- {brand: A, type: x, aliases: [A, Aa], ambiguous_aliases: [Aa]}\n- {brand: B, parent: A, type: y, aliases: [B], case_sensitive: true}\n")
    assert files.read_config(str(tmp_path / "c.yaml")).low_n_answers == 2
    brands = files.read_brands(str(tmp_path / "b.yaml"))
    assert brands[1].credit == ("A", "B") and files.brands_frame(spark, brands).where("ambiguous").count() == 1


def workbook(path):
    rows = [["#", "Pillar", "Intent", "Prompt", "North", "South"], ["7", "Price", "List", "Which tea?", "Alder.\r\nLinks cited\r\n- https://guild.example/a", "Birch.\nLink cited\nhttps://paper.example"]]
    cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t xml:space="preserve">{v.replace(chr(13), "&#13;")}</t></is></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    with ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_sheet_to_citations(spark, tmp_path):
    from answerscope.functions import urls

    workbook(tmp_path / "w.xlsx")
    reruns = spark.createDataFrame([("sou", 7, "Cedar.\nLinks cited\nhttps://forum.example/")], "prefix string, prompt_no int, answer_raw string")
    df = A.with_sections(A.load_answers(files.read_sheet(spark, str(tmp_path / "w.xlsx")), reruns, CFG))
    rows = {r.answer_id: r for r in df.collect()}
    assert rows["nor-07"].answer_body == "Alder." and rows["sou-07"].answer_body == "Cedar." and str(rows["nor-07"].run_date) == "2025-03-31"
    cited = urls.extract_citations(df)
    assert {(r.answer_id, r.rank, r.url) for r in cited.collect()} == {("nor-07", 1, "https://guild.example/a"), ("sou-07", 1, "https://forum.example")}
    assert schemas.assert_counts(df, cited, {"answers": 2, "citations": 2, "unique_urls": 2, "domains": 2})["answers"] == 2
    with pytest.raises(schemas.ContractError):
        schemas.assert_counts(df, cited, {"answers": 3})


def test_contracts(spark):
    t = tables(spark)
    assert [r.domain for r in schemas.subset(t["citations"], t["domains"], ["domain"]).collect()] == ["shop.example"]
    assert [(r.sent_idx, r.brand) for r in schemas.repeated(t["mentions"], ["answer_id", "sent_idx", "brand"]).collect()] == [(2, "Alder Tea")]
    with pytest.raises(schemas.ContractError):
        schemas.has_columns(t["pages"], ["nope"])


def test_text_and_binary_files(spark, tmp_path):
    (tmp_path / "k1.rendered.html").write_bytes(b"<html>r</html>")
    (tmp_path / "k1.bin").write_bytes(b"<html>raw</html>")
    rows = {(r.key, r.suffix): bytes(r.body) for r in files.read_binary(spark, str(tmp_path)).collect()}
    assert rows == {("k1", ".rendered.html"): b"<html>r</html>", ("k1", ".bin"): b"<html>raw</html>"}
    assert {r.text for r in files.read_texts(spark, str(tmp_path)).collect()} == {"<html>r</html>", "<html>raw</html>"}


def test_html_fields():
    d = P.extract_html(ARTICLE, "https://guild.example/a")
    assert (d["title"], d["published_date"], d["date_source"]) == ("Leaf & root", "2025-02-03", "jsonld")
    assert d["schema_types"] == ["BlogPosting", "Organization", "Thing"] and d["n_words"] == 70
    assert P.extract_html('<meta property="article:published_time" content="2025-01-02T00:00">')["date_source"] == "meta"
    assert P.extract_html("<p>x</p>", "https://guild.example/2025/03/04/x")["published_date"] == "2025-03-04"
    assert P.walk_jsonld([{"@type": "A", "x": [{"@type": ["B"], "datePublished": 2025}]}]) == (["A", "B"], ["2025"])


def pdf():
    stream = zlib.compress(b"BT (Harvest \\(2025\\)) Tj T* <4142> Tj ET")
    objects = [b"<< /Type /Pages /Kids [2 0 R 3 0 R] /Count 2 >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Filter /FlateDecode >> stream\n" + stream + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (k, o) for k, o in enumerate(objects, 1))


def test_pdf():
    d = extract_pdf(pdf(), 1)
    assert d["n_pages"] == 2 and d["text"].split() == ["Harvest", "(2025)", "AB"] and d["n_words"] == 3


def test_page_rows(spark):
    at, long = "2025-03-30T09:00:00+00:00", b"leaf " * 80
    meta = [("u1", 200, None, "html", "", at, ARTICLE.encode()), ("u2", 200, None, "html", "utf-8", at, b"<title>Sorry, page not found</title><p>" + long),
            ("u3", 200, None, "html", None, at, b"<time datetime=2025-03-28></time><p>" + long), ("u4", 500, "", "html", None, at, None),
            ("u5", 200, None, "pdf", None, at, b"no pdf"), ("u6", 200, None, "pdf", None, None, pdf()), ("u7", 200, None, "html", None, at, b"<time datetime=2025-03-26></time><p>" + long)]
    df = spark.createDataFrame(meta, "url string, http_status int, fetch_error string, content_kind string, encoding string, fetched_at string, body binary").withColumn("final_url", F.col("url"))
    rows = {r.url: r for r in P.page_rows(df.drop("body", "encoding"), P.extracted(df.select("url", "content_kind", "encoding", "body")), Config()).collect()}
    assert rows["u1"].is_readable and rows["u1"].has_org_schema and rows["u1"].has_article_schema and not rows["u1"].has_faq_schema
    assert (rows["u2"].soft_404, rows["u2"].is_readable) == (True, False)
    assert [(rows[u].published_date, rows[u].date_source) for u in ("u3", "u7")] == [("", "htmldate_near_crawl"), ("2025-03-26", "htmldate")]
    assert (rows["u4"].is_readable, rows["u5"].fetch_error, rows["u6"].n_pages) == (False, "extract_error: ValueError", 2)


def test_small_page_functions(spark):
    kinds = {("application/x-pdf", "https://x/a"): "pdf", ("Text/HTML", "https://x/a"): "html", ("", "https://x/a.PDF?x"): "pdf", ("application/xml", "https://x"): "html", (None, "https://x/a.gif"): "other"}
    df = spark.createDataFrame([(*k, v) for k, v in kinds.items()], "t string, u string, kind string")
    assert df.where(P.content_kind(F.col("t"), F.col("u")) != F.col("kind")).count() == 0
    waits = {"12": 12, " 3 ": 3, "0": 0, None: 5, "": 5, "31": 30, "99999999999999999999": 30, "-4": 5, "2.5": 5, "Mon, 31 Mar": 5}
    df = spark.createDataFrame(list(waits.items()), "w string, seconds int")
    assert df.where(P.retry_wait(F.col("w")) != F.col("seconds")).count() == 0
    titles = {"Oops, 404": True, "Error Page": True, "Teh tidak ditemukan": True, "Tea Not Found - Guild": True, "Guild | Tea": False, None: False, "14041": False}
    df = spark.createDataFrame(list(titles.items()), "t string, soft boolean")
    assert df.where(P.soft_404(F.col("t")) != F.col("soft")).count() == 0
    r = spark.range(1).select(P.iso_date(F.lit(" 2025-02-03T1")), P.iso_date(F.lit("3 Feb")), P.cache_key(F.lit("tea")), P.html_title(F.lit("<TITLE a>\n x  y</title>")), P.needs_render(F.lit(200), F.lit("html"), F.lit(10), 50), P.needs_render(F.lit(500), F.lit("html"), F.lit(0), 50)).first()
    assert list(r) == ["2025-02-03", "", hashlib.sha1(b"tea").hexdigest(), "x y", True, False]
    b = spark.createDataFrame([(b"r", b"w", True), (None, b"w", True), (b"r", b"w", False), (None, None, None)], "r binary, w binary, f boolean")
    assert [r[0].source for r in b.select(P.loaded_body(F.col("r"), F.col("w"), F.col("f"))).collect()] == ["rendered", "raw", "raw", ""]


class Answer:
    def __init__(self, status, text="", kind="text/html", url="u", headers=None):
        self.status_code, self.text, self.content, self.url, self.encoding = status, text, text.encode(), url, "utf-8"
        self.headers = {"Content-Type": kind} | (headers or {})


def site():
    """A stub site; made in the worker."""

    def get(url, timeout):
        if url.endswith("/robots.txt"):
            return Answer(200, "User-agent: *\nDisallow: /cellar\n") if "guild" in url else Answer(502)
        if url.endswith("/stuck"):
            raise TimeoutError
        return Answer(410 if url.endswith("/old") else 200, "<p>x</p>", url=url)

    return get


@pytest.mark.parametrize(
    "status, rules, page, expected",
    [
        (200, "User-agent: *\nDisallow: /cellar", "/cellar/key", (False, "robots_disallowed")),
        (200, "User-agent: *\nDisallow: /cellar", "/garden", (True, "")),
        (206, "User-agent: other\nDisallow: /", "/garden", (True, "")),
        (200, "", "/garden", (True, "")),
        (401, "", "/garden", (True, "")),
        (451, "User-agent: *\nDisallow: /", "/garden", (True, "")),
        (500, "", "/garden", (False, "robots_unreachable")),
        (302, "", "/garden", (False, "robots_unreachable")),
    ],
)
def test_robots(status, rules, page, expected):
    assert crawl.Robots(lambda u, timeout: Answer(status, rules)).decide("https://guild.example" + page) == expected


def test_robots_are_asked_once_a_host():
    asked = []
    r = crawl.Robots(lambda u, timeout: asked.append(u) or Answer(404))
    for page in ("https://guild.example/1", "https://guild.example/2", "http://guild.example/1"):
        assert r.decide(page) == (True, "")
    assert asked == ["https://guild.example/robots.txt", "http://guild.example/robots.txt"]

    def broken(u, timeout):
        raise OSError

    assert crawl.Robots(broken).decide("https://guild.example/x") == (False, "robots_unreachable")


def test_seconds_to_wait():
    waits = {"12": 12, " 3 ": 3, "0": 0, "": 5, "31": 30, "99999999999999999999": 30, "-4": 5, "2.5": 5, "Mon, 31 Mar": 5, "٣": 5}
    assert {h: crawl.seconds_asked_for({"Retry-After": h}) for h in waits} == waits
    assert crawl.seconds_asked_for({}) == 5


def test_fetch_and_cache(spark, tmp_path):
    urls = spark.createDataFrame([(u,) for u in ("https://guild.example/1", "https://guild.example/cellar/key", "https://guild.example/old", "https://guild.example/stuck", "https://paper.example/1")], "url string")
    rows = {r.url.split("//")[1]: r for r in crawl.fetch_all(urls, site, delay=0, workers=2).collect()}
    assert (rows["guild.example/1"].http_status, bytes(rows["guild.example/1"].body)) == (200, b"<p>x</p>")
    assert rows["guild.example/cellar/key"].fetch_error == "robots_disallowed" and rows["paper.example/1"].fetch_error == "robots_unreachable"
    assert rows["guild.example/stuck"].fetch_error == "TimeoutError" and (rows["guild.example/old"].http_status, rows["guild.example/old"].body) == (410, None)


def test_hosts_stay_together(spark):
    df = spark.createDataFrame([(f"https://h{k % 3}.id/{k}",) for k in range(30)], "url string")
    parts = crawl.by_host(df, 4).select("host", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == 3


def attempts(spark):
    """a: good, then bad. b: bad, good, good. c: bad twice."""
    day = "2025-03-{}T00:00:00+00:00".format
    rows = [("a", 200, "", day("01"), b"a1"), ("a", 500, "", day("05"), None), ("b", 200, "cut off", day("01"), b"b0"), ("b", 200, "", day("02"), b"b1"), ("b", 200, None, day("03"), b"b2"), ("c", None, "TimeoutError", day("01"), None), ("c", 404, "", day("02"), None)]
    df = spark.createDataFrame(rows, "key string, http_status int, fetch_error string, fetched_at string, body binary")
    return df.select("key", F.col("key").alias("url"), F.col("key").alias("final_url"), "http_status", "fetch_error", F.lit("").alias("content_type"), F.lit("").alias("encoding"), "fetched_at", "body")


def test_newest_good_attempt_wins(spark, tmp_path):
    check = lambda df: {r.key: (r.body and bytes(r.body), r.fetched_at[8:10]) for r in df.collect()} == {"a": (b"a1", "01"), "b": (b"b2", "03"), "c": (None, "02")}
    assert check(crawl.merged(attempts(spark)))
    wanted = spark.createDataFrame([("a",), ("c",), ("d",)], "key string")
    assert {r.key for r in reshape.unfetched(wanted, crawl.merged(attempts(spark)), "key", crawl.is_good()).collect()} == {"c", "d"}
    attempts(spark).repartition(3).write.parquet(f"{tmp_path}/in")
    query = crawl_cache.keep_merged(spark, f"{tmp_path}/in", f"{tmp_path}/cache", f"{tmp_path}/ck", files_a_batch=1)
    query.awaitTermination(120)
    assert query.exception() is None
    assert check(crawl_cache.read_cache(spark, f"{tmp_path}/cache"))


def test_report(spark):
    t = tables(spark)
    hits = spark.createDataFrame([("nor-01", 0, "Birch", 3, "s", "keep", ""), ("nor-02", 0, "Birch", 4, "s", None, "")], schemas.SCHEMAS["ambiguous_hits"])
    spot = spark.createDataFrame([("nor-01", "agree", None)], schemas.SCHEMAS["sentiment_spotcheck"])
    text = quality.build_report(t | {"ambiguous_hits": hits, "sentiment_spotcheck": spot}, CFG, usual=2)
    for part in ("# Data quality report", "3 of 8 answers list exactly 2", "`nor-01` has 3", "4 of 6 pages were readable (66.7%)", "https://paper.example/x", "HTTP 404", "| Birch | keep | 1 |", "| nor-01 | agree |  |"):
        assert part in text, (part, text)


def test_facts(spark):
    t = tables(spark)
    o = {r.what: r for r in facts.overlap(t["citations"], "North", "South").collect()}
    assert (o["sites"].both, o["sites"].jaccard, o["pages"].both, o["pages"].second_only, o["pages"].total) == (4, 1.0, 5, 1, 6)
    counts = facts.pillar_counts(t["answers"], t["mentions"], spark.createDataFrame([(3,)], "prompt_no int"))
    assert {(r.pillar, r.brand): (r.n, r.named) for r in counts.collect()} == {
        ("Price", "Alder Tea"): (2, 2), ("Price", "Birch Tea"): (2, 1), ("Price", "Cedar Tea"): (2, 1), ("Taste", "Birch Tea"): (2, 1), ("Taste", "Cedar Tea"): (2, 1), ("Care", "Alder Tea"): (2, 1),
    }
    assert {r.pillar: r.leaders for r in facts.pillar_leaders(counts).collect()} == {"Price": "Alder Tea", "Taste": "Birch Tea+Cedar Tea", "Care": "Alder Tea"}
    assert facts.modal_citations(t["citations"]).first()[0] == 1
    assert tuple(facts.dead_links(t["citations"], t["pages"], t["citations"].where("rank = 1"), "North").first()) == (1, 4, 1, 4)
    assert {(r.brand, r.engine) for r in facts.exclusive_brands(t["answers"], t["mentions"]).collect()} == {("Birch Tea", "North"), ("Cedar Tea", "South")}


def test_the_whole_job(spark, tmp_path):
    """From a workbook and a crawl to all tables and the report, with a review on the way."""
    from answerscope.functions.entities import Brand, ReviewNeeded
    from answerscope.plans.job import run_all

    cite = lambda *u: "\n\n## Links cited\n" + "\n".join(f"- {x}" for x in u)
    rows = [
        ("1", "Price", "List", "Which tea?", "Alder is mild. Birch is not." + cite("https://guild.example/a", "https://paper.example/x"), "Cedar Tea!" + cite("https://www.guild.example/a/")),
        ("2", "Taste", "Why", "Why tea?", "Nobody knows." + cite("https://paper.example/x"), "Try Alder.\n\n- Birch, too" + cite("https://forum.example/q")),
    ]
    (tmp_path / "w.xlsx").write_bytes(files.sheet_bytes(["#", "Pillar", "Intent", "Prompt", "North", "South"], rows))
    sheet = files.read_sheet(spark, str(tmp_path / "w.xlsx"))
    brands = [Brand("Alder Tea", None, "t", ("Alder", "Alder Tea")), Brand("Birch Tea", None, "t", ("Birch",), ambiguous_aliases=("Birch",)), Brand("Cedar Tea", None, "t", ("Cedar Tea",))]
    at = "2025-03-30T09:00:00+00:00"
    pages = [("https://guild.example/a", 200, "", "html", "utf-8", at, ARTICLE.replace("leaf", "Alder").encode(), False), ("https://paper.example/x", 404, "", "html", "", at, None, False), ("https://forum.example/q", 200, "", "html", "", at, b"<p>" + b"leaf Cedar Tea " * 60, True)]
    made = spark.createDataFrame(pages, "url string, http_status int, fetch_error string, content_kind string, encoding string, fetched_at string, body binary, rendered boolean").withColumn("final_url", F.col("url"))
    labels = {
        "domains": tables(spark)["domains"],
        "sentiment": spark.createDataFrame([("nor-01", "Alder Tea", "positive", 1)], "answer_id string, brand string, label string, score int"),
        "ambiguous_hits": spark.createDataFrame([("nor-01", 1, "Birch", 0, "Birch is not.", "reject", "")], schemas.SCHEMAS["ambiguous_hits"]),
        "sentiment_spotcheck": spark.createDataFrame([("nor-01", "agree", None)], schemas.SCHEMAS["sentiment_spotcheck"]),
    }
    cfg = Config(run_date="2025-03-31", engines=CFG.engines, expected_counts={"answers": 4, "citations": 5, "unique_urls": 3, "domains": 3})
    with pytest.raises(ReviewNeeded) as asked:
        run_all(sheet, None, made, labels, brands, cfg)
    queue = asked.value.rows
    assert [(r.answer_id, r.sent_idx, r.alias, r.decision) for r in queue.orderBy("answer_id").collect()] == [("nor-01", 1, "Birch", "reject"), ("sou-02", 1, "Birch", "")]
    labels["ambiguous_hits"] = queue.withColumn("decision", F.when(F.col("decision") == "", "keep").otherwise(F.col("decision")))
    out = run_all(sheet, None, made, labels, brands, cfg, usual=1)
    assert {(r.answer_id, r.brand) for r in out["mentions"].collect()} == {("nor-01", "Alder Tea"), ("sou-01", "Cedar Tea"), ("sou-02", "Alder Tea"), ("sou-02", "Birch Tea")}
    assert {(r.url.split("/")[2], r.is_readable, r.body_source) for r in out["pages"].collect()} == {("guild.example", True, "raw"), ("paper.example", False, ""), ("forum.example", True, "rendered")}
    assert {r.brand: (r.ai_mentions, r.source_count) for r in out["source_sov"].collect()} == {"Alder Tea": (2, 70), "Birch Tea": (1, 0), "Cedar Tea": (1, 60)}
    assert out["domains"].where("domain = 'guild.example'").first().citations == 2 and out["vis"].count() == 3
    text = "\n".join(r.line for r in out["report"].orderBy("section", "place").collect())
    assert "| Citations | 5 | 5 |" in text and "- `nor-01` has 2." in text and "| https://paper.example/x | HTTP 404 |" in text and "| Birch | keep | 1 |" in text
    quality.write_report(out["report"], f"{tmp_path}/report")
    assert "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))).strip() == text.strip()


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from answerscope.plans import storage

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(cluster)


def test_lookup(spark):
    df = tables(spark)["domains"]
    assert facts.lookup(df, {"domain": "forum.example"}, "authority_tier").first()[0] == "Low"
    assert facts.lookup(df, {"domain": "nowhere"}, "authority_tier").first()[0] is None
    with pytest.raises(Exception, match="not one row"):
        facts.lookup(df, {}, "domain").collect()


def test_intermediate_tables_are_released(spark):
    from answerscope.plans import storage

    df = storage.stored(spark.range(3), "three")
    assert df.count() == 3 and storage.release(spark) > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        spark.read.parquet(df.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_pdf_with_packed_objects_font_maps_and_filters():
    """Pages out of order, an object stream, chained filters, a two-byte font, and gaps as spaces."""
    import base64

    def stream(data, extra=b""):
        return b"<< " + extra + b" >> stream\n" + data + b"\nendstream"

    packed = [(2, b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 /Resources << /Font << /F1 8 0 R >> >> >>"), (8, b"<< /Type /Font /ToUnicode 9 0 R >>")]
    header, inner = b"", b""
    for n, body in packed:
        header += b"%d %d " % (n, len(inner))
        inner += body + b" "
    cmap = b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0001> <0054> endbfchar beginbfrange <0002> <0004> <0061> <0005> <0006> [<00E9> <D83DDE42>] endbfrange"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R 10 0 R] >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>",
        5: stream(b"BT /F1 12 Tf 1 0 0 1 0 0 Tm <000100020003> Tj T* [<0004> -300 <0005> 20 <0006>] TJ ET (not shown)"),
        6: stream(base64.a85encode(zlib.compress(b"BT (Plain \\(text\\) with (nested) \\101)' ET")) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]"),
        7: stream(zlib.compress(header + inner), b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % len(header)),
        9: stream(cmap),
        10: stream(b"425420285365636F6E64292027204554>", b"/Filter /ASCIIHexDecode"),
    }
    data = b"%PDF-1.7\n" + b"".join(b"%d 0 obj %s endobj\n" % (k, o) for k, o in objects.items())
    d = extract_pdf(data, 10)
    assert d["n_pages"] == 2
    assert d["text"].split() == ["Tab", "c", "é\U0001f642", "Plain", "(text)", "with", "(nested)", "A", "Second"]
    assert extract_pdf(data, 1)["text"].split() == ["Tab", "c", "é\U0001f642"]
