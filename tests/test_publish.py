"""The whole job in stages: what is done stays done, half a stage is never seen, and tables appear together."""

import pytest
from pyspark.sql import functions as F

from answerscope.functions.entities import Brand, ReviewNeeded
from answerscope.plans import job, schemas
from answerscope.plans.config import Config
from answerscope.plans.publish import StageStore
from tests.tea_answers import CFG

BRANDS = [Brand("Alder Tea", None, "t", ("Alder",)), Brand("Birch Tea", None, "t", ("Birch",), ambiguous_aliases=("Birch",))]
SETTINGS = Config(run_date="2025-03-31", engines=CFG.engines)


def inputs(spark, folder, decision):
    cited = "\n\n## Links cited\n- https://guild.example/a"
    pages = [("https://guild.example/a", 200, "", "html", "utf-8", "2025-03-30T09:00:00+00:00", b"<title>T</title><p>" + b"leaf Alder " * 60, False)]
    frames = {
        "sheet": spark.createDataFrame([("1", "Price", "List", "Which tea?", "Alder is mild. Birch is not." + cited, "Alder!" + cited)], "`#` string, Pillar string, Intent string, Prompt string, North string, South string"),
        "crawl": spark.createDataFrame(pages, "url string, http_status int, fetch_error string, content_kind string, encoding string, fetched_at string, body binary, rendered boolean").withColumn("final_url", F.col("url")),
        "domains": spark.createDataFrame([("guild.example", "press", "High", None)], schemas.SCHEMAS["domains"]),
        "sentiment": spark.createDataFrame([("nor-01", "Alder Tea", "positive", 1, "", "")], schemas.SCHEMAS["sentiment"]),
        "ambiguous_hits": spark.createDataFrame([("nor-01", 1, "Birch", 0, "s", decision, "")] if decision else [], schemas.SCHEMAS["ambiguous_hits"]),
        "sentiment_spotcheck": spark.createDataFrame([("nor-01", "agree", None)], schemas.SCHEMAS["sentiment_spotcheck"]),
    }
    for name, df in frames.items():
        df.write.mode("ignore" if name != "ambiguous_hits" else "overwrite").parquet(f"{folder}/in/{name}")
    return lambda store: {name: store.source(f"file://{folder}/in/{name}") for name in frames}


def test_a_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"

    def run(decision):
        store = StageStore(spark, root)
        sources = inputs(spark, tmp_path, decision)
        try:
            return store, job.published(store, sources(store), BRANDS, SETTINGS, usual=1)
        except Exception as e:
            return store, e

    store, asked = run(None)
    assert isinstance(asked, ReviewNeeded) and [(r.alias, r.decision) for r in asked.rows.collect()] == [("Birch", "")]
    assert store.built == ["answers", "citations", "sentences", "hits"] and store.read() == {}

    with monkeypatch.context() as m:  # killed on the way
        m.setattr(job.quality, "report_lines", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        store = StageStore(spark, root)
        with pytest.raises(KeyboardInterrupt):
            job.published(store, inputs(spark, tmp_path, "keep")(store), BRANDS, SETTINGS, usual=1)
    assert "answers" not in store.built and "metric_vis" in store.built and store.read() == {}  # nothing is published

    store, out = run("keep")
    # the decisions are written anew for each run, so what is made from them is; the rest stays
    assert "pages" not in store.built and "hits" not in store.built and store.built[-1] == "report"
    assert {(r.answer_id, r.brand) for r in out["mentions"].collect()} >= {("nor-01", "Alder Tea"), ("nor-01", "Birch Tea")}
    assert out["metric_vis"].count() == 2 and out["report"].count() > 10

    again = StageStore(spark, root)
    names = ["sheet", "crawl", "domains", "sentiment", "ambiguous_hits", "sentiment_spotcheck"]
    job.published(again, {n: again.source(f"file://{tmp_path}/in/{n}") for n in names}, BRANDS, SETTINGS, usual=1)
    assert again.built == [] and again._runs() == [0]  # the same tables are no new publication

    left = {p.name for p in (tmp_path / "store" / "stages").iterdir()}
    assert again.sweep() > 0 and {n: df.count() for n, df in again.read().items()} == {n: df.count() for n, df in out.items()}
    assert {p.name for p in (tmp_path / "store" / "stages").iterdir()} < left


def test_readers_see_one_publication_or_the_one_before(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}/s")
    made = lambda name, n, setting: store.stage(name, [], lambda: spark.range(n), setting)
    assert store.publish({"a": made("a", 1, "1"), "b": made("b", 2, "1")}) == 0
    first = store.read()
    assert store.publish({"a": made("a", 3, "2"), "b": made("b", 4, "2")}) == 1
    assert [first["a"].count(), first["b"].count()] == [1, 2] and [df.count() for df in store.read().values()] == [3, 4]
    assert [df.count() for df in store.read(0).values()] == [1, 2]
    with pytest.raises(RuntimeError, match="boom"):
        store.stage("c", [], lambda: (_ for _ in ()).throw(RuntimeError("boom")))
    assert not [p for p in (tmp_path / "s" / "stages").iterdir() if p.name.startswith("c-")]
