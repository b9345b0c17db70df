from math import exp

import pytest
from pyspark.sql import functions as F

from answerscope.operators import brand, citation
from answerscope.plans.compute import compute_all
from answerscope.plans.config import Config
from tests.tea_answers import CFG, rows, tables


@pytest.fixture(scope="module")
def out(spark):
    return {k: [r.asDict() for r in df.collect()] for k, df in compute_all(tables(spark), CFG).items()}


def one(table, **keys):
    found = [r for r in table if all(r[k] == v for k, v in keys.items())]
    assert len(found) == 1, (keys, found)
    return found[0]


#: Prominence by hand: words of the sentence over words of the answer, times exp(-place / sentences).
ALDER = {"nor-01": 6 / 20 + 12 / 20 * exp(-2 / 3), "nor-04": 7 / 10, "sou-01": 4 / 20 * exp(-1 / 4)}
CEDAR = {"sou-01": 8 / 20 * exp(-3 / 4), "sou-02": 9 / 10 + 1 / 10 * exp(-1 / 2)}


def test_a_sentence_weighs_less_the_later_it_comes(spark):
    r = spark.range(1).select(*[brand.pawc_weight(F.lit(k), F.lit(5)).alias(f"w{k}") for k in range(3)]).first()
    assert list(r) == pytest.approx([1.0, exp(-0.2), exp(-0.4)])


def test_prominence_counts_a_sentence_once(spark):
    t = tables(spark)
    for frame in (brand.brand_pawc(t["sentences"], t["mentions"]), brand.answer_brands(t["sentences"], t["mentions"])):
        got = {(r.answer_id, r.brand): r.pawc for r in frame.collect()}
        assert {a: got[a, "Alder Tea"] for a in ALDER} == pytest.approx(ALDER) and {a: got[a, "Cedar Tea"] for a in CEDAR} == pytest.approx(CEDAR)


def test_brands_of_an_engine(out):
    r = one(out["brand_engine"], brand="Alder Tea", engine="North")
    assert [r[k] for k in ("n", "n_answers_mentioning", "mention_rate", "ai_mentions", "ai_sov")] == pytest.approx([4, 2, 0.5, 4, 2 / 3])
    assert r["pawc"] == pytest.approx((ALDER["nor-01"] + ALDER["nor-04"]) / 4)
    assert [r[k] for k in ("first_mention_pos", "sentiment_mean", "n_pos", "n_neu", "n_neg", "n_mixed")] == pytest.approx([0, 0.5, 1, 0, 0, 1])
    r = one(out["brand_engine"], brand="Cedar Tea", engine="South")
    assert [r[k] for k in ("mention_rate", "ai_mentions", "ai_sov", "first_mention_pos", "sentiment_mean", "n_pos")] == pytest.approx([0.5, 3, 0.75, 0.375, 1, 2])
    assert one(out["brand_engine"], brand="Birch Tea", engine="North")["first_mention_pos"] == pytest.approx(0.25)
    r = one(out["brand_engine"], brand="Birch Tea", engine="South")
    assert (r["ai_mentions"], r["mention_rate"], r["pawc"], r["first_mention_pos"], r["sentiment_mean"]) == (0, 0, 0, None, None)
    assert len(out["brand_engine"]) == 3 * 3


def test_brands_of_a_cut(out):
    assert [(r["n"], r["mention_rate"]) for r in (one(out["brand_pillar"], brand=b, engine="All", pillar="Price") for b in ("Alder Tea", "Birch Tea", "Cedar Tea"))] == [(4, 0.5), (4, 0.25), (4, 0.25)]
    assert one(out["brand_intent"], brand="Birch Tea", engine="North", intent="Why")["ai_sov"] == 1.0
    r = one(out["brand_intent"], brand="Cedar Tea", engine="South", intent="Steps")
    assert [r[k] for k in ("n", "ai_mentions", "ai_sov", "first_mention_pos", "sentiment_mean")] == [1, 0, 0.0, None, None]


def test_answers_that_name_nobody(out):
    rates = {(r["engine"], r["intent"]): (r["n"], r["no_brand_rate"]) for r in out["no_brand_rate"]}
    assert len(rates) == 12
    assert [rates[k] for k in (("North", "List"), ("North", "Why"), ("South", "Steps"), ("All", "List"), ("All", "All"))] == [(2, 0.5), (1, 0.0), (1, 1.0), (4, 0.5), (8, 0.375)]


def test_domains(out):
    r = one(out["domains"], domain="guild.example")
    assert [r[k] for k in ("citations", "nor", "sou", "unique_pages", "prompts", "answers", "avg_rank", "avg_rank_nor", "n")] == pytest.approx([5, 3, 2, 2, 3, 5, 1.4, 4 / 3, 15])
    assert (r["readable_pages_nor"], r["readable_pages_sou"]) == (2, 2)
    assert {r["domain"] for r in out["domains"]} == {"guild.example", "paper.example", "forum.example"}


def test_pages(out):
    ranked = [(r["rank"], r["url"].split("//")[1], r["citations"], r["engines"]) for r in sorted(out["pages_top"], key=lambda r: r["rank"])]
    assert ranked == [
        (1, "forum.example/q", 3, "North+South"), (2, "guild.example/a", 3, "North+South"), (3, "paper.example/x", 3, "North+South"),
        (4, "guild.example/b", 2, "North+South"), (5, "paper.example/y", 2, "South"), (6, "shop.example/s", 2, "North+South"),
    ]
    assert sorted(r["rank"] for r in out["cross_engine_pages"]) == [1, 2, 3, 4, 6]


def test_mixes(out):
    r = one(out["authority_mix"], engine="North", authority_tier="High")
    assert (r["citations"], r["share"], r["n"]) == (3, 3 / 8, 8)
    assert sum(r["share"] for r in out["domain_type_mix"] if r["engine"] == r["pillar"] == "All") == pytest.approx(13 / 15)
    assert one(out["domain_type_mix"], engine="South", pillar="Taste", domain_type="paper")["citations"] == 1
    assert [one(out["concentration"], engine=e)["n"] for e in ("North", "South", "All")] == [8, 7, 15]
    assert one(out["concentration"], engine="All")["top5_share"] == 1.0


def test_shares_of_voice(out):
    voice = {r["brand"]: r for r in out["source_sov"]}
    of = lambda name: [voice[b][name] for b in ("Alder Tea", "Birch Tea", "Cedar Tea", "Dune Tea")]
    assert of("source_sov") == pytest.approx([0.3125, 0.25, 0.3125, 0.125])
    assert of("source_sov_raw") == pytest.approx([7 / 19, 5 / 19, 6 / 19, 1 / 19])
    assert of("ai_sov_weighted") == pytest.approx([0.45, 0.25, 0.3, 0]) and of("ai_sov") == pytest.approx([0.5, 0.2, 0.3, 0])
    assert of("sov_gap") == pytest.approx([0.1375, 0, -0.0125, -0.125])
    assert voice["Alder Tea"]["sov_gap_raw"] == pytest.approx(0.5 - 7 / 19)
    assert (voice["Dune Tea"]["n_pages_with_brands"], voice["Dune Tea"]["n_readable_pages"], voice["Dune Tea"]["ai_mentions"]) == (4, 4, 0)


def test_a_page_counts_alike_however_often_it_names_a_brand(spark):
    more = [(u, b, n * 1000 if b == "Alder Tea" and "guild" in u else n) for u, b, n in rows()["page_brand_counts"][1]]
    got = compute_all(tables(spark, page_brand_counts=more), CFG)["source_sov"].where("brand = 'Alder Tea'").first()
    assert got.source_sov == pytest.approx((6000 / 6002 + 0.5) / 4)


def test_ages(out):
    ages = {(r["basis"], r["cut"], r["value"], r["group"]): r["citations"] for r in out["recency"]}
    assert [ages["all dates", "engine", "North", g] for g in ("0-30", "31-180", "unknown")] == [2, 1, 2]
    assert ages["all dates", "engine", "South", ">365"] == 2 and ages["structured dates only", "engine", "South", "unknown"] == 3
    assert ages["structured dates only", "domain_type", "guild", "0-30"] == 3


def test_why_pages_do_not_count(spark, out):
    why = {(r["cut"], r["value"], r["reason"]): (r["count"], r["share"]) for r in out["readability"]}
    assert [why["domain_type", "All", x][0] for x in ("readable", "http_404", "Timeout")] == [4, 1, 1]
    assert why["engine", "South", "readable"] == (5, pytest.approx(5 / 7))
    pages = tables(spark)["pages"].withColumn("soft_404", F.col("url").contains("forum")).withColumn("is_readable", F.col("is_readable") & ~F.col("soft_404"))
    r = one([r.asDict() for r in compute_all(tables(spark) | {"pages": pages}, CFG)["readability"].collect()], cut="domain_type", value="forum", reason="soft_404")
    assert (r["count"], r["unit"]) == (1, "pages")


def test_structured_data(out):
    whole, guild = one(out["schema"], domain_type="All"), one(out["schema"], domain_type="guild")
    assert [whole[k] for k in ("n", "any_jsonld", "article", "faq", "org")] == pytest.approx([3, 2 / 3, 1 / 3, 1 / 3, 1 / 3])
    assert (guild["n"], guild["article"], guild["faq"]) == (2, 0.5, 0)


def test_score(out):
    r = one(out["vis"], brand="Alder Tea")
    parts = [1, 5.2 / 7, 2 / 3, 1]
    assert [r[k] for k in ("pawc_norm", "authority", "sentiment_norm", "diversity", "vis")] == pytest.approx([*parts, 100 * sum(parts) / 4])
    assert r["low_n"] is False and r["pawc"] == pytest.approx(sum(ALDER.values()) / 8)
    r = one(out["vis_engine"], brand="Alder Tea", engine="South")
    assert (r["n_answers"], r["low_n"], r["diversity"]) == (1, True, None)
    assert one(out["vis"], brand="Birch Tea")["diversity"] == 0.5


def test_no_per_citation_pawc_columns(out):
    assert not any("pawc" in c for name in ("domains", "pages_top", "source_sov") for c in out[name][0])


def test_empty_inputs(spark):
    empty = {k: df.limit(0) for k, df in tables(spark).items()}
    got = {k: df.count() for k, df in compute_all(empty, CFG).items()}
    assert all(n <= 3 for n in got.values()), got


def test_ranks_have_no_gaps_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    got = citation.ranked(df, [F.desc("k"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_config_is_checked():
    assert Config.of({"recency_bins": [1, 2, 3]}).recency_bins == (1, 2, 3)
    for bad in ({"recency_bins": [3, 2, 1]}, {"vis_weights": {"pawc": 1}}, {"other": 1}):
        with pytest.raises(ValueError):
            Config.of(bad)


def test_partitions_grow_with_tables(spark, tmp_path, monkeypatch):
    """A large table is dealt to more tasks after a shuffle, a small one to as many as the session says."""
    from answerscope.plans import bindings

    spark.range(50_000).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get(bindings.FIRST, None)
    try:
        bindings.read(spark, str(tmp_path), "orders")
        assert spark.conf.get(bindings.FIRST, None) == before and int(spark.conf.get(bindings.TASK).rstrip("b")) == bindings.TASK_BYTES
        monkeypatch.setattr(bindings, "FILE_BYTES", 10_000)
        bindings.read(spark, str(tmp_path), "orders")
        assert int(spark.conf.get(bindings.FIRST)) > 4
    finally:
        spark.conf.unset(bindings.FIRST)


@pytest.mark.parametrize("off", ["spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"])
def test_partitions_grow_where_none_are_joined(spark, tmp_path, monkeypatch, off):
    """The step that brand tables share takes more tasks for a larger table in a session that keeps the partitions it begins with."""
    from answerscope.plans import bindings

    monkeypatch.setattr(bindings, "FILE_BYTES", 10_000)
    spark.range(50_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = {c: spark.conf.get(c, None) for c in (off, "spark.sql.shuffle.partitions", bindings.FIRST)}
    spark.conf.set(off, "false")
    try:
        lines = bindings.read(spark, str(tmp_path), "lineitem")
        most = max(lines.groupBy("id").count().groupBy(F.spark_partition_id().alias("p")).count().collect(), key=lambda r: r["count"])
        assert most["count"] < 50_000 / 10 and spark.conf.get(bindings.FIRST, None) == before[bindings.FIRST]
    finally:
        for c, value in before.items():
            spark.conf.set(c, value) if value else spark.conf.unset(c)


def test_readers_take_little_of_a_table(spark, tmp_path):
    """A task that reads a table and deals its rows to many partitions holds them: Spark's own 128 MB of files is too much."""
    from answerscope.plans import bindings

    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    spark.range(10).write.parquet(f"{tmp_path}/lineitem.parquet")
    try:
        spark.conf.unset(split)
        bindings.read(spark, str(tmp_path), "lineitem")
        assert int(spark.conf.get(split).rstrip("b")) <= 32 << 20
        spark.conf.set(split, "16m")
        bindings.read(spark, str(tmp_path), "lineitem")
        assert spark.conf.get(split) in ("16m", f"{16 << 20}b")
    finally:
        spark.conf.set(split, before)
