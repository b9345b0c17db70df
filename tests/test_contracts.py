"""Contracts observed by the writes of tables: right numbers, no job of their own, and a broken one ends the job."""

import pytest
from pyspark.sql import functions as F

from answerscope.operators import brand, citation
from answerscope.plans import contracts, job
from answerscope.plans.compute import compute_all
from answerscope.plans.config import Config
from answerscope.plans.publish import StageStore
from answerscope.plans.schemas import ContractError
from tests.tea_answers import ANSWERS, CFG, CITATIONS, DOMAINS, LENGTHS, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_tables_break_nothing(spark):
    t, seen = tables(spark), {}
    compute_all(t, CFG, seen)
    assert seen == {
        "answers_repeated": 0, "answers_without_id": 0, "citations_without_answer": 0, "citations_unlabelled": 2, "citations_of_repeated_labels": 0, "rows:labelled": 15,
        "mentions_without_sentence": 0, "mentions_of_repeated_sentences": 0, "rows:answer_brands": 7,
    }
    contracts.hold(seen)


def test_breaks_are_counted_and_multiply_nothing(spark):
    """A repeated answer, one that no citation is of, one without id; citations of none; repeated labels and sentences, and a lost one."""
    broken = tables(
        spark,
        answers=[*[a for a in ANSWERS if a[0] != "sou-04"], ANSWERS[0], ("new", "North", 9, "Care", "Why"), ("new", "North", 9, "Care", "Why"), (None, "North", 9, "Care", "Why")],
        citations=[*CITATIONS, (None, "North", 1, "https://guild.example/a", "guild.example")],
        domains=[*DOMAINS, ("guild.example", "a lesser label", "High")],
        sentences=[(a, k, "x", n) for a, ns in LENGTHS.items() for k, n in enumerate(ns) if (a, k) != ("sou-02", 1)] + [("nor-01", 2, "x", 12)],
    )
    cited, seen = contracts.stored_watched(citation.labelled_watched(broken["citations"], broken["answers"], broken["domains"]), "labelled")
    guilds = sum(c[4] == "guild.example" for c in CITATIONS) + 1
    assert seen == {"rows": 14, "answers_repeated": 4, "answers_without_id": 1, "citations_without_answer": 2, "citations_unlabelled": 2, "citations_of_repeated_labels": guilds}
    known = tables(spark)
    wanted = citation.labelled(known["citations"], known["answers"], known["domains"]).where("answer_id <> 'sou-04'")
    assert rows(cited.select(wanted.columns)) == rows(wanted)  # "guild" is the larger label, and no row stands twice
    _, seen = contracts.stored_watched(brand.answer_brands_watched(broken["sentences"], broken["mentions"]), "pairs")
    assert seen == {"rows": 7, "mentions_without_sentence": 1, "mentions_of_repeated_sentences": 2}
    with pytest.raises(ContractError, match="'citations_without_answer': 2"):
        contracts.hold({"citations_without_answer": 2, "citations_unlabelled": 5})


def test_empty_tables_and_other_columns(spark):
    none = tables(spark, **{n: [] for n in ("answers", "citations", "domains", "sentences", "mentions")})
    for w in (citation.labelled_watched(none["citations"], none["answers"], none["domains"]), brand.answer_brands_watched(none["sentences"], none["mentions"])):
        assert set(contracts.checked_only(w).values()) == {0}
    t = tables(spark)
    more = {n: df.withColumns({c: F.lit("mine") for c in ("n_answers", "label", "answer", "is_answer", "lost")}) for n, df in t.items()}
    assert contracts.checked_only(citation.labelled_watched(more["citations"], more["answers"], more["domains"]))["rows"] == 15
    assert contracts.checked_only(brand.answer_brands_watched(more["sentences"], more["mentions"]))["rows"] == 7


def test_observing_takes_no_job(spark):
    """As many jobs as the plain write of the same plan has."""
    t, status = tables(spark), spark.sparkContext.statusTracker()

    def jobs(group, act):
        spark.sparkContext.setJobGroup(group, group)
        act()
        spark.sparkContext.setJobGroup("tests", "tests")
        return len(status.getJobIdsForGroup(group))

    w = citation.labelled_watched(t["citations"], t["answers"], t["domains"])
    plain = jobs("plain", lambda: w.df.where(w.keep).drop(*w.carried).write.format("noop").mode("overwrite").save())
    assert jobs("watched", lambda: contracts.checked_only(w)) == plain


def test_a_stage_keeps_what_its_write_observed(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}/s")
    build = lambda: contracts.Watched(spark.range(10), {"odd": F.col("id") % 2 == 1, "sum": F.col("id")}, F.col("id") < 4)
    made = store.stage("a", [], build)
    again = StageStore(spark, f"file://{tmp_path}/s").stage("a", [], lambda: pytest.fail("built twice"))
    assert made.observed == again.observed == {"rows": 4, "odd": 5, "sum": 45} and again.df.count() == 4


def test_expected_rows_are_those_observed(spark):
    cited = "\n\n## Links cited\n- https://guild.example/a"
    sheet = spark.createDataFrame([("1", "Price", "List", "Which?", f"Alder.{cited}", f"Birch.{cited}")], "`#` string, Pillar string, Intent string, Prompt string, North string, South string")
    seen = {}
    job.read_answers(sheet, None, Config(run_date="2025-03-31", engines=CFG.engines), seen)
    assert seen == {"rows:answers": 2, "rows:citations": 2, "rows:sentences": 2}
    with pytest.raises(ContractError, match="'rows:answers': 2"):
        job.read_answers(sheet, None, Config(run_date="2025-03-31", engines=CFG.engines, expected_counts={"answers": 3}))
