"""Eight invented answers about invented teas, with every number small enough to work out by hand."""

from answerscope.plans.config import Config
from answerscope.plans.schemas import SCHEMAS

CFG = Config(run_date="2025-03-31", engines={"North": "nor", "South": "sou"})

ANSWERS = [
    ("nor-01", "North", 1, "Price", "List"),
    ("nor-02", "North", 2, "Taste", "Why"),
    ("nor-03", "North", 3, "Price", "List"),
    ("nor-04", "North", 4, "Care", "Steps"),
    ("sou-01", "South", 1, "Price", "List"),
    ("sou-02", "South", 2, "Taste", "Why"),
    ("sou-03", "South", 3, "Price", "List"),
    ("sou-04", "South", 4, "Care", "Steps"),
]
#: Words of each sentence.
LENGTHS = {"nor-01": [6, 2, 12], "nor-02": [10, 10], "nor-03": [5], "nor-04": [7, 3], "sou-01": [4, 4, 4, 8], "sou-02": [9, 1], "sou-03": [15], "sou-04": [10, 20, 10]}
MENTIONS = [
    ("nor-01", 0, "Alder Tea"),
    ("nor-01", 0, "Birch Tea"),
    ("nor-01", 2, "Alder Tea"),
    ("nor-01", 2, "Alder Tea"),
    ("nor-02", 1, "Birch Tea"),
    ("nor-04", 0, "Alder Tea"),
    ("sou-01", 3, "Cedar Tea"),
    ("sou-01", 1, "Alder Tea"),
    ("sou-02", 0, "Cedar Tea"),
    ("sou-02", 1, "Cedar Tea"),
]
SENTIMENT = [
    ("nor-01", "Alder Tea", "positive", 1),
    ("nor-01", "Birch Tea", "negative", -1),
    ("nor-02", "Birch Tea", "neutral", 0),
    ("nor-04", "Alder Tea", "mixed", 0),
    ("sou-01", "Cedar Tea", "positive", 1),
    ("sou-01", "Alder Tea", "neutral", 0),
    ("sou-02", "Cedar Tea", "positive", 1),
]
CITATIONS = [
    ("nor-01", "North", 1, "https://guild.example/a", "guild.example"),
    ("nor-01", "North", 2, "https://paper.example/x", "paper.example"),
    ("nor-01", "North", 3, "https://forum.example/q", "forum.example"),
    ("nor-02", "North", 1, "https://guild.example/a", "guild.example"),
    ("nor-03", "North", 1, "https://paper.example/x", "paper.example"),
    ("nor-03", "North", 2, "https://shop.example/s", "shop.example"),
    ("nor-04", "North", 1, "https://forum.example/q", "forum.example"),
    ("nor-04", "North", 2, "https://guild.example/b", "guild.example"),
    ("sou-01", "South", 1, "https://paper.example/x", "paper.example"),
    ("sou-01", "South", 2, "https://guild.example/a", "guild.example"),
    ("sou-02", "South", 1, "https://guild.example/b", "guild.example"),
    ("sou-02", "South", 2, "https://forum.example/q", "forum.example"),
    ("sou-02", "South", 3, "https://paper.example/y", "paper.example"),
    ("sou-03", "South", 1, "https://shop.example/s", "shop.example"),
    ("sou-04", "South", 1, "https://paper.example/y", "paper.example"),
]
#: The shop has no labels.
DOMAINS = [("guild.example", "guild", "High"), ("paper.example", "paper", "Medium"), ("forum.example", "forum", "Low")]
#: url, status, readable, kind, published, schema types, date source, error
PAGES = [
    ("https://guild.example/a", 200, True, "html", "2025-03-21", "NewsArticle", "jsonld", None),
    ("https://guild.example/b", 200, True, "html", "2024-12-21", None, "meta", None),
    ("https://paper.example/x", 404, False, "html", None, None, None, None),
    ("https://paper.example/y", 200, True, "pdf", "2024-02-25", None, "htmldate", None),
    ("https://forum.example/q", 200, True, "html", None, "FAQPage;Organization", None, None),
    ("https://shop.example/s", None, False, None, None, None, None, "Timeout: too slow"),
]
COUNTS = [
    ("https://guild.example/a", "Alder Tea", 6),
    ("https://guild.example/a", "Cedar Tea", 2),
    ("https://guild.example/b", "Birch Tea", 5),
    ("https://paper.example/x", "Birch Tea", 50),
    ("https://paper.example/y", "Cedar Tea", 4),
    ("https://forum.example/q", "Dune Tea", 1),
    ("https://forum.example/q", "Alder Tea", 1),
]


def rows():
    return {
        "answers": ("answer_id string, engine string, prompt_no int, pillar string, intent string", ANSWERS),
        "sentences": ("answer_id string, sent_idx int, text string, n_words int", [(a, k, "x", n) for a, ns in LENGTHS.items() for k, n in enumerate(ns)]),
        "mentions": ("answer_id string, sent_idx int, brand string, sub_brand string", [(*m, "") for m in MENTIONS]),
        "sentiment": ("answer_id string, brand string, label string, score int", SENTIMENT),
        "citations": ("answer_id string, engine string, rank int, url string, domain string", CITATIONS),
        "domains": ("domain string, domain_type string, authority_tier string", DOMAINS),
        "pages": ("url string, http_status int, is_readable boolean, content_kind string, published_date string, schema_types string, date_source string, fetch_error string", PAGES),
        "page_brand_counts": ("url string, brand string, count int", COUNTS),
    }


def tables(spark, **changed):
    return {name: spark.createDataFrame(changed.get(name, data), schema) for name, (schema, data) in rows().items()}


assert set(rows()) <= set(SCHEMAS)
