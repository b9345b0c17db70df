"""Dictionary matching of entities in text.

The dictionary is an automaton that each Python worker builds once from a broadcast list of aliases; texts go through it
in Arrow batches, where they stand, and the plan is the same for ten aliases and for a million. The list is broadcast up
to MOST_BYTES. A dictionary beyond that stays a table: pieces of text that could be an alias meet it in a hash join, and
the hits of a text come together again. Word characters are Unicode's; an apostrophe before an alias blocks it. Overlaps
are settled longest first, then leftmost, then in dictionary order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..plans.storage import stored
from .automaton import Matcher, folded, listed, pieces, settled

HITS = "array<struct<start: int, end: int, nth: int>>"
#: UTF-8 bytes of the aliases that may be broadcast; an automaton takes some thirty times as much in each worker.
MOST_BYTES = 8 << 20
ALIAS = "nth long, alias string, case_sensitive boolean, brand string, sub_brand string, ambiguous boolean"


@dataclass(frozen=True)
class Brand:
    brand: str
    parent: str | None = None
    type: str = ""
    aliases: tuple[str, ...] = ()
    case_sensitive: bool = False
    ambiguous_aliases: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not set(self.ambiguous_aliases) <= set(self.aliases):
            raise ValueError(f"{self.brand}: ambiguous aliases must be aliases")

    @property
    def ambiguous(self) -> bool:
        return bool(self.ambiguous_aliases)

    @property
    def credit(self) -> tuple[str, str]:
        """(credited brand, sub-brand or "")."""
        return (self.parent, self.brand) if self.parent else (self.brand, "")


def checked(brands: list[Brand]) -> list[Brand]:
    names = {b.brand for b in brands}
    if missing := {b.parent for b in brands if b.parent} - names:
        raise ValueError(f"parents without an entry: {sorted(missing)}")
    return brands


def entries(brands: list[Brand]) -> list[tuple[Brand, str]]:
    return [(b, a) for b in brands for a in b.aliases]


@cache
def _matcher(dictionary: tuple[tuple[int, str, bool], ...]) -> Matcher:
    return Matcher(dictionary)


def _listed(brands: list[Brand], unambiguous_only: bool = False) -> tuple[tuple[int, str, bool], ...]:
    # Aliases that differ only by brand and case rule still are separate entries: the first one wins a tie.
    return tuple((n, a, b.case_sensitive) for n, (b, a) in enumerate(entries(brands)) if not (unambiguous_only and a in b.ambiguous_aliases))


def _by_automaton(text: Column, dictionary: tuple[tuple[int, str, bool], ...], of: Callable[[Matcher, str], object], put: Callable[[list], pa.Array], kind: str) -> Column:
    size = sum(len(a.encode()) for _, a, _ in dictionary)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of aliases are too many to broadcast ({MOST_BYTES}): give the dictionary as a table (all_hits)")
    spark = SparkSession.active()
    ship(spark)
    sent = spark.sparkContext.broadcast(dictionary)

    def run(texts: pa.Array) -> pa.Array:
        m = _matcher(sent.value)
        return put([of(m, t) if t else None for t in texts.to_pylist()])

    return F.arrow_udf(run, kind)(text)


def find_matches(text: Column, brands: list[Brand], unambiguous_only: bool = False) -> Column:
    """Array of struct(start, end, nth) by start; nth is the alias's place in entries(brands). A null text has none."""
    return _by_automaton(text, _listed(brands, unambiguous_only), Matcher.settled, lambda rows: listed([r or [] for r in rows]), HITS)


def names_any(text: Column, brands: list[Brand]) -> Column:
    """Whether any alias occurs: then a prompt is branded. Null for a null text."""
    return F.when(text.isNotNull(), _by_automaton(text, _listed(brands), Matcher.any, lambda rows: pa.array([bool(r) for r in rows]), "boolean"))


def aliases_of(spark: SparkSession, brands: list[Brand]) -> DataFrame:
    """The dictionary as a table of ALIAS: a row for each alias, in order."""
    rows = [(n, a, b.case_sensitive, *b.credit, a in b.ambiguous_aliases) for n, (b, a) in enumerate(entries(brands))]
    return spark.createDataFrame(rows, ALIAS)


def _joined_hits(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Hits of a dictionary of any size: row, struct(start, end, nth), of texts (row, text). Pieces that could be an alias are hash-joined with it."""
    lengths = frozenset(r[0] for r in aliases.select(F.length("alias")).distinct().collect())  # as many as there are lengths
    most = max(lengths, default=0)

    def cut(text: pa.Array) -> pa.Array:
        found = [pieces(t, lengths, most) if t else [] for t in text.to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("piece", pa.string())]))
        return pa.array([[{"start": a, "piece": p} for a, p in r] for r in found], kind)

    fold = F.arrow_udf(lambda a: pa.array([None if x is None else folded(x) for x in a.to_pylist()], pa.string()), "string")
    known = aliases.where("alias <> ''").select(fold(F.col("alias")).alias("piece"), "nth", F.when(F.col("case_sensitive"), F.col("alias")).alias("exact"))
    at = texts.select("row", "text", F.explode(F.arrow_udf(cut, "array<struct<start: int, piece: string>>")(F.col("text"))).alias("p"))
    at = at.select("row", "p.piece", "p.start", F.substring("text", F.col("p.start") + 1, F.length("p.piece")).alias("written"))
    met = at.join(known, "piece").where(F.col("exact").isNull() | (F.col("exact") == F.col("written")))
    return met.select("row", F.struct("start", (F.col("start") + F.length("piece")).alias("end"), F.col("nth").cast("int").alias("nth")).alias("h"))


def _settle(hits: pa.Array) -> pa.Array:
    """Of all hits of each text: of one alias the first from the left, of those that overlap the longest."""
    out = []
    for row in hits.to_pylist():
        ends: dict[int, int] = {}
        kept = []
        for start, end, nth in sorted((h["start"], h["end"], h["nth"]) for h in row or []):
            if ends.get(nth, 0) <= start:
                ends[nth] = end
                kept.append((start, end, nth))
        out.append(settled(kept))
    return listed(out)


def _kept(texts: DataFrame, brands: list[Brand] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with a column h of hits, the dictionary as a table, to be broadcast where its size is known to be small)."""
    if not isinstance(brands, DataFrame):
        aliases = aliases_of(texts.sparkSession, brands)
        if sum(len(a.encode()) for _, a in entries(brands)) <= MOST_BYTES:
            return texts.withColumn("h", F.explode(find_matches(F.col("text"), brands))), F.broadcast(aliases)
    else:
        aliases = brands
        if (aliases.agg(F.sum(F.octet_length("alias"))).first()[0] or 0) <= MOST_BYTES:
            dictionary = tuple(map(tuple, aliases.where("alias is not null").select(F.col("nth").cast("int"), "alias", "case_sensitive").orderBy("nth").collect()))  # of checked size
            found = _by_automaton(F.col("text"), dictionary, Matcher.settled, lambda rows: listed([r or [] for r in rows]), HITS)
            return texts.withColumn("h", F.explode(found)), F.broadcast(aliases)
    rows = stored(texts.withColumn("row", F.monotonically_increasing_id()), "texts")  # so that a row keeps its number
    met = _joined_hits(rows.select("row", "text"), aliases).groupBy("row").agg(F.collect_list("h").alias("hs"))  # as many as fit into one text
    each = met.select("row", F.explode(F.arrow_udf(_settle, HITS)(F.col("hs"))).alias("h"))
    return rows.join(each, "row").drop("row"), aliases


def all_hits(df: DataFrame, brands: list[Brand] | DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("answer_id", "sent_idx")) -> DataFrame:
    """keys, text, brand, sub_brand, alias_matched, char_pos, ambiguous: a row for each match, overlaps settled.

    brands: a list, or a table of ALIAS of any size, nth telling the order of its rows.
    """
    found, aliases = _kept(df.select(*keys, F.col(text_col).alias("text")), brands)
    entry = aliases.select(F.col("nth").cast("int").alias("__nth"), "brand", "sub_brand", "alias", "ambiguous")
    joined = found.withColumn("__nth", F.col("h.nth")).join(entry, "__nth")
    return joined.select(*keys, "text", "brand", "sub_brand", F.col("alias").alias("alias_matched"), F.col("h.start").alias("char_pos"), "ambiguous")


class ReviewNeeded(RuntimeError):
    """Ambiguous hits that nobody has decided yet; rows is the frame of them."""

    def __init__(self, rows: DataFrame, n: int):
        super().__init__(f"review ambiguous hits: {n} new rows")
        self.rows, self.n = rows, n


HIT = ["answer_id", "sent_idx", "alias", "char_pos"]


def _undecided(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """HIT and the hash of the text, for every ambiguous hit without a decision."""
    named = hits.where("ambiguous").withColumnRenamed("alias_matched", "alias").select(*HIT, F.xxhash64("text").alias("h"))
    return named.join(decisions.select(*HIT), HIT, "left_anti")


def decided(hits: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, rows to review). An ambiguous hit counts if its decision is keep; an undecided one is for review.

    Hits meet decisions without their texts; a text that has hits to review is joined to them once, told from others of its place by its hash.
    """
    known = decisions.select(*HIT, F.coalesce("decision", F.lit("")).alias("decision"))
    mentions = hits.drop("text").withColumnRenamed("alias_matched", "alias").join(known, HIT, "left").where(~F.col("ambiguous") | (F.col("decision") == "keep"))
    texts = hits.where("ambiguous").select(F.col("answer_id").alias("a"), F.col("sent_idx").alias("i"), F.col("text").alias("sentence")).distinct().withColumn("of", F.xxhash64("sentence"))
    review = _undecided(hits, decisions).join(texts, F.col("answer_id").eqNullSafe(F.col("a")) & F.col("sent_idx").eqNullSafe(F.col("i")) & (F.col("h") == F.col("of")))
    return (
        mentions.select("answer_id", "sent_idx", "brand", "sub_brand", F.col("alias").alias("alias_matched"), "char_pos"),
        review.select(*HIT, "sentence", F.lit("").alias("decision"), F.lit("").alias("note")),
    )


def gated(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """The mentions, or ReviewNeeded if any ambiguous hit is undecided."""
    mentions, review = decided(hits, decisions)
    if n := _undecided(hits, decisions).count():
        raise ReviewNeeded(review, n)
    return mentions


def brand_counts(pages: DataFrame, brands: list[Brand], text_col: str = "text", key: str = "url") -> DataFrame:
    """key, brand, count, first_pos_ratio over unambiguous aliases; ambiguous ones are out before overlaps are settled."""
    aliases = aliases_of(pages.sparkSession, brands).where("not ambiguous")
    found, entry = _kept(pages.select(key, F.col(text_col).alias("text")), aliases)
    each = found.select(key, F.length("text").alias("size"), F.col("h.nth").alias("__nth"), F.col("h.start").alias("start"))
    credited = each.join(entry.select(F.col("nth").cast("int").alias("__nth"), "brand"), "__nth")
    return credited.groupBy(key, "brand").agg(F.count("*").alias("count"), F.bround(F.min("start") / F.greatest(F.max("size"), F.lit(1)), 4).alias("first_pos_ratio"))
