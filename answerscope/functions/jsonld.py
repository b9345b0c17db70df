"""JSON-LD of pages by VARIANT: all types and publication dates at any depth, without Python.

Blocks are parsed once; a level of all blocks is exploded at a time, LEVELS in a plan, until nothing is left. Rows that are
settled pass on through later levels. A variant knows what is text and what is structure, but keeps no order of keys; that
comes from the block's own text, which goes along, so that dates keep the order in which the document says them: a node's
own first, then those of its parts. A block that is no JSON is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .pages import ISO
from .sentences import strip

BLOCK = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
META = r"""(?is)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*["']?article:published_time["'\s>])[^>]*?\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
#: Levels in a plan, before it is stored and looked at.
LEVELS = 8


def _blocks(pages: DataFrame, key: str, html: Column) -> DataFrame:
    blocks = pages.select(F.col(key).alias("page"), F.posexplode(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1))).alias("block", "text"))
    parsed = blocks.select("page", F.array("block").alias("path"), F.lit("").alias("own"), "text", F.try_parse_json("text").alias("v"), F.lit(False).alias("settled"))
    return parsed.where(F.col("v").isNotNull())


def _next_level(rows: DataFrame) -> DataFrame:
    """Every row that isn't settled gives way to its parts, or is settled if it has none; only what says a type or a date is kept then."""
    open_ = lambda c: F.when(~F.col("settled"), c)
    texts = rows.withColumns({"members": open_(F.from_json("text", "map<string,string>")), "items": open_(F.from_json("text", "array<string>")), "live": open_(F.col("v"))})
    each = texts.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("live").outer()))
    part, named = F.col("pos").isNotNull(), F.col("key").isNotNull()
    place = F.when(~named, F.col("pos")).when(F.col("key") == "datePublished", -1).otherwise(F.array_position(F.map_keys("members"), F.col("key")).cast("int"))
    text = F.when(named, F.try_element_at("members", F.col("key"))).otherwise(F.get("items", F.col("pos")))
    own = F.when(named, F.col("key")).when(part & (F.col("own") != "@type"), "").otherwise(F.col("own"))  # a list of types says each of them
    kept = part | F.col("own").isin("@type", "datePublished")
    return each.where(kept).select(
        "page", F.when(part, F.concat("path", F.array(place))).otherwise(F.col("path")).alias("path"), own.alias("own"), F.when(part, text).alias("text"), F.when(part, F.col("value")).otherwise(F.col("v")).alias("v"), (~part).alias("settled")
    )


def walked(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """page, types (sorted, distinct), dates: a row for every page with a type or a date."""
    rows = _blocks(pages, key, html)
    while True:
        for _ in range(LEVELS):
            rows = _next_level(rows)
        rows = stored(rows, "jsonld_rows")
        if not rows.where("not settled").limit(1).count():
            break
    said = rows.where(~F.schema_of_variant("v").rlike("^(ARRAY|OBJECT)")).select("page", "path", "own", F.try_variant_get("v", "$", "string").alias("said")).where("said <> ''")
    dates = F.sort_array(F.collect_list(F.when(F.col("own") == "datePublished", F.struct("path", "said"))))
    return said.groupBy("page").agg(F.array_sort(F.collect_set(F.when(F.col("own") == "@type", F.col("said")))).alias("types"), F.transform(dates, lambda x: x["said"]).alias("dates"))


def fields(pages: DataFrame, key: str = "url", html_col: str = "html") -> DataFrame:
    """key, types, published_date, date_source: the first date of JSON-LD, else that of the article's meta tag."""
    html = F.col(html_col)
    iso = lambda x: F.regexp_extract(strip(x), ISO, 1)
    meta = iso(F.concat(*[F.regexp_extract(html, META, k) for k in (1, 2, 3)]))
    said = walked(pages, key, html).withColumnRenamed("page", key)
    first = F.get(F.filter(F.transform(F.coalesce("dates", F.array()), iso), lambda d: d != ""), F.lit(0))
    rows = pages.select(key, F.coalesce(meta, F.lit("")).alias("meta")).join(said, key, "left")
    date = F.coalesce(first, F.col("meta"))
    source = F.when(first.isNotNull(), "jsonld").when(F.col("meta") != "", "meta").otherwise("")
    return rows.select(key, F.coalesce("types", F.expr("cast(array() as array<string>)")).alias("types"), date.alias("published_date"), source.alias("date_source"))
