"""Markdown cleaning and sentence splitting, as column functions.

Answers are cleaned line by line, inside the row. What a line means depends on lines beside it (chips that follow an
icon, soft wraps): never on more than the nearest line that counts, so each line is judged by its place in the array
and nothing is carried along. Time grows with the text, and no pattern repeats a group: Java matches such a repetition by
recursion, so that a long line would end the executor. Where a pattern could start anew at each of many places and run
to the same end, it takes the whole stretch at once instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bound, grouped

ITEM = "• "
ICON_LINE = "\u0000favicon"
# Line classes and abbreviations.
PLUS = r"(?U)^\s*\+\d+\s*$"
RULE_SIGNS, RULE_LINE = r"(?U)[-*_]\s*+[-*_]\s*+[-*_]", r"(?U)^[\s*_-]++$"  # a line of at least three signs
TABLE_LINE, TABLE_CELL = r"(?U)^[\s|:-]++$", r"(?U)^\s*:?-{3,}:?\s*$"  # cells of a rule, between bars
LIST = r"(?U)^\s*(?:[*+\-•]|\d+[.)])\s+"
IMAGE, LINK = r"!\[[^\]]*+\]\([^)]*+\)", r"\[([^\]]*+)\]\([^)]*+\)"
ICON = r"!\[(?:(?=[^\]]*s2/favicons)[^\]]*+\]\([^)]*+\)|[^\]]*+\]\((?=[^)]*s2/favicons)[^)]*+\))"
SITE = r"(?iU)^[\w-][\w.-]*+(?<=\.(?:com|id|org|net|co|io|app))$"  # of labels between single dots
BUTTON = "Add to Favorites"
ABBREVIATIONS = ("p.a", "tbk", "dll", "no", "dsb", "dst", "pt", "jl", "dr", "vs", "e.g", "i.e", "rp", "sdr", "bpk", "ibu", "st")
BREAK = r"""(?U)([.?!]["'”’)\]]*)\s+(?=[A-Z0-9"“(])"""
#: An abbreviation as the last word, with the sign that would end a sentence after it.
SHORTENED = r"(?U)(?:^|\s)(?:" + "|".join(x.replace(".", r"\.") for x in ABBREVIATIONS) + r""")\.*\s*[.?!]["'”’)\]]*$"""
# Inline markup, in the order in which it goes.
INLINE = [
    (r"(?i)<br\s*/?>", " "), (IMAGE, ""), (LINK, "$1"), (r"\*\*|__|`", ""),
    (r"(?U)(?<!\w)\*(?!\s)|(?<!\s)\*(?!\w)", ""), (r"\\([\\`*_{}\[\]()#+\-.!&|~<>])", "$1"), (r"(?U)\s+", " "),
]


#: What Unicode counts as white space.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Stand about a bracket that is passed over, and where there is none, for what is replaced.
PASSED = ("\ufdd2", "\ufdd3")
#: Stand for a line break's tag, without and with a blank inside, while leading ones are looked for: noncharacters, which no text exchanges.
BREAKS = ("\ufdd0", "\ufdd1")


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(x, F.lit(WHITE))


def _bars(x: Column) -> Column:
    return F.btrim(x, F.lit("|"))


def is_rule(line: Column) -> Column:
    """A line of three or more of - * _, and white space."""
    return line.rlike(RULE_LINE) & line.rlike(RULE_SIGNS)


def is_table_rule(line: Column) -> Column:
    """Cells of dashes, each with colons at its ends or none, between bars; outer bars may be missing."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return line.rlike(TABLE_LINE) & F.forall(F.split(inner, r"\|"), lambda c: c.rlike(TABLE_CELL))


def is_site(line: Column) -> Column:
    """Nothing but a site's name."""
    text = strip(line)
    return text.rlike(SITE) & ~text.contains("..")


def _linked(x: Column, pattern: str, new: str) -> Column:
    """Replaces images by new, or links by their text. Only up to the last closing bracket can there be any, and a bracket that opens none is
    passed over together with all that it spans, since what opens inside ends at the same sign."""
    if pattern == LINK:  # whose text is empty where none is passed over
        opening, put, settle = r"\[", "$1$2", lambda y: y
    else:
        opening, put = r"!\[", f"{PASSED[0]}$1{PASSED[1]}"
        settle = lambda y: F.translate(F.replace(y, F.lit("".join(PASSED)), F.lit(new)), "".join(PASSED), "")

    def cut(v: Column) -> Column:
        last = F.length(v) - F.length(F.substring_index(v, ")", -1))
        done = settle(F.regexp_replace(F.substring(v, F.lit(1), last), f"{pattern}|({opening}[^\\]]*+\\]?)", put))
        return F.when(v.contains("]("), F.concat(done, F.substring(v, last + 1, F.length(v)))).otherwise(v)

    return bound(x, cut)


def inline(x: Column) -> Column:
    """Text of one line without inline markup."""
    for pattern, new in INLINE:
        x = _linked(x, pattern, new) if pattern in (IMAGE, LINK) else F.regexp_replace(x, pattern, new)
    return strip(_bars(strip(x)))


def _without_leading_breaks(body: Column) -> Column:
    """Without line breaks' tags, and white space about them, at the beginning of a line.

    A stretch of white space and tags is judged once: from its first line on, it goes up to the white space after its last tag.
    """
    marked = F.regexp_replace(F.regexp_replace(body, r"(?i)<br/?>", BREAKS[0]), r"(?iU)<br\s+/?>", BREAKS[1])
    tags = "".join(BREAKS)
    led = rf"(?U)(\A|(?<![\s{tags}])[[\s{tags}]&&[^\n]]*+\n)[\s{tags}]*[{tags}]\s*+"
    cut = F.replace(F.replace(F.regexp_replace(marked, led, "$1"), F.lit(BREAKS[0]), F.lit("<br>")), F.lit(BREAKS[1]), F.lit("<br />"))
    return F.when(body.rlike("(?i)<br"), cut).otherwise(body)


def _is_marker(line: Column) -> Column:
    return (strip(line) == ICON_LINE) | line.rlike(PLUS) | is_rule(line) | (strip(line) == BUTTON)


def join_soft_wraps(lines: Column) -> Column:
    """Lines of one block as one line, unless a line starts an item, a table row, a heading or a marker.

    A line goes on in the next one unless it is blank, a marker or a table row.
    """

    def judged(line: Column) -> Column:
        text, marker = strip(line), _is_marker(line)
        row = text.startswith("|")
        return F.struct(
            line.alias("line"), text.alias("text"), ((text != "") & ~marker & ~row).alias("open"),
            ((text == "") | marker | row | line.rlike(LIST) | text.startswith("#")).alias("starts"),
        )

    def block(part: Column) -> Column:
        rest = F.transform(F.slice(part, 2, F.size(part)), lambda x: x["text"])
        first = F.element_at(part, 1)
        whole = F.concat_ws(" ", F.rtrim(first["line"], F.lit(WHITE)), F.array_join(rest, " "))
        return F.when(F.size(part) > 1, whole).when(first["text"] == "", "").otherwise(first["line"])

    of = lambda a: grouped(a, lambda x, i: x["starts"] | ~F.get(a, i - 1)["open"])
    return F.transform(bound(F.transform(lines, judged), of), block)


def _line_text(line: Column) -> Column:
    """The clean text of a line that is kept; null if nothing is left."""
    text = strip(line)
    cells = F.filter(F.transform(F.split(_bars(text), r"\|"), inline), lambda c: c != "")
    row = F.array_join(cells, " ")
    item = inline(F.regexp_replace(line, LIST, ""))
    plain = inline(F.regexp_replace(line, r"(?U)^\s*#{1,6}\s*", ""))
    marked = lambda x: bound(x, lambda v: F.when(v != "", F.concat(F.lit(ITEM), v)))
    said = bound(plain, lambda v: F.when((v != "") & ~v.rlike(r"(?U)^\d+[.)]?$") & v.rlike(r"(?U)\w"), v))  # cleaned once, and not for each question
    return F.when(text.startswith("|"), marked(row)).when(line.rlike(LIST), marked(item)).otherwise(said)


def clean_lines(body: Column) -> Column:
    """Array of clean lines; items and table rows start with ITEM."""
    body = _linked(_linked(body, ICON, f"\n{ICON_LINE}\n"), IMAGE, "\n")  # an icon is a line of its own
    body = bound(body, _without_leading_breaks)
    kept = F.filter(join_soft_wraps(F.split(body, "\n")), lambda x: strip(x) != "")

    def judged(a: Column) -> Column:
        return F.transform(
            a,
            lambda x, i: F.struct(
                x.alias("line"), (strip(x) == ICON_LINE).alias("icon"), F.coalesce(F.get(a, i + 1), F.lit("")).rlike(PLUS).alias("counted"),
                ((strip(_bars(strip(x))) == "") | is_site(x)).alias("aside"),
                (_is_marker(x) | is_table_rule(x)).alias("marker"),
                ((word_count(x) <= 4) & ~x.rlike(LIST)).alias("few"),
            ),
        )

    def cleaned(a: Column) -> Column:
        chip = lambda x, i: F.coalesce(F.get(a, i - 1)["icon"], F.lit(False)) & (x["counted"] | x["few"])
        return F.transform(a, lambda x, i: F.when(~x["marker"] & ~chip(x, i), _line_text(x["line"])))

    # lines that stand aside neither show nor count as what comes before a line
    return F.array_compact(bound(F.filter(bound(kept, judged), lambda x: ~x["aside"]), cleaned))


def clean_body(body: Column) -> Column:
    return F.array_join(clean_lines(body), "\n")


def split_paragraph(paragraph: Column) -> Column:
    """Sentences of one line. A piece that ends in an abbreviation goes on in the next. A line feed ends a sentence, too."""

    go_on = lambda piece: F.lower(piece).rlike(SHORTENED)
    pieces = F.split(F.regexp_replace(paragraph, BREAK, "$1\n"), "\n")
    of = lambda a: grouped(a, lambda x, i: ~go_on(F.get(a, i - 1)))
    return F.filter(F.transform(bound(pieces, of), lambda part: strip(F.array_join(part, " "))), lambda s: s != "")


def split_sentences(lines: Column) -> Column:
    """Sentences of clean lines: an item is one sentence."""
    each = F.transform(F.filter(lines, lambda x: strip(x) != ""), lambda x: F.when(x.startswith(ITEM), F.array(strip(F.substr(x, F.lit(len(ITEM) + 1))))).otherwise(split_paragraph(x)))
    return F.flatten(each)


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


def build_sentences(answers: DataFrame, body_col: str = "answer_body", keys: tuple[str, ...] = ("answer_id",)) -> DataFrame:
    """keys, sent_idx (0-based), text, n_words."""
    found = answers.select(*keys, F.posexplode(split_sentences(clean_lines(F.col(body_col)))).alias("sent_idx", "text"))
    return found.withColumn("n_words", word_count(F.col("text")))
