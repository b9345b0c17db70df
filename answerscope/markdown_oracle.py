"""DuckDB SQL of Markdown cleaning over whole documents: lines, soft wraps, markup, sentences, by windows over lines.

RE2 has no lookaround, so single asterisks are judged by their neighbours in a list of characters. Icons of sites, whose
chips are hidden, are left to the queries over constructed answers.
"""

from __future__ import annotations

# Line classes, abbreviations, sentence ends, as in functions.sentences.
WORD = r"[\p{L}\p{M}\p{N}_]"
LIST = r"^\s*(?:[*+\-•]|\d+[.)])\s+"
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$"
SITE = r"(?i)^\s*[\w-]+(\.[\w-]+)*\.(com|id|org|net|co|io|app)\s*$"
SHORT = r"(^|\s)(p\.a|tbk|dll|no|dsb|dst|pt|jl|dr|vs|e\.g|i\.e|rp|sdr|bpk|ibu|st)\.*\s*[.?!][\"''”’)\]]*$".replace('\\"', '"')
BREAK = r"""([.?!]["''”’)\]]*)\s+([A-Z0-9"“(])"""


def _replaced(x: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


def _strip(x: str) -> str:
    return _replaced(x, (r"^\s+|\s+$", ""))


# Lines that are markers.
def _marker(t: str) -> str:
    return rf"(regexp_matches({t}, '^\+\d+$') or regexp_matches({t}, '^([-*_]\s*){{3,}}$') or {t} = 'Add to Favorites')"


def _beside(k: str, pattern: str, edge: str) -> str:
    """Whether a neighbour is missing or no match."""
    return f"({edge} or not regexp_matches(cs[{k}], '{pattern}'))"


_FIRST, _LAST = "j = 1", "j = len(cs)"
_STAR = rf"cs[j] = '*' and (({_beside('j - 1', WORD, _FIRST)} and {_beside('j + 1', '\\s', _LAST)}) or ({_beside('j - 1', '\\s', _FIRST)} and {_beside('j + 1', WORD, _LAST)}))"
_OPENING = _replaced("s", (r"(?i)<br\s*/?>", " "), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\*\*|__|`", ""))
_CLOSING = _replaced("y", (r"\\([\\`*_{}\[\]()#+\-.!&|~<>])", r"\1"), (r"\s+", " "), (r"^\s+|\s+$", ""), (r"^\|+|\|+$", ""), (r"^\s+|\s+$", ""))

SQL = rf"""
with l0 as (select doc_id, unnest(string_split(text, chr(10))) l, unnest(range(len(string_split(text, chr(10))))) i from documents),
l1 as (select *, {_strip("l")} t from l0),
l2 as (select *, t <> '' and not {_marker("t")} and not starts_with(t, '|') more, t = '' or {_marker("t")} or starts_with(t, '|') or starts_with(t, '#') or regexp_matches(l, '{LIST}') fresh from l1),
l3 as (select *, sum(case when fresh or not coalesce(before, false) then 1 else 0 end) over (partition by doc_id order by i) g from (select *, lag(more) over (partition by doc_id order by i) before from l2)),
l4 as (select doc_id, g, list(l order by i) ls, list(t order by i) ts from l3 group by all),
l5 as (select doc_id, g, case when len(ls) > 1 then regexp_replace(ls[1], '\s+$', '') || ' ' || array_to_string(ts[2:], ' ') else ls[1] end x from l4),
l6 as (select *, {_strip("x")} t from l5 where {_strip("x")} <> ''),
l7 as (select *, starts_with(t, '|') tr, regexp_matches(x, '{LIST}') item from l6 where not {_marker("t")} and {_replaced("t", (r"^\|+|\|+$", ""))} <> '' and not regexp_matches(x, '{SITE}') and not regexp_matches(x, '{TABLE_RULE}')),
p0 as (select doc_id, g, tr, item, unnest(c) s, unnest(range(len(c))) k from (select *, case when tr then string_split({_replaced("t", (r"^\|+|\|+$", ""))}, '|') when item then [regexp_replace(x, '{LIST}', '')] else [regexp_replace(x, '^\s*#{{1,6}}\s*', '')] end c from l7)),
p1 as (select *, string_split({_OPENING}, '') cs from p0),
p2 as (select *, array_to_string(list_transform(range(1, len(cs) + 1), lambda j: case when {_STAR} then '' else cs[j] end), '') y from p1),
p3 as (select *, {_CLOSING} z from p2),
q as (select doc_id, g, any_value(tr or item) whole, case when any_value(tr) then array_to_string(list_filter(list(z order by k), lambda c: c <> ''), ' ') else any_value(z) end c from p3 group by doc_id, g),
kept as (select doc_id, g li, whole, c from q where c <> '' and (whole or (not regexp_matches(c, '^\d+[.)]?$') and regexp_matches(c, '{WORD}')))),
ps as (select doc_id, li, unnest(p) x, unnest(range(len(p))) pi from (select doc_id, li, case when whole then [c] else string_split(regexp_replace(c, '{BREAK}', '\1' || chr(10) || '\2', 'g'), chr(10)) end p from kept)),
fl as (select *, regexp_matches(lower(x), '{SHORT}') go from ps),
gr as (select *, coalesce(sum((not go)::int) over (partition by doc_id, li order by pi rows between unbounded preceding and 1 preceding), 0) h from fl),
se as (select doc_id, li, h, {_strip("string_agg(x, ' ' order by pi)")} as "text" from gr group by doc_id, li, h)
select doc_id, row_number() over (partition by doc_id order by li, h) - 1 sent_idx, "text", len(list_filter(string_split_regex("text", '\s+'), lambda w: w <> '')) n_words from se where "text" <> ''
"""
