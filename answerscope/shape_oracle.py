"""DuckDB SQL of the queries over constructed inputs: what must come out, said from how the inputs are made."""

from __future__ import annotations

from .markdown_oracle import SQL as MARKDOWN
from .oracle import BASE, NB, TOKENS

DAY = "strftime(date '2024-01-01' + cast({} as int), '%Y-%m-%d')"


def _text_of(html: str) -> str:
    """Text outside of boilerplate elements, for pages where none of these holds one of its own kind."""
    for name in "script style noscript template svg nav header footer aside form button iframe select title".split():
        html = f"regexp_replace({html}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', '', 'g')"
    inline = "a|b|i|em|strong|span|code|u|small|sup|sub"
    for pattern, new in ((r"(?is)</[a-z][^>]*>|<![^>]*>", "''"), (rf"(?is)<({inline})(\s[^>]*)?>", "''"), (r"(?is)<[a-z][^>]*>", "chr(10)")):
        html = f"regexp_replace({html}, '{pattern}', {new}, 'g')"
    return f"replace({html}, '&nbsp;', ' ')"


PLAIN = _text_of("regexp_replace(html, '(?is)<!--.*?-->', '', 'g')")

SHAPES = {
    "markdown_sentences": MARKDOWN,
    "page_extract": f"""select url, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) title,
  len(list_filter(string_split_regex({PLAIN}, '\\s+'), lambda w: w <> '')) n_words, case when not regexp_matches(html, 'ld.json|<time|<meta[^>]*(date|time)') and not regexp_matches(url, '/[0-9]{{4}}[/-][0-9]{{2}}[/-][0-9]{{2}}') then '' end date_source from pages""",
    "csv_table": """select n_nationkey, case when n_nationkey % 5 <> 0 then n_name || ', "' || n_regionkey || '"' || chr(10) || '.' end label from nation""",
    "json_lines": """select n_nationkey, case when n_nationkey % 3 <> 0 then n_name || '"\\' || chr(10) end label, round(n_nationkey / 8, 6) part from nation""",
    "dictionary": "select * from (values ('Alder', null, 'house', 'Alder|Alder Tea House', true, false, ''), ('sip', 'Alder', 'shop', 'sip of Alder Tea|sip', false, true, 'sip')) v(brand, parent, type, aliases, case_sensitive, ambiguous, ambiguous_aliases)",
    "sheet": "select cast(n_nationkey as varchar) \"key\", case when n_nationkey % 4 <> 0 then n_name else '' end \"name\", 'a & <b>' || chr(13) || chr(10) note from nation",
    "whole_texts": "select r_regionkey region, r_name || chr(10) as \"text\" from region",
    "binary_files": "select r_name || chr(10) body, 'txt' suffix, true keyed from region",
    "crawl_cache": "select user_id as key, event_id, event_type <> 'error' good from events qualify row_number() over (partition by user_id order by event_type <> 'error' desc, ts desc) = 1",
    "hosts": "select 'h' || n_regionkey || '.example' host, count(*) urls, 1 parts from nation group by 1",
    "page_columns": f"""select p_partkey, case when p_partkey % 3 = 1 then '' else {DAY.format("p_size")} end "date",
  case p_partkey % 4 when 0 then least(p_size, 30) when 1 then 30 else 5 end wait,
  case when p_partkey % 6 = 0 then p_name when p_partkey % 5 > 0 then p_brand end body,
  case when p_partkey % 6 = 0 then 'rendered' when p_partkey % 5 > 0 then 'raw' else '' end "source",
  p_partkey % 6 > 1 and p_partkey % 2 = 0 and p_size < 20 render from part""",
    "markdown_answers": """with x as (select p_partkey k, unnest(list_filter(['Part ' || p_partkey, 'The ' || p_name || ' weighs about 2.5 kg p.a. and is cheap.', 'Is it?', '(It is!)', 'See no. 7.', 'Size ' || p_size, 'Type ' || p_type || ' goes on',
    'Key Brand', p_partkey || ' ' || p_brand, case when p_partkey % 2 = 1 and p_partkey % 3 <> 0 then 'A long report on parts of all kinds' end, case when p_partkey % 3 <> 0 then '2_3' end, 'Last 12. line end'], lambda t: t is not null)) t from part),
  y as (select k, t, row_number() over (partition by k) - 1 i from x)
select k answer_id, i sent_idx, t as "text", len(string_split(t, ' ')) n_words from y""",
    "jsonld_fields": f"""select n_name url, n_name || ' & co' title, n_nationkey n_words, case when n_nationkey % 4 in (0, 3) then {DAY.format("n_nationkey")} else '2023-05-06' end published_date,
  case when n_nationkey % 4 in (0, 3) then 'jsonld' else 'meta' end date_source, ['Corporation;NewsArticle;Thing', 'FAQPage;Question', '', 'Report'][n_nationkey % 4 + 1] types from nation""",
    "date_sources": f"""with p as (select p_partkey k, p_partkey % 8 place, {DAY.format("p_size")} d, strftime(date '2024-01-01' + cast(p_size as int), '%Y/%m/%d') u from part)
select 'https://tea.example/' || case when place in (0, 6) then u || '/' else '' end || k url, case when place < 7 then d else '' end published_date,
  case place when 0 then 'jsonld' when 1 then 'meta' when 7 then '' else 'htmldate' end date_source, 3 + [2, 2, 2, 2, 10, 7, 3, 2][place + 1] n_words from p""",
    "pdf_pages": "select r_name url, 'Region ' || r_name || ' has (some) Nations' as \"text\", 4 + len(string_split(r_name, ' ')) n_words, 2 n_pages, '' \"error\" from region",
    "page_table": """with p as (select *, p_partkey k, p_partkey % 7 > 0 f, ['jsonld', 'htmldate', ''][p_partkey % 3 + 1] s from part),
  q as (select *, f and s = 'htmldate' and p_size % 9 <= 3 near, f and k % 13 = 0 soft, case when f then p_size * 3 else 0 end w from p)
select k url, case when f and k % 11 = 0 then 'extract_error: X' when k % 5 = 0 then 'Timeout' else '' end fetch_error, k % 5 > 1 and w >= 50 and not soft is_readable, soft soft_404, w n_words,
  case when f and s <> '' and not near then strftime(date '2025-03-31' - cast(p_size % 9 as int), '%Y-%m-%d') else '' end published_date, case when near then 'htmldate_near_crawl' when f then s else '' end date_source,
  case when not f then '' when k % 2 = 0 then 'FAQPage;Report' else 'Corporation' end schema_types, f and k % 2 = 0 has_article_schema, f and k % 2 = 0 has_faq_schema, f and k % 2 = 1 has_org_schema,
  case when not f then '' when soft then 'Page not found' else p_name end title from q""",
    "answer_ids": "select o_orderkey, lower(o_orderstatus) || '-' || format('{:02d}', o_custkey) answer_id, 'a' || chr(10) || 'b' || o_orderkey || chr(10) || 'c' || chr(10) as \"raw\" from orders",
    "listed_names": """with l as (select n_regionkey, list_sort(list(n_name)) n from nation group by 1)
select n_regionkey, case when len(n) < 2 then n[1] else array_to_string(n[:len(n) - 1], ', ') || ' and ' || n[len(n)] end "names", n[1] "first" from l""",
    "unknown_numbers": r"""with t as (select distinct unnest(regexp_extract_all(p_size || ' of ' || (p_partkey % 50) || '.5, or 1,000. In 7%', '\d[\d.,]*\d|\d')) number from part)
select number from t where number not in (select cast(n_nationkey as varchar) from nation) and number not in (select n_nationkey || '.5' from nation)""",
    "wrapped_links": "select n_nationkey answer_id, 'https://b.example' url from nation union all select n_nationkey, 'https://n' || n_nationkey || '.example/p?a=' || n_nationkey from nation where n_nationkey % 3 > 0",
    "deep_redirects": "select n_nationkey, 'https://n.example/p' || n_nationkey url from nation",
    "review_rows": TOKENS + "select doc_id answer_id, alias, cast(pos as bigint) char_pos, len(text) size from hits join documents using (doc_id) where alias = 'la' and doc_id % 3 = 2",
    "reviewed_mentions": TOKENS + "select brand, alias alias_matched, count(*) n, cast(sum(pos) as bigint) positions from hits join br using (alias) where alias <> 'la' or doc_id % 3 = 0 group by all",
    "ambiguous_by_decision": TOKENS + "select alias, case when doc_id % 3 = 0 then 'keep' else 'reject' end decision, count(*) hits from hits where alias = 'la' group by all",
    "report_unreadable": BASE + """, o as (select url, case when soft_404 then 'soft 404 (error page with status 200)' when fetch_error is not null then split_part(fetch_error, ':', 1) when http_status <> 200 then 'HTTP ' || http_status else 'fewer than 50 words of text' end why from pages where not is_readable)
select row_number() over (order by url) place, '| ' || url || ' | ' || why || ' |' line from o union all values (-2, '| URL | Reason |'), (-1, '|---|---|')""",
    "markdown_rows": "select r_regionkey + 2 place, '| ' || r_regionkey || ' | ' || case when r_regionkey = 2 then '' else r_name end || ' |' line from region union all values (0, '| key | name |'), (1, '|---|---|')",
    "grid_totals": BASE + "select (select count(distinct prompt_no) from answers) prompts, (select count(distinct pillar) from answers) pillars, (select count(distinct intent) from answers) intents, (select count(*) from part where p_size % 7 <> 0 and p_size > 10) rendered_pages",
    "label_lookup": BASE + NB + "select round(r, 6) no_brand_rate from nb where engine = 'O' and intent = 'BUILDING'",
    "line_counts": """select doc_id, cast(list_sum(list_transform(string_split(text, chr(10)), lambda p: list_reduce(list_prepend({'n': 1, 'used': 0::bigint}, list_transform(string_split(p, ' '), lambda w: {'n': 0, 'used': len(w)})),
  lambda acc, x: case when acc.used = 0 then {'n': acc.n, 'used': x.used} when acc.used + 1 + x.used <= 40 then {'n': acc.n, 'used': acc.used + 1 + x.used} else {'n': acc.n + 1, 'used': x.used} end).n)) as bigint) lines from documents""",
}
