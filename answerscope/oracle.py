"""The queries in DuckDB SQL, written from the definitions and not from the plans."""

from __future__ import annotations

BASE = """
with ln as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as sent_idx from lineitem),
answers as (select o_orderkey answer_id, o_orderstatus engine, o_custkey prompt_no, o_orderpriority pillar, c_mktsegment intent from orders left join customer on o_custkey = c_custkey),
sentences as (select l_orderkey answer_id, sent_idx, cast(l_quantity as int) n_words from ln),
mentions as (select l_orderkey answer_id, sent_idx, p_brand brand, p_type sub_brand from ln join part on l_partkey = p_partkey
  union all select l_orderkey, sent_idx, p_brand, p_type from ln join part on l_partkey = p_partkey where l_quantity > 25),
sentiment as (select answer_id, brand, label, case label when 'positive' then 1 when 'negative' then -1 else 0 end score from (
  select l_orderkey answer_id, p_brand brand, case when count(distinct l_returnflag) > 1 then 'mixed' when min(l_returnflag) = 'A' then 'positive' when min(l_returnflag) = 'R' then 'negative' else 'neutral' end label
  from lineitem join part on l_partkey = p_partkey group by all)),
citations as (select l_orderkey answer_id, o_orderstatus engine, row_number() over (partition by l_orderkey order by f) as rank, 'https://www.d' || (l_partkey % 40) || '.example/p' || l_partkey url, 'd' || (l_partkey % 40) || '.example' as domain
  from (select l_orderkey, l_partkey, min(sent_idx) f from ln group by all) join orders on l_orderkey = o_orderkey),
domains as (select 'd' || n_nationkey || '.example' as domain, r_name domain_type, case n_nationkey % 3 when 0 then 'High' when 1 then 'Medium' else 'Low' end authority_tier from nation join region on n_regionkey = r_regionkey),
pg as (select *, case p_size % 10 when 0 then 404 when 1 then 403 when 2 then null else 200 end http_status from part),
pages as (select 'https://www.d' || (p_partkey % 40) || '.example/p' || p_partkey url, http_status, case when p_size % 10 = 2 then 'Timeout: read' end fetch_error, case when p_size % 7 = 0 then 'pdf' else 'html' end content_kind,
  p_size % 11 = 0 and coalesce(http_status, 0) = 200 soft_404, coalesce(http_status, 0) = 200 and p_size * 10 >= 50 and p_size % 11 <> 0 is_readable,
  case when p_partkey % 7 <> 0 then date '2026-10-09' - cast(p_partkey % 700 as int) end published_date, ['jsonld', 'meta', 'htmldate'][p_partkey % 3 + 1] date_source,
  ['', 'NewsArticle;Organization', 'FAQPage', 'WebPage', 'BankOrCreditUnion;Report'][p_partkey % 5 + 1] schema_types from pg),
page_brand_counts as (select 'https://www.d' || (p_partkey % 40) || '.example/p' || p_partkey url, p_brand brand, p_size as "count" from part
  union all select 'https://www.d' || (p_partkey % 40) || '.example/p' || p_partkey, 'Side#' || (p_partkey % 4), p_size % 5 + 1 from part where p_partkey % 3 = 0),
answers_all as (select answer_id, engine, prompt_no, pillar, intent from answers union all select answer_id, 'All', prompt_no, pillar, intent from answers),
weights as (select answer_id, sent_idx, count(*) over w n_sents, n_words * exp(-sent_idx / (count(*) over w)) / (sum(n_words) over w) wt from sentences window w as (partition by answer_id)),
pawc as (select answer_id, brand, sum(wt) pawc from (select distinct answer_id, sent_idx, brand from mentions) join weights using (answer_id, sent_idx) group by all),
firsts as (select m.answer_id, brand, min(m.sent_idx) / max(n_sents) first_pos from mentions m join weights using (answer_id) group by all),
cited as (select c.*, prompt_no, pillar, domain_type, authority_tier from citations c join answers a on c.answer_id = a.answer_id left join domains d on c.domain = d.domain),
cited_all as (select * from cited union all select * replace ('All' as engine) from cited)
"""

BIG = "cast({0} as bigint) {0}"


def _brands(cut: str | None) -> str:
    k = ["engine", *([cut] if cut else [])]
    ks, on = ", ".join(k), ", ".join([*k, "brand"])
    return f""", gn as (select {ks}, count(*) n from answers_all group by all),
gr as (select * from gn cross join (select distinct brand from mentions)),
gm as (select {on}, count(distinct answer_id) na, count(*) nm from mentions join answers_all using (answer_id) group by all),
gt as (select {ks}, count(*) t from mentions join answers_all using (answer_id) group by all),
gp as (select {on}, sum(pawc) sp from pawc join answers_all using (answer_id) group by all),
gf as (select {on}, avg(first_pos) fp from firsts join answers_all using (answer_id) group by all),
gs as (select {on}, avg(score) sm, count(*) filter (label = 'positive') p, count(*) filter (label = 'neutral') u, count(*) filter (label = 'negative') g, count(*) filter (label = 'mixed') x from sentiment join answers_all using (answer_id) group by all),
bt as (select {on}, n, coalesce(na, 0) n_answers_mentioning, coalesce(na, 0) / n mention_rate, coalesce(nm, 0) ai_mentions, coalesce(coalesce(nm, 0) / t, 0) ai_sov,
  coalesce(sp, 0) / n pawc, fp first_mention_pos, sm sentiment_mean, coalesce(p, 0) n_pos, coalesce(u, 0) n_neu, coalesce(g, 0) n_neg, coalesce(x, 0) n_mixed
  from gr left join gt using ({ks}) left join gm using ({on}) left join gp using ({on}) left join gf using ({on}) left join gs using ({on}))"""


def _brand_rows(cut: str | None) -> str:
    keys = f"engine, {cut}, brand" if cut else "engine, brand"
    return BASE + _brands(cut) + f"""select {keys}, n, n_answers_mentioning, round(mention_rate, 6) mention_rate, ai_mentions, round(ai_sov, 6) ai_sov, round(pawc, 6) pawc,
  round(first_mention_pos, 6) first_mention_pos, round(sentiment_mean, 6) sentiment_mean, n_pos, n_neu, n_neg, n_mixed from bt"""


PILLARS = """, pa as (select * from answers where prompt_no not in (select prompt_no from answers where intent = 'MACHINERY')),
pn as (select pillar, count(*) n from pa group by 1),
pc as (select pillar, brand, n, count(distinct answer_id) named from mentions join pa using (answer_id) join pn using (pillar) group by 1, 2, 3)
"""

SOV = """, ok as (select url from pages where is_readable), pb as (select * from page_brand_counts where url in (select url from ok)),
ps as (select brand, sum("count" / tot) s, sum("count") c, count(distinct url) p from (select *, sum("count") over (partition by url) tot from pb) group by 1),
am as (select brand, count(*) m from mentions group by 1),
aw as (select brand, sum(k / t) / (select count(distinct answer_id) from mentions) w from (select *, sum(k) over (partition by answer_id) t from (select answer_id, brand, count(*) k from mentions group by all)) group by 1),
sov as (select brand, coalesce(w, 0) ai_sov_weighted, coalesce(s / (select count(distinct url) from pb), 0) source_sov, coalesce(m / (select count(*) from mentions), 0) ai_sov,
  coalesce(c / (select sum("count") from pb), 0) source_sov_raw, coalesce(m, 0) ai_mentions, coalesce(c, 0) source_count, coalesce(p, 0) n_pages, (select count(distinct url) from pb) n_pages_with_brands, (select count(*) from ok) n_readable_pages
  from ps full join am using (brand) full join aw using (brand))
"""

FACTS = """, pf as (select url, regexp_replace(split_part(url, '/', 3), '^www\\.', '') as domain, is_readable, content_kind, schema_types,
  case when is_readable then 'readable' when soft_404 then 'soft_404' when fetch_error is not null then split_part(fetch_error, ':', 1) when http_status <> 200 then 'http_' || http_status else 'too_little_text' end reason,
  case when published_date is null then 'unknown' when date '2026-10-09' - published_date <= 30 then '0-30' when date '2026-10-09' - published_date <= 180 then '31-180' when date '2026-10-09' - published_date <= 365 then '181-365' else '>365' end grp, date_source from pages),
pd as (select pf.*, case when date_source in ('jsonld', 'meta') then grp else 'unknown' end grp_s, domain_type from pf left join domains using (domain))
"""

RECENCY = FACTS + """, cr as (select engine, domain_type, grp, grp_s from citations join pd using (url) where is_readable),
cb as (select engine, domain_type, 'all dates' basis, grp g from cr union all select engine, domain_type, 'structured dates only', grp_s from cr),
rv as (select 'engine' cut, engine v, basis, g from cb union all select 'engine', 'All', basis, g from cb union all select 'domain_type', domain_type, basis, g from cb where domain_type is not null union all select 'domain_type', 'All', basis, g from cb),
rec as (select cut, v "value", basis, g as "group", count(*) citations, count(*) / sum(count(*)) over (partition by cut, v, basis) share, cast(sum(count(*)) over (partition by cut, v, basis) as bigint) n from rv group by cut, v, basis, g)
"""

AUTH = """, av as (select c.answer_id, case authority_tier when 'High' then 1.0::double when 'Medium' then 0.7::double when 'Low' then 0.4::double end v from citations c left join domains using (domain)),
auth as (select engine, brand, avg(v) authority from (select distinct answer_id, engine, brand from mentions join answers_all using (answer_id)) left join av using (answer_id) group by all)
"""

VIS = _brands(None) + AUTH + """, dv as (select brand, count(distinct engine) / 3 diversity from mentions join answers using (answer_id) group by 1),
vs as (select brand, engine, n_answers_mentioning n_answers, n_answers_mentioning < 3 low_n, pawc, coalesce(pawc / nullif(max(pawc) over (partition by engine), 0), 0) pawc_norm, authority, (sentiment_mean + 1) / 2 sentiment_norm, diversity
  from bt join auth using (engine, brand) join dv using (brand) where n_answers_mentioning > 0)
"""

PAGES = """, pt as (select url, domain, count(*) citations, count(*) filter (engine = 'F') f, count(*) filter (engine = 'O') o, count(*) filter (engine = 'P') p, string_agg(distinct engine, '+' order by engine) engines,
  row_number() over (order by count(*) desc, url) as "rank", (select count(*) from cited) n from cited group by url, domain)
"""

DOMAINS = """, dt as (select domain, domain_type, authority_tier, count(*) citations, count(distinct url) unique_pages, count(distinct prompt_no) prompts, count(distinct answer_id) answers, avg(rank) avg_rank,
  count(*) filter (engine = 'F') f, avg(rank) filter (engine = 'F') avg_rank_f, count(distinct url) filter (engine = 'F' and is_readable) readable_pages_f,
  count(*) filter (engine = 'O') o, avg(rank) filter (engine = 'O') avg_rank_o, count(distinct url) filter (engine = 'O' and is_readable) readable_pages_o,
  count(*) filter (engine = 'P') p, avg(rank) filter (engine = 'P') avg_rank_p, count(distinct url) filter (engine = 'P' and is_readable) readable_pages_p, (select count(*) from cited) n
  from cited join pages using (url) where domain_type is not null group by 1, 2, 3)
"""

MIX = """, pv as (select engine, pillar, domain_type from cited_all union all select engine, 'All', domain_type from cited_all),
mx as (select engine, pillar, domain_type, count(*) citations, n from pv join (select engine, pillar, count(*) n from pv group by all) using (engine, pillar) where domain_type is not null group by engine, pillar, domain_type, n)
"""

NB = """, nb as (select engine, i intent, count(*) n, avg(case when answer_id in (select answer_id from mentions) then 0 else 1 end) r
  from (select answer_id, engine, intent i from answers_all union all select answer_id, engine, 'All' from answers_all) group by all)
"""

WRAPPED = ", wr as (select answer_id, url from citations where rank = 1)"

SQL = {
    "brand_engine": _brand_rows(None),
    "brand_pillar": _brand_rows("pillar"),
    "brand_intent": _brand_rows("intent"),
    "sentence_weights": BASE + "select answer_id, sent_idx, n_sents, round(wt, 6) w from weights",
    "brand_pawc": BASE + "select answer_id, brand, round(pawc, 6) pawc from pawc",
    "answer_brands": BASE + "select answer_id, brand, n ai_mentions, round(pawc, 6) pawc, round(first_pos, 6) first_mention_pos from (select answer_id, brand, count(*) n from mentions group by all) join pawc using (answer_id, brand) join firsts using (answer_id, brand)",
    "no_brand_rate": BASE + NB + "select engine, intent, n, round(r, 6) no_brand_rate from nb",
    "ai_sov_weighted": BASE + SOV + "select brand, round(w, 6) ai_sov_weighted from aw",
    "domains": BASE + DOMAINS + "select * replace (round(avg_rank, 6) as avg_rank, round(avg_rank_f, 6) as avg_rank_f, round(avg_rank_o, 6) as avg_rank_o, round(avg_rank_p, 6) as avg_rank_p) from dt",
    "pages_top": BASE + PAGES + "select * from pt",
    "cross_engine_pages": BASE + PAGES + "select * from pt where f > 0 and o > 0 and p > 0",
    "domain_type_mix": BASE + MIX + "select engine, pillar, domain_type, citations, round(citations / n, 6) share, n from mx",
    "authority_mix": BASE + ", t as (select engine, count(*) n from cited_all group by 1) select engine, authority_tier, count(*) citations, round(count(*) / n, 6) share, n from cited_all join t using (engine) where authority_tier is not null group by engine, authority_tier, n",
    "concentration": BASE + ", c as (select engine, domain, count(*) k from cited_all group by all), r as (select *, row_number() over (partition by engine order by k desc, domain) i, sum(k) over (partition by engine) n from c) select engine, round(sum(k) / n, 6) top5_share, cast(n as bigint) n from r where i <= 5 group by engine, n",
    "source_sov": BASE + SOV + "select brand, round(ai_sov_weighted, 6) ai_sov_weighted, round(source_sov, 6) source_sov, round(ai_sov_weighted - source_sov, 6) sov_gap, round(ai_sov, 6) ai_sov, round(source_sov_raw, 6) source_sov_raw, round(ai_sov - source_sov_raw, 6) sov_gap_raw, ai_mentions, cast(source_count as bigint) source_count, n_pages, n_pages_with_brands, n_readable_pages from sov",
    "unreadable_reason": BASE + FACTS + "select url, domain, reason, grp as \"group\", grp_s group_structured from pd",
    "readability": BASE + FACTS + """, rp as (select 'domain_type' cut, domain_type v, reason, 'pages' unit from pd where domain_type is not null union all select 'domain_type', 'All', reason, 'pages' from pd
  union all select 'engine', engine, reason, 'citations' from citations left join pd using (url) union all select 'engine', 'All', reason, 'citations' from citations left join pd using (url))
select cut, v "value", reason, count(*) as "count", unit, round(count(*) / sum(count(*)) over (partition by cut, v), 6) share, cast(sum(count(*)) over (partition by cut, v) as bigint) n from rp group by cut, v, reason, unit""",
    "recency": BASE + RECENCY + "select * replace (round(share, 6) as share) from rec where cut = 'engine' or \"value\" <> 'All' union all select * replace (round(share, 6) as share) from rec where cut = 'domain_type' and \"value\" = 'All'",
    "schema": BASE + FACTS + """, h as (select domain_type dt, schema_types st from pd where is_readable and content_kind = 'html'), ha as (select dt, st from h where dt is not null union all select 'All', st from h)
select dt domain_type, count(*) n, round(avg((st <> '')::int), 6) any_jsonld, round(avg((st like '%Article%' or st like '%BlogPosting%' or st like '%Report%')::int), 6) article, round(avg((st like '%FAQPage%')::int), 6) faq,
  round(avg((st like '%Organization%' or st like '%BankOrCreditUnion%' or st like '%FinancialService%' or st like '%Corporation%')::int), 6) org from ha group by 1""",
    "authority": BASE + AUTH + "select engine, brand, round(authority, 6) authority from auth",
    "vis": BASE + VIS + "select brand, engine, n_answers, low_n, round(pawc, 6) pawc, round(pawc_norm, 6) pawc_norm, round(authority, 6) authority, round(sentiment_norm, 6) sentiment_norm, round(diversity, 6) diversity, round(100 * (pawc_norm + authority + sentiment_norm + diversity) / 4, 6) vis from vs where engine = 'All'",
    "vis_engine": BASE + VIS + "select brand, engine, n_answers, low_n, round(pawc, 6) pawc, round(pawc_norm, 6) pawc_norm, round(authority, 6) authority, round(sentiment_norm, 6) sentiment_norm, cast(null as double) diversity, round(100 * (pawc_norm + authority + sentiment_norm) / 3, 6) vis from vs where engine <> 'All'",
    "row_counts": BASE + """select 'answers' item, count(*) n from answers union all select 'sentences', count(*) from sentences union all select 'mentions', count(*) from mentions union all select 'citations', count(*) from citations
union all select 'pages', count(*) from pages union all select 'readable_pages', count(*) from pages where is_readable union all select 'readable_pages_with_brand', count(distinct url) from page_brand_counts where url in (select url from pages where is_readable)""",
    "brands_by_engine": BASE + "select engine, count(distinct brand) brands from mentions join answers using (answer_id) group by 1",
    "leader_gap": BASE + _brands(None) + "select engine, brand, round(mention_rate, 6) mention_rate, dense_rank() over (partition by engine order by mention_rate desc) place, round(max(mention_rate) over (partition by engine) - mention_rate, 6) gap from bt",
    "pillar_counts": BASE + PILLARS + "select pillar, brand, n, named, round(named / n, 6) mention_rate from pc",
    "pillar_leaders": BASE + PILLARS + "select pillar, string_agg(brand, '+' order by brand) leaders, named from pc where named = (select max(named) from pc x where x.pillar = pc.pillar) group by pillar, named",
    "pillar_heatmap": BASE + PILLARS + ", v as (select pillar, brand, round(named / n, 6) r from pc) select pillar, coalesce(max(r) filter (brand = 'Brand#1'), 0) as \"Brand#1\", coalesce(max(r) filter (brand = 'Brand#2'), 0) as \"Brand#2\", coalesce(max(r) filter (brand = 'Brand#3'), 0) as \"Brand#3\" from v group by 1",
    "sentiment_counts": BASE + "select count(*) filter (label = 'positive') positive, count(*) filter (label = 'neutral') neutral, count(*) filter (label = 'mixed') mixed, count(*) filter (label = 'negative') negative, count(*) pairs from sentiment",
    "intent_named_share": BASE + NB + "select intent, round(1 - r, 6) named_share, n from nb where engine = 'All' and intent <> 'All'",
    "source_mix": BASE + MIX + "select engine, string_agg(domain_type || '=' || citations, ',' order by domain_type || '=' || citations) counts, round(sum(citations / n), 6) labelled_share from mx where pillar = 'All' and engine <> 'All' group by 1",
    "overlap_jaccard": BASE + """, s as (select 'sites' what, domain k, engine from citations union all select 'pages', url, engine from citations), x as (select what, k, bool_or(engine = 'F') a, bool_or(engine = 'O') b from s group by all),
y as (select what, count(*) filter (a and b) "both", count(*) filter (a and not b) first_only, count(*) filter (b and not a) second_only from x group by 1) select *, "both" + first_only + second_only total, round("both" / ("both" + first_only + second_only), 6) jaccard from y""",
    "top_sites": BASE + DOMAINS + "select domain, domain_type, citations, f, o, p from dt order by citations desc, domain limit 12",
    "top_pages": BASE + PAGES + "select url, domain, citations, f, o, p from pt order by citations desc, url limit 8",
    "top_page_by_domain": BASE + PAGES + "select domain, url, citations from pt qualify row_number() over (partition by domain order by citations desc, url) = 1",
    "sov_gap_top": BASE + SOV + "select brand, round(ai_sov_weighted, 6) ai_sov_weighted, round(source_sov, 6) source_sov, round(ai_sov_weighted - source_sov, 6) sov_gap from sov where ai_mentions > 0 order by sov.ai_sov_weighted desc, brand limit 8",
    "dead_links_2x2": BASE + WRAPPED + """, l as (select (answer_id, url) in (select (answer_id, url) from wr) w, url in (select url from pages where http_status = 404 or soft_404) d from citations where engine = 'F')
select count(*) filter (w and d) wrapped_dead, count(*) filter (w) wrapped, count(*) filter (not w and d) direct_dead, count(*) filter (not w) direct from l""",
    "citations_per_answer": BASE + "select n, count(*) answers from (select answer_id, count(*) n from citations group by 1) group by 1",
    "mode_citations": BASE + "select n as \"mode\" from (select answer_id, count(*) n from citations group by 1) group by n order by count(*) desc, n limit 1",
    "prompt_grid": BASE + "select pillar, intent, count(distinct prompt_no) prompts, count(*) answers from answers group by all",
    "dated_citations": BASE + RECENCY + "select max(n) readable_citations, cast(sum(citations) filter (\"group\" <> 'unknown') as bigint) dated_citations from rec where cut = 'engine' and \"value\" = 'All' and basis = 'structured dates only'",
    "compare_prompt": BASE + "select engine, string_agg(distinct brand, '+' order by brand) brands from mentions join answers using (answer_id) where prompt_no = 13 group by 1",
    "expected_counts": BASE + "select (select count(*) from answers) answers, count(*) citations, count(distinct url) unique_urls, count(distinct domain) domains from citations",
    "contracts_observed": BASE + """, a as (select answer_id from answers where engine <> 'P' union all select answer_id from answers where engine <> 'P' and prompt_no % 10 = 0),
an as (select answer_id, count(*) n from a group by 1), bs as (select answer_id, sent_idx from sentences where sent_idx <> 1 union all select answer_id, sent_idx from sentences where sent_idx = 2),
sn as (select answer_id, sent_idx, count(*) n from bs group by all), ms as (select m.*, coalesce(n, 0) n from mentions m left join sn using (answer_id, sent_idx) where brand is not null),
lb as (select domain, domain_type from domains where domain_type <> 'EUROPE' union all select domain, domain_type from domains where domain_type = 'ASIA'),
ld as (select domain, count(*) n from lb group by 1)
select 'answers_repeated' contract, cast(coalesce((select sum(n) from an where n > 1), 0) as bigint) n
union all select 'answers_without_id', (select count(*) from a where answer_id is null)
union all select 'citations_of_repeated_labels', (select count(*) from citations join ld using (domain) where n > 1)
union all select 'citations_unlabelled', (select count(*) from citations where domain not in (select domain from ld))
union all select 'citations_without_answer', (select count(*) from citations where answer_id not in (select answer_id from a))
union all select 'mentions_of_repeated_sentences', (select count(*) from ms where n > 1)
union all select 'mentions_without_sentence', (select count(*) from ms where n = 0)
union all select 'rows:answer_brands', (select count(*) from (select distinct answer_id, brand from ms))
union all select 'rows:labelled', (select count(*) from citations where answer_id in (select answer_id from a))""",
    "mentions_without_answer": BASE + "select distinct answer_id from mentions where answer_id not in (select answer_id from answers where engine <> 'P')",
    "override_by_key": BASE + "select answer_id, prompt_no, case when pillar = '5-LOW' then 'changed' else pillar end pillar from answers",
    "unpivot_engines": "select c_custkey, 'F' engine, c_name as text from customer union all select c_custkey, 'O', c_mktsegment from customer",
    "wrapped_mark": BASE + WRAPPED + "select answer_id, rank, url, rank = 1 wrapped from citations",
    "cache_merge_newest_good": "select user_id as key, event_id, event_type <> 'error' good from events qualify row_number() over (partition by user_id order by event_type <> 'error' desc, ts desc) = 1",
    "rate_maps": BASE + _brands(None) + "select brand, string_agg(engine || '=' || n_answers_mentioning, ',' order by engine) answers from bt where n_answers_mentioning > 0 group by 1",
    "exclusive_brands": BASE + "select brand || '/' || prompt_no brand, min(engine) engine from mentions join answers using (answer_id) group by 1 having count(distinct engine) = 1",
    "top_brands": BASE + _brands(None) + "select engine, row_number() over (partition by engine order by mention_rate desc, brand) place, brand, round(mention_rate, 6) mention_rate from bt qualify place <= 5",
    "domain_focus": BASE + ", f(domain) as (values ('d1.example'), ('d39.example'), ('none.example')) select f.domain, count(url) citations, count(distinct answer_id) answers from f left join citations c on f.domain = c.domain and engine = 'O' group by 1",
    "share_sum": BASE + MIX + "select engine, round(sum(citations / n), 6) share from mx where pillar = 'All' and domain_type in ('ASIA', 'EUROPE') group by 1",
    "schema_by_type": BASE + FACTS + "select domain_type, count(*) n, round(avg((schema_types <> '')::int), 6) any_jsonld from pd where is_readable and content_kind = 'html' and domain_type is not null group by 1",
    "crawl_outcomes": BASE + """select case when is_readable then 'readable' when soft_404 then 'soft 404 (error page with status 200)' when fetch_error is not null then split_part(fetch_error, ':', 1) when http_status <> 200 then 'HTTP ' || http_status else 'fewer than 50 words of text' end outcome, count(*) pages from pages group by 1""",
    "readable_shares": BASE + "select count(*) filter (is_readable) readable, count(*) pages, round(avg(is_readable::int), 6) page_share, (select round(avg(is_readable::int), 6) from citations join pages using (url)) citation_share from pages",
    "odd_citations": BASE + "select answer_id, count(*) n from citations group by 1 having count(*) <> 4",
    "pillars_in_order": "select p pillar, i place, (select count(*) from orders where o_orderstatus = 'F' and o_orderpriority = p) n from (values (0, '5-LOW'), (1, '1-URGENT'), (2, '9-NONE')) v(i, p)",
    "repeated_citations": BASE + "select answer_id, domain, count(*) n from citations group by all having count(*) > 1",
    "incremental_anti": "select c_custkey as key from customer where c_custkey not in (select user_id from events where event_type <> 'error' and user_id is not null)",
}

# Text queries. RE2 has no lookaround, so matching works on runs of word and other characters.
TOKENS = r"""
with ws as (select doc_id, unnest(t) w, unnest(range(len(t))) i from (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+') t from documents)),
tk as (select *, coalesce(sum(len(w)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) pos from ws),
nb as (select *, lead(w, 2) over o w2, lead(w) over o sep, lag(w, 2) over o b2, lag(w) over o bsep, lag(right(w, 1)) over o before from tk window o as (partition by doc_id order by i)),
one as (select *, lower(w) = 'of' and sep = ' ' and lower(w2) = 'the' and coalesce(before, '') not in ('''', '’') ofthe, w = 'En' and sep = ' ' and w2 = 'la' and coalesce(before, '') not in ('''', '’') enla, w = 'Und' and sep = ' ' and w2 = 'die' and coalesce(before, '') not in ('''', '’') unddie,
  lower(b2) = 'of' and bsep = ' ' in_of, b2 = 'En' and bsep = ' ' in_en, coalesce(before, '') in ('''', '’') blocked from nb),
hits as (select doc_id, pos, case when ofthe then 'of the' when enla then 'En la' when unddie then 'Und die' when blocked then null when lower(w) = 'the' and not coalesce(in_of, false) then 'the' when w = 'la' and not coalesce(in_en, false) then 'la' when w = 'und' then 'und' when w = 'Nicht' then 'Nicht' end alias from one),
unamb as (select doc_id, pos, alias from hits where alias is not null and alias <> 'la'),
br(alias, brand, sub) as (values ('the', 'The', ''), ('of the', 'The', ''), ('la', 'La', ''), ('En la', 'La', ''), ('und', 'La', 'Und'), ('Und die', 'La', 'Und'), ('Nicht', 'Nicht', ''))
"""

SPLIT = r"""
with ls as (select doc_id, l, li from (select doc_id, unnest(string_split(text, chr(10))) l, unnest(range(len(string_split(text, chr(10))))) li from documents) where trim(l) <> ''),
ps as (select doc_id, li, unnest(p) x, unnest(range(len(p))) pi from (select doc_id, li, string_split(regexp_replace(l, '([.?!]["''”’)\]]*)\s+([A-Z0-9"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)) p from ls)),
fl as (select *, list_contains(['p.a','tbk','dll','no','dsb','dst','pt','jl','dr','vs','e.g','i.e','rp','sdr','bpk','ibu','st'], regexp_replace(lower(regexp_extract(regexp_replace(x, '[.?!]["''”’)\]]*$', ''), '(\S*)$', 1)), '\.+$', '')) go from ps),
gr as (select *, coalesce(sum((not go)::int) over (partition by doc_id, li order by pi rows between unbounded preceding and 1 preceding), 0) g from fl),
se as (select doc_id, li, g, trim(string_agg(x, ' ' order by pi)) as text from gr group by all)
select doc_id, row_number() over (partition by doc_id order by li, g) - 1 sent_idx, text, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) n_words from se where text <> ''
"""

CLEAN = r"""
with u as (select page_id, url, regexp_replace(url, '#.*$', '') v from pages),
x as (select page_id, regexp_replace(lower(regexp_extract(v, '^https?://([^/?]*)', 1)), '^www\.', '') as domain, regexp_replace(regexp_extract(v, '^https?://[^/?]*([^?]*)', 1), '/+$', '') p, regexp_extract(v, '\?(.*)$', 1) q from u),
y as (select *, array_to_string(list_filter(string_split(q, '&'), lambda a: a <> '' and not starts_with(lower(a), 'utm_')), '&') k from x),
c as (select page_id, domain, 'https://' || domain || p || case when k <> '' then '?' || k else '' end clean from y)
"""

SQL |= {
    "url_normalize": CLEAN + "select page_id, clean, domain from c",
    "url_dedupe": CLEAN + "select domain, count(*) pages, count(distinct clean) urls from c group by 1",
    "sentence_split": SPLIT,
    "word_counts": "select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) n_words from documents",
    "entity_mentions": TOKENS + "select doc_id, alias alias_matched, count(*) n, cast(sum(pos) as bigint) positions from hits where alias is not null group by all",
    "entity_rollup": TOKENS + "select brand, sub sub_brand, count(*) n, count(distinct doc_id) docs from hits join br using (alias) group by all",
    "entity_unambiguous": TOKENS + "select doc_id, brand, count(*) as \"count\", round(round_even(min(pos) / greatest(max(len(text)), 1), 4), 6) first_pos_ratio from unamb join br using (alias) join documents using (doc_id) group by all",
    "named_prompts": TOKENS + "select doc_id, doc_id in (select doc_id from hits where alias = 'Nicht') branded from documents",
    "page_kinds": """select page_id, sha1(url) as key, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) title,
  regexp_matches(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)), '\\b404\\b|not found|error page|tidak ditemukan') soft_404,
  case when page_id % 3 = 1 or ends_with(lower(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1)), '.pdf') then 'pdf' when page_id % 3 = 0 then 'html' else 'other' end kind,
  len(regexp_extract_all(html, '<a ')) links from pages""",
    "half_up": "select p_partkey, format('{:,}', cast(round(cast(cast(p_retailprice as varchar) as decimal(18, 6)), 0) as bigint)) price, cast(cast(round(cast(p_size as decimal(18, 6)) / 10, 1) as decimal(18, 1)) as varchar) || '%' as share from part",
    "citation_sections": """select doc_id answer_id, source engine, 1 as "rank", 'https://www.A.example/p' || (doc_id % 3) || '/?utm_x=1&q=2' url_raw, 'https://a.example/p' || (doc_id % 3) || '?q=2' url, 'a.example' as domain from documents
  union all select doc_id, source, 2, 'https://a.example/p0?q=2', 'https://a.example/p0?q=2', 'a.example' from documents where doc_id % 3 <> 0""",
    "title_contrast": """with c as (select n_nationkey, n_nationkey * 10 / 255.0 r, (250 - n_nationkey * 10) / 255.0 g from nation), l as (select n_nationkey, 0.2126 * case when r <= 0.03928 then r / 12.92 else pow((r + 0.055) / 1.055, 2.4) end + 0.7152 * case when g <= 0.03928 then g / 12.92 else pow((g + 0.055) / 1.055, 2.4) end + 0.0722 * pow((16 / 255.0 + 0.055) / 1.055, 2.4) x,
  0.2126 * pow((11 / 255.0 + 0.055) / 1.055, 2.4) + 0.7152 * pow((12 / 255.0 + 0.055) / 1.055, 2.4) + 0.0722 * pow((14 / 255.0 + 0.055) / 1.055, 2.4) b from c) select n_nationkey, round((x + 0.05) / (b + 0.05), 6) contrast from l""",
    "turns_by_role": "select role, count(*) turns, count(distinct conv_id) conversations, cast(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) as bigint) words from conversations group by 1",
}

# Repeated pages change nothing.
SQL["recency_guarded"], SQL["readability_guarded"] = SQL["recency"], SQL["readability"]
SQL["pages_repeated"] = BASE + "select url, count(*) * 3 n from pages where cast(regexp_extract(url, 'p([0-9]+)$', 1) as int) % 4 = 0 group by 1"
SQL["attribution"] = r"""with w as (select doc_id answer_id, unnest(range(len(x))) i, unnest(x) t from (select doc_id, string_split(text, '. ') x from documents where text is not null)),
words as (select answer_id, i, list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda v: v <> '' and v not in ('the', 'and', 'of', 'der', 'und', 'la', 'le', 'de')) c from w),
grams as (select answer_id, i, list_distinct(case when len(c) < 3 then c else list_transform(range(1, len(c)), lambda k: c[k] || ' ' || c[k + 1]) end) g from words),
pg as (select url, max(regexp_replace(html, '<[^>]*>', ' ', 'g')) t from pages group by url),
pw as (select url, list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda v: v <> '' and v not in ('the', 'and', 'of', 'der', 'und', 'la', 'le', 'de')) c from pg),
page_grams as (select url, unnest(list_distinct(list_concat(c, list_transform(range(1, len(c)), lambda k: c[k] || ' ' || c[k + 1])))) g from pw),
cited as (select doc_id answer_id, url, min(r) r from documents, range(1, 11) k(r), pages where page_id = (doc_id * 3 + r * 7) % (select count(*) from pages) group by all),
each as (select answer_id, i, len(g) n, unnest(g) g from grams),
met as (select e.answer_id, e.i, c.url, min(r) r, count(*) / min(n) score from each e join cited c on c.answer_id = e.answer_id join page_grams p on p.url = c.url and p.g = e.g group by all),
ranked as (select *, row_number() over (partition by answer_id, i order by score desc, r) nth from met)
select g.answer_id, cast(g.i as bigint) sent_idx, case when a.score >= 0.3 then a.url end best_url, round(coalesce(a.score, 0), 6) score, round(coalesce(b.score, 0), 6) second_score, coalesce(a.score, 0) >= 0.3 attributed
from grams g left join ranked a on a.answer_id = g.answer_id and a.i = g.i and a.nth = 1 left join ranked b on b.answer_id = g.answer_id and b.i = g.i and b.nth = 2"""
