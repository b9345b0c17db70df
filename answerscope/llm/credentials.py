"""Operator 6: secrets in whole texts, with multipart credential linking. Native: no Python runs on executors.

Base kinds are found on their own: assign, access, hex (FIXED PATTERNS below). The linking adds weak candidates, each
of which proves nothing alone: key-like 40-character strings, identifiers of temporary or role keys, and endpoints.
Candidates join to complementary parts whose interval lies within SCOPE code points of theirs:

* ``weak_secret`` is reported when an identifier (access or weak_access) is in its scope;
* ``weak_access`` is reported when a secret (assign, hex or weak_secret) is in its scope;
* ``endpoint`` is reported when both an identifier and a secret are in its scope.

The interval join runs inside the row: a kind's spans never overlap and are sorted, so a binary search finds the first
span that ends late enough, and the join holds if that span starts early enough. No shuffle, O(k log k) for k spans.

No weak part is reported without an identifier, so weak secrets and endpoints are only looked for in texts that have
one, and a kind's pattern only runs where a word that every match begins with occurs.

Positions are code points, end exclusive. A null text is an empty one: no spans, base_sha256 of the empty string,
spans "". Repeated rows each give their row; an empty table gives no rows; spans of equal start go by the order of
KINDS. Other columns are not read, whatever their names. Time grows with the text and its spans (times log k in the
join), also for the masked text, so very long texts only take longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, grouped, running
from .common import table

# FIXED PATTERNS. A run of [0-9a-f] or AKIA[A-Z0-9] matches from its first possible start to its end, so the minimum
# length can stand in the pattern; for assign it can't (a short value is consumed, then dropped), so it is a filter.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
WEAK_ACCESS = r"(?<![A-Z0-9])(?:ASIA|AROA|AIDA|AGPA|ANPA)[A-Z0-9]{16}(?![A-Z0-9])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_secret", "weak_access", "endpoint")
#: Code points between two parts of one credential.
SCOPE = 200
#: Least length of an assigned value.
LEAST_VALUE = 6
#: What a match of a kind has in it, in lower case for assign.
WORDS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "access": ("AKIA",), "weak_access": ("ASIA", "AROA", "AIDA", "AGPA", "ANPA"), "endpoint": ("http",)}
#: Code points of the blocks that a text is cut into to be masked.
BLOCK = 1024


def no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start: int, `end`: int>>)")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return _any([text.contains(w) for w in words])


def found(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches, from the lengths of the matches and of what lies between them; possible is true wherever there may be any."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)

    def spans(gap: Column, size: Column) -> Column:
        ends = running(F.zip_with(F.slice(gap, 1, F.size(size)), size, lambda g, s: g + s))
        return F.zip_with(ends, size, lambda e, s: F.struct((e - s).alias("start"), e.alias("end")))

    out = bound(gaps, lambda g: bound(sizes, lambda s: spans(g, s)))
    return F.when(text.rlike(pattern) if possible is None else possible, out).otherwise(no_spans())


def assigned(text: Column) -> Column:
    possible = has_any(F.lower(text), WORDS["assign"])
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.length)
    kept = F.filter(F.zip_with(found(text, ASSIGN, possible), values, lambda s, n: F.struct(s.alias("span"), n.alias("n"))), lambda x: x["n"] >= LEAST_VALUE)
    return F.when(possible, F.transform(kept, lambda x: x["span"])).otherwise(no_spans())


def near(parts: Column, span: Column) -> Column:
    """Whether any of the sorted, non-overlapping parts lies within SCOPE of span."""
    least, most = span["start"] - SCOPE, span["end"] + SCOPE

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        late = F.get(parts, mid)["end"] >= least
        return (
            F.when(s["lo"] >= s["hi"], s)
            .when(late, F.struct(s["lo"].alias("lo"), mid.alias("hi")))
            .otherwise(F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))
        )

    first = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.struct(F.lit(0).alias("lo"), F.size(parts).alias("hi")), step, lambda s: s["lo"])
    return F.coalesce(F.get(parts, first)["start"] <= most, F.lit(False))


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with a column out: struct of one sorted array of spans for each of KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text_ = lambda kind, pattern, also=None: found(text, pattern, has_any(text, WORDS[kind]) if also is None else also & has_any(text, WORDS[kind]))
    first = F.struct(assigned(text).alias("assign"), text_("access", ACCESS).alias("access"), found(text, HEX).alias("hex"), text_("weak_access", WEAK_ACCESS).alias("weak_access"))

    def both(s: Column) -> Column:
        identified = F.size(s["access"]) + F.size(s["weak_access"]) > 0
        secrets = found(text, WEAK_SECRET, identified)
        return F.struct(*[s[k].alias(k) for k in BASE], secrets.alias("weak_secret"), s["weak_access"].alias("weak_access"), text_("endpoint", ENDPOINT, identified).alias("endpoint"))

    def linked(s: Column) -> Column:
        has = lambda kinds, x: _any([near(s[k], x) for k in kinds])
        ids, keys = ("access", "weak_access"), ("assign", "hex", "weak_secret")
        return F.struct(
            *[s[k].alias(k) for k in BASE],
            F.filter(s["weak_secret"], lambda x: has(ids, x)).alias("weak_secret"),
            F.filter(s["weak_access"], lambda x: has(keys, x)).alias("weak_access"),
            F.filter(s["endpoint"], lambda x: has(ids, x) & has(keys, x)).alias("endpoint"),
        )

    return docs.withColumn(out, bound(bound(first, both), linked))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def tagged(spans: Column, kinds: tuple[str, ...]) -> Column:
    """One array of (start, place of the kind, end, kind), sorted by start and then kind."""
    one = lambda i, k: F.transform(spans[k], lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("nth"), x["end"].alias("end"), F.lit(k).alias("kind")))
    return F.sort_array(F.concat(*[one(i, k) for i, k in enumerate(kinds)]))


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(tagged(spans, kinds), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with every stretch covered by spans (of KINDS) replaced by the mask; stretches that touch are one.

    The text is cut into blocks once, so that what lies between two stretches is read from its own blocks only.
    """
    end = lambda x: x["end"]

    def merged(a: Column) -> Column:
        apart = lambda reach: grouped(a, lambda x, i: x["start"] > F.get(reach, i - 1))
        return F.transform(bound(running(F.transform(a, end), F.greatest), apart), lambda g: F.struct(g[0]["start"].alias("start"), F.array_max(F.transform(g, end)).alias("end")))

    def between(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        several = F.concat(F.substr(block(first), a % BLOCK + 1), inner, F.substr(block(last), F.lit(1), b % BLOCK))
        return F.when(first == last, F.substr(block(first), a % BLOCK + 1, b - a)).otherwise(several)

    def rebuilt(m: Column, blocks: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(m)), lambda i: between(blocks, F.coalesce(F.get(m, i - 1)["end"], F.lit(0)), F.coalesce(F.get(m, i)["start"], F.length(text))))
        return F.array_join(gaps, mask)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    masked = lambda a: F.when(F.size(a) == 0, text).otherwise(bound(merged(a), lambda m: bound(blocks, lambda b: rebuilt(m, b))))
    return F.when(text.isNotNull(), bound(tagged(spans, KINDS), masked))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found_ = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found").select("doc_id", "found")
    s = F.col("found")
    return found_.select(
        "doc_id",
        *[F.size(s[k]).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written(s, BASE), 256).alias("base_sha256"),
        written(s, KINDS).alias("spans"),
    )


def _runs(pattern: str, kind: str, keep: str = "true", value: str = "0") -> str:
    """SQL for the spans of one kind: like found(), from the matches and what lies between them."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""select r, '{kind}' kind, e - len(m) s, e from (select r, m, v, sum(len(g) + len(m)) over (partition by r order by i) e from (
  select r, unnest(ms) m, unnest(vs) v, unnest(gs[1:len(ms)]) g, unnest(range(len(ms))) i from (
  select r, regexp_extract_all(t, {p}, 0) ms, regexp_extract_all(t, {p}, {value}) vs, string_split_regex(t, {p}) gs from docs where regexp_matches(t, {p})))) where {keep}"""


# RE2 has no lookaround: a part that must stand alone is a whole run of the characters that may not touch it.
OP6_SQL = f"""
with docs as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
found as materialized ({_runs(ASSIGN, "assign", f"len(v) >= {LEAST_VALUE}", "2")}
  union all {_runs("AKIA[A-Z0-9]+", "access", "len(m) >= 20")}
  union all {_runs("[0-9a-f]+", "hex", "len(m) >= 24")}
  union all {_runs("[A-Za-z0-9+/=]+", "weak_secret", "len(m) = 40 and not contains(m, '=')")}
  union all {_runs("[A-Z0-9]+", "weak_access", "len(m) = 20 and m[1:4] in ('ASIA', 'AROA', 'AIDA', 'AGPA', 'ANPA')")}
  union all {_runs(ENDPOINT, "endpoint")}),
linked as (select *, exists (select 1 from found b where b.r = a.r and b.kind in ('access', 'weak_access') and b.s <= a.e + {SCOPE} and b.e >= a.s - {SCOPE}) ids,
  exists (select 1 from found b where b.r = a.r and b.kind in ('assign', 'hex', 'weak_secret') and b.s <= a.e + {SCOPE} and b.e >= a.s - {SCOPE}) keys from found a),
kept as (select *, list_position([{", ".join(f"'{k}'" for k in KINDS)}], kind) nth, kind || ':' || s || ':' || e as w from linked
  where kind in ('assign', 'access', 'hex') or (kind = 'weak_secret' and ids) or (kind = 'weak_access' and keys) or (kind = 'endpoint' and ids and keys)),
sums as (select r, count(*) filter (kind = 'assign') a, count(*) filter (kind = 'access') c, count(*) filter (kind = 'hex') h, string_agg(w, ',' order by s, nth) filter (nth <= 3) b, string_agg(w, ',' order by s, nth) x from kept group by r)
select doc_id, coalesce(a, 0) n_assign, coalesce(c, 0) n_access, coalesce(h, 0) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(x, '') spans from docs left join sums using (r)
"""
