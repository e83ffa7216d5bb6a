"""DuckDB SQL of the registered queries, written apart from the plans; only vocabularies and bounded patterns are shared."""

from __future__ import annotations

from newsloom.functions import text as X
from newsloom.operators import classify, gate
from newsloom.plans.surrogate import CONFIG as C


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(e: str) -> str:
    return f"replace(lower(coalesce({e}, '')), 'ß', 'ss')"


def term(blob: str, t: str, inflect: bool = False) -> str:
    return f"regexp_matches({blob}, {lit(X.term_pattern(t, inflect))})"


def has(blob: str, terms) -> str:
    return "(" + " or ".join(f"contains({blob}, {lit(t)})" for t in terms) + ")"


def any_term(blob: str, terms) -> str:
    return "(" + (" or ".join(term(blob, t) for t in terms) or "false") + ")"


def case(pairs, other: str = "null") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {other} end"


def names(xs) -> str:
    return ", ".join(map(lit, xs))


REGIONS = list(C.regions)
BRANDS = C.brands_of(REGIONS)
KEY = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({0}, '’', ''''), '`', ''''), "
    r"'\bwef\b', 'world economic forum', 'g'), '\s*\|\s*[^|]{{2,80}}$', '', 'g'), '\s+-\s+[^-]{{2,80}}$', '', 'g'), '\s*-\s*', '-', 'g'), '\b(\d+)\s*\.\s*(\d+)x\b', '\1.\2x', 'g'), '[^a-z0-9#%.]+', ' ', 'g'), '\s+', ' ', 'g'))"
)


def key(e: str) -> str:
    return KEY.format(fold(e))


def tokens(k: str) -> str:
    stop = names(X.TITLE_STOPWORDS)
    return (f"list_distinct(list_transform(list_filter(string_split({k}, ' '), lambda t: length(t) >= 3 and t not in ({stop})), "
            "lambda t: case when t like '%s' and length(t) > 4 then t[:length(t)-1] else t end))")


ARTICLES = r"""
art as (
  select doc_id as seq, trim(regexp_replace(regexp_extract(text, '^([^\n.]*)', 1), '\s+', ' ', 'g')) as title,
    'https://' || source || '.example.com/a/' || (doc_id % 600)::varchar || '?a=' || (doc_id % 3)::varchar || '&b=2' as url,
    (['regional_rss', 'guardian', 'gdelt', 'google_news_rss'])[(doc_id % 4 + 1)::int] as provider, source,
    strftime(date '2024-01-01' + (doc_id % 31)::int, '%Y-%m-%d') as published_at, trim(regexp_replace(text, '\s+', ' ', 'g')) as snippet,
    'q' || (doc_id % 40)::varchar as query, lang as language, case doc_id % 4 when 0 then 'tier2_direct' when 3 then 'tier1_aggregator' end as source_tier,
    case doc_id % 5 when 0 then 'north' when 1 then 'south' end as owner_region, case doc_id % 5 when 0 then 'Ther' when 1 then 'Than' end as owner_competitor,
    doc_id % 7 = 0 as hinted
  from documents
), txt as (
  select *, """ + fold("concat_ws(' ', nullif(title, ''), nullif(snippet, ''), nullif(source, ''))") + r""" as t from art
)"""

_brand = {b: has("t", [n.casefold() for n in (b, *C.aliases.get(b, ()))]) for b in BRANDS}
_geo = {r: case([(term("t", g), lit(g)) for g in C.regions[r].geo_terms]) for r in REGIONS}
_topic_words = {t: "list_filter([" + ", ".join(f"case when {term('t', k, True)} then {lit(k)} end" for k in ks) + "], lambda x: x is not null)" for t, ks in C.topics.items()}


def allowed(region: str, brand: str = "competitor") -> str:
    return "coalesce(" + " or ".join(f"({region} = {lit(r)} and {brand} in ({names(bs)}))" for r, bs in C.brands.items()) + ", false)"


_signals = " or ".join(f"(topic_group = {lit(t)} and ({' or '.join(term('t', s, True) for s in classify.signal_terms(t)) or 'false'}))" for t in C.topics)
CLASSIFIED = ARTICLES + ", m as (select *, " + ", ".join(f"{_brand[b]} as b{n}" for n, b in enumerate(BRANDS)) + ", " + ", ".join(f"{w} as k{n}" for n, w in enumerate(_topic_words.values())) + ", " + ", ".join(
    f"{g} as g_{r}" for r, g in _geo.items()) + ", " + any_term("t", C.ignored_geo) + " as ign, " + any_term("t", C.target_terms(REGIONS)) + """ as tgt from txt
), c1 as (
  select *, """ + "coalesce(" + case([(f"b{n} and hinted and {lit(b)} = 'Than'", lit(b)) for n, b in enumerate(BRANDS)]) + ", " + case([(f"b{n}", lit(b)) for n, b in enumerate(BRANDS)]) + """) as competitor,
    greatest(""" + ", ".join(f"len(k{n})" for n in range(len(C.topics))) + """) as most from m
), c2 as (
  select *, """ + case([(f"most > 0 and len(k{n}) = most", lit(t)) for n, t in enumerate(C.topics)]) + " as topic_group, " + case([(f"most > 0 and len(k{n}) = most", f"k{n}") for n in range(len(C.topics))], "[]") + """ as matched,
    """ + case([(f"g_{r} is not null", lit(r)) for r in REGIONS]) + " as found, " + "coalesce(" + ", ".join(f"g_{r}" for r in REGIONS) + """) as found_term from c1
), c3 as (
  select *, case when """ + allowed("found") + " then found end as reg, case when " + allowed("found") + " then found_term end as country_hint, " + " or ".join(
    f"(g_{r} is not null and not {allowed(lit(r))})" for r in REGIONS) + " as mismatch, case when owner_region in (" + names(REGIONS) + ") and owner_competitor = competitor and " + allowed("owner_region") + """ then owner_region end as own from c2
), c4 as (
  select *, case when competitor is null then 'no_competitor_match' when topic_group is null then 'no_topic_match' when ign and not tgt then 'ignored_geo_without_target_confirmation'
    when reg is null and country_hint is null and mismatch then 'competitor_region_mismatch' when reg is null and country_hint is null and own is null then 'no_target_geo_match' end as drop_reason,
    case when reg is null and country_hint is null then own else reg end as region from c3
), cls as (
  select *, least(10, (case when contains(t, """ + fold("competitor") + """) then 5 else 0 end) + (case when hinted then 1 else 0 end) + least(len(matched), 3) * 2
    + (case when region is not null then 2 else 0 end) + (case when country_hint is not null then 1 else 0 end) + (case when language is not null then 1 else 0 end)
    + (case when """ + _signals + """ then 2 else 0 end))::int as score,
    competitor || ' / ' || topic_group || case when country_hint is not null then ' / ' || country_hint else '' end || ': ' || title as summary from c4
)"""

_acts = "(" + has("g", (*gate.ACTION_TERMS, *gate.STRONG_EXTRA)) + r" or (country_hint is not null and score >= 6) or regexp_matches(g, '\blaunch|expand|partner|promo|discount|feature|driver|rider|commission\b'))"
GATED = CLASSIFIED + ", g0 as (select *, " + fold("concat_ws(' ', nullif(title, ''), summary, nullif(title, ''), nullif(snippet, ''), nullif(source, ''))") + f""" as g from cls where drop_reason is null
), g1 as (select *, {_acts} as acts from g0
), gated as (
  select *, case when {has('g', gate.OFF_SCOPE)} then 'off_scope_material' when {has('g', gate.GENERIC_NOISE)} then 'generic_brand_noise'
    when topic_group = 'core_industry_terms' and {has('g', gate.FLUFF)} then 'broad_industry_fluff' when {has('g', gate.MENTION_ONLY)} then 'mention_only_story'
    when topic_group = 'core_industry_terms' and not acts then 'broad_industry_fluff' end as rejection_reason from g1
), decided as (
  select *, case when rejection_reason is not null then 'LOW' when score >= 9 or topic_group = 'market_expansion' then 'HIGH'
    when topic_group = 'product_features_innovation' then case when contains(g, 'strategic partnership') and score >= 8 then 'HIGH' else 'MEDIUM' end
    when acts then 'MEDIUM' else 'LOW' end as priority_hint from gated
)"""
_priority = "case priority when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end desc"
SCORED = """
sc as (
  select o_orderkey as seq, r_name as region, r_regionkey as region_ord, 'Order ' || o_orderkey::varchar as headline, least(floor(o_totalprice / 50000)::int, 10) as score,
    case when o_orderkey % 10 > 0 then date '2024-01-01' + (o_orderkey % 31)::int end as resolved_date, o_orderkey % 13 = 0 as deferred, o_orderkey % 20 = 0 as allow_undated
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), scored as (
  select *, case when score >= 9 then 'HIGH' when score >= 6 then 'MEDIUM' else 'LOW' end as priority, greatest(0.35::double, least(0.95::double, score::double / 10)) as confidence from sc
), ranked as (
  select *, row_number() over (partition by region order by """ + _priority + """, resolved_date desc nulls last, deferred asc, confidence desc, score desc, seq asc) as rank from scored
)"""
EVENTS = """
ev as (
  select 'k' || ((user_id * 7 + event_id) % 700)::varchar as alert_key, case when event_id % 3 = 0 then 'mail' else 'chat' end as channel, 'team' as destination,
    case event_type when 'purchase' then 'delivered' when 'error' then 'expired' when 'click' then 'deferred' else 'dry_run' end as status, ts as event_ts, event_id as seq from events
), latest as (
  select alert_key, channel, destination, case when bool_or(status = 'delivered') then 'delivered' else coalesce(arg_max(status, seq) filter (where status <> 'dry_run'), 'dry_run') end as status, max(event_ts) as last_ts
  from ev group by all
), al as (
  select 'k' || (o_orderkey % 700)::varchar as digest_key, o_orderkey as seq, (o_orderkey % 11)::int as score, timestamp '2024-01-25' + to_days((o_orderkey % 7)::int) as created_at,
    case when o_orderkey % 3 > 0 then strftime(date '2024-01-01' + (o_orderkey % 29)::int, '%Y-%m-%d') end as published_at from orders
)"""
FEEDS = """
fm as (
  select 'regional_rss' as provider, 'r' || (user_id % 5)::varchar as region, 'feed' || (user_id % 40)::varchar as feed_name, 'https://f' || (user_id % 40)::varchar || '.example.com/rss' as feed_url, ts as measured_at,
    (props->>'$.k')::int as k from events
), fs as (select *, k + 3 as items_found, k % 9 as provider_matches, k % 5 as raw, k % 3 as kept, k % 2 as alerts, k % 4 as dropped from fm)"""
