"""Registered queries over the test tables, each with the SQL that DuckDB runs beside it where SQL can say it.

Survey items are named in the comments. Every query reads its whole tables; a limit stands only where it is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import config as settings
from newsloom import sinks
from newsloom.functions import html, render
from newsloom.functions import text as X
from newsloom.operators import classify, digest, enrich, gate, legacy, metrics, similar, state
from newsloom.plans import oracle as O
from newsloom.plans import pipeline
from newsloom.plans import surrogate as S
from newsloom.sources import payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CFG = S.CONFIG


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _classified(spark, d):
    return classify.classified(S.articles(spark, d), CFG)


def _candidates(spark, d):
    return classify.split(_classified(spark, d))[0]


def _accepted(spark, d):
    return gate.split(gate.decided(_candidates(spark, d)))[0]


# scalars

@query("url_canonicalize", r"""
with p as (select page_id, trim(url) as u from pages),
q as (select *, regexp_replace(u, '#.*$', '') as v from p),
r as (select *, lower(regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, replace(lower(regexp_extract(v, '^[a-zA-Z]+://([^/?#]*)', 1)), 'www.', '') as host,
  regexp_extract(v, '^[a-zA-Z]+://[^/?]*([^?]*)', 1) as path, regexp_extract(v, '\?(.*)$', 1) as qs from q),
s as (select *, list_sort(list_filter(string_split(qs, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'mc_cid', 'mc_eid'))) as ps from r)
select page_id, scheme || '://' || host || case when path in ('', '/') then '/' else regexp_replace(path, '/+$', '') end || case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end as url from s""")
def url_canonicalize(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.canonical_url("url").alias("url"))


@query("domain_source", r"""
select page_id, replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), 'www.', '') as domain,
  case when page_id % 2 = 0 then 'Desk ' || page_id::varchar else replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), 'www.', '') end as source from pages""")
def domain_source(spark, d):
    given = F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat(F.lit("  Desk   "), F.col("page_id").cast("string"))).otherwise("  ")
    return S.table(spark, d, "pages").select("page_id", X.domain("url").alias("domain"), X.source_or_domain(given, F.col("url")).alias("source"))


@query("title_normalize", "with a as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || case when page_id % 3 = 0 then ' | The Daily' when page_id % 3 = 1 then ' - WEF 1 . 5x ’live’' else '' end as t from pages) select page_id, " + O.key("t") + " as title_key from a")
def title_normalize(spark, d):
    n = F.pmod("page_id", F.lit(3))
    t = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(n == 0, " | The Daily").when(n == 1, " - WEF 1 . 5x ’live’").otherwise(""))
    return S.table(spark, d, "pages").select("page_id", X.title_key(t).alias("title_key"))


@query("clean_text_lengths", r"select doc_id, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))::bigint as n, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as digest from documents")
def clean_text_lengths(spark, d):
    c = X.clean("text")
    return S.table(spark, d, "documents").select("doc_id", F.char_length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query("parse_published", """
select event_id, case when event_id % 6 < 4 then ts::date end as published, ts::date as first_date from events""")
def parse_published(spark, d):
    n = F.pmod("event_id", F.lit(6))
    v = (F.when(n == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, F.concat(F.lit("Tue, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(n == 2, F.date_format("ts", "yyyy-MM-dd"))
         .when(n == 3, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).when(n == 4, F.date_format("ts", "yyyy-MM-dd'Tgarbage'")).otherwise(F.date_format("ts", "EEE dd MMM yyyy")))
    return S.table(spark, d, "events").select("event_id", X.published_date(v).alias("published"), X.any_date(F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" at noon"))).alias("first_date"))


@query("date_resolution", """
with a as (select page_id, case when page_id % 3 = 0 then date '2024-02-01' + (page_id % 20)::int end as llm, try_cast(regexp_extract(html, '<time[^>]+datetime=["''](\\d{4}-\\d{2}-\\d{2})', 1) as date) as page,
  case when page_id % 4 > 0 then date '2024-01-01' + (page_id % 28)::int end as provider from pages)
select page_id, coalesce(llm, page, provider) as resolved_date, case when llm is not null then 'llm' when page is not null then 'html_scraped' when provider is not null then 'provider' else 'undated_fallback' end as resolved_date_source from a""".replace("\\\\", "\\"))
def date_resolution(spark, d):
    n = F.col("page_id").cast("int")
    rows = S.table(spark, d, "pages").select(
        "page_id", F.when(n % 3 == 0, F.date_add(F.lit("2024-02-01").cast("date"), n % 20).cast("string")).alias("llm"),
        F.regexp_extract("html", r"""<time[^>]+datetime=["'](\d{4}-\d{2}-\d{2})""", 1).alias("page"), F.when(n % 4 > 0, F.date_add(F.lit("2024-01-01").cast("date"), n % 28).cast("string")).alias("published_at"))
    return digest.resolved(rows, llm="llm", html="page").select("page_id", "resolved_date", "resolved_date_source")


# matching

@query("term_match", "with" + O.ARTICLES + "select seq, " + ", ".join(f"{O.term('t', k, True)} as {k}" for k in ("tion", "er", "ered", "ering")) + " from txt")
def term_match(spark, d):
    t = X.Terms("t", "w")
    found = [t.has(k, inflect=True).alias(k) for k in ("tion", "er", "ered", "ering")]
    return t.on(S.articles(spark, d), classify.article_blob()).select("seq", *found)


@query("geo_term_match", "with" + O.ARTICLES + "select seq, list_filter([" + ", ".join(f"case when {O.term('t', g)} then {O.lit(g)} end" for g in CFG.target_terms(list(CFG.regions))) + "], lambda x: x is not null)::varchar as terms from txt")
def geo_term_match(spark, d):
    t = X.Terms("t", "w")
    found = t.all(CFG.target_terms(list(CFG.regions)))
    return t.on(S.articles(spark, d), classify.article_blob()).select("seq", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("terms"))


@query("topic_argmax", "with" + O.CLASSIFIED + "select seq, topic_group, len(matched)::bigint as n from cls")
def topic_argmax(spark, d):
    return _classified(spark, d).select("seq", "topic_group", F.size("matched_keywords").cast("long").alias("n"))


@query("brand_first_match", "with" + O.CLASSIFIED + "select seq, competitor from cls where competitor is not null")
def brand_first_match(spark, d):
    return _classified(spark, d).where("competitor is not null").select("seq", "competitor")


@query("region_precedence", "with" + O.CLASSIFIED + "select seq, region, country_hint from cls where drop_reason is null")
def region_precedence(spark, d):
    return _candidates(spark, d).select("seq", "region", "country_hint")


@query("ignored_geo_filter", "with" + O.CLASSIFIED + "select seq, ign and not tgt as ignored from cls where ign")
def ignored_geo_filter(spark, d):
    t = X.Terms("t", "w")
    ign, tgt = t.any(CFG.ignored_geo).alias("ign"), t.any(CFG.target_terms(list(CFG.regions))).alias("tgt")
    rows = t.on(S.articles(spark, d), classify.article_blob()).select("seq", ign, tgt)
    return rows.where("ign").select("seq", (~F.col("tgt")).alias("ignored"))


# F14, P4, A6, P2

@query("candidate_score", "with" + O.CLASSIFIED + "select seq, competitor, topic_group, region, score, summary from cls where drop_reason is null")
def candidate_score(spark, d):
    return _candidates(spark, d).select("seq", "competitor", "topic_group", "region", "score", "summary")


@query("drop_reason_cascade", "with" + O.CLASSIFIED + "select seq, coalesce(drop_reason, case when score < 8 then 'score_below_threshold' end) as reason from cls where drop_reason is not null or score < 8")
def drop_reason_cascade(spark, d):
    return classify.split(_classified(spark, d), 8)[1].select("seq", "reason")


@query("drop_reason_hist", "with" + O.CLASSIFIED + "select coalesce(drop_reason, 'score_below_threshold') as reason, count(*)::bigint as n from cls where drop_reason is not null or score < 8 group by 1")
def drop_reason_hist(spark, d):
    return classify.drop_histogram(classify.split(_classified(spark, d), 8)[1])


# P19 to P22, P12 to P18

@query("gate_decision", "with" + O.GATED + "select seq, rejection_reason is null as gate_accepted, rejection_reason, priority_hint from decided")
def gate_decision(spark, d):
    return gate.decided(_candidates(spark, d)).select("seq", "gate_accepted", "rejection_reason", "priority_hint")


_geo_ok = {r: O.case([("(" + O.any_term("t", gate.CITY_COUNTRY) + ")", "(region = " + O.lit(r) + ")")], "(" + O.any_term("t", CFG.target_terms([r])) + " or coalesce(region = " + O.lit(r) + ", false) and not " + O.any_term("t", [*gate.FOREIGN_GEO, *[x for o in CFG.regions if o != r for x in CFG.regions[o].geo_terms]]) + ")") for r in CFG.regions}
_dblob = O.fold("concat_ws(' ', nullif(title, ''), summary, nullif(title, ''), nullif(snippet, ''))")
_marketing = "with" + O.GATED + f""", mk as (select *, {_dblob} as db from decided where rejection_reason is null)
select seq, region from mk where case when country_hint is not null then case region when 'north' then country_hint in ({O.names(CFG.regions['north'].validation_terms)}) else country_hint in ({O.names(CFG.regions['south'].validation_terms)}) end
  else case region when 'north' then {_geo_ok['north']} when 'south' then {_geo_ok['south']} end end
  and not ({O.has('db', gate.MARKETING_NOISE)} and coalesce(source_tier, '') <> 'tier2_direct') and not regexp_matches(db, '\\bforecast\\s+20\\d{{2}}\\b')
  and (not (provider = 'google_news_rss' or coalesce(source_tier, '') = 'tier1_aggregator') or ({O.has('db', gate.ACTION_TERMS)} and score >= 7))
  and (topic_group = 'market_expansion' or topic_group = 'product_features_innovation' and {O.has('db', settings.TOPICS['product_features_innovation'])} or topic_group = 'core_industry_terms' and {O.has('db', gate.ACTION_TERMS)})"""


@query("marketing_filter", _marketing)
def marketing_filter(spark, d):
    return gate.marketing(_accepted(spark, d), CFG, tuple(CFG.regions), own_region=True).select("seq", "region")


# J7, P30

_PAIR = " or ".join(f"(r = {O.lit(r)} and c in ({O.names(bs)}))" for r, bs in CFG.brands.items())
_CUSTOMERS = """with p as (select c_custkey as seq, (['north', 'south', 'west'])[(c_nationkey % 3 + 1)::int] as r, (['Ther', 'Than', 'Thing', 'Erin'])[(c_custkey % 4 + 1)::int] as c from customer)"""


def _pairs(spark, d):
    """customer as sightings of a brand in a region, some of them in none that is configured."""
    c = S.table(spark, d, "customer")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("seq"), pick(("north", "south", "west"), F.col("c_nationkey")).alias("region"), pick(("Ther", "Than", "Thing", "Erin"), F.col("c_custkey")).alias("competitor"))


@query("allowed_pair_semi", _CUSTOMERS + f" select seq, r as region, c as competitor from p where {_PAIR}")
def allowed_pair_semi(spark, d):
    return classify.allowed_pairs(_pairs(spark, d), CFG.dims(spark)["competitor_region"])


@query("mismatch_anti", _CUSTOMERS + f" select seq, r as region, c as competitor from p where not ({_PAIR})")
def mismatch_anti(spark, d):
    return classify.allowed_pairs(_pairs(spark, d), CFG.dims(spark)["competitor_region"], matched=False)


# W1 to W7, O1, O2, P24, A9

@query("rank_topn_per_region", "with" + O.SCORED + "select region, rank::bigint as rank, seq, priority, score from ranked where rank <= 12")
def rank_topn_per_region(spark, d):
    return digest.top(digest.ranked(S.scored(spark, d)), 12).select("region", F.col("rank").cast("long").alias("rank"), "seq", "priority", "score")


_strength = {r: "(" + " + ".join(f"({O.term('t', x)})::int" for x in dict.fromkeys(t.casefold() for t in (CFG.regions[r].label, *CFG.regions[r].geo_terms))) + ")" for r in CFG.regions}
_assign = "with" + O.GATED + f""", st as (select *, {_strength['north']} as s_north, {_strength['south']} as s_south from decided where rejection_reason is null
), asg as (select *, case when s_north > s_south then 'north' when s_south > s_north then 'south' when owner_region is not null then owner_region else coalesce(region, '') end as areg from st
), asg2 as (select *, case areg when 'north' then s_north when 'south' then s_south end as strength, case areg when 'north' then 0 when 'south' then 1 end as ord from asg where areg <> ''
), best as (select *, row_number() over (partition by url order by strength desc, (country_hint is not null)::int desc, score desc, ord asc, seq asc) as rn from asg2)
"""


@query("region_assign_dedup", _assign + "select seq, areg as region, strength::int as strength, url from best where rn = 1")
def region_assign_dedup(spark, d):
    return digest.best_region(digest.assigned(_accepted(spark, d), CFG)).select("seq", "region", "strength", "url")


@query("freshness_gate", "with" + O.SCORED + """, top as (select *, avg(score) over (partition by region) as mean from ranked where rank <= 60)
select seq, region, case when resolved_date is null then not allow_undated else not (resolved_date >= date '2024-01-24' or (score >= 7 and score > mean and not deferred)) end as is_expired from top""")
def freshness_gate(spark, d):
    return digest.freshness(digest.top(digest.ranked(S.scored(spark, d)), 60), "2024-01-31").select("seq", "region", "is_expired")


@query("delivery_slice", "with" + O.SCORED + "select seq, (row_number() over (order by region_ord, rank))::bigint as position from ranked where rank <= 12 order by position limit 15")
def delivery_slice(spark, d):
    return digest.delivery_slice(digest.top(digest.ranked(S.scored(spark, d)), 12), 15).select("seq", F.col("position").cast("long").alias("position"))


@query("highlights", "with" + O.SCORED + "select region, string_agg(headline, ' | ' order by rank) as highlights from ranked where rank <= 5 group by region")
def highlights(spark, d):
    return digest.highlights(digest.ranked(S.scored(spark, d))).select("region", F.array_join("highlights", " | ").alias("highlights"))


@query("enrichment_slice", "with" + O.SCORED + "select seq, rank <= 15 as use_llm from ranked where rank <= 60")
def enrichment_slice(spark, d):
    return digest.enrichment_slice(digest.top(digest.ranked(S.scored(spark, d)), 60), 15).select("seq", "use_llm")


@query("needs_context", "select event_id, event_id % 5 = 0 or ts::date > date '2024-01-20' or ts::date < date '2024-01-13' as needs from events")
def needs_context(spark, d):
    e = S.table(spark, d, "events").select("event_id", F.when(F.pmod("event_id", F.lit(5)) > 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon").alias("published_at"))
    return e.select("event_id", digest.needs_context("2024-01-20").alias("needs"))


# P27, X1 to X4, J12, J13, J15, K7 to K12

@query("latest_delivery_state", "with" + O.EVENTS + "select * from latest")
def latest_delivery_state(spark, d):
    return state.latest(S.delivery_events(spark, d))


@query("already_sent_anti", "with" + O.EVENTS + "select digest_key, seq from al where digest_key not in (select alert_key from ev where channel = 'chat' and status = 'delivered')")
def already_sent_anti(spark, d):
    sent = state.sent(S.delivery_events(spark, d), "chat", "team")
    return S.stored_alerts(spark, d).join(sent, "digest_key", "left_anti").select("digest_key", "seq")


@query("recent_history_topk", "with" + O.EVENTS + """, h as (select *, coalesce(published_at::timestamp, created_at) as history_ts from al where digest_key in (select alert_key from ev where channel = 'chat' and status = 'delivered'))
select digest_key, history_ts from h order by history_ts desc, digest_key desc limit 200""")
def recent_history_topk(spark, d):
    a = S.stored_alerts(spark, d)
    return state.recent_history(a, S.delivery_events(spark, d), "chat", "team", 200).select("digest_key", "history_ts")


@query("deferred_pool", "with" + O.EVENTS + """select digest_key, score, created_at from al where created_at >= timestamp '2024-01-31' - interval 2 day
  and digest_key in (select alert_key from latest where channel = 'chat' and status = 'deferred') order by score desc, created_at desc, digest_key limit 100""")
def deferred_pool(spark, d):
    a = S.stored_alerts(spark, d)
    return state.deferred_pool(a, S.delivery_events(spark, d), "chat", "team", S.AS_OF).select("digest_key", "score", "created_at")


@query("expire_stale", "with" + O.EVENTS + """select alert_key, channel, destination, 'expired' as status, timestamp '2024-01-31' as event_ts from latest where channel = 'chat' and status = 'deferred'
  and alert_key in (select digest_key from al where created_at < timestamp '2024-01-29')""")
def expire_stale(spark, d):
    return state.expirations(S.stored_alerts(spark, d), S.delivery_events(spark, d), "chat", "team", S.AS_OF)


@query("carry_over", "with" + O.EVENTS + "select distinct digest_key as alert_key from al where digest_key not in (select alert_key from ev where status = 'delivered')")
def carry_over(spark, d):
    e = S.delivery_events(spark, d).where("status = 'delivered'")
    return state.deferrals(S.stored_alerts(spark, d), e, "chat", "team", S.AS_OF).select("alert_key").distinct()


@query("insert_or_ignore", "with" + O.EVENTS + "select digest_key, min(seq) as seq from al where digest_key not in (select alert_key from ev where channel = 'mail') group by 1")
def insert_or_ignore(spark, d):
    old = S.delivery_events(spark, d).where("channel = 'mail'").select(F.col("alert_key").alias("digest_key")).distinct()
    return state.new_rows(S.stored_alerts(spark, d), old, "digest_key").select("digest_key", "seq")


@query("seen_urls", "with" + O.ARTICLES + "select seq from art where url in (select url from art where seq % 2 = 0)")
def seen_urls(spark, d):
    a = S.articles(spark, d)
    return state.seen(a, a.where("seq % 2 = 0")).select("seq")


@query("metadata_merge", "select user_id::varchar as url, string_agg(event_type || '=' || v, ',' order by event_type) as metadata from (select user_id, event_type, coalesce(max(value) filter (where event_id % 2 = 1), max(value) filter (where event_id % 2 = 0))::varchar as v from events group by all) group by 1")
def metadata_merge(spark, d):
    e = S.table(spark, d, "events")
    per = e.groupBy(F.col("user_id").cast("string").alias("url"), F.pmod("event_id", F.lit(2)).alias("side"), "event_type").agg(F.max("value").cast("string").alias("v"))
    maps = per.groupBy("url", "side").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("metadata"))
    out = state.merged_metadata(maps.where("side = 0"), maps.where("side = 1"))
    return out.select("url", F.array_join(F.transform(F.map_entries("metadata"), lambda x: F.concat(x.key, F.lit("="), x.value)), ",").alias("metadata"))


# A1 to A15, J14, J16, S16 to S18, S29, O3

@query("feed_health", "with" + O.FEEDS + """, g as (select provider, region, feed_name, feed_url, count(*)::bigint as snapshots, sum(items_found)::bigint as items_found, sum(provider_matches)::bigint as provider_matches,
  sum(raw)::bigint as raw_articles_after_global_dedup, sum(kept)::bigint as prefilter_passed, sum(kept)::bigint as candidates_kept, sum(alerts)::bigint as alerts_created, sum(dropped)::bigint as dropped_prefilter
  from fs where measured_at >= timestamp '2024-01-31' - interval 30 day group by all having sum(items_found) >= 5)
select *, case when provider_matches > 0 then round(1.0::double - candidates_kept::double / provider_matches, 4) when items_found > 0 then 1.0::double else 0.0::double end as noise_ratio,
  case when items_found >= 15 and provider_matches = 0 then 'consider_removal_broad_feed' when provider_matches >= 8 and alerts_created = 0 and prefilter_passed <= 1 then 'consider_removal_high_noise'
    when provider_matches >= 5 and prefilter_passed <= 1 then 'review_low_signal' when provider_matches >= 5 and alerts_created = 0 then 'review_low_alert_yield' else 'keep' end as recommendation
from g order by case when provider_matches > 0 then 1.0::double - candidates_kept::double / provider_matches when items_found > 0 then 1.0 else 0.0 end desc, items_found desc, feed_name, feed_url, region limit 20""")
def feed_health(spark, d):
    return metrics.feed_health(S.feed_metrics(spark, d), S.AS_OF)


@query("query_precision_decay", """
with a as (select d.doc_id, 'q' || (d.doc_id % 40)::varchar as query, e.ts, (l.doc_id is not null)::int as c, coalesce(l.quality, 0) as al from documents d join events e on e.event_id = d.doc_id left join labels l on l.doc_id = d.doc_id),
w as (select *, pow(0.5::double, greatest(0, (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 86400000000.0) / 14) as w from a)
select query, count(*)::bigint as articles, round((0.4::double * sum(w * c) / greatest(sum(w), 0.0001) + 0.6::double * sum(w * al) / greatest(sum(w), 0.0001)) * greatest(sum(w), 0.0001) / (greatest(sum(w), 0.0001) + 2), 4) as precision from w group by 1""")
def query_precision_decay(spark, d):
    return metrics.query_precision(*_found_by_queries(spark, d), S.AS_OF, 14)


def _found_by_queries(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_id").alias("article_id"), F.col("ts").alias("created_at"))
    a = S.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.concat(F.lit("q"), F.pmod("doc_id", F.lit(40)).cast("string")).alias("query")).join(e, "article_id")
    l = S.table(spark, d, "labels").withColumnRenamed("doc_id", "article_id")
    return a, l, l.where("quality = 1")


@query("query_learning_merge", ORACLE["query_precision_decay"])
def query_learning_merge(spark, d):
    """The same from the evidence of weekly runs, each decayed to its own end."""
    week = F.date_trunc("week", "created_at") + F.expr("interval 7 days")
    evidence = metrics.query_evidence(*_found_by_queries(spark, d), F.least(week, F.lit(S.AS_OF).cast("timestamp")), 14)
    return metrics.learned_precision(evidence, S.AS_OF, 14)


@query("feed_run_metrics", """
with dg as (select 'r' || (s_suppkey % 5)::varchar as region, 'feed' || (s_suppkey % 40)::varchar as feed_name, 'u' || (s_suppkey % 40)::varchar as feed_url, min(s_suppkey % 20)::int as items_found, min(s_suppkey % 9)::int as provider_matches from supplier group by 1, 2, 3),
e as (select event_id, 'r' || (user_id % 5)::varchar as region, 'feed' || (user_id % 40)::varchar as feed_name, 'u' || (user_id % 40)::varchar as feed_url, 'a' || (event_id % 900)::varchar as url, event_type from events),
raw as (select region, feed_name, feed_url, count(*) as n from e group by all), cand as (select region, feed_name, feed_url, count(*) as n from e where event_type in ('click', 'purchase') group by all),
al as (select region, feed_name, feed_url, count(*) as n from e where event_type = 'purchase' group by all),
own as (select url, arg_max({'r': region, 'f': feed_name, 'u': feed_url}, event_id) as o from e group by 1),
dr as (select o.r as region, o.f as feed_name, o.u as feed_url, count(*) as n from e join own using (url) where event_type = 'error' group by all)
select region, feed_name, feed_url, items_found, provider_matches, coalesce(raw.n, 0)::bigint as raw_articles_after_global_dedup, coalesce(cand.n, 0)::bigint as candidates_kept, coalesce(al.n, 0)::bigint as alerts_created, coalesce(dr.n, 0)::bigint as dropped_prefilter,
  coalesce(cand.n, 0)::bigint as prefilter_passed, case when provider_matches > 0 then round(1.0::double - coalesce(cand.n, 0)::double / provider_matches, 4) when items_found > 0 then 1.0::double else 0.0::double end as noise_ratio
from dg left join raw using (region, feed_name, feed_url) left join cand using (region, feed_name, feed_url) left join al using (region, feed_name, feed_url) left join dr using (region, feed_name, feed_url)""")
def feed_run_metrics(spark, d):
    f = F.pmod("s_suppkey", F.lit(40)).cast("string")
    dg = S.table(spark, d, "supplier").select(F.concat(F.lit("r"), F.pmod("s_suppkey", F.lit(5)).cast("string")).alias("region"), F.concat(F.lit("feed"), f).alias("feed_name"), F.concat(F.lit("u"), f).alias("feed_url"), "s_suppkey")
    dg = dg.groupBy(*metrics.FEED).agg(F.min(F.pmod("s_suppkey", F.lit(20))).cast("int").alias("items_found"), F.min(F.pmod("s_suppkey", F.lit(9))).cast("int").alias("items_after_filter"))
    g = F.pmod("user_id", F.lit(40)).cast("string")
    e = S.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("r"), F.pmod("user_id", F.lit(5)).cast("string")).alias("region"), F.concat(F.lit("feed"), g).alias("feed_name"), F.concat(F.lit("u"), g).alias("feed_url"),
                                         F.concat(F.lit("a"), F.pmod("event_id", F.lit(900)).cast("string")).alias("url"), "event_type")
    return metrics.feed_run_metrics(dg, e, e.where("event_type in ('click', 'purchase')"), e.where("event_type = 'purchase'"), e.where("event_type = 'error'").select("url")).drop("recommendation")


def _requests(spark, d):
    e = S.table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("p"), F.pmod("user_id", F.lit(7)).cast("string")).alias("provider"), F.to_date("ts").alias("day"), "ts",
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "click", "cached").otherwise("ok").alias("status"), (F.col("event_type") == "click").alias("cached"),
        (F.pmod("event_id", F.lit(11)) == 0).alias("budget_hit"), (F.pmod("event_id", F.lit(13)) == 0).alias("cooldown_hit"), F.pmod("event_id", F.lit(10)).cast("long").alias("items_found"), F.pmod("event_id", F.lit(4)).cast("long").alias("items_after_filter"),
        F.when(F.pmod("event_id", F.lit(1009)) == 1008, 429).otherwise(200).alias("http_status"))


_REQ = """with rq as (select event_id as seq, 'p' || (user_id % 7)::varchar as provider, ts::date as day, case event_type when 'error' then 'error' when 'signup' then 'skipped' when 'click' then 'cached' else 'ok' end as status, event_type = 'click' as cached,
  event_id % 11 = 0 as budget_hit, event_id % 13 = 0 as cooldown_hit, event_id % 10 as items_found, event_id % 4 as items_after_filter, case when event_id % 1009 = 1008 then 429 else 200 end as http_status from events)"""


@query("provider_metrics", _REQ + """select provider, count(*)::bigint as queries, count(*) filter (where cached)::bigint as cached, count(*) filter (where status = 'skipped')::bigint as skipped, count(*) filter (where budget_hit)::bigint as budget_hits,
  count(*) filter (where cooldown_hit)::bigint as cooldown_hits, sum(items_found)::bigint as items_found, sum(items_after_filter)::bigint as items_after_filter,
  case when bool_or(status = 'error') and bool_or(status in ('ok', 'cached')) then 'partial_error' when bool_or(status = 'error') then 'error' when bool_or(status in ('ok', 'cached')) then 'ok' else 'skipped' end as status from rq group by provider""")
def provider_metrics(spark, d):
    return metrics.provider_metrics(_requests(spark, d))


@query("provider_stats", _REQ + """select provider, count(*)::bigint as attempts, count(*) filter (where status <> 'error')::bigint as successes, count(*) filter (where status = 'error')::bigint as failures, sum(items_found)::bigint as articles,
  arg_max('e' || seq::varchar, seq) filter (where status = 'error') as last_error from rq group by provider""")
def provider_stats(spark, d):
    r = _requests(spark, d)
    return metrics.provider_stats(r.select("seq", "provider", F.when(F.col("status") == "error", F.concat(F.lit("e"), F.col("seq").cast("string"))).alias("error"), F.col("items_found").alias("articles")))


@query("request_budget", _REQ + "select seq, provider, row_number() over (partition by provider, day order by seq) > case provider when 'p0' then 5 when 'p1' then 20 else 1000000 end as budget_hit from rq")
def request_budget(spark, d):
    return payloads.budgeted(_requests(spark, d).drop("budget_hit"), {"p0": 5, "p1": 20}).select("seq", "provider", "budget_hit")


@query("cooldown_skip", _REQ + "select seq, provider, coalesce(max((http_status = 429)::int) over (partition by provider order by seq rows between unbounded preceding and 1 preceding), 0) = 1 as skipped from rq")
def cooldown_skip(spark, d):
    return payloads.cooled(_requests(spark, d)).select("seq", "provider", "skipped")


@query("query_cache", _REQ + ", c as (select distinct provider, 'q' || (seq % 50)::varchar as query from rq where day > date '2024-01-20'), q as (select seq, provider, 'q' || (seq % 50)::varchar as query from rq) select seq, exists (select 1 from c where c.provider = q.provider and c.query = q.query) as hit from q")
def query_cache(spark, d):
    q = _requests(spark, d).select("seq", "provider", "day", F.concat(F.lit("q"), F.pmod("seq", F.lit(50)).cast("string")).alias("query"))
    cache = q.groupBy("provider", "query").agg(F.max(F.date_add("day", 11)).cast("timestamp").alias("expires_at"))
    hit, miss = payloads.cache_split(q.drop("day"), cache, S.AS_OF)
    return hit.select("seq", F.lit(True).alias("hit")).union(miss.select("seq", F.lit(False)))


@query("provider_caps", _REQ + """, p as (select 'q' || (seq % 50)::varchar as query, round(avg(items_found), 4) as precision from rq group by 1), q as (select provider, 'q' || (seq % 50)::varchar as query, min(seq) as seq from rq group by all),
r as (select q.*, coalesce(p.precision, 0) as precision, row_number() over (partition by provider order by coalesce(p.precision, 0) desc, seq) as place from q left join p using (query))
select provider, query, place::bigint as place from r where place <= case provider when 'p0' then 10 when 'p1' then 40 when 'p2' then 25 else 1000000 end""")
def provider_caps(spark, d):
    r = _requests(spark, d).withColumn("query", F.concat(F.lit("q"), F.pmod("seq", F.lit(50)).cast("string")))
    precision = r.groupBy("query").agg(F.round(F.avg("items_found"), 4).alias("precision"))
    return metrics.ordered_queries(r.groupBy("provider", "query").agg(F.min("seq").alias("seq")), precision, {"p0": 10, "p1": 40, "p2": 25}).select("provider", "query", F.col("place").cast("long").alias("place"))


@query("mirror_actions", "select 'k' || p_partkey::varchar as digest_key, case when p_partkey in (select o_custkey from orders) then 'update' else 'create' end as action from part")
def mirror_actions(spark, d):
    pages = S.table(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("digest_key"), F.col("o_custkey").alias("page_id")).distinct()
    a = S.table(spark, d, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("digest_key"), F.col("p_name").alias("headline"), F.col("p_brand").alias("competitor"), F.lit("n").alias("region"),
                                         *[F.lit("").alias(c) for c in ("country", "topic", "priority", "what_happened", "url")], F.lit(0.5).alias("confidence"), F.lit(1).alias("score"), F.lit(None).cast("date").alias("resolved_date"))
    return sinks.mirror_actions(a, pages).select("digest_key", "action")


# J1, J2

@query("query_expansion", "with d as (select 1) select * from (values " + ", ".join(
    f"({O.lit(q)}, {O.lit(r)}, {O.lit(b)}, {O.lit(t)}, {n + 1})" for n, (q, r, b, t) in enumerate({
        q: (q, r, b, t) for r, b, t, q in reversed([(r, b, t, q) for r, bs in CFG.brands.items() for b in bs for t in CFG.topic_order() for q in (
            f'"{b}" {" OR ".join(CFG.topics[t])} {" OR ".join(CFG.regions[r].geo_terms)}', f'"{b}" {t.replace("_", " ")} {CFG.regions[r].label} {" OR ".join(CFG.regions[r].language_hints)}')])
    }[q] for q in dict.fromkeys(q for r, bs in CFG.brands.items() for b in bs for t in CFG.topic_order() for q in (
        f'"{b}" {" OR ".join(CFG.topics[t])} {" OR ".join(CFG.regions[r].geo_terms)}', f'"{b}" {t.replace("_", " ")} {CFG.regions[r].label} {" OR ".join(CFG.regions[r].language_hints)}')))) + ") v(query, owner_region, owner_competitor, owner_topic, seq)")
def query_expansion(spark, d):
    return CFG.queries(spark)


@query("provider_query_texts")
def provider_query_texts(spark, d):
    return settings.provider_queries(spark, settings.default_config())


# J9, J10, J11, J21, W5, F10, F11

@query("url_dedup_best_quality", "with" + O.ARTICLES + """, q as (select *, row_number() over (partition by url order by case source_tier when 'tier2_direct' then 2 when 'tier1_aggregator' then 1 else 0 end desc,
  case provider when 'regional_rss' then 4 when 'guardian' then 3 when 'gdelt' then 2 else 1 end desc, (snippet <> '')::int desc, seq asc) as rn from art) select seq, url from q where rn = 1""")
def url_dedup_best_quality(spark, d):
    return similar.best_by_url(S.articles(spark, d)).select("seq", "url")


_PAIRS = "with" + O.ARTICLES + ", k0 as (select seq, " + O.key("title") + " as k from art), k as (select min(seq) as seq, k from k0 where k <> '' group by k), tk as (select *, " + O.tokens("k") + """ as tok, string_split(k, ' ') as w from k),
p as (select a.seq as l_id, b.seq as r_id, a.tok as ta, b.tok as tb, a.k as ka, b.k as kb, a.w as wa, b.w as wb from tk a join tk b on a.seq > b.seq),
q as (select *, len(list_intersect(ta, tb)) as n_both, least(len(ta), len(tb)) as short from p)
select l_id, r_id from q where (least(len(wa), len(wb)) >= 5 and case when len(wa) <= len(wb) then contains(kb, ka) else contains(ka, kb) end)
  or (short >= 3 and ((n_both >= 3 and n_both >= 0.85::double * short) or (n_both >= 4 and (n_both >= 0.6::double * short or n_both >= 0.45::double * (len(ta) + len(tb) - n_both)))))"""


@query("fuzzy_dup_pairs", _PAIRS)
def fuzzy_dup_pairs(spark, d):
    k = similar.keyed(S.articles(spark, d)).where("title_key <> ''")
    first = k.groupBy("title_key").agg(F.min("seq").alias("id"), F.first("tokens").alias("tokens"))
    return similar.sql_pairs(first)


@query("fuzzy_dedup_full")
def fuzzy_dedup_full(spark, d):
    return similar.deduplicated(S.articles(spark, d))[0].select("seq", "slot", "url", "provider")


_HIST = "with" + O.CLASSIFIED + ", n as (select seq, competitor, topic_group, region, country_hint, " + O.key("title") + " as k from cls where drop_reason is null), nt as (select *, " + O.tokens("k") + """ as tok, string_split(k, ' ') as w from n),
h as (select * from nt where seq % 3 = 0), a as (select * from nt where seq % 3 <> 0),
hit as (select a.seq from a join h on a.competitor = h.competitor and a.topic_group = h.topic_group and a.k <> '' and h.k <> ''
  and not (a.country_hint is not null and h.country_hint is not null and a.country_hint <> h.country_hint) and not (a.country_hint is null and a.region is not null and h.region is not null and a.region <> h.region)
  where a.k = h.k or (least(len(a.w), len(h.w)) >= 5 and case when len(a.w) <= len(h.w) then contains(h.k, a.k) else contains(a.k, h.k) end)
  or (least(len(a.tok), len(h.tok)) >= 3 and ((len(list_intersect(a.tok, h.tok)) >= 3 and len(list_intersect(a.tok, h.tok)) >= 0.85::double * least(len(a.tok), len(h.tok)))
    or (len(list_intersect(a.tok, h.tok)) >= 4 and (len(list_intersect(a.tok, h.tok)) >= 0.6::double * least(len(a.tok), len(h.tok)) or len(list_intersect(a.tok, h.tok)) >= 0.45::double * (len(a.tok) + len(h.tok) - len(list_intersect(a.tok, h.tok))))))))
select seq from a where seq not in (select seq from hit)"""


@query("history_similar_anti", _HIST)
def history_similar_anti(spark, d):
    rows = _candidates(spark, d).withColumn("canonical_topic", gate.canonical_topic("topic_group")).withColumn("digest_key", F.col("seq").cast("string"))
    return similar.suppressed_by_history(rows.where("seq % 3 <> 0"), rows.where("seq % 3 = 0"), with_ratio=False).select("seq")


@query("history_similar_full")
def history_similar_full(spark, d):
    rows = _candidates(spark, d).withColumn("canonical_topic", gate.canonical_topic("topic_group")).withColumn("digest_key", F.col("seq").cast("string"))
    return similar.suppressed_by_history(rows.where("seq % 3 <> 0"), rows.where("seq % 3 = 0")).select("seq")


@query("suppress_within")
def suppress_within(spark, d):
    rows = _accepted(spark, d).withColumn("canonical_topic", gate.canonical_topic("topic_group")).withColumn("rank_in", F.col("seq"))
    return similar.suppressed_within(rows).select("seq")


@query("date_band_dup", _PAIRS.replace("select l_id, r_id from q where (", "select l_id, r_id from q where ((").replace("contains(ka, kb) end)\n  or (short", "contains(ka, kb) end))\n  or (abs(l_id % 31 - r_id % 31) <= 7 and short"))
def date_band_dup(spark, d):
    k = similar.keyed(S.articles(spark, d)).where("title_key <> ''").groupBy("title_key").agg(F.min("seq").alias("id"))
    rows = k.select("id", F.col("title_key").alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("id", F.lit(31)).cast("int")).alias("day"))
    return similar.date_band_pairs(rows)


# F27, F28, P29

@query("article_body_regex", r"""
with a as (select page_id, regexp_replace(html, '(?is)<(script|style|noscript|svg|iframe)[^>]*>.*?</(script|style|noscript|svg|iframe)>', ' ', 'g') as h from pages),
b as (select page_id, list_transform(regexp_extract_all(h, '(?is)<(?:p|li)(?:\s[^>]*)?>(.*?)</(?:p|li)>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as ps from a)
select page_id, array_to_string(list_filter(ps, lambda x: length(x) >= 40), chr(10)) as body from b""")
def article_body_regex(spark, d):
    return S.table(spark, d, "pages").select("page_id", html.body_regex(F.col("html")).alias("body"))


@query("article_body")
def article_body(spark, d):
    return S.table(spark, d, "pages").select("page_id", html.page_text(F.col("html")).alias("body"), html.page_date(F.col("html")).alias("published"))


# payloads

_JSON = r"""select page_id, 'u' || page_id::varchar as url, 'T ' || page_id::varchar as title from pages where page_id % 5 < 3"""


def _payloads(spark, d):
    p = S.table(spark, d, "pages")
    n, i = F.pmod("page_id", F.lit(5)), F.col("page_id").cast("string")
    body = (
        F.when(n == 0, F.concat(F.lit('{"articles": [{"title": "T '), i, F.lit('", "url": "u'), i, F.lit('", "domain": "d.com", "seendate": "20240101T000000Z"}]}')))
        .when(n == 1, F.concat(F.lit('{"status": "ok", "articles": [{"title": "T '), i, F.lit('", "url": "u'), i, F.lit('", "source": {"name": "N"}, "publishedAt": "2024-01-01", "content": "c"}]}')))
        .when(n == 2, F.concat(F.lit('{"response": {"results": [{"webTitle": "T '), i, F.lit('", "webUrl": "u'), i, F.lit('", "fields": {"trailText": "", "bodyText": "b"}}]}}')))
        .when(n == 3, "<html>busy</html>").otherwise("{broken")
    )
    provider = F.when(n == 1, "newsapi").when(n == 2, "guardian").otherwise("gdelt")
    none = F.lit(None).cast("string")
    return p.select(provider.alias("provider"), i.alias("query"), F.col("page_id").alias("seq"), F.lit(200).alias("http_status"), none.alias("content_type"), body.alias("body"), none.alias("error"), *[none.alias(f"feed_{c}") for c in ("name", "url", "region", "language")])


@query("payload_articles", "select page_id * 1000 as seq, title, url, case page_id % 5 when 0 then 'd.com' when 1 then 'N' else 'The Guardian' end as source, case page_id % 5 when 0 then '' when 1 then 'c' else 'b' end as snippet from (" + _JSON + ")")
def payload_articles(spark, d):
    return payloads.articles(payloads.parsed(_payloads(spark, d)), CFG).select("seq", "title", "url", "source", "snippet")


@query("payload_diagnostics", "select page_id as seq, case when page_id % 5 = 3 then 'non-JSON response body' when page_id % 5 = 4 then 'invalid JSON response' end as exception, case when page_id % 5 < 3 then 1 else 0 end as items_found, case when page_id % 5 < 3 then 1 else 0 end::bigint as items_after_filter, case when page_id % 5 < 3 then 'ok' else 'error' end as status from pages")
def payload_diagnostics(spark, d):
    rows = payloads.parsed(_payloads(spark, d))
    return payloads.diagnostics(rows, payloads.articles(rows, CFG)).select("seq", "exception", "items_found", "items_after_filter", "status")


# texts

_ALERTS = "with" + O.GATED + ", a as (select *, replace(topic_group, '_', ' ') as tl, coalesce(country_hint, '') as country, coalesce(nullif(coalesce(country_hint, ''), ''), nullif(coalesce(region, ''), ''), 'the market') as market from decided where rejection_reason is null)"


@query("alert_texts", _ALERTS + """select seq, competitor || ' ' || tl || ' move' || case when country <> '' then ' in ' || country else '' end as event,
  competitor || ' is reported to have made a ' || tl || ' move. Detected signals: ' || array_to_string(matched, ', ') || '.' as what_happened, 'Possible impact on brand narrative, growth messaging, or driver/rider perception around ' || market || '.' as potential_impact from a""")
def alert_texts(spark, d):
    return enrich.fallback(_accepted(spark, d)).select("seq", "event", "what_happened", "potential_impact")


@query("strategist_block", _ALERTS + "select seq, topic_group = 'product_features_innovation' as product_strategist_invoked, case when topic_group = 'product_features_innovation' then 'This feature or service move may shift parity expectations for riders or drivers in ' || market || '.' end as product_take from a")
def strategist_block(spark, d):
    return enrich.strategist(enrich.fallback(_accepted(spark, d))).select("seq", "product_strategist_invoked", "product_take")


@query("truth_layer", _ALERTS + """select seq, case when region is not null then region when competitor = 'Ther' then 'north' when competitor in ('Thing', 'Erin') then 'south' else '' end as safe_region, country,
  case when region is not null then 'pipeline' else 'empty' end as region_source, case when country <> '' then 'pipeline' else 'empty' end as country_source from a""")
def truth_layer(spark, d):
    return enrich.truth(_accepted(spark, d), CFG).select("seq", "safe_region", "country", "region_source", "country_source")


@query("render_digest_md", "with" + O.SCORED + r""", e as (select region, rank, E'\n\n## ' || rank::varchar || '. Competitor Alert — ' || region || E'\n\n- Competitor: Brand\n- Event: ' || headline || E'\n- Priority: ' || priority || E'\n- Where: ' || region || E'\n- Confidence: ' || confidence::varchar
  || E'\n\n### What happened\nMove.\n\n### Why it matters\nIt does.\n\n### Potential impact\nSome.\n\n### Source\nhttps://x.example.com/' || seq::varchar as t from ranked where rank <= 12)
select region, count(*)::bigint as alerts, E'# Digest Preview\n\n- Generated at: now\n- Alerts: ' || count(*)::varchar || string_agg(t, '' order by rank) as document from e group by region""")
def render_digest_md(spark, d):
    rows = digest.top(digest.ranked(S.scored(spark, d)), 12)
    none = F.lit("")
    rows = rows.withColumns({"competitor": F.lit("Brand"), "event": F.col("headline"), "topic": none, "country": none, "what_happened": F.lit("Move."), "why_it_matters": F.lit("It does."), "potential_impact": F.lit("Some."),
                             "url": F.concat(F.lit("https://x.example.com/"), F.col("seq").cast("string")), "product_take": none, "product_risk": none, "product_follow_up": none})
    return render.markdown_digest(rows, "now")


@query("alert_promotion", "with" + O.GATED + """select seq, lower(competitor) || '::' || topic_group || '::' || url as digest_key, priority_hint as priority, greatest(0.35::double, least(0.95::double, score::double / 10)) as confidence, summary as reason from decided where rejection_reason is null""")
def alert_promotion(spark, d):
    return digest.alerts(_accepted(spark, d)).select("seq", "digest_key", "priority", "confidence", "reason")


# F32, F33, W8, O6, P34

_terms = {k: "list_filter([" + ", ".join(f"case when regexp_matches(c, {O.lit('(^|[^a-z0-9])' + X.quoted(t) + '([^a-z0-9]|$)')}) then {O.lit(t)} end" for t in sorted(ts)) + "], lambda x: x is not null)" for k, ts in (("company", ("ther", "than")), ("service", legacy.SERVICE), ("comp", legacy.COMPETITORS), ("reg", legacy.REGULATION), ("noise", legacy.NOISE))}
_LEG = "with" + O.ARTICLES + ", l as (select *, trim(regexp_replace(" + O.fold("concat_ws(' ', nullif(title, ''), nullif(snippet, ''), nullif(url, ''))") + r", '\s+', ' ', 'g')) as c from art), t as (select *, " + ", ".join(f"{v} as m_{k}" for k, v in _terms.items()) + """ from l),
s as (select *, greatest(0, least(10, case when len(m_company) > 0 then 7 else 0 end + case when len(m_service) > 0 then 2 else 0 end + case when len(m_comp) > 0 then 1 else 0 end + case when len(m_reg) > 0 then 1 else 0 end - case when len(m_noise) > 0 and len(m_company) = 0 then 2 else 0 end))::int as relevance_score from t)"""


@query("legacy_heuristic", _LEG + "select seq, relevance_score, relevance_score >= 7 as is_business_critical, case when len(m_company) > 0 and len(m_service) > 0 then 'Прямое упоминание сервиса ther' when len(m_company) > 0 then 'Прямое упоминание ther' when len(m_reg) > 0 then 'Регулирование такси или доставки' when len(m_comp) > 0 then 'Активность конкурентов' when len(m_service) > 0 then 'Рынок мобильности или доставки' else 'Низкая релевантность' end as main_topic from s")
def legacy_heuristic(spark, d):
    return legacy.heuristic(S.articles(spark, d), ("ther", "than")).select("seq", "relevance_score", "is_business_critical", "main_topic")


@query("legacy_renumber", "with" + O.ARTICLES + "select seq, (row_number() over (order by published_at, lower(title), seq))::bigint as number from art")
def legacy_renumber(spark, d):
    return legacy.renumbered(S.articles(spark, d)).select("seq", F.col("number").cast("long").alias("number"))


# whole runs

@query("digest_topn", "with" + O.GATED + """, d as (select *, greatest(0.35::double, least(0.95::double, score::double / 10)) as confidence from decided where rejection_reason is null),
r as (select *, row_number() over (partition by region order by case priority_hint when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end desc, published_at desc, confidence desc, score desc, seq) as rank from d)
select region, rank::bigint as rank, seq, competitor, topic_group, score from r where rank <= 12""")
def digest_topn(spark, d):
    rows = digest.resolved(digest.alerts(_accepted(spark, d)))
    return digest.top(digest.ranked(rows), CFG.digest_limit).select("region", F.col("rank").cast("long").alias("rank"), "seq", "competitor", "topic_group", "score")


@query("pipeline_digest")
def pipeline_digest(spark, d):
    return pipeline.run(S.articles(spark, d), CFG, S.AS_OF)["digest"].select("region", "rank", "seq", "competitor", "topic_group", "score", "priority", "digest_key")


@query("pipeline_summary")
def pipeline_summary(spark, d):
    s = pipeline.run(S.articles(spark, d), CFG, S.AS_OF)["summary"]
    return s.withColumn("drop_reasons", F.to_json("drop_reasons"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_topn(spark, sf_dir)
