"""Views of the synthetic test tables as news entities, and a vocabulary that occurs in their invented prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import SignalConfig
from newsloom.functions import text as X
from newsloom.operators import normalize

AS_OF = "2024-01-31 00:00:00"
CONFIG = SignalConfig.from_dict({
    "regions": {
        "north": {"label": "Northland", "geo_terms": ["thre", "ernd"], "language_hints": ["en", "fr"]},
        "south": {"label": "Southland", "geo_terms": ["attion", "ouan"], "language_hints": ["de", "en"]},
    },
    "competitors_by_region": {"north": ["Ther", "Than"], "south": ["Thing", "Erin", "Than"]},
    "topic_groups": {"market_expansion": ["tion", "thtion", "ertion"], "core_industry_terms": ["erly", "ering", "ered"], "product_features_innovation": ["thble", "erble"]},
    "topic_priority_groups": ["product_features_innovation", "market_expansion"],
    "competitor_aliases": {"Erin": ["erre"]},
    "keyword_templates": ['"{competitor}" {topic_keywords} {geo_terms}', '"{competitor}" {topic_name} {region_label} {language_hints}'],
    "ignored_geo_terms": ["thon"], "daily_digest_limit": 12, "enabled_providers": ["gdelt", "guardian"],
})
PROVIDERS = ("regional_rss", "guardian", "gdelt", "google_news_rss")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw articles: the first sentence is the title, the whole text the snippet."""
    d = table(spark, sf_dir, "documents")
    n = F.pmod("doc_id", F.lit(4))
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (n + 1).cast("int"))
    raw = d.select(
        F.col("doc_id").alias("seq"), F.trim(F.regexp_extract("text", r"^([^\n.]*)", 1)).alias("title"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/a/"), F.pmod("doc_id", F.lit(600)).cast("string"), F.lit("/?utm_source=x&b=2&a="), F.pmod("doc_id", F.lit(3)).cast("string"), F.lit("#top")).alias("url"),
        provider.alias("provider"), F.col("source"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(31)).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.col("text").alias("snippet"), F.concat(F.lit("q"), F.pmod("doc_id", F.lit(40)).cast("string")).alias("query"), F.col("lang").alias("language"),
        F.when(n == 0, "tier2_direct").when(n == 3, "tier1_aggregator").alias("source_tier"),
        F.when(F.pmod("doc_id", F.lit(5)) == 0, "north").when(F.pmod("doc_id", F.lit(5)) == 1, "south").alias("query_owner_region"),
        F.when(F.pmod("doc_id", F.lit(5)) == 0, "Ther").when(F.pmod("doc_id", F.lit(5)) == 1, "Than").alias("query_owner_competitor"),
        F.when(F.pmod("doc_id", F.lit(7)) == 0, F.array(F.lit("Than"))).alias("competitor_hints"),
    )
    return normalize.normalized(normalize.conformed(raw))


def delivery_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "delivered").when(F.col("event_type") == "error", "expired").when(F.col("event_type") == "click", "deferred").otherwise("dry_run")
    return e.select(F.concat(F.lit("k"), F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.lit(700)).cast("string")).alias("alert_key"), F.when(F.pmod("event_id", F.lit(3)) == 0, "mail").otherwise("chat").alias("channel"),
                    F.lit("team").alias("destination"), status.alias("status"), F.col("ts").alias("event_ts"), F.col("event_id").alias("seq"))


def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as scored alerts."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("k"), F.pmod("o_orderkey", F.lit(700)).cast("string")).alias("digest_key"), F.col("o_orderkey").alias("seq"), (F.pmod("o_orderkey", F.lit(11))).cast("int").alias("score"),
        (F.lit("2024-01-25").cast("timestamp") + F.make_dt_interval(F.pmod("o_orderkey", F.lit(7)).cast("int"))).alias("created_at"),
        F.when(F.pmod("o_orderkey", F.lit(3)) > 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("o_orderkey", F.lit(29)).cast("int")), "yyyy-MM-dd")).alias("published_at"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as candidates of a region's digest: region is the customer's, priority and dates are the order's."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    score = F.floor(F.col("o_totalprice") / 50000).cast("int")
    score = F.least(score, F.lit(10))
    return rows.select(
        F.col("o_orderkey").alias("seq"), F.col("r_name").alias("region"), F.col("r_regionkey").alias("region_ord"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("headline"), score.alias("score"),
        X.priority(score).alias("priority"), X.confidence(score).alias("confidence"), F.when(F.pmod("o_orderkey", F.lit(10)) > 0, F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("o_orderkey", F.lit(31)).cast("int"))).alias("resolved_date"),
        F.when(F.pmod("o_orderkey", F.lit(13)) == 0, F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))).alias("deferred_digest_key"), (F.pmod("o_orderkey", F.lit(20)) == 0).alias("allow_undated"),
    )


def feed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as snapshots of feeds."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    f = F.pmod("user_id", F.lit(40))
    kept = F.pmod(k, F.lit(3))
    return e.select(
        F.lit("regional_rss").alias("provider"), F.concat(F.lit("r"), F.pmod("user_id", F.lit(5)).cast("string")).alias("region"), F.concat(F.lit("feed"), f.cast("string")).alias("feed_name"),
        F.concat(F.lit("https://f"), f.cast("string"), F.lit(".example.com/rss")).alias("feed_url"), F.col("ts").alias("measured_at"), (k + 3).cast("long").alias("items_found"), F.pmod(k, F.lit(9)).cast("long").alias("provider_matches"),
        F.pmod(k, F.lit(5)).cast("long").alias("raw_articles_after_global_dedup"), kept.cast("long").alias("prefilter_passed"), kept.cast("long").alias("candidates_kept"), F.pmod(k, F.lit(2)).cast("long").alias("alerts_created"), F.pmod(k, F.lit(4)).cast("long").alias("dropped_prefilter"),
    )
