"""Provider responses to articles and diagnostics (survey S2 to S8, S11, S13, S24, S29, S30, O4).

A payload row is (provider, query, seq, http_status, content_type, body, error) and, for feeds, feed_name, feed_url, feed_region,
feed_language. Parsing is a plan over such rows: JSON by from_json, XML by the standard parser over Arrow batches; what
cannot be read becomes a diagnostic row, never a failed job.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.config import PAGE_SIZES, SignalConfig
from newsloom.functions import text as X
from newsloom.functions.html import plain
from newsloom.operators.classify import feed_brand
from newsloom.operators.normalize import conformed

PAYLOAD = "provider string, query string, seq long, http_status int, content_type string, body string, error string, feed_name string, feed_url string, feed_region string, feed_language string"
ITEM = "array<struct<title:string,url:string,published_at:string,snippet:string,source:string>>"
SHAPES = {
    "gdelt": "struct<articles:array<struct<title:string,url:string,domain:string,seendate:string,snippet:string>>>",
    "newsapi": "struct<status:string,code:string,message:string,articles:array<struct<title:string,url:string,source:struct<name:string>,publishedAt:string,description:string,content:string>>>",
    "guardian": "struct<response:struct<results:array<struct<webTitle:string,webUrl:string,webPublicationDate:string,fields:struct<trailText:string,bodyText:string>>>>>",
}
FEEDS = ("google_news_rss", "regional_rss")
FLAGS = ("cached", "cooldown_hit", "budget_hit")


def rss_items(body: str | None) -> list[dict] | None:
    """Items of an RSS document; None if it is not one."""
    try:
        root = ElementTree.fromstring(body or "")
    except ElementTree.ParseError:
        return None
    def local(e):
        return e.tag.rsplit("}", 1)[-1]

    out = []
    for item in root.iter():
        if local(item) != "item":
            continue
        found: dict[str, str] = {}
        for child in item:
            found.setdefault(local(child), "".join(child.itertext()).strip())
        out.append({"title": found.get("title", ""), "url": found.get("link", ""), "published_at": found.get("pubDate") or found.get("date", ""), "snippet": found.get("description", ""), "source": found.get("source", "")})
    return out


def _xml(body: Column) -> Column:
    @F.pandas_udf(ITEM)
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([rss_items(b) for b in bodies], dtype=object)

    return run(body)


def body_kind() -> Column:
    """What a JSON provider's body really is: the ladder from empty to json."""
    b = F.ltrim(X.text("body"))
    return F.when(b == "", "empty").when(b.startswith("<"), "html").when(~b.rlike(r"^[\[{]"), "text").when(F.try_parse_json(b).isNull(), "invalid_json").otherwise("json")


def _none_if_blank(c: Column) -> Column:
    return F.nullif(X.clean(c), F.lit(""))


def _items(provider: str, parsed: Column) -> Column:
    def made(title, url, at, snippet, source):
        return F.struct(title.alias("title"), url.alias("url"), at.alias("published_at"), snippet.alias("snippet"), source.alias("source"))

    if provider == "gdelt":
        return F.transform(parsed.articles, lambda a: made(a.title, a.url, a.seendate, a.snippet, a.domain))
    if provider == "newsapi":
        return F.transform(parsed.articles, lambda a: made(a.title, a.url, a.publishedAt, F.coalesce(_none_if_blank(a.description), a.content), a.source["name"]))
    return F.transform(parsed.response.results, lambda a: made(a.webTitle, a.webUrl, a.webPublicationDate, F.coalesce(_none_if_blank(a.fields.trailText), _none_if_blank(a.fields.bodyText), F.lit("")), F.lit("The Guardian")))


def parsed(payloads: DataFrame) -> DataFrame:
    """Adds items (null where the body cannot be used), body_kind and exception."""
    kind = F.when(F.col("provider").isin(*FEEDS), "xml").otherwise(body_kind())
    rows = payloads.withColumn("body_kind", kind)
    items = F.when(F.col("body_kind") == "xml", _xml(F.col("body")))
    api_error = F.lit(None).cast("string")
    for p, shape in SHAPES.items():
        obj = F.from_json("body", shape)
        items = F.when((F.col("provider") == p) & (F.col("body_kind") == "json"), _items(p, obj)).otherwise(items)
        if p == "newsapi":
            api_error = F.when((F.col("provider") == p) & (F.col("body_kind") == "json") & (obj.status == "error"), F.concat_ws(": ", obj.code, obj.message))
    bad = F.coalesce(F.col("http_status") >= 400, F.lit(False))
    why = F.coalesce(
        F.col("error"), F.when(bad, F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))), api_error,
        F.when(F.col("body_kind") == "empty", "empty response body").when(F.col("body_kind").isin("html", "text"), "non-JSON response body").when(F.col("body_kind") == "invalid_json", "invalid JSON response"),
        F.when(F.col("_items").isNull(), "unexpected response structure"),
    )
    return rows.withColumn("_items", items).withColumn("exception", why).withColumn("items", F.when(F.col("exception").isNull(), F.col("_items"))).drop("_items")


def articles(rows: DataFrame, config: SignalConfig) -> DataFrame:
    """Article rows of parsed payloads: at most the provider's page, without empty URLs; feed items only if they name a brand of their region."""
    cap = F.lit(50)
    for p, n in PAGE_SIZES.items():
        cap = F.when(F.col("provider") == p, n).otherwise(cap)
    flat = rows.where("items is not null").select("provider", "query", "feed_name", "feed_url", "feed_region", "feed_language", F.col("seq").alias("query_seq"), F.posexplode(F.slice("items", F.lit(1), cap)).alias("pos", "item"))
    flat = flat.where(X.clean(F.col("item.url")) != "")
    snippet = F.when(F.col("provider").isin(*FEEDS), plain(F.col("item.snippet"))).otherwise(X.clean(F.col("item.snippet")))
    flat = flat.withColumns({"title": X.clean(F.col("item.title")), "url": F.trim("item.url"), "published_at": F.col("item.published_at"), "snippet": snippet, "source": X.source_or_domain(F.col("item.source"), F.col("item.url"))})
    folded = X.fold(X.blob("title", "snippet"))
    hint = F.lit(None).cast("string")
    for r in config.regions:
        hint = F.when(F.col("feed_region") == r, feed_brand(folded, config, config.brands.get(r, ()))).otherwise(hint)
    direct = F.col("provider") == "regional_rss"
    flat = flat.withColumn("_hint", hint).where(~direct | F.col("_hint").isNotNull())
    return conformed(flat.withColumns({
        "seq": F.col("query_seq") * 1000 + F.col("pos"), "competitor_hints": F.when(F.col("_hint").isNotNull(), F.array("_hint")), "source_tier": F.when(direct, "tier2_direct").otherwise("tier1_aggregator"),
        "region": F.when(direct & (X.text("feed_language") != ""), F.col("feed_region")), "language": F.when(direct, F.nullif("feed_language", F.lit(""))),
        "query_owner_region": F.when(direct, F.col("feed_region")), "direct_feed_name": F.when(direct, F.col("feed_name")), "direct_feed_url": F.when(direct, F.col("feed_url")),
    }))


def diagnostics(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row per request: status, items found and kept, what went wrong."""
    kept = found.groupBy("provider", "query", F.coalesce("direct_feed_url", F.lit("")).alias("_f")).agg(F.count("*").alias("items_after_filter"))
    out = rows.withColumn("_f", F.when(F.col("provider") == "regional_rss", X.text("feed_url")).otherwise("")).join(kept, ["provider", "query", "_f"], "left")
    flags = [F.lit(False).alias(c) if c not in rows.columns else F.col(c) for c in FLAGS]
    status = F.when(F.col("exception").isNotNull(), "error").otherwise("ok")
    return out.select("provider", "query", "seq", "http_status", "exception", "body_kind", F.coalesce(F.size("items"), F.lit(0)).alias("items_found"), F.coalesce("items_after_filter", F.lit(0)).alias("items_after_filter"),
                      status.alias("status"), "feed_name", "feed_url", "feed_region", *flags)


def unsupported(spark, names) -> DataFrame:
    """Diagnostics of unknown providers: an error is data."""
    return spark.createDataFrame([(n, "", 0, None, f"unsupported provider: {n}", None, 0, 0, "error") for n in names],
                                 "provider string, query string, seq long, http_status int, exception string, body_kind string, items_found int, items_after_filter long, status string")


def budgeted(requests: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Adds budget_hit: requests beyond a provider's daily limit (S18); requests has provider, day, seq."""
    cap = F.lit(None).cast("int")
    for p, n in limits.items():
        cap = F.when(F.col("provider") == p, n).otherwise(cap)
    place = F.row_number().over(W.partitionBy("provider", "day").orderBy("seq"))
    return requests.withColumn("budget_hit", F.coalesce(place > cap, F.lit(False)))


def cooled(requests: DataFrame) -> DataFrame:
    """Adds skipped: requests of a run after the first that was told to slow down (S16); requests has provider, seq, http_status."""
    slowed = requests.where("http_status = 429").groupBy(F.col("provider").alias("_provider")).agg(F.min("seq").alias("_slowed"))
    joined = requests.join(slowed, F.col("provider").eqNullSafe(F.col("_provider")), "left")
    return joined.withColumn("skipped", F.coalesce(F.col("seq") > F.col("_slowed"), F.lit(False))).drop("_provider", "_slowed")


def cache_split(queries: DataFrame, cache: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(payloads from the cache, queries to fetch): entries live until expires_at."""
    live = cache.where(F.col("expires_at") > F.lit(as_of).cast("timestamp"))
    return queries.join(live, ["provider", "query"]), queries.join(live, ["provider", "query"], "left_anti")


def feed_specs(config: SignalConfig, spark) -> DataFrame:
    """Curated feeds, the first of each (region, url)."""
    feeds = config.dims(spark)["feed"]
    return feeds.join(feeds.groupBy("region", "url").agg(F.min("ord").alias("ord")), ["region", "url", "ord"])
