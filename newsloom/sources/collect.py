"""Collecting a run's articles: queries and feeds in, articles and diagnostics out, with state kept over runs (survey S14 to S19, C6).

The store keeps a log of requests and a cache of payloads. A query whose payload is still alive is not sent; a provider that
was told to slow down rests; a provider's requests of a day and of a run are bounded. What is not sent is a diagnostic row.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import SignalConfig, provider_queries
from newsloom.operators import metrics
from newsloom.operators.normalize import owned
from newsloom.operators.similar import checkpointed
from newsloom.sinks import TableStore
from newsloom.sources import fetch, payloads

#: Requests of a day, queries of a run, seconds a payload lives and a slowed provider rests.
DAILY = {"newsapi": 90, "guardian": 450}
PER_RUN = {"gdelt": 10, "newsapi": 25, "guardian": 40}
LIFETIME, LIVES = {"newsapi": 600}, 900
REST = {"gdelt": 60, "newsapi": 900, "guardian": 900}
KEYED = ("guardian", "newsapi")
LOG = "provider string, query string, at timestamp, http_status int"
CACHE = payloads.PAYLOAD + ", expires_at timestamp"


def stamp(as_of: str, days: int = 0) -> str:
    """A time, or one some days before it, as a name that sorts by time."""
    return (datetime.datetime.fromisoformat(as_of) - datetime.timedelta(days=days)).strftime("%Y-%m-%d-%H-%M-%S")


def planned(spark: SparkSession, config: SignalConfig, as_of: str, regions=None, days: int = 7, keys: dict[str, str] | None = None, precision: DataFrame | None = None) -> list[dict]:
    """The requests of a run in order: searches, a provider's most precise queries first (``precision``: query, precision), then by topic
    priority; then feeds. Searches that need a key are left out without one."""
    keys, out = keys or {}, []
    queries = provider_queries(spark, config, regions)
    queries = queries.withColumn("place", F.col("seq")) if precision is None else metrics.ordered_queries(queries, precision, {})
    for r in queries.orderBy("place", "seq").collect():  # as many as the configuration says
        p = r["provider"]
        if p in fetch.SEARCHES and (p not in KEYED or keys.get(p)):
            out.append({"provider": p, "query": r["query"], "seq": len(out), "url": fetch.request_url(p, r["query"], days, keys.get(p, ""), as_of)})
    chosen = config.selected(regions)
    for f in payloads.feed_specs(config, spark).orderBy("region", "ord").collect():
        if f["region"] in chosen:
            out.append({"provider": "regional_rss", "query": "", "seq": len(out), "url": f["url"], "feed_url": f["url"], "feed_name": f["name"], "feed_region": f["region"], "feed_language": f["language"]})
    return out


def allowed(requests: list[dict], log: DataFrame, as_of: str) -> tuple[list[dict], list[tuple[dict, str]]]:
    """(to send, left out with the reason) under the budgets of the day and the run and the rest of slowed providers."""
    now = datetime.datetime.fromisoformat(as_of)
    today = log.where(F.to_date("at") == F.lit(as_of[:10]).cast("date"))
    used = {r["provider"]: r["count"] for r in today.groupBy("provider").count().collect()}
    slowed = {r["provider"]: r["at"] for r in log.where("http_status = 429").groupBy("provider").agg(F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("at")).collect()}
    send, left, run = [], [], {}
    for r in requests:
        p = r["provider"]
        if p in slowed and (now - datetime.datetime.fromisoformat(slowed[p])).total_seconds() < REST.get(p, 0):
            left.append((r, "cooldown"))
        elif used.get(p, 0) >= DAILY.get(p, 1 << 31) or run.get(p, 0) >= PER_RUN.get(p, 1 << 31):
            left.append((r, "budget"))
        else:
            send.append(r)
            used[p], run[p] = used.get(p, 0) + 1, run.get(p, 0) + 1
    return send, left


def collected(spark: SparkSession, config: SignalConfig, store: TableStore, as_of: str, regions=None, days: int = 7, keys: dict[str, str] | None = None, transport: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, diagnostics) of a run's searches and feeds; the log and the cache grow by what was sent."""
    at = F.lit(as_of).cast("timestamp")
    precision = metrics.learned_precision(store.read("query_evidence", metrics.EVIDENCE + ", run string"), as_of)
    requests = planned(spark, config, as_of, regions, days, keys, precision)
    # tables in places by time: older ones are not read, and those that nothing can ask for any more go
    run, oldest = stamp(as_of), stamp(as_of, days=1)
    live = store.read("payload_cache", CACHE + ", run string").where((F.col("run") >= oldest) & (F.col("expires_at") > at)).drop("run")
    log = store.read("requests", LOG + ", run string").where(F.col("run") >= oldest).drop("run")
    store.prune("payload_cache", oldest)
    store.prune("requests", stamp(as_of, days=30))
    place = F.coalesce("feed_url", F.lit(""))
    held = live.select("provider", "query", place.alias("feed_url"), "expires_at", *[c for c in fetch.FIELDS if c not in ("provider", "query", "feed_url", "seq")])
    known = {(r["provider"], r["query"], r["feed_url"]) for r in held.select("provider", "query", "feed_url").distinct().collect()}
    cached = [r for r in requests if (r["provider"], r["query"], r.get("feed_url", "")) in known]
    send, left = allowed([r for r in requests if (r["provider"], r["query"], r.get("feed_url", "")) not in known], log, as_of)
    got = checkpointed(fetch.fetch(spark, send, transport))
    store.put("requests", got.select("provider", "query", at.alias("at"), F.col("http_status").cast("int").alias("http_status")), run)
    lives = F.lit(LIVES)
    for p, seconds in LIFETIME.items():
        lives = F.when(F.col("provider") == p, seconds).otherwise(lives)
    store.put("payload_cache", got.where("error is null and http_status < 400").withColumn("expires_at", at + F.make_dt_interval(secs=lives)), run)
    if cached:
        turn = spark.createDataFrame([(r["provider"], r["query"], r.get("feed_url", ""), r["seq"]) for r in cached], "provider string, query string, feed_url string, seq long")
        newest = held.groupBy("provider", "query", "feed_url").agg(F.max("expires_at").alias("expires_at"))
        again = held.join(newest, ["provider", "query", "feed_url", "expires_at"]).dropDuplicates(["provider", "query", "feed_url"]).join(turn, ["provider", "query", "feed_url"])
        again = again.withColumn("feed_url", F.nullif("feed_url", F.lit("")))
        got = got.unionByName(again.select(*[F.col(c).cast(got.schema[c].dataType).alias(c) for c in got.columns]))
    found = checkpointed(payloads.parsed(got))
    queries = provider_queries(spark, config, regions)
    owners = queries.groupBy("query").agg(F.min_by(F.struct("owner_region", "owner_competitor", "owner_topic"), "seq").alias("o")).select("query", "o.*")
    articles = owned(payloads.articles(found, config), owners)
    told = payloads.diagnostics(found, articles)
    if left:
        rows = [(r["provider"], r["query"], r["seq"], why) for r, why in left]
        extra = spark.createDataFrame(rows, "provider string, query string, seq long, exception string").withColumns({
            "status": F.lit("skipped"), "cached": F.lit(False), "budget_hit": F.col("exception") == "budget", "cooldown_hit": F.col("exception") == "cooldown"})
        told = told.unionByName(extra, allowMissingColumns=True)
    return articles, told
