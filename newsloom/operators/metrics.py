"""Quality metrics (survey A1 to A15, J14, J16, F22, F23, O3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as X

FEED = ("region", "feed_name", "feed_url")
SUMS = ("items_found", "provider_matches", "raw_articles_after_global_dedup", "prefilter_passed", "candidates_kept", "alerts_created", "dropped_prefilter")


def noise_ratio(items: Column, matches: Column, kept: Column) -> Column:
    return F.when(matches > 0, F.round(1.0 - kept / matches, 4)).when(items > 0, 1.0).otherwise(0.0)


def recommendation(items: Column, matches: Column, passed: Column, alerts: Column) -> Column:
    """What to do about a feed (A3)."""
    return (
        F.when((items >= 15) & (matches == 0), "consider_removal_broad_feed")
        .when((matches >= 8) & (alerts == 0) & (passed <= 1), "consider_removal_high_noise")
        .when((matches >= 5) & (passed <= 1), "review_low_signal")
        .when((matches >= 5) & (alerts == 0), "review_low_alert_yield").otherwise("keep")
    )


def feed_health(metrics: DataFrame, as_of: str, days: int = 30, min_items: int = 5, limit: int = 20) -> DataFrame:
    """Feeds by noise over the last days (A1): one aggregation with a map-side part, then a bounded sort."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {max(1, int(days))} days")
    per = metrics.where(F.col("measured_at") >= cutoff).groupBy("provider", *FEED).agg(F.count("*").alias("snapshots"), *[F.sum(c).cast("long").alias(c) for c in SUMS]).where(F.col("items_found") >= max(0, int(min_items)))
    i, m, k = F.col("items_found"), F.col("provider_matches"), F.col("candidates_kept")
    raw = F.when(m > 0, 1.0 - k / m).when(i > 0, 1.0).otherwise(0.0)
    out = per.withColumns({"noise_ratio": noise_ratio(i, m, k), "recommendation": recommendation(i, m, F.col("prefilter_passed"), F.col("alerts_created")), "_o": raw})
    return out.orderBy(F.col("_o").desc(), i.desc(), "feed_name", "feed_url", "region").limit(max(1, int(limit))).drop("_o")


#: What a run learns about its queries; the weights are decayed to ``landmark``.
EVIDENCE = "query string, articles long, weight double, cw double, aw double, landmark timestamp"


def query_evidence(articles: DataFrame, candidates: DataFrame, alerts: DataFrame, landmark: Column, half_life_days: float = 30.0) -> DataFrame:
    """Decayed counts per query of a run's articles, and of those that became candidates and alerts.

    articles: article_id, query, created_at; candidates: article_id; alerts: article_id. ``landmark``, a Column over articles, is the time the
    weights are decayed to, no earlier than what it weighs: decay on from there is one factor, so evidence of runs adds up.
    """
    has_c = candidates.select("article_id").distinct().withColumn("c", F.lit(1.0))
    has_a = alerts.select("article_id").distinct().withColumn("a", F.lit(1.0))
    rows = articles.withColumn("landmark", landmark).withColumn("w", X.decay(F.col("created_at"), F.col("landmark"), half_life_days))
    rows = rows.join(has_c, "article_id", "left").join(has_a, "article_id", "left")
    return rows.groupBy("query", "landmark").agg(
        F.count("*").alias("articles"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.coalesce("c", F.lit(0.0))).alias("cw"), F.sum(F.col("w") * F.coalesce("a", F.lit(0.0))).alias("aw"),
    ).select(*[c.split()[0] for c in EVIDENCE.split(", ")])


def learned_precision(evidence: DataFrame, as_of: str, half_life_days: float = 30.0) -> DataFrame:
    """Precision per query from the evidence of all runs: 0.4 of candidates plus 0.6 of alerts, shrunk by w / (w + 2).

    Equals the figure over all articles at once, as evidence of each run needs one factor; a row a query and run is all that is read.
    """
    f = X.decay(F.col("landmark"), F.lit(as_of).cast("timestamp"), half_life_days)
    per = evidence.withColumn("f", f).groupBy("query").agg(F.sum("articles").alias("articles"), *[F.sum(F.col(c) * F.col("f")).alias(c) for c in ("weight", "cw", "aw")])
    weight = F.greatest("weight", F.lit(0.0001))
    score = 0.4 * F.col("cw") / weight + 0.6 * F.col("aw") / weight
    return per.select("query", "articles", F.round(score * weight / (weight + 2.0), 4).alias("precision"))


def query_precision(articles: DataFrame, candidates: DataFrame, alerts: DataFrame, as_of: str, half_life_days: float = 30.0) -> DataFrame:
    """Time-decayed precision per query over all articles."""
    return learned_precision(query_evidence(articles, candidates, alerts, F.lit(as_of).cast("timestamp"), half_life_days), as_of, half_life_days)


def ordered_queries(queries: DataFrame, precision: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Queries per provider, the historically precise first, then in order, up to the provider's cap (O3); queries has provider, query, seq."""
    w = W.partitionBy("provider").orderBy(F.col("precision").desc(), "seq")
    cap = F.lit(None).cast("int")
    for p, n in caps.items():
        cap = F.when(F.col("provider") == p, n).otherwise(cap)
    rows = queries.join(precision.select("query", "precision"), "query", "left").withColumn("precision", F.coalesce("precision", F.lit(0.0))).withColumn("place", F.row_number().over(w))
    return rows.where(cap.isNull() | (F.col("place") <= cap))


def feed_run_metrics(diagnostics: DataFrame, raw: DataFrame, candidates: DataFrame, alerts: DataFrame, dropped: DataFrame) -> DataFrame:
    """Counts of a run per feed (A4, J16). diagnostics: the feed columns, items_found, items_after_filter; raw: the feed columns and url, seq;
    candidates and alerts: the feed columns; dropped: url, which leads to the feed that last brought it."""
    def counted(rows, name):
        return rows.where("feed_name <> ''").groupBy(*FEED).agg(F.count("*").alias(name))

    owner = raw.where("feed_name <> ''").groupBy("url").agg(F.max_by(F.struct(*FEED), "seq").alias("f")).select("url", *[F.col(f"f.{c}").alias(c) for c in FEED])
    out = diagnostics.where("feed_name <> ''").select(*FEED, "items_found", F.col("items_after_filter").alias("provider_matches"))
    for rows, name in ((raw, "raw_articles_after_global_dedup"), (candidates, "candidates_kept"), (alerts, "alerts_created"), (dropped.join(owner, "url"), "dropped_prefilter")):
        out = out.join(counted(rows, name), list(FEED), "left").fillna(0, [name])
    out = out.withColumn("prefilter_passed", F.col("candidates_kept"))
    i, m = F.col("items_found"), F.col("provider_matches")
    return out.withColumns({"noise_ratio": noise_ratio(i, m, F.col("candidates_kept")), "recommendation": recommendation(i, m, F.col("prefilter_passed"), F.col("alerts_created"))})


def provider_metrics(diagnostics: DataFrame) -> DataFrame:
    """Per provider: flags counted, items summed, statuses rolled up (A5, A7, A12). Rows: provider, status, cached, budget_hit, cooldown_hit, items."""
    def n(c):
        return F.count_if(c).cast("long")

    err, ok = F.bool_or(F.col("status") == "error"), F.bool_or(F.col("status").isin("ok", "cached"))
    status = F.when(err & ok, "partial_error").when(err, "error").when(ok, "ok").otherwise("skipped")
    return diagnostics.groupBy("provider").agg(
        F.count("*").alias("queries"), n(F.col("cached")).alias("cached"), n(F.col("status") == "skipped").alias("skipped"), n(F.col("budget_hit")).alias("budget_hits"),
        n(F.col("cooldown_hit")).alias("cooldown_hits"), F.sum("items_found").cast("long").alias("items_found"), F.sum("items_after_filter").cast("long").alias("items_after_filter"), status.alias("status"))


def provider_stats(attempts: DataFrame) -> DataFrame:
    """Attempts, successes, failures, articles and last error per provider (A11); rows: seq, provider, error, articles."""
    return attempts.groupBy("provider").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("error").isNull()).alias("successes"), F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.sum(F.coalesce("articles", F.lit(0))).cast("long").alias("articles"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("last_error"))


def run_summary(raw: DataFrame, candidates: DataFrame, dropped: DataFrame, digest: DataFrame, queries: int) -> DataFrame:
    """One row about a run (A10)."""
    counts = None
    for name, rows in (("raw_articles", raw), ("candidates", candidates), ("dropped", dropped), ("alerts", digest)):
        one = rows.agg(F.count("*").alias(name))
        counts = one if counts is None else counts.crossJoin(one)
    reasons = drop_reasons(dropped)
    return counts.crossJoin(reasons).withColumns({"queries_generated": F.lit(queries), "status": F.when(F.col("alerts") > 0, "ok").otherwise("empty")})


def drop_reasons(dropped: DataFrame) -> DataFrame:
    per = dropped.groupBy("reason").agg(F.count("*").alias("n"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("drop_reasons"))


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))
