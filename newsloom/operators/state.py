"""Operational state as append-only tables with latest-state views (survey X1 to X5, P27, P28, J12, J13, J15, K7 to K12, H5).

delivery_events: alert_key, channel, destination, status, event_ts, seq. Nothing is updated in place: a state is the
fold of its events, so a lost write can be repeated and a run can be replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as X

KEY = ("alert_key", "channel", "destination")


def latest(events: DataFrame) -> DataFrame:
    """Current status per key: delivered for good, else the last status that is not a dry run, else dry_run."""
    when = F.struct("event_ts", "seq")
    return events.groupBy(*KEY).agg(
        F.max((F.col("status") == "delivered").cast("int")).alias("_d"), F.max_by("status", F.when(F.col("status") != "dry_run", when)).alias("_s"), F.max("event_ts").alias("last_ts"),
    ).select(*KEY, F.when(F.col("_d") == 1, "delivered").otherwise(F.coalesce("_s", F.lit("dry_run"))).alias("status"), "last_ts")


def sent(events: DataFrame, channel: str, destination: str) -> DataFrame:
    """Keys delivered over a channel to a destination."""
    return events.where((F.col("channel") == channel) & (F.col("destination") == destination) & (F.col("status") == "delivered")).select(F.col("alert_key").alias("digest_key")).distinct()


def recent_history(alerts: DataFrame, events: DataFrame, channel: str, destination: str, limit: int = 200) -> DataFrame:
    """The latest delivered alerts: by publication, else creation, newest first."""
    at = F.coalesce(X.any_date("published_at").cast("timestamp"), F.col("created_at"))
    return alerts.join(sent(events, channel, destination), "digest_key", "left_semi").withColumn("history_ts", at).orderBy(F.col("history_ts").desc_nulls_last(), F.col("digest_key").desc()).limit(limit)


def deferred_pool(alerts: DataFrame, events: DataFrame, channel: str, destination: str, as_of: str, max_age_days: int = 2, limit: int = 100) -> DataFrame:
    """Deferred alerts young enough to come back, best first (X2, J13); deferred_digest_key marks them."""
    open_ = latest(events).where((F.col("channel") == channel) & (F.col("destination") == destination) & (F.col("status") == "deferred")).select(F.col("alert_key").alias("digest_key"))
    young = F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(max_age_days)} days")
    return alerts.join(open_, "digest_key", "left_semi").where(young).orderBy(F.col("score").desc(), F.col("created_at").desc(), "digest_key").limit(limit).withColumn("deferred_digest_key", F.col("digest_key"))


def expirations(alerts: DataFrame, events: DataFrame, channel: str, destination: str, as_of: str, max_age_days: int = 2) -> DataFrame:
    """``expired`` events for deferred alerts that grew too old."""
    old = alerts.where(F.col("created_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(max_age_days)} days")).select(F.col("digest_key").alias("alert_key"))
    open_ = latest(events).where((F.col("channel") == channel) & (F.col("destination") == destination) & (F.col("status") == "deferred"))
    return open_.join(old, "alert_key", "left_semi").select(*KEY, F.lit("expired").alias("status"), F.lit(as_of).cast("timestamp").alias("event_ts"))


def deferrals(digest: DataFrame, delivered: DataFrame, channel: str, destination: str, as_of: str) -> DataFrame:
    """``deferred`` events for what the digest holds and delivery did not send."""
    return digest.select(F.col("digest_key").alias("alert_key")).join(delivered.select("alert_key"), "alert_key", "left_anti").select(
        "alert_key", F.lit(channel).alias("channel"), F.lit(destination).alias("destination"), F.lit("deferred").alias("status"), F.lit(as_of).cast("timestamp").alias("event_ts"))


def new_rows(rows: DataFrame, existing: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """What an insert that ignores known keys would add: first writer wins, within the batch too (K7 to K9)."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first, list(keys)).where(F.col(order) == F.col("_first")).drop("_first").join(existing.select(*keys), list(keys), "left_anti")


def seen(rows: DataFrame, existing: DataFrame) -> DataFrame:
    return rows.join(existing.select("url").distinct(), "url", "left_semi")


def merged_metadata(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Metadata maps per url with the updates' entries on top."""
    entries = base.select("url", F.explode(F.map_entries("metadata")).alias("e"), F.lit(0).alias("p")).unionByName(updates.select("url", F.explode(F.map_entries("metadata")).alias("e"), F.lit(1).alias("p")))
    last = entries.groupBy("url", "e.key").agg(F.max_by("e.value", "p").alias("value"))
    return last.groupBy("url").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def migrated(old: DataFrame, required: dict[str, str]) -> DataFrame:
    """Adds missing columns with defaults (K18): name -> SQL literal."""
    return old.withColumns({k: F.expr(v) for k, v in required.items() if k not in old.columns})
