"""What a run takes from the state of earlier runs and adds to it (survey X1 to X4, P27, K7 to K10, K13).

Everything a run stores stands in a place named after the run, so a run that was killed and is repeated replaces its own rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import delivery
from newsloom.operators import enrich, metrics, state
from newsloom.sinks import TableStore

EVENTS = "alert_key string, channel string, destination string, status string, seq long, external_id string, error_message string, event_ts timestamp"


def run_name(as_of: str, channel: str, destination: str) -> str:
    """Name of a run: its time and where it delivers; ordered by time."""
    return re.sub(r"[^A-Za-z0-9]+", "-", f"{as_of} {channel} {destination}").strip("-")


def stored_state(store: TableStore, but: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(alerts, delivery events) of earlier runs, without those of the run ``but``; both None before the first run."""
    if not store.exists("alerts"):
        return None, None
    alerts = store.spark.read.option("mergeSchema", True).parquet(f"{store.root}/alerts")
    events = store.read("delivery_events", EVENTS + ", run string")
    if but is not None:
        alerts, events = (x.where(F.col("run") != but) for x in (alerts, events))
    alerts, events = alerts.drop("run"), events.drop("run")
    return (None, None) if but is not None and alerts.isEmpty() else (alerts, events)


def known_answers(store: TableStore) -> DataFrame:
    """What a model said in earlier runs, by content."""
    return store.read("model_answers", enrich.ANSWERS + ", run string").where("answer is not null").select("content", "answer").dropDuplicates(["content"])


def remember(store: TableStore, out: dict[str, DataFrame], sender: str | None, channel: str, destination: str, as_of: str, run: str | None = None, wait: float = delivery.FIRST_WAIT) -> None:
    """Stores a run: its counts, new candidates and alerts, and the events of its deliveries.

    Old deferred alerts expire first. ``sender`` names the transport of messages: then every alert of the digest is sent, and what could
    not be sent is deferred to the next run. Without one nothing was delivered, so no delivery is recorded. Alerts are stored before anything
    is sent, and sent messages have receipts: at whatever point a run is killed, repeating it sends only the rest.
    """
    at, run = F.lit(as_of).cast("timestamp"), run or run_name(as_of, channel, destination)
    alerts, events = stored_state(store, run)
    parts = []
    if alerts is not None:
        parts.append(_event_rows(state.expirations(alerts, events, channel, destination, as_of).withColumn("seq", F.lit(0).cast("long"))))
    digest = out["digest"].persist()
    try:
        store.put("runs", out["summary"].withColumn("as_of", at), run)
        store.insert_new("candidates", out["candidates"], run, "url", "competitor", "topic_group")
        store.insert_new("alerts", digest.withColumn("created_at", at), run, "digest_key")
        learn(store, out, at, run)
        if "answers" in out:
            store.put("model_answers", out["answers"], run)
        if sender is not None:
            sent = delivery.deliver(digest, f"{store.root}/delivery", run, sender, destination, channel, as_of, wait=wait).persist()
            late = state.deferrals(digest, sent.where("status = 'delivered'"), channel, destination, as_of).withColumn("seq", F.lit(1 << 40).cast("long"))
            parts += [_event_rows(sent), _event_rows(late)]
        if parts:
            rows = parts[0]
            for more in parts[1:]:
                rows = rows.unionByName(more)
            store.put("delivery_events", rows, run)
    finally:
        digest.unpersist()


def learn(store: TableStore, out: dict[str, DataFrame], at: Column, run: str) -> None:
    """Stores what a run's new articles say about the queries that found them."""
    store.insert_new("articles_raw", out["articles"].where("url <> ''").select("seq", "url", "query", "provider"), run, "url")
    new = store.spark.read.parquet(f"{store.root}/articles_raw/run={run}").where("query <> ''")
    found = new.select(F.col("url").alias("article_id"), F.trim("query").alias("query"), at.alias("created_at"))
    of = lambda rows: rows.select(F.col("url").alias("article_id"))
    store.put("query_evidence", metrics.query_evidence(found, of(out["candidates"]), of(out["digest"]), at), run)


def _event_rows(rows: DataFrame) -> DataFrame:
    blank = {c: F.lit("") for c in ("external_id", "error_message") if c not in rows.columns}
    return rows.withColumns(blank).select(*[F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in EVENTS.split(", ")])
