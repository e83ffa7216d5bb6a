"""The pipeline over a stream of article files: micro-batches with append-only state (survey 2.10, X1 to X10).

Each batch normalises, removes what earlier batches stored (cross-run dedup by URL), classifies, gates and ranks. State lives in
a TableStore by batch, so a batch that is repeated after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators.normalize import ARTICLE
from newsloom.plans import pipeline
from newsloom.plans.run_state import remember, stored_state
from newsloom.sinks import TableStore


def unique_urls(stream: DataFrame, delay: str = "2 days", event_time: str = "fetched_at") -> DataFrame:
    """First article per URL within the watermark's span (X5); rows that come later than the watermark are not dropped from
    the archive, which is a separate query on the source."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])


def counts_by_window(stream: DataFrame, event_time: str = "ts", width: str = "1 day", delay: str = "1 day", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *keys).agg(F.count("*").alias("n"))


def run_of(batch_id: int) -> str:
    return f"batch-{batch_id:012d}"


def handler(store: TableStore, run: Callable[[DataFrame, str], dict[str, DataFrame]], keep: Callable[[dict[str, DataFrame], str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: runs the pipeline on the new URLs of a batch and stores its results under the batch's number.

    URLs are compared in canonical form, as they are stored. A batch that is repeated after a failure leaves its own
    earlier rows out of account and writes them anew in the same place, so it adds nothing. A batch without new articles
    leaves the backlog alone (X9). ``keep`` stores what later batches need to know; it gets the results and the batch's name.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        known = store.read("articles_raw", "url string, run string").where(F.col("run") != run_of(batch_id)).select(F.col("url").alias("_known")).distinct()
        fresh = batch.join(known, X.canonical_url("url") == F.col("_known"), "left_anti").persist()
        try:
            if fresh.isEmpty():
                return
            out = run(fresh, run_of(batch_id))
            for name in ("dropped", "digest") if keep else ("candidates", "dropped", "digest"):
                if name in out:
                    store.put(name, out[name], run_of(batch_id))
            if keep:
                keep(out, run_of(batch_id))
            store.put("articles_raw", out["articles"].select("seq", "url", "title", "query", "provider").dropDuplicates(["url"]), run_of(batch_id))
        finally:
            fresh.unpersist()

    return each


def start(spark: SparkSession, source: str, store: TableStore, checkpoint: str, config, as_of: str, trigger: dict | None = None, sender: str | None = None, channel: str = "daily_digest", destination: str = "local"):
    """Runs the pipeline over article files that arrive in a folder, each batch with the state that earlier ones stored.

    What a batch delivered is not in the digest of a later one, what it could not deliver comes back.
    """
    stream = spark.readStream.schema(ARTICLE).parquet(source)

    def run(rows: DataFrame, name: str) -> dict[str, DataFrame]:
        alerts, events = stored_state(store, name)
        return pipeline.run(rows, config, as_of=as_of, alerts=alerts, events=events, channel=channel, destination=destination)

    each = handler(store, run, lambda out, name: remember(store, out, sender, channel, destination, as_of, name))
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
