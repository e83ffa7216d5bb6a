"""Two runs in a row, and batches that come twice."""

import os

from pyspark.sql import functions as F

from newsloom.config import default_config
from newsloom.operators import metrics
from newsloom.plans import pipeline, run_state, surrogate
from newsloom.plans.run_state import remember, stored_state
from newsloom.sinks import TableStore
from newsloom.sources import collect
from newsloom.streaming import micro_batch

SF = "/root/testdata/sf0.001"


def _run(spark, store, box="box"):
    alerts, events = stored_state(store)
    return pipeline.run(surrogate.articles(spark, SF), surrogate.CONFIG, surrogate.AS_OF, alerts=alerts, events=events, destination=box)


def test_second_run_holds_nothing_that_was_delivered(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/state")
    first = _run(spark, store, f"{tmp_path}/box")
    keys = {r.digest_key for r in first["digest"].select("digest_key").collect()}
    remember(store, first, "newsloom.delivery:Folder", "daily_digest", f"{tmp_path}/box", surrogate.AS_OF)
    assert keys and len(os.listdir(f"{tmp_path}/box")) == len(keys)
    alerts, events = stored_state(store)
    assert {r.alert_key for r in events.where("status = 'delivered'").collect()} == keys == {r.digest_key for r in alerts.collect()}
    second = _run(spark, store, f"{tmp_path}/box")
    assert not keys & {r.digest_key for r in second["digest"].select("digest_key").collect()}


def test_nothing_is_delivered_without_a_sender(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/state")
    out = _run(spark, store)
    remember(store, out, None, "daily_digest", "box", surrogate.AS_OF)
    assert stored_state(store)[1].count() == 0 and store.exists("runs")

    (tmp_path / "closed").write_text("no folder can be made here")
    remember(store, out, "newsloom.delivery:Folder", "daily_digest", f"{tmp_path}/closed/box", surrogate.AS_OF, wait=0.01)
    events = stored_state(store)[1]
    assert {r.status for r in events.select("status").distinct().collect()} == {"failed", "deferred"}


def test_repeated_batch_adds_nothing(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/state")
    rows = spark.createDataFrame([(0, "Bolt opens", "https://www.e.com/a/?utm_source=x"), (1, "Grab opens", "https://e.com/b")], "seq long, title string, url string")
    seen = []

    def run(fresh, name):
        seen.append(fresh.count())
        made = pipeline.normalize.normalized(pipeline.normalize.conformed(fresh))
        return {"articles": made, "digest": made.select("seq")}

    each = micro_batch.handler(store, run)
    each(rows, 0)
    each(rows, 0)
    each(rows.withColumn("url", F.concat("url", F.lit("#top"))), 1)
    assert seen == [2, 2] and store.read("digest", "seq long, run string").count() == 2 == store.read("articles_raw", "url string, run string").count()


def test_precise_queries_are_asked_first(spark, tmp_path):
    store, config = TableStore(spark, f"{tmp_path}/state"), default_config()
    order = lambda: [r["query"] for r in collect.planned(spark, config, surrogate.AS_OF, precision=metrics.learned_precision(store.read("query_evidence", metrics.EVIDENCE + ", run string"), surrogate.AS_OF)) if r["provider"] == "google_news_rss"]
    first = order()
    good = first[-3]
    rows = spark.createDataFrame([(n, f"u{n}", q, "google_news_rss") for n, q in enumerate([good, good, first[0], first[1]])], "seq long, url string, query string, provider string")
    out = {"articles": rows, "candidates": rows.where("seq in (0, 1, 2)"), "digest": rows.where("seq = 0")}
    at = F.lit(surrogate.AS_OF).cast("timestamp")
    for name in ("r1", "r1", "r2"):  # a repeated run replaces its evidence, and known articles say nothing new
        run_state.learn(store, out, at, name)
    assert store.read("query_evidence", metrics.EVIDENCE + ", run string").count() == 3
    assert order()[:2] == [good, first[0]] and sorted(order()) == sorted(first)


def test_evidence_of_runs_adds_up(spark):
    rows = spark.range(300).select(F.col("id").alias("article_id"), F.concat(F.lit("q"), F.col("id") % 7).alias("query"), (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 90).cast("int"))).alias("created_at"))
    c, a = rows.where("article_id % 3 = 0").select("article_id"), rows.where("article_id % 6 = 0").select("article_id")
    whole = {r.query: (r.articles, r.precision) for r in metrics.query_precision(rows, c, a, "2026-05-01").collect()}
    runs = metrics.query_evidence(rows, c, a, F.date_trunc("month", "created_at") + F.expr("interval 1 month"))
    merged = {r.query: (r.articles, r.precision) for r in metrics.learned_precision(runs, "2026-05-01").collect()}
    assert {q: n for q, (n, _) in merged.items()} == {q: n for q, (n, _) in whole.items()} and all(abs(merged[q][1] - whole[q][1]) <= 1e-4 for q in whole)
