"""Deliveries and mirrors with receivers that keep a log, writers that are killed, and a listing that is read in parts."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom import delivery
from newsloom.plans import pipeline, run_state, surrogate
from newsloom.sinks import TableStore
from newsloom.streaming import micro_batch

SF = "/root/testdata/sf0.001"


def log(folder):
    path = f"{folder}/log"
    return [json.loads(x) for x in open(path)] if os.path.exists(path) else []


def alerts(spark, *rows):
    base = dict.fromkeys(("headline", "competitor", "country", "topic", "event", "what_happened", "why_it_matters", "potential_impact", "product_take", "product_risk", "product_follow_up", "url"), "x")
    made = [{**base, "digest_key": k, "region": r, "region_ord": n, "rank": k_rank, "priority": "HIGH", "confidence": 0.5, "score": 5, "resolved_date": None, "what_happened": w} for k_rank, (k, r, n, w) in enumerate(rows, 1)]
    schema = ", ".join(f"{c} string" for c in (*base, "digest_key", "region", "priority", "resolved_date")) + ", region_ord int, rank int, confidence double, score int"
    return spark.createDataFrame([tuple(m[c.split()[0]] for c in schema.split(", ")) for m in made], schema)


def test_messages_are_split_where_lines_end():
    text = "\n\n".join(f"part {k} " + "w" * 30 for k in range(20)) + " " + "y" * 300
    parts = delivery.split_message(text, 100)
    assert all(len(p) <= 100 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert all(p.startswith(("part", "y")) for p in parts) and delivery.split_message("", 10) == [""] and delivery.split_message("a" * 10, 10) == ["a" * 10]


def test_attempts_wait_longer_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        delivery.with_attempts(call, sleep=waits.append)
    assert len(calls) == 3 and waits == [2.0, 4.0]


def test_each_message_once_over_retries_and_repeats(spark, tmp_path):
    box = f"{tmp_path}/box"
    os.mkdir(box)
    open(f"{box}/shaky", "w").close()
    rows = alerts(spark, ("a", "r", 0, "one"), ("b", "r", 0, "refuse"), ("c", "s", 1, "long " * 2000), ("d", "s", 1, "two"))
    send = lambda run: {r.alert_key: r for r in delivery.deliver(rows, f"{tmp_path}/state", run, "fake_receivers:Box", box, "daily", "2026-05-20", wait=0.01).collect()}
    got = send("r1")
    assert {k: r.status for k, r in got.items()} == {"a": "delivered", "b": "failed", "c": "delivered", "d": "delivered"} and "refused" in got["b"].error_message
    n = len(log(box))
    assert n == 2 + len(got["c"].external_id.split(",")) and n >= 5
    again = send("r1")
    assert len(log(box)) == n and {k: r.external_id for k, r in again.items()} == {k: r.external_id for k, r in got.items()}
    send("r2")  # another run, the same cards
    assert len(log(box)) == n and max(Counter(x["key"] for x in log(box)).values()) == 1
    dry = delivery.deliver(rows, f"{tmp_path}/state", "r3", "fake_receivers:Box", box, "daily", "2026-05-20", dry_run=True).collect()
    assert {r.status for r in dry} == {"dry_run"} and len(log(box)) == n


def run(spark, store, name):
    a, e = run_state.stored_state(store, name)
    return pipeline.run(surrogate.articles(spark, SF), surrogate.CONFIG, surrogate.AS_OF, alerts=a, events=e, destination="box")


def test_killed_and_repeated_run_sends_each_card_once(spark, tmp_path):
    store, box = TableStore(spark, f"{tmp_path}/state"), f"{tmp_path}/box"
    os.mkdir(box)
    name = run_state.run_name(surrogate.AS_OF, "daily_digest", "box")
    remember = lambda: run_state.remember(store, run(spark, store, name), "fake_receivers:Box", "daily_digest", box, surrogate.AS_OF, name, wait=0.01)
    open(f"{box}/kill", "w").close()
    with pytest.raises(Exception):
        remember()
    some = len(log(box))
    assert some == 1 and not store.exists("delivery_events")
    os.remove(f"{box}/kill")
    remember()
    keys = {r.digest_key for r in store.spark.read.parquet(f"{store.root}/alerts").collect()}
    sent = Counter(x["key"] for x in log(box))
    assert len(sent) == len(keys) > some and set(sent.values()) == {1}
    before = {t: spark.read.parquet(f"{store.root}/{t}").count() for t in ("runs", "alerts", "candidates", "delivery_events")}
    remember()
    assert {t: spark.read.parquet(f"{store.root}/{t}").count() for t in before} == before and before["runs"] == 1 and len(log(box)) == len(keys)


def test_pages_are_made_once_and_archived(spark, tmp_path):
    box = f"{tmp_path}/box"
    os.mkdir(box)
    rows = alerts(spark, ("a", "r", 0, "one"), ("b", "r", 0, "two"), ("b", "r", 0, "two again"), ("c", "s", 1, "three"))
    go = lambda run, **kw: {r.key: (r.action, r.page_id) for r in delivery.mirrored(rows, f"{tmp_path}/state", run, "fake_receivers:Box", box, wait=0.01, **kw).collect()}
    assert {a for a, _ in go("r0", dry_run=True).values()} == {"would_create"} and not log(box)
    first = go("r1")
    assert {a for a, _ in first.values()} == {"created"} and len(first) == 3
    open(f"{box}/blind", "w").close()  # a mirror whose search lags behind: the receipts know
    assert {k: a for k, (a, _) in go("r2").items()} == dict.fromkeys("abc", "updated")
    known = spark.createDataFrame([("a", "elsewhere")], "key string, page_id string")
    gone = spark.createDataFrame([("b",), ("nowhere",)], "key string")
    last = go("r3", pages=known, gone=gone)
    assert last["a"] == ("updated", "elsewhere") and last["nowhere"][0] == "skipped"
    done = Counter(x["do"] for x in log(box))
    assert done["create"] == 3 and Counter(x.get("key") for x in log(box) if x["do"] == "create").most_common(1)[0][1] == 1
    other = delivery.mirrored(rows, f"{tmp_path}/other", "r1", "fake_receivers:Box", box, wait=0.01).count()
    os.remove(f"{box}/blind")
    found = delivery.mirrored(rows, f"{tmp_path}/third", "r1", "fake_receivers:Box", box, wait=0.01).collect()
    assert other == 3 and {r.action for r in found} == {"updated"}


def test_mirror_destination_falls_back():
    assert delivery.mirror_destination({"MIRROR_DATABASE_ID": "m", "DATABASE_ID": "d", "MIRROR_TOKEN": "t"}) == ("m", [])
    found, warnings = delivery.mirror_destination({"DATABASE_ID": "d", "MIRROR_TOKEN": "t"})
    assert found == "d" and len(warnings) == 1
    assert delivery.mirror_destination({"MIRROR_DATABASE_ID": "m"})[0] is None


def test_listing_goes_on_where_it_stopped(spark, tmp_path):
    box = f"{tmp_path}/box"
    os.mkdir(box)
    json.dump(list(range(10)), open(f"{box}/pages", "w"))

    def go(batches):
        stream = delivery.pages(spark, "fake_receivers:Listing", box).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="0 seconds").start()
        while len(stream.recentProgress) < batches and stream.isActive:
            stream.awaitTermination(0.3)
        stream.processAllAvailable()
        stream.stop()
        return sorted(r.page_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = go(1)
    assert first and first == sorted(set(first))
    json.dump(list(range(17)), open(f"{box}/pages", "w"))
    assert go(2) == sorted(f"p{k}" for k in range(17))
    once = delivery._Listing({"transport": "x:y"})
    once._page = lambda cursor: ([{"page_id": k} for k in "abc"], "n") if not cursor else ([{"page_id": k} for k in "de"], None)
    assert [r[0] for r in once.readBetweenOffsets({"cursor": "", "seen": 1}, {"cursor": "n", "seen": 1})] == ["b", "c", "d"]


def test_stream_knows_what_earlier_batches_delivered(spark, tmp_path):
    box, source = f"{tmp_path}/box", f"{tmp_path}/in"
    os.mkdir(box)
    store = TableStore(spark, f"{tmp_path}/state")
    rows = surrogate.articles(spark, SF).select(*[c for c in micro_batch.ARTICLE.names])
    go = lambda: micro_batch.start(spark, source, store, f"{tmp_path}/check", surrogate.CONFIG, surrogate.AS_OF, sender="fake_receivers:Box", destination=box).awaitTermination()
    rows.write.parquet(f"{source}/../in", mode="append")
    go()
    keys = [x["key"] for x in log(box)]
    assert keys and len(keys) == len(set(keys))
    # the same stories under other URLs: alike to what was delivered
    rows.withColumn("url", F.concat("url", F.lit("&again=1"))).write.parquet(source, mode="append")
    go()
    events = store.read("delivery_events", run_state.EVENTS + ", run string")
    runs = {r.run: r.n for r in events.where("status = 'delivered'").groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert runs[micro_batch.run_of(0)] == len(keys)
    again = store.spark.read.parquet(f"{store.root}/digest").where(F.col("run") == micro_batch.run_of(1))
    first = store.spark.read.parquet(f"{store.root}/digest").where(F.col("run") == micro_batch.run_of(0))
    assert again.join(first.select("competitor", "canonical_topic", "title"), ["competitor", "canonical_topic", "title"], "left_semi").count() == 0
