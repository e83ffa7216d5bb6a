"""Timers of streams: what expires, what waits, and that both survive a restart."""

import datetime

from pyspark.sql import functions as F

from newsloom.streaming import timers

EVENTS = "alert_key string, channel string, destination string, status string, seq long, event_ts timestamp"
REQUESTS = "provider string, kind string, seq long, url string, http_status int, at timestamp"
T0 = datetime.datetime(2026, 5, 20)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


class Fed:
    """A stream over files that are added one by one, run to its end after each; every run is a restart."""

    def __init__(self, spark, tmp_path, schema, made):
        timers.with_timers(spark)
        self.spark, self.path, self.schema, self.made, self.n = spark, tmp_path, schema, made, 0

    def add(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/*")
        self.made(stream).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/check").trigger(availableNow=True).start().awaitTermination(300)

    def out(self, *columns):
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.path}/out").select(*columns).collect())


def test_deferred_alerts_expire_on_time(spark, tmp_path):
    fed = Fed(spark, tmp_path, EVENTS, lambda s: timers.expired(s, max_age_days=2))
    e = lambda key, status, hours, seq=0: (key, "c", "d", status, seq, at(hours))
    fed.add(e("old", "deferred", 0), e("sent", "deferred", 0), e("again", "deferred", 0), e("dry", "dry_run", 0), e("done", "delivered", 0))
    fed.add(e("sent", "delivered", 10), e("again", "deferred", 30), e("done", "deferred", 20), e("late", "deferred", 40), e("old", "dry_run", 41))
    fed.add(e("tick", "dry_run", 60))  # the watermark passes two days after hour 0, no row for the expired keys
    fed.add(e("tick", "dry_run", 61))
    assert fed.out("alert_key", "status") == [("again", "expired"), ("old", "expired")]
    assert {r[0] for r in fed.out(F.unix_seconds("event_ts"))} == {int((at(48) - datetime.datetime(1970, 1, 1)).total_seconds())}
    fed.add(e("old", "deferred", 62), e("tick", "dry_run", 120))
    fed.add(e("tick", "dry_run", 130))
    assert fed.out("alert_key") == [("again",), ("late",), ("old",), ("old",)]


def test_requests_are_spaced_and_rest_after_a_429(spark, tmp_path):
    fed = Fed(spark, tmp_path, REQUESTS, lambda s: timers.paced(s, spacing_seconds=5, rest_seconds=60))
    s = lambda n: T0 + datetime.timedelta(seconds=n)
    q = lambda p, seq, n: (p, "request", seq, f"u{seq}", None, s(n))
    fed.add(q("a", 1, 0), q("a", 2, 0), q("a", 3, 1), q("b", 4, 0))
    fed.add(("clock", "request", 0, "x", None, s(6)))
    fed.add(("a", "response", 2, None, 429, s(7)), ("clock", "request", 0, "x", None, s(8)))
    fed.add(("clock", "request", 0, "x", None, s(40)))
    fed.add(("clock", "request", 0, "x", None, s(100)))
    fed.add(("clock", "request", 0, "x", None, s(101)))
    got = {(p, n): t for p, n, t in fed.out("provider", "seq", F.unix_seconds("send_at")) if p != "clock"}
    base = int((T0 - datetime.datetime(1970, 1, 1)).total_seconds())
    assert {k: t - base for k, t in got.items()} == {("a", 1): 0, ("b", 4): 0, ("a", 2): 5, ("a", 3): 67}
