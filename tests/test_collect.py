"""A run that collects, and what it keeps for the next one."""

import json

from newsloom.config import default_config
from newsloom.operators import metrics
from newsloom.sinks import TableStore
from newsloom.sources import collect

FAKE = """
import json

def send(url, timeout):
    if "gdelt" in url:
        return 429, "text/plain", "slow down"
    if "guardian" in url:
        assert "from-date=2026-05-13" in url
        return 200, "application/json", json.dumps({"response": {"results": [{"webTitle": "Bolt opens " + str(len(url)), "webUrl": "https://e.com/" + str(abs(hash(url)) % 1000), "webPublicationDate": "2026-05-19T00:00:00Z", "fields": {"trailText": "t"}}]}})
    return 200, "application/rss+xml", "<rss><channel></channel></rss>"
"""


def test_collected_keeps_log_and_cache(spark, tmp_path):
    (tmp_path / "fake_media.py").write_text(FAKE)
    spark.sparkContext.addPyFile(str(tmp_path / "fake_media.py"))
    store, config = TableStore(spark, f"{tmp_path}/state"), default_config()

    def go(as_of):
        articles, told = collect.collected(spark, config, store, as_of, keys={"guardian": "k"}, transport="fake_media:send")
        assert articles.where("provider = 'guardian' and (query_owner_region is null or query_owner_competitor is null)").count() == 0
        assert {r.provider for r in metrics.provider_metrics(told).collect()} >= {"guardian", "gdelt", "regional_rss"}
        return articles.count(), told.groupBy("provider", "status", "exception").count().collect()

    n, told = go("2026-05-20 10:00:00")
    counts = {(r.provider, r.status, r.exception): r["count"] for r in told}
    sent = store.read("requests", collect.LOG)
    by = {r.provider: r["count"] for r in sent.groupBy("provider").count().collect()}
    assert n > 0 and by["guardian"] == collect.PER_RUN["guardian"] and counts[("gdelt", "error", "HTTP 429")] == 1
    assert any(p == "guardian" and why == "budget" for p, _, why in counts)
    before = sent.count()
    again, told = go("2026-05-20 10:00:30")
    counts = {(r.provider, r.status, r.exception): r["count"] for r in told}
    assert again >= n and ("gdelt", "skipped", "cooldown") in counts
    assert store.read("requests", collect.LOG).where("provider = 'regional_rss'").count() == by["regional_rss"] and store.read("requests", collect.LOG).count() > before


def test_old_payloads_go(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/state")
    rows = spark.range(3)
    for as_of in ("2026-05-18 10:00:00", "2026-05-19 09:00:00", "2026-05-20 08:00:00"):
        store.put("payload_cache", rows, collect.stamp(as_of))
    store.prune("payload_cache", collect.stamp("2026-05-20 08:30:00", days=1))
    assert {r.run for r in store.read("payload_cache", "id long, run string").collect()} == {"2026-05-19-09-00-00", "2026-05-20-08-00-00"}
    store.prune("nothing", "x")
