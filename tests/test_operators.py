import random

import pytest
from pyspark.sql import functions as F

from newsloom.config import SignalConfig, default_config
from newsloom.operators import classify, digest, gate, metrics, normalize, similar, state
from newsloom.plans import pipeline
from newsloom.sources import payloads


def articles(spark, *rows):
    base = {f.name: None for f in normalize.ARTICLE} | {"title": "", "provider": "gdelt", "source": "", "snippet": ""}
    made = [tuple({**base, "seq": n, "url": f"https://e.com/{n}", **r}.values()) for n, r in enumerate(rows)]
    return normalize.normalized(spark.createDataFrame(made, normalize.ARTICLE))


@pytest.mark.parametrize("title, brand", [
    ("Prices fall 99% in Brazil after discount campaign", None), ("Taxi 99 starts discount campaign in Brazil", "99"), ("How to maximize the discount campaign in Indonesia", None),
    ("Maxim taxi opens a campaign in Indonesia", "Maxim"), ("Shoppers grab a discount campaign in Thailand", None), ("Grab drivers get a discount campaign in Thailand", "Grab"), ("GoCar discount campaign in Indonesia", "Gojek"),
])
def test_brand_detection(spark, title, brand):
    got = classify.classified(articles(spark, {"title": title}), default_config()).head()
    assert got.competitor == brand


def test_drop_reasons_and_score(spark):
    rows = articles(
        spark, {"title": "Weather today"}, {"title": "Uber news"}, {"title": "Uber expansion in the USA"}, {"title": "Cabify expansion in Indonesia"}, {"title": "Uber expansion"},
        {"title": "Uber expansion in Mexico", "language": "es"}, {"title": "Uber expansion", "query_owner_region": "latam", "query_owner_competitor": "Uber"},
    )
    got = classify.classified(rows, default_config()).orderBy("seq").collect()
    assert [g.drop_reason for g in got] == [*classify.DROP_REASONS, None, None]
    assert (got[5].region, got[5].country_hint, got[5].score) == ("latam", "Mexico", 10) and got[5].summary == "Uber / market_expansion / Mexico: Uber expansion in Mexico"
    assert got[6].region == "latam" and got[6].country_hint is None and got[2].drop_details["ignored_geo_terms"] == "USA"


def test_query_never_matches(spark):
    rows = articles(spark, {"title": "Plain story", "query": "Uber expansion Mexico"})
    assert classify.classified(rows, default_config()).head().drop_reason == "no_competitor_match"


def test_gate(spark):
    rows = articles(spark, {"title": "Uber launches promo in Mexico City"}, {"title": "Uber: ride-hailing market size report Mexico"}, {"title": "Uber expansion mentioned among brands in Mexico"}, {"title": "Uber new logo and expansion in Mexico"})
    got = gate.decided(classify.split(classify.classified(rows, default_config()))[0]).orderBy("seq").collect()
    assert [g.rejection_reason for g in got[-3:]] == ["broad_industry_fluff", "mention_only_story", "off_scope_material"]


def test_dedup_settles_every_article(spark):
    rng = random.Random(3)
    words = "grab opens riders city bolt price promo launch pilot drivers safety taxi".split()
    rows = [{"title": " ".join(rng.choices(words, k=rng.randint(2, 7))), "url": f"https://e.com/{rng.randint(0, 40)}" if rng.random() < 0.8 else "", "provider": rng.choice(["gdelt", "guardian", "regional_rss"]), "snippet": rng.choice(["", "s"])} for _ in range(60)]
    made = articles(spark, *rows)
    kept = {r.seq: r.slot for r in similar.deduplicated(made)[0].select("slot", "seq").collect()}
    all_ = {r.seq: r for r in similar.keyed(made).withColumn("q", similar.quality()).collect()}
    slots = sorted(kept.values())
    assert len(set(slots)) == len(slots) and all(slot <= seq for seq, slot in kept.items())
    # prefixes: an article changes nothing, opens its own slot, or takes one over with a higher quality
    before = {}
    for n in sorted(all_):
        now = {r.slot: r.seq for r in similar.deduplicated(made.where(F.col("seq") <= n))[0].select("slot", "seq").collect()} if n % 20 == 19 else None
        if now is None:
            continue
        assert set(before) <= set(now)
        for slot, holder in now.items():
            if slot in before and before[slot] != holder:
                assert tuple(all_[holder].q) > tuple(all_[before[slot]].q)
        before = now
    assert before == {slot: seq for seq, slot in kept.items()}
    # whoever holds no slot has its like: an earlier URL of its own, or a title that a holder's title once met
    opened = [all_[s] for s in slots]
    for n, r in all_.items():
        if n not in kept and n not in slots:
            assert any(r.url and r.url == o.url for o in all_.values() if o.seq < n) or any(similar.similar(r.title_key, o.title_key) for o in all_.values() if o.seq < n)
    assert opened[0].seq == min(all_)


def test_better_source_takes_the_slot(spark):
    rows = articles(spark, {"title": "Bolt starts service in Kenya", "provider": "google_news_rss", "source_tier": "tier1_aggregator"}, {"title": "Bolt starts service in Kenya | Daily", "provider": "regional_rss", "source_tier": "tier2_direct", "snippet": "s"})
    kept, wins = similar.deduplicated(rows)
    assert [(r.seq, r.slot) for r in kept.collect()] == [(1, 0)]
    assert [(r.provider, r.tier, r.wins, r.direct_over_aggregator) for r in similar.win_metrics(wins).collect()] == [("regional_rss", "tier2_direct", 1, 1)]


def test_rank_keeps_order_of_equals_and_dates_last(spark):
    rows = spark.createDataFrame([(0, 7, "MEDIUM", "2026-05-18", None), (1, 9, "HIGH", "2026-05-17", None), (2, 9, "HIGH", "2026-05-17", None), (3, 9, "HIGH", None, None), (4, 9, "HIGH", "2026-05-17", "k")],
                                 "seq long, score int, priority string, d string, deferred_digest_key string").withColumns({"resolved_date": F.col("d").cast("date"), "region": F.lit("r"), "confidence": F.lit(0.9)})
    assert [r.seq for r in digest.ranked(rows).orderBy("rank").collect()] == [1, 2, 4, 3, 0]


def test_freshness(spark):
    rows = spark.createDataFrame([(0, 5, "2026-05-01", False), (1, 9, "2026-05-01", False), (2, 5, None, False), (3, 5, None, True), (4, 2, "2026-05-18", False)], "seq long, score int, d string, allow_undated boolean").withColumns(
        {"resolved_date": F.col("d").cast("date"), "region": F.lit("r"), "deferred_digest_key": F.lit(None).cast("string")})
    assert [r.is_expired for r in digest.freshness(rows, "2026-05-20").orderBy("seq").collect()] == [True, False, True, False, False]


def test_delivery_states(spark):
    e = spark.createDataFrame([("a", "dry_run", 1), ("a", "deferred", 2), ("b", "delivered", 1), ("b", "deferred", 2), ("c", "dry_run", 5), ("d", "deferred", 1), ("d", "expired", 2), ("d", "deferred", 3)], "alert_key string, status string, seq long").withColumns(
        {"channel": F.lit("c"), "destination": F.lit("x"), "event_ts": F.timestamp_seconds("seq")})
    assert {r.alert_key: r.status for r in state.latest(e).collect()} == {"a": "deferred", "b": "delivered", "c": "dry_run", "d": "deferred"}


def test_feed_health(spark):
    rows = spark.createDataFrame([("f1", 12, 6, 1, 0), ("f2", 10, 4, 2, 1)], "feed_name string, items_found long, provider_matches long, candidates_kept long, alerts_created long").withColumns(
        {"provider": F.lit("p"), "region": F.lit("r"), "feed_url": F.col("feed_name"), "measured_at": F.lit("2026-05-19").cast("timestamp"), "prefilter_passed": F.col("candidates_kept"), "raw_articles_after_global_dedup": F.lit(0), "dropped_prefilter": F.lit(0)})
    got = metrics.feed_health(rows, "2026-05-20").collect()
    assert [(r.feed_name, r.recommendation) for r in got] == [("f1", "review_low_signal"), ("f2", "keep")]


def test_payload_ladder(spark):
    bodies = ["", "<html>", "busy", "{bad", '{"articles": []}', '{"articles": [{"title": "t", "url": "u"}]}']
    rows = spark.createDataFrame([("gdelt", str(n), n, 200, None, b, None, None, None, None, None) for n, b in enumerate(bodies)], payloads.PAYLOAD)
    parsed = payloads.parsed(rows)
    got = payloads.diagnostics(parsed, payloads.articles(parsed, default_config())).orderBy("seq").collect()
    assert [(r.status, r.items_found) for r in got] == [("error", 0)] * 4 + [("ok", 0), ("ok", 1)]


def test_config_rejects_unknown_regions():
    with pytest.raises(ValueError):
        SignalConfig.from_dict({"regions": {"a": {"label": "A", "geo_terms": ["x"], "language_hints": ["en"]}}, "competitors_by_region": {"b": ["B"]}, "topic_groups": {"t": ["k"]}})


def test_pipeline_end_to_end(spark):
    rows = articles(spark, {"title": "Uber launches promo code and discount in Mexico", "published_at": "2026-05-19"}, {"title": "Bolt wins market entry in Kenya", "published_at": "2026-05-01"}, {"title": "Weather"})
    out = pipeline.run(rows, default_config(), "2026-05-20")
    assert [r.competitor for r in out["digest"].collect()] == ["Uber"]
    assert {r.reason for r in out["dropped"].collect()} == {"no_competitor_match"}
