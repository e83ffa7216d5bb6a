"""Exports of mentions: order, numbers, every entry, and a report of many mentions."""

import re

from pyspark.sql import functions as F

from newsloom import reports, sinks
from newsloom.operators import legacy
from newsloom.plans import pipeline, surrogate


def test_report_of_many_mentions(spark, tmp_path):
    n = 60_000
    rows = spark.range(n, numPartitions=7).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 1000 > 0, F.concat(F.lit("Title "), "id")).alias("title"), F.concat(F.lit("https://e.com/"), "id").alias("url"), (F.col("id") * 7919 % 11).alias("relevance_score"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("2026-05-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))).alias("published_at"), F.lit("s").alias("summary"), F.lit("").alias("article_essence_ru"))
    stats = spark.createDataFrame([("b", 2, 1, 1, 5, "HTTP 500"), ("a", 1, 1, 0, 3, None)], "provider string, attempts long, successes long, failures long, articles long, last_error string")
    reports.write_report(rows, f"{tmp_path}/report.md", "2026-05-20", 0, stats)
    text = (tmp_path / "report.md").read_text()
    assert text.startswith("# Media mentions report\n\nGenerated: 2026-05-20\nRelevant mentions: 60000\n") and text.index("- a: attempts=1") < text.index("- b: attempts=2, successes=1, failures=1, articles=5, last_error=HTTP 500")
    order = sorted(range(n), key=lambda k: (-(k * 7919 % 11), k % 3 == 0, -(k % 28 + 1) if k % 3 else 0, k))
    assert [int(x) for x in re.findall(r"^### (\d+)\.", text, re.M)] == list(range(1, n + 1))
    assert [int(x) for x in re.findall(r"^- URL: https://e.com/(\d+)$", text, re.M)] == order
    assert text.count("Untitled") == n // 1000 and "- Relevance: 10/10\n" in text and "- Article essence: s\n" in text
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"report.md"}


def test_empty_export(spark, tmp_path):
    rows = spark.createDataFrame([], "seq long, title string, url string, relevance_score int, published_at string")
    reports.export(rows, str(tmp_path), "2026-05-20", 4)
    assert "No relevant mentions found" in (tmp_path / "report.md").read_text()
    rows = spark.createDataFrame([(0, 'a "quoted" title', "u", 5, "2026-05-01"), (1, "b", "v", 9, None)], rows.schema)
    reports.export(rows, str(tmp_path), "2026-05-20", 4)
    got = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/mentions.csv").collect()
    assert [(r.number, r.title) for r in got] == [("1", "b"), ("2", 'a "quoted" title')] and got[0].asDict().keys() == set(reports.COLUMNS)
    assert spark.read.json(f"{tmp_path}/run_summary.json").head().relevant_mentions == 2


def test_review_has_all_columns(spark, tmp_path):
    out = pipeline.run(surrogate.articles(spark, "/root/testdata/sf0.001"), surrogate.CONFIG, surrogate.AS_OF)
    sinks.review_csv(out["candidates"], out["digest"], f"{tmp_path}/review")
    got = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/review")
    assert got.columns == list(sinks.REVIEW) and len(got.columns) == 35
    rows, digest = {r.url: r for r in got.collect()}, {r.url: r for r in out["digest"].collect()}
    assert len(rows) == out["candidates"].count() > len(digest) > 0
    for url, alert in digest.items():
        r = rows[url]
        assert r.final_region == alert.region and r.news_gatekeeper_accept == "true" and r.resolved_publication_date == str(alert.resolved_date) and r.matched_keywords == " | ".join(alert.matched_keywords)
    assert any(r.final_region is None and r.is_expired == "false" for url, r in rows.items() if url not in digest)


def test_company_context(spark, tmp_path):
    assert legacy.company_context(spark, f"{tmp_path}/none.txt", "d") == "d"
    (tmp_path / "c.txt").write_text("  one\ntwo\n")
    assert legacy.company_context(spark, f"{tmp_path}/c.txt") == "one\ntwo"
