"""Command line (survey C1 to C9, P33): run, qa-feeds, test-provider, preflight, queries, legacy."""

from __future__ import annotations

import argparse
import datetime
import os
import sys

from pyspark.sql import SparkSession

from newsloom import reports
from newsloom.config import SignalConfig, default_config, provider_queries
from newsloom.operators import legacy, metrics
from newsloom.plans import pipeline
from newsloom.plans.run_state import remember, stored_state
from newsloom.sources import collect
from newsloom.sinks import TableStore, digest_json, review_csv, write_json, write_markdown

COMMANDS = ("run", "dry-run", "qa-feeds", "test-provider", "preflight", "queries", "legacy")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="newsloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        s = sub.add_parser(name)
        s.add_argument("--config")
        s.add_argument("--regions", nargs="*")
        s.add_argument("--as-of", default=datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
        s.add_argument("--articles", help="Parquet of articles; without it a run collects them from the providers")
        s.add_argument("--pages")
        s.add_argument("--state", default="state")
        s.add_argument("--out", default="output")
        s.add_argument("--provider", default="guardian")
        s.add_argument("--query", action="append", default=[])
        s.add_argument("--company", nargs="*", default=[])
        s.add_argument("--days", type=int, default=30)
        s.add_argument("--outbox", help="where cards are delivered: for the default sender a folder that takes a text file each; without it nothing is delivered")
        s.add_argument("--sender", default="newsloom.delivery:Folder", help="module:factory of the transport of messages, which gets --outbox")
    return p


def preflight(args, env=os.environ) -> list[str]:
    """What is missing for a run."""
    missing = [f"{flag} is required" for flag, v in (("--articles", args.articles),) if args.command == "legacy" and not v]
    if args.provider in ("guardian", "newsapi") and args.command == "test-provider" and not env.get(f"{args.provider.upper()}_API_KEY"):
        missing.append(f"{args.provider.upper()}_API_KEY is not set")
    return missing


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0].startswith("--"):
        argv.insert(0, "run")
    args = parser().parse_args(argv)
    config = SignalConfig.load(args.config) if args.config else default_config()
    if args.command == "preflight":
        problems = preflight(args)
        print("\n".join(problems) or "ready")
        return int(bool(problems))
    if problems := preflight(args):
        print("\n".join(problems), file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("newsloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = TableStore(spark, args.state)
    if args.command == "queries":
        provider_queries(spark, config, args.regions).orderBy("seq").show(1000, False)
    elif args.command == "qa-feeds":
        schema = "provider string, region string, feed_name string, feed_url string, measured_at timestamp, " + ", ".join(f"{c} long" for c in metrics.SUMS)
        metrics.feed_health(store.read("rss_feed_metrics", schema), args.as_of, args.days).show(100, False)
    elif args.command == "test-provider":
        from newsloom.sources import fetch, payloads

        key = os.environ.get(f"{args.provider.upper()}_API_KEY", "")
        rows = fetch.fetch(spark, [{"provider": args.provider, "query": q, "seq": n, "url": fetch.request_url(args.provider, q, args.days, key)} for n, q in enumerate(args.query)])
        parsed = payloads.parsed(rows)
        payloads.diagnostics(parsed, payloads.articles(parsed, config)).show(100, False)
    elif args.command == "legacy":
        found = legacy.heuristic(spark.read.option("multiLine", True).json(args.articles), tuple(args.company or ("company",)))
        reports.export(legacy.relevant(found, 4), args.out, args.as_of, 4, audit=found)
    else:
        channel, destination = "daily_digest", args.outbox or "local"
        alerts, events = stored_state(store)
        if args.articles:
            articles = spark.read.parquet(args.articles)
        else:
            keys = {p: os.environ.get(f"{p.upper()}_API_KEY", "") for p in collect.KEYED}
            articles, told = collect.collected(spark, config, store, args.as_of, args.regions, min(args.days, 7), keys)
            write_json(told, f"{args.out}/diagnostics.json")
            write_json(metrics.provider_metrics(told), f"{args.out}/provider_metrics.json")
        out = pipeline.run(articles, config, args.as_of, args.regions, alerts=alerts, events=events, channel=channel, destination=destination, pages=spark.read.parquet(args.pages) if args.pages else None)
        for name in ("candidates", "dropped", "summary"):
            write_json(out[name], f"{args.out}/{name}.json")
        digest_json(out["digest"], f"{args.out}/digest.json")
        write_markdown(out["digest"], f"{args.out}/digest_preview", args.as_of)
        review_csv(out["candidates"], out["digest"], f"{args.out}/candidates_review")
        if args.command == "run":
            remember(store, out, args.sender if args.outbox else None, channel, destination, args.as_of)
        print(out["summary"].toPandas().to_string(index=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
