"""``media_search``: a Spark data source that runs provider queries and returns their payloads (survey S1 to S6, S9, S12 to S19, S28, D1, X8).

Options: ``requests`` (JSON list of request objects with provider, query, seq, url and, for feeds, the feed fields),
``transport`` (module:function that takes a URL and a timeout and returns (status, content type, body); the default
uses urllib). One partition per provider where order matters for pacing, else one per request. A failure is a row with
``error``; the reader never fails the job. After a 429 the rest of a provider's requests are skipped.
"""

from __future__ import annotations

import datetime
import importlib
import json
import time
import urllib.parse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsloom.sources.payloads import PAYLOAD

TIMEOUTS = {"gdelt": 25}
TIMEOUT = 20
PACED = {"gdelt": 5.0}
ATTEMPTS, FIRST_WAIT, LAST_WAIT = 3, 2.0, 10.0
FIELDS = [f.split()[0] for f in PAYLOAD.split(", ")]


SEARCHES = ("google_news_rss", "gdelt", "newsapi", "guardian")


def request_url(provider: str, query: str, days: int = 7, api_key: str = "", as_of: str = "") -> str:
    """URL of a provider's search; time limits and page sizes are pushed to the source."""
    q = urllib.parse.quote_plus
    since = f"&from-date={datetime.date.fromisoformat(as_of[:10]) - datetime.timedelta(days=days)}" if as_of else ""
    if provider == "google_news_rss":
        return f"https://news.google.com/rss/search?q={q(f'{query} when:{days}d')}"
    if provider == "gdelt":
        return f"https://api.gdeltproject.org/api/v2/doc/doc?query={q(query)}&mode=artlist&maxrecords=75&format=json&sort=datedesc&timespan={days}d"
    if provider == "newsapi":
        return f"https://newsapi.org/v2/everything?q={q(query)}&language=en&pageSize=50&apiKey={q(api_key)}"
    if provider == "guardian":
        return f"https://content.guardianapis.com/search?q={q(query)}&page-size=20&order-by=newest&show-fields=trailText,bodyText{since}&api-key={q(api_key)}"
    raise ValueError(f"unsupported provider: {provider}")


def by_urllib(url: str, timeout: float) -> tuple[int, str, str]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "newsloom"}), timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type", ""), e.read().decode("utf-8", "replace")


def with_retries(send: Callable, url: str, timeout: float, sleep: Callable[[float], None] = time.sleep):
    """Up to three attempts on transport errors, waiting twice as long each time."""
    for n in range(ATTEMPTS):
        try:
            return send(url, timeout)
        except OSError:
            if n + 1 == ATTEMPTS:
                raise
            sleep(min(LAST_WAIT, FIRST_WAIT * 2**n))


class _Requests(InputPartition):
    def __init__(self, rows: list[dict]):
        self.rows = rows


class MediaReader(DataSourceReader):
    def __init__(self, requests: list[dict], transport: str | None):
        self.requests, self.transport = requests, transport

    def partitions(self):
        groups: dict[object, list[dict]] = {}
        for n, r in enumerate(self.requests):
            # one after the other, so that a provider that is told to slow down gets no more; feeds are sites of their own
            groups.setdefault(n if r["provider"] == "regional_rss" else r["provider"], []).append(r)
        return [_Requests(rows) for rows in groups.values()] or [_Requests([])]

    def read(self, partition):
        send = by_urllib
        if self.transport:
            module, _, name = self.transport.partition(":")
            send = getattr(importlib.import_module(module), name)
        last, stopped = {}, set()
        for r in sorted(partition.rows, key=lambda r: r.get("seq", 0)):
            p, status, kind, body, error = r["provider"], None, None, None, None
            if p in stopped:
                error = "cooldown"
            else:
                if p in PACED and p in last and send is by_urllib:
                    time.sleep(max(0.0, PACED[p] - (time.monotonic() - last[p])))
                last[p] = time.monotonic()
                try:
                    status, kind, body = with_retries(send, r["url"], TIMEOUTS.get(p, TIMEOUT))
                    if status == 429:
                        stopped.add(p)
                except Exception as e:  # an error is data
                    error = f"{type(e).__name__}: {e}"
            found = {**r, "http_status": status, "content_type": kind, "body": body, "error": error}
            yield tuple(found.get(f) for f in FIELDS)


class MediaSearch(DataSource):
    @classmethod
    def name(cls):
        return "media_search"

    def schema(self):
        return PAYLOAD

    def reader(self, schema):
        return MediaReader(json.loads(self.options.get("requests", "[]")), self.options.get("transport"))


def fetch(spark: SparkSession, requests: list[dict], transport: str | None = None) -> DataFrame:
    """Payloads of bounded request lists (hundreds per run)."""
    spark.dataSource.register(MediaSearch)
    reader = spark.read.format("media_search").option("requests", json.dumps(requests))
    return (reader.option("transport", transport) if transport else reader).load()
