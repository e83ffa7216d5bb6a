"""Article bodies and dates out of HTML pages (survey F27 to F29, S11, S22, P29, X10).

Real pages leave paragraphs open and nest them, which needs a parser: ``page_text`` runs the standard library's over
Arrow batches. ``body_regex`` is the approximation that stays in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import text as X

SKIPPED = ("script", "style", "noscript", "svg", "iframe")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
MIN_PARAGRAPH, MIN_PAGE, MAX_CHARS = 40, 80, 8000


class _Text(HTMLParser):
    """Text of paragraphs and list items by enclosing block, and of the whole page.

    A paragraph is a stretch of the page's pieces of text, so one that is left open costs nothing for what follows in it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.blocks = ("article", "main", "body")
        self.paragraphs: list[tuple[int, int]] = []  # of the open ones: depth and number
        self.done: list[tuple[int, int | None, tuple[str, ...]]] = []  # first piece, end, enclosing blocks
        self.all: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append(tag)
        self.count[tag] += 1
        if tag in ("p", "li"):
            self.paragraphs.append((len(self.open), len(self.done)))
            self.done.append((len(self.all), None, tuple(b for b in self.blocks if self.count[b])))

    def handle_endtag(self, tag):
        while self.count[tag]:
            top = self.open.pop()
            self.count[top] -= 1
            while self.paragraphs and self.paragraphs[-1][0] > len(self.open):
                _, n = self.paragraphs.pop()
                self.done[n] = (self.done[n][0], len(self.all), self.done[n][2])
            if top == tag:
                return

    def handle_data(self, data):
        if not any(self.count[s] for s in SKIPPED):
            self.all.append(data.strip())

    def said(self, start: int, end: int | None, most: int) -> str:
        """The words of some pieces, as far as ``most`` characters reach."""
        words, size = [], 0
        for k in range(start, len(self.all) if end is None else end):
            for w in self.all[k].split():
                words.append(w)
                size += len(w) + 1
            if size > most:
                break
        return " ".join(words)

    def text(self, most: int) -> str:
        for block in self.blocks:
            long, size = [], 0
            for start, end, inside in self.done:
                if block in inside and size <= most and len(t := self.said(start, end, most)) >= MIN_PARAGRAPH:
                    long.append(t)
                    size += len(t) + 1
            if long:
                return "\n".join(long)[:most]
        whole = self.said(0, None, max(most, MIN_PAGE))
        return whole[:most] if len(whole) >= MIN_PAGE else ""


def page_body(html: str | None, most: int = MAX_CHARS) -> str:
    """First of article, main and body that has paragraphs of 40 characters or more; else the page's text if it has 80."""
    if not html:
        return ""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return parser.text(most)


def strip_tags(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return " ".join(" ".join(parser.all).split())


def page_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(page_body)

    return run(html)


def plain(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(strip_tags)

    return run(html)


def body_regex(html: Column) -> Column:
    """Paragraphs between their tags, without a parser."""
    skipped = F.regexp_replace(X.text(html), r"(?is)<(script|style|noscript|svg|iframe)[^>]*>.*?</(script|style|noscript|svg|iframe)>", " ")
    found = F.regexp_extract_all(skipped, F.lit(r"(?is)<(?:p|li)(?:\s[^>]*)?>(.*?)</(?:p|li)>"), F.lit(1))
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " ")))
    return F.array_join(F.filter(clean, lambda x: F.char_length(x) >= MIN_PARAGRAPH), "\n")


_DATE = r"(\d{4}-\d{2}-\d{2})"
# From the strictest place of a date to the loosest.
DATE_PLACES = (
    rf"""(?is)<meta[^>]+(?:property|name|itemprop)=["'](?:article:published_time|datePublished|date|pubdate|publish-date|dc\.date[^"']*)["'][^>]+content=["']{_DATE}""",
    rf"""(?is)"datePublished"\s*:\s*"{_DATE}""",
    rf"""(?is)<time[^>]+datetime=["']{_DATE}""",
    rf"(?is)>\s*{_DATE}",
)


def page_date(html: Column) -> Column:
    """Publication date that a page states: meta, JSON-LD, time element, then any dated text. An approximation by rules."""
    h = X.text(html)
    return F.coalesce(*[F.regexp_extract(h, p, 1).try_cast("date") for p in DATE_PLACES])


def fetchable(url) -> Column:
    return X.text(url).rlike(r"(?i)^https?://[^/]+")


def page_title(html) -> Column:
    return X.clean(F.regexp_extract(X.text(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def with_context(rows, pages, wanted: Column | None = None, most: int = MAX_CHARS):
    """Joins article pages (url, html) to rows that want them; the rest get the fallback context: title, snippet, provider date.

    Adds article_body, page_date and context_source. Pages are read once per url, and only of the rows that want one."""
    wanted = F.lit(True) if wanted is None else wanted
    need = rows.where(wanted & fetchable("url")).select("url").distinct()
    got = pages.join(need, "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    got = got.select(F.col("url").alias("_u"), F.substring(page_text(F.col("html")), 1, most).alias("_body"), page_date(F.col("html")).alias("_date"))
    out = rows.join(got, wanted & (F.col("url") == F.col("_u")), "left")
    return out.withColumns({"article_body": F.coalesce("_body", F.lit("")), "page_date": F.col("_date"),
                            "context_source": F.when(F.col("_date").isNotNull(), "html_scraped").when(F.col("_u").isNotNull(), "page").otherwise("fallback")}).drop("_u", "_body", "_date")


def title_of(html: str) -> str:
    m = re.search(r"(?is)<title[^>]*>(.*?)</title>", html or "")
    return " ".join(m.group(1).split()) if m else ""
