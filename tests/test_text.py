import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import html
from newsloom.functions import text as X
from newsloom.operators import similar


def one(spark, value, *functions, kind="string"):
    row = spark.createDataFrame([(value,)], f"v {kind}").select(*[f(F.col("v")).alias(f"c{n}") for n, f in enumerate(functions)]).head()
    return row[0] if len(functions) == 1 else tuple(row)


@pytest.mark.parametrize("url, want", [
    ("https://www.example.com/story/?utm_source=x&b=2&a=1&fbclid=123", "https://example.com/story?a=1&b=2"), ("", ""), (None, ""),
    ("HTTP://WWW.Example.com", "http://example.com/"), ("https://e.com/a;p=1?x=%zz&y=#f", "https://e.com/a?x=%25zz&y="), ("https://e.com/?q=a+b~*", "https://e.com/?q=a+b~%2A"),
])
def test_canonical_url(spark, url, want):
    assert one(spark, url, X.canonical_url) == want


@pytest.mark.parametrize("title, want", [
    ("Maker expands delivery service in Mexico City | Another Publisher", "maker expands delivery service in mexico city"), ("WEF says 1 . 5x growth - The Post", "world economic forum says 1.5x growth"), (None, ""),
])
def test_title_key(spark, title, want):
    assert one(spark, title, X.title_key) == want


@pytest.mark.parametrize("value, want", [
    ("2026-05-19T09:00:00Z", "2026-05-19"), ("Tue, 18 May 2026 09:00:00 GMT", "2026-05-18"), ("2026-05-18", "2026-05-18"), ("20260518T090000Z", "2026-05-18"),
    ("2024-05-01Tgarbage", None), ("2024-05", None), ("", None), (None, None), ("2024-13-01", None),
])
def test_published_date(spark, value, want):
    got = one(spark, value, X.published_date)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("blob, term, inflect, want", [
    ("truck demand is rising", "UK", False, False), ("in   united   states", "United States", False, True), ("jordanian", "Jordan", False, False),
    ("he launched it", "launch", True, True), ("launcher", "launch", True, False), ("new  feature", "new feature", True, True),
])
def test_has_term(spark, blob, term, inflect, want):
    assert one(spark, blob, lambda c: X.has_term(c, term, inflect)) is want


def test_pair_expressions_agree_with_python(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta bolts riders new the fares launch cities 99".split()
    keys = [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(60)]
    pairs = [(a, b) for a in keys for b in rng.sample(keys, 8)]
    rows = spark.createDataFrame(pairs, "l string, r string")
    got = rows.select("l", "r", X.contained(F.col("l"), F.col("r")).alias("c"), X.semantic(X.title_tokens(F.col("l")), X.title_tokens(F.col("r"))).alias("s")).collect()
    for g in got:
        assert g.c == similar._contained(g.l, g.r), g
        assert g.s == similar._semantic(g.l, g.r), g


def test_page_body():
    p = "x" * 45
    assert html.page_body(f"<body><p>{'y' * 50}</p><article><p>{p}<p><b>{p}</b><script>no</script></article></body>") == f"{p} {p}\n{p}"
    assert html.page_body(f"<p>short</p><div>{'z ' * 50}</div>").startswith("short z")
    assert html.page_body("<p>short</p>") == "" == html.page_body(None)
