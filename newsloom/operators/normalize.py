"""Raw article rows: schema, construction and normalisation (survey P1, P5, P35, P36, S10, U1, J3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text as X

#: Columns that drive logic; sources may leave any of them out.
ARTICLE = T.StructType([T.StructField(n, k) for n, k in (
    ("seq", T.LongType()), ("title", T.StringType()), ("url", T.StringType()), ("provider", T.StringType()), ("source", T.StringType()),
    ("published_at", T.StringType()), ("snippet", T.StringType()), ("query", T.StringType()), ("region", T.StringType()), ("language", T.StringType()),
    ("competitor_hints", T.ArrayType(T.StringType())), ("source_tier", T.StringType()), ("query_owner_competitor", T.StringType()),
    ("query_owner_region", T.StringType()), ("query_owner_topic_group", T.StringType()), ("direct_feed_name", T.StringType()),
    ("direct_feed_url", T.StringType()), ("deferred_digest_key", T.StringType()), ("allow_undated", T.BooleanType()),
)])


def conformed(rows: DataFrame) -> DataFrame:
    """All article columns in order, absent ones null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ARTICLE])


def normalized(rows: DataFrame) -> DataFrame:
    """Cleaned title, source, snippet and query, canonical URL; a date that cannot be read stays as it is."""
    return X.pinned(rows, {
        "title": X.clean("title"), "source": X.source_or_domain(F.col("source"), F.col("url")), "snippet": X.clean("snippet"), "query": X.clean("query"),
        "published_at": F.coalesce(X.published_date("published_at").cast("string"), F.col("published_at")), "url": X.canonical_url("url"),
    })


def article_blob() -> Column:
    """Folded title, snippet and source; the search query never enters."""
    return X.fold(X.blob("title", "snippet", "source"))


def owned(articles: DataFrame, queries: DataFrame) -> DataFrame:
    """Owner of the query that found an article, unless the article names one."""
    own = queries.select(F.col("query").alias("_q"), *[F.col(f"owner_{k}").alias(f"_{k}") for k in ("region", "competitor", "topic")])
    joined = articles.join(own, F.col("query") == F.col("_q"), "left")
    return joined.withColumns({
        "query_owner_region": F.coalesce("query_owner_region", "_region"), "query_owner_competitor": F.coalesce("query_owner_competitor", "_competitor"),
        "query_owner_topic_group": F.coalesce("query_owner_topic_group", "_topic"),
    }).select(*articles.columns)


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """Articles of several providers as one stream; seq keeps provider order, then the order within it."""
    out = None
    for n, p in enumerate(parts):
        p = conformed(p).withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")) + F.lit(n).cast("long") * (1 << 40))
        out = p if out is None else out.unionByName(p)
    return out
