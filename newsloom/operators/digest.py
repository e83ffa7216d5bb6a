"""Regional assignment, ranking, limits and freshness of the digest (survey W1 to W7, O1, O2, P23 to P26, F8, F17, F21, J19, X6, A9, U4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.config import SignalConfig
from newsloom.functions import text as X
from newsloom.operators import gate, similar

PRIORITY = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def region_strength(region: str, config: SignalConfig, terms: X.Terms) -> Column:
    """Distinct markers of a region that a text names."""
    rc = config.regions[region]
    markers = dict.fromkeys(t.casefold() for t in (rc.label, *rc.geo_terms, *rc.validation_terms))
    return sum((terms.has(t).cast("int") for t in markers), F.lit(0))


def assigned(candidates: DataFrame, config: SignalConfig, regions=None) -> DataFrame:
    """Sets region by the clear winner of the markers, else the query's owner, else the candidate's own or only region.

    Adds strength and region_ord; rows that end up in no selected region have region_ord null, so they can be audited."""
    regions = config.selected(regions)
    terms = X.Terms("_geo", "_geo_words")
    strengths = {f"_s_{r}": region_strength(r, config, terms) for r in regions}
    out = X.pinned(terms.on(candidates, gate.geo_blob()), strengths)
    most = F.greatest(F.lit(0), F.lit(0), *[F.col(f"_s_{r}") for r in regions])
    winners = sum(((F.col(f"_s_{r}") == most).cast("int") for r in regions), F.lit(0))
    clear = F.when((most > 0) & (winners == 1), X.first_of((F.col(f"_s_{r}") == most, r) for r in regions))
    owner = F.lower(F.trim(X.text("query_owner_region")))
    own = F.lower(F.trim(F.coalesce(F.nullif("region", F.lit("")), F.nullif("article_region", F.lit("")), F.lit("")))) if "article_region" in out.columns else F.lower(F.trim(X.text("region")))
    fallback = F.when(own != "", own).otherwise(F.lit(regions[0] if len(regions) == 1 else ""))
    region = F.coalesce(clear, F.when(owner.isin(*regions), owner), fallback)
    strength, place = F.lit(0), F.lit(None).cast("int")
    for n, r in enumerate(regions):
        strength, place = F.when(F.col("region") == r, F.col(f"_s_{r}")).otherwise(strength), F.when(F.col("region") == r, n).otherwise(place)
    out = X.pinned(out, {"region": region})
    out = X.pinned(out, {"strength": strength, "region_ord": place})
    return out.drop("_geo", "_geo_words", *[f"_s_{r}" for r in regions])


def dedup_key() -> Column:
    url = X.canonical_url("url")
    return F.when(url != "", F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("text:"), X.title_key("title"), F.lit("::"), X.title_key("snippet")))


def best_region(rows: DataFrame) -> DataFrame:
    """One row per story over all regions: strongest, with a country, best score, first region, first in order."""
    rank = F.struct("strength", (X.text("country_hint") != "").cast("int").alias("c"), "score", (-F.col("region_ord")).alias("r"), (-F.col("seq")).alias("s"))
    rows = rows.where("region_ord is not null").withColumns({"_key": dedup_key(), "_rank": rank})
    top = rows.groupBy("_key").agg(F.max("_rank").alias("_top"))
    return rows.join(top, ["_key"]).where("_rank = _top").drop("_key", "_rank", "_top")


def alerts(candidates: DataFrame) -> DataFrame:
    """Promotes candidates: digest_key, headline, priority, confidence, reason."""
    key = F.concat_ws("::", F.lower("competitor"), "topic_group", "url")
    priority = F.coalesce(F.nullif("priority_hint", F.lit("")), X.priority(F.col("score"))) if "priority_hint" in candidates.columns else X.priority(F.col("score"))
    return X.pinned(candidates, {
        "digest_key": F.coalesce(F.nullif("deferred_digest_key", F.lit("")), key), "headline": F.col("title"), "severity": F.lower(priority), "priority": priority,
        "confidence": X.confidence(F.col("score")), "reason": F.coalesce(F.nullif("summary", F.lit("")), F.nullif(F.array_join("reasons", ", "), F.lit("")), F.col("title")),
        "canonical_topic": gate.canonical_topic("topic_group"),
    })


def rank_order(date: str = "resolved_date") -> list[Column]:
    prio = F.lit(0)
    for k, v in PRIORITY.items():
        prio = F.when(F.upper("priority") == k, v).otherwise(prio)
    return [prio.desc(), F.col(date).desc_nulls_last(), (X.text("deferred_digest_key") != "").asc(), F.col("confidence").desc(), F.col("score").desc(), F.col("seq").asc()]


def ranked(rows: DataFrame, name: str = "rank", date: str = "resolved_date") -> DataFrame:
    """Position in the region's digest; equals keep their order of arrival."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy("region").orderBy(*rank_order(date))))


def top(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where(F.col("rank") <= max(1, limit))


def resolved(rows: DataFrame, llm: str | None = None, html: str | None = None) -> DataFrame:
    """resolved_date and resolved_date_source: model, page, provider, none (F8)."""
    found = [(X.any_date(F.col(c)), s) for c, s in ((llm, "llm"), (html, "html_scraped"), ("published_at", "provider")) if c]
    source = F.lit("undated_fallback")
    for d, s in reversed(found):
        source = F.when(d.isNotNull(), s).otherwise(source)
    return X.pinned(rows, {"resolved_date": F.coalesce(*[d for d, _ in found]), "resolved_date_source": source})


def needs_context(as_of: str, days: int = 7) -> Column:
    """A missing, future or old provider date calls for the page."""
    d, today = X.published_date("published_at"), F.lit(as_of).cast("date")
    return d.isNull() | (d > today) | (d < F.date_sub(today, days))


def freshness(rows: DataFrame, as_of: str, days: int = 7, score_min: int = 7) -> DataFrame:
    """Adds is_expired. Undated alerts expire unless allowed; old ones stay if they are strong, above their digest's average and not deferred.

    The average is over the digest after its limit and before this filter."""
    today = F.lit(as_of).cast("date")
    mean = F.avg("score").over(W.partitionBy("region"))
    strong = (F.col("score") >= score_min) & (F.col("score") > mean) & (X.text("deferred_digest_key") == "")
    fresh = F.when(F.col("resolved_date").isNull(), F.coalesce("allow_undated", F.lit(False))).otherwise((F.col("resolved_date") >= F.date_sub(today, days)) | strong)
    return rows.withColumn("is_expired", ~fresh)


def delivery_slice(rows: DataFrame, limit: int) -> DataFrame:
    """The first alerts of the digests strung together in region order."""
    return rows.withColumn("position", F.row_number().over(W.orderBy("region_ord", "rank"))).where(F.col("position") <= limit)


def enrichment_slice(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("use_llm", F.col("rank") <= n)


def highlights(rows: DataFrame, n: int = 5) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("rank", "headline")))
    return rows.where(F.col("rank") <= n).groupBy("region").agg(F.transform(listed, lambda x: x.headline).alias("highlights"))


def build(candidates: DataFrame, config: SignalConfig, regions, history: DataFrame | None = None, sent: DataFrame | None = None, limit: int | None = None,
          ranking: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The regional digests: filter, promote, rank, suppress, limit - in this order (suppression before the limit).

    ``ranking`` may set anew what the ranks are made of: priority, confidence, score, resolved_date (D4)."""
    chosen = config.selected(regions)
    rows = gate.marketing(candidates, config, tuple(chosen), own_region=True)
    rows = resolved(alerts(rows)) if "resolved_date" not in rows.columns else alerts(rows)
    rows = ranked(ranking(rows) if ranking else rows, "rank_in")
    if sent is not None:
        rows = rows.join(sent.select("digest_key").distinct(), "digest_key", "left_anti")
    if history is not None:
        rows = similar.suppressed_by_history(rows, history)
    # the pass over kept alerts is per region, brand and topic
    rows = rows.withColumn("_topic", F.col("canonical_topic")).withColumn("canonical_topic", F.concat_ws("\0", "canonical_topic", "region"))
    rows = similar.suppressed_within(rows).withColumn("canonical_topic", F.col("_topic")).drop("_topic")
    return top(ranked(rows), config.digest_limit if limit is None else limit).drop("rank_in")
