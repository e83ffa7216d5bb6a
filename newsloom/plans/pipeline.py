"""The main pipeline: articles in, digests, drops and metrics out (survey C5, C6, section 3.1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.config import SignalConfig
from newsloom.operators import classify, digest, enrich, gate, metrics, normalize, similar, state


def run(raw: DataFrame, config: SignalConfig, as_of: str, regions=None, min_score: int = 4, alerts: DataFrame | None = None, events: DataFrame | None = None,
        channel: str = "daily_digest", destination: str = "local", pages: DataFrame | None = None, limit: int | None = None, queries: int = 0, dedup: bool = True,
        ranking: Callable[[DataFrame], DataFrame] | None = None, client: Callable | None = None, known: DataFrame | None = None, ask: int = 15) -> dict[str, DataFrame]:
    """All results of a run as named DataFrames. ``alerts`` and ``events`` are the stored state; nothing is written here.

    ``ranking`` may set anew what ranks are made of (D4). With ``client`` a model is asked for the texts of the first ``ask`` alerts of each region,
    but for those that ``known`` (content, answer) has answers to; the result "answers" is what it said (D11, D13).

    Order: normalise, dedup, classify, gate, assign regions, merge deferred, rank, suppress, limit, freshness, texts.
    """
    regions = config.selected(regions)
    articles = normalize.normalized(normalize.conformed(raw))
    wins = None
    if dedup:
        articles, wins = similar.deduplicated(articles)
        articles = articles.withColumn("seq", F.col("slot")).drop("slot")
    # written once: every result below reads it
    candidates, dropped = classify.split(similar.checkpointed(classify.classified(articles, config, regions)), min_score)
    accepted, refused = gate.split(gate.decided(candidates))
    placed = digest.assigned(accepted, config, regions)
    lost = placed.where("region_ord is null").select("seq", "url", "title", F.lit("no_assigned_region").alias("reason"), F.create_map(F.lit("competitor"), F.col("competitor")).alias("details"))
    pool = digest.best_region(placed)
    history = sent = None
    if alerts is not None and events is not None:
        deferred = state.deferred_pool(alerts, events, channel, destination, as_of)
        pool = pool.unionByName(deferred, allowMissingColumns=True).select(*pool.columns)
        history, sent = state.recent_history(alerts, events, channel, destination), state.sent(events, channel, destination)
    if pages is not None:
        from newsloom.functions.html import with_context

        pool = with_context(pool, pages, digest.needs_context(as_of))
    pool = digest.resolved(pool, html="page_date" if pages is not None else None)
    top = digest.build(pool, config, regions, history, sent, limit, ranking)
    texts, said = enrich.fallback(digest.freshness(top, as_of)), None
    if client is not None:
        texts = similar.checkpointed(digest.enrichment_slice(texts, ask))
        said = similar.checkpointed(enrich.answers(texts.where("not is_expired"), client, known))  # asked once, whatever reads it
        every = said if known is None else said.unionByName(known.select("content", "answer", F.lit(None).cast("string").alias("error")))
        texts = enrich.with_answers(texts, every)
    flagged = enrich.strategist(texts)
    fresh = flagged.where("not is_expired")
    drops = dropped.unionByName(refused).unionByName(lost)
    out = {
        "articles": articles, "candidates": accepted, "dropped": drops, "digest": fresh, "expired": flagged.where("is_expired"), "highlights": digest.highlights(top),
        "summary": metrics.run_summary(articles, accepted, drops, fresh, queries),
    }
    if said is not None:
        out["answers"] = said
    return out | ({"wins": similar.win_metrics(wins)} if wins is not None else {})
