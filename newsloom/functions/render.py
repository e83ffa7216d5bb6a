"""Digest cards and documents as Column expressions (survey F26, D12, K5, K13, K15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as X

# Labels by language.
LABELS = {
    "en": {"headline": "Competitor Alert", "unknown": "Unknown Market", "nowhere": "Unknown", "competitor": "Competitor", "event": "Event", "priority": "Priority", "what": "What happened", "where": "Where", "source": "Source", "why": "Why it matters", "impact": "Potential impact", "take": "Product take", "risk": "Product risk", "follow_up": "Product follow-up"},
    "ru": {"headline": "Алерт по конкуренту", "unknown": "Неизвестный рынок", "nowhere": "Неизвестно", "competitor": "Конкурент", "event": "Событие", "priority": "Приоритет", "what": "Что произошло", "where": "Где", "source": "Источник", "why": "Почему это важно", "impact": "Потенциальное влияние", "take": "Продуктовый вывод", "risk": "Продуктовый риск", "follow_up": "Что проверить продуктово"},
}


def _or(*cs) -> Column:
    return F.coalesce(*[F.nullif(X.clean(c), F.lit("")) for c in cs[:-1]], F.lit(cs[-1]))


def headline(locale: str = "en") -> Column:
    l = LABELS.get(locale, LABELS["en"])
    return F.concat(F.lit(f"{l['headline']} — "), _or("country", "region", l["unknown"]))


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"\n\n{title}:\n"), body)


def card(locale: str = "en") -> Column:
    """One alert as plain text; product sections only where there is text."""
    l = LABELS.get(locale, LABELS["en"])
    what = X.clean("what_happened")
    what = F.when((what != "") & ~what.endswith("."), F.concat(what, F.lit("."))).otherwise(what)
    parts = [
        headline(locale), F.lit(f"\n\n{l['competitor']}: "), X.clean("competitor"), F.lit(f"\n{l['event']}: "), _or("event", "topic", ""), F.lit(f"\n{l['priority']}: "), F.upper(X.clean("priority")),
        _section(l["what"], what), F.lit(f"\n{l['where']}: "), _or("country", "region", l["nowhere"]), _section(l["source"], X.clean("url")), _section(l["why"], X.clean("why_it_matters")), _section(l["impact"], X.clean("potential_impact")),
    ]
    for c, k in (("product_take", "take"), ("product_risk", "risk"), ("product_follow_up", "follow_up")):
        parts.append(F.when(X.clean(c) != "", _section(l[k], X.clean(c))).otherwise(""))
    return F.concat(*parts)


def markdown_entry() -> Column:
    """One ranked alert of a Markdown digest; needs rank."""
    def line(name, c):
        return F.concat(F.lit(f"\n- {name}: "), c)

    def head(name, c):
        return F.concat(F.lit(f"\n\n### {name}\n"), c)

    parts = [F.concat(F.lit("\n\n## "), F.col("rank").cast("string"), F.lit(". "), headline(), F.lit("\n")), line("Competitor", X.clean("competitor")), line("Event", _or("event", "topic", "")),
             line("Priority", F.upper(X.clean("priority"))), line("Where", _or("country", "region", "Unknown")), line("Confidence", F.col("confidence").cast("string")),
             head("What happened", X.clean("what_happened")), head("Why it matters", X.clean("why_it_matters")), head("Potential impact", X.clean("potential_impact")), head("Source", X.clean("url"))]
    for c, k in (("product_take", "Product take"), ("product_risk", "Product risk"), ("product_follow_up", "Product follow-up")):
        parts.append(F.when(X.clean(c) != "", head(k, X.clean(c))).otherwise(""))
    return F.concat(*parts)


def _document(rows: DataFrame, entry: Column, top: Column, none: str) -> DataFrame:
    per = rows.withColumn("_e", entry).groupBy("region").agg(F.count("*").alias("alerts"), F.array_sort(F.collect_list(F.struct("rank", "_e"))).alias("l"))
    body = F.when(F.size("l") == 0, none).otherwise(F.array_join(F.transform("l", lambda x: x["_e"]), ""))
    return per.select("region", "alerts", F.concat(top, body).alias("document"))


def markdown_digest(rows: DataFrame, generated_at: str, title: str = "Digest Preview") -> DataFrame:
    """(region, alerts, document): a digest per region; its rows were limited before, so a document is small."""
    return _document(rows, markdown_entry(), F.concat(F.lit(f"# {title}\n\n- Generated at: {generated_at}\n- Alerts: "), F.col("alerts").cast("string")), "\n\n_No alerts were selected for this digest._")


def text_digest(rows: DataFrame, generated_at: str, title: str = "Daily Digest") -> DataFrame:
    entry = F.concat(F.lit("\n\n"), F.col("rank").cast("string"), F.lit(". "), headline(), F.lit("\n"), card())
    return _document(rows, entry, F.concat(F.lit(f"{title}\nGenerated at: {generated_at}\nAlerts: "), F.col("alerts").cast("string")), "\n\nNo alerts selected for this digest.")


def mirror_properties(limit: int = 2000) -> Column:
    """Properties of an alert for an external page."""
    def trimmed(c):
        return F.substring(X.clean(c), 1, limit)

    return F.struct(F.col("digest_key"), trimmed("headline").alias("name"), trimmed("competitor").alias("competitor"), trimmed("region").alias("region"), trimmed("country").alias("country"), trimmed("topic").alias("topic"),
                    F.col("priority"), F.round("confidence", 4).alias("confidence"), F.col("score"), trimmed("what_happened").alias("what_happened"), F.col("url"), F.col("resolved_date").cast("string").alias("published_date"))
