"""Rule-based classification of articles: brand, topic, geography, score and the reason of a drop.

Survey P2 to P10, P30, P31, J4 to J8, W3, F14 to F18, F20. The configuration compiles into Column expressions, so a
classification is one projection without shuffle, join or Python: it scans, filters and scores at the speed of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import TOPIC_ALIASES, TOPICS, SignalConfig
from newsloom.functions import text as X
from newsloom.operators.normalize import article_blob

# Context words of brands whose names are ordinary words, and signals that raise a topic's score.
NUMBER_CONTEXT = "app|ride|rides|rider|riders|taxi|driver|drivers|transport"
NAME_CONTEXT = "taxi|service|services|app|ride|rides|driver|drivers|transport"
VERB_CONTEXT = (
    "app|apps|airport|bank|banking|bonus|brand|campaign|career|commission|courier|delivery|discount|driver|drivers|fare|fares|feature|features|"
    "financial|fintech|fuel|graduate|graduates|launch|launches|launched|mobility|operations|open|opens|opened|partnership|pilot|pilots|platform|"
    "pricing|promo|recruitment|rider|riders|ride|rides|service|services|stake|strategic|subsidies|subscription|superapp|superbank|support|taxi|transport"
)
EXTRA_SIGNALS = {
    "pricing": ["commission", "discount", "fare", "price", "pricing"],
    "regulation": ["ban", "permit", "license", "compliance", "regulation", "regulatory approval"],
    "safety": ["incident", "security", "insurance", "background check", "safety"],
    "product_launch": ["launch", "rollout", "expansion", "partnership", "pilot"],
    "market_expansion": ["launch"],
    "campaign_launches": ["strategic partnership", "driver recruitment campaign"],
    "pricing_promo": ["first ride free", "discounted rides", "referral bonus", "loyalty program", "low commission", "bonus for new drivers"],
    "core_industry_terms": ["mobility as a service"],
    "strategic_operations": [],
    "performance_growth": ["low commission"],
    "product_features_innovation": ["launch", "rollout", "partnership", "pilot"],
}
DROP_REASONS = ("no_competitor_match", "no_topic_match", "ignored_geo_without_target_confirmation", "competitor_region_mismatch", "no_target_geo_match")


def near_words(name: str, words: str, gap: int) -> str:
    return rf"(?:\b{name}\b(?:\W+\w+){{0,{gap}}}\W+\b({words})\b)|(?:\b({words})\b(?:\W+\w+){{0,{gap}}}\W+\b{name}\b)"


def brand_match(brand: str, aliases=(), content: Column | None = None, folded: Column | None = None) -> Column:
    """Whether an article speaks of a brand: its name or an alias anywhere, or a name that is an ordinary word in context."""
    content = content if content is not None else X.blob("title", "snippet", "source")
    folded = folded if folded is not None else X.fold(content)
    name = brand.casefold()
    if name == "99":
        return folded.rlike(rf"(?U)(?:\b99\b(?!\s*[%$])(?:\W+({NUMBER_CONTEXT}))\b)|(?:\b({NUMBER_CONTEXT})\b(?:\W+99\b(?![%$])))")
    if name == "maxim":
        return content.rlike("(?U)" + near_words("Maxim", NAME_CONTEXT, 3))
    if name == "grab":
        return content.rlike(r"(?U)\bGrab\b") & content.rlike("(?iU)" + near_words("grab", VERB_CONTEXT, 4))
    return X.contains_any(folded, [n.casefold() for n in (brand, *aliases)])


def feed_brand_pattern(token: str) -> str:
    """Bounded pattern of a brand token for curated feeds; numbers and two-letter names need context."""
    token = token.casefold().strip()
    body = r"\s+".join(X.quoted(w) for w in token.split())
    if token.isdigit() or len(token) <= 2:
        words = NUMBER_CONTEXT
        return rf"(?U)(?:\b{body}\b(?!\s*[%$])(?:\W+\w+){{0,3}}\W+(?:{words})\b)|(?:\b(?:{words})\b(?:\W+\w+){{0,3}}\W+{body}\b(?!\s*[%$]))"
    return rf"(?U)(?<!\w){body}(?!\w)"


def feed_brand(folded: Column, config: SignalConfig, brands) -> Column:
    """First brand, in order, that a feed item speaks of, else null."""
    return X.first_of((X.any_of(folded.rlike(feed_brand_pattern(t)) for t in (b, *config.aliases.get(b, ()))), b) for b in brands)


def best_topic(config: SignalConfig) -> Column:
    """(topic, keywords) with the most keywords, the first of equals, null without any; columns _k0, _k1, ... hold each topic's."""
    sizes = [F.size(f"_k{n}") for n in range(len(config.topics))]
    most = F.greatest(F.lit(0), F.lit(0), *sizes)
    out = F.lit(None).cast("struct<topic:string,keywords:array<string>>")
    for n, t in reversed(list(enumerate(config.topics))):
        out = F.when((sizes[n] == most) & (most > 0), F.struct(F.lit(t).alias("topic"), F.col(f"_k{n}").alias("keywords"))).otherwise(out)
    return out


def signal_terms(topic: str) -> tuple[str, ...]:
    name = topic if topic in EXTRA_SIGNALS else TOPIC_ALIASES.get(topic, topic)
    return (*TOPICS.get(name, ()), *EXTRA_SIGNALS.get(name, ()))


def allowed_pairs(rows: DataFrame, competitor_region: DataFrame, matched: bool = True) -> DataFrame:
    """Rows whose (region, competitor) the configuration's table allows, or those for which it does not.

    The same rule as in ``classified``, as a join, for configurations kept as tables; null in either is a mismatch.
    """
    return rows.join(competitor_region.select("region", "competitor"), ["region", "competitor"], "left_semi" if matched else "left_anti").select(*rows.columns)


def classified(articles: DataFrame, config: SignalConfig, regions=None) -> DataFrame:
    """Adds competitor, topic_group, matched_keywords, region, country_hint, language_hint, score, reasons, summary, drop_reason
    and drop_details to normalised articles; drop_reason is null for the candidates. The article's own region moves to article_region."""
    regions = config.selected(regions)
    brands = config.brands_of(regions)
    geo_terms = {r: config.regions[r].geo_terms for r in config.regions}
    flat = {f"_b{n}": brand_match(b, config.aliases.get(b, ()), F.col("_content"), F.col("_text")) for n, b in enumerate(brands)}
    terms = X.Terms("_text", "_words")
    flat |= {f"_k{n}": terms.all(ks, inflect=True) for n, ks in enumerate(config.topics.values())}
    flat |= {f"_g_{r}": terms.first(ts) for r, ts in geo_terms.items()}
    flat |= {"_ignored": terms.all(config.ignored_geo), "_target": terms.any(config.target_terms(regions))}
    flat["_signals"] = F.array_compact(F.array(*[F.when(terms.any(signal_terms(t), inflect=True), F.lit(t)) for t in config.topics]))
    hints = F.transform(F.coalesce("competitor_hints", F.array().cast("array<string>")), X.fold)
    out = X.pinned(articles.withColumnRenamed("region", "article_region"), {"_content": X.blob("title", "snippet", "source"), "_hints": hints})
    out = X.pinned(terms.on(out, article_blob()), flat)
    hit = [(F.col(f"_b{n}"), F.array_contains("_hints", b.casefold()), b) for n, b in enumerate(brands)]
    competitor = F.coalesce(X.first_of((m & h, b) for m, h, b in hit), X.first_of((m, b) for m, _, b in hit))
    out = X.pinned(out, {"competitor": competitor, "_topic": best_topic(config)}).withColumns({"topic_group": F.col("_topic.topic"), "matched_keywords": F.coalesce("_topic.keywords", F.array().cast("array<string>"))})
    ignored = (F.size("_ignored") > 0) & ~F.col("_target")

    def allowed(region: Column) -> Column:
        return F.coalesce(X.any_of((region == r) & F.col("competitor").isin(*config.brands.get(r, ())) for r in config.regions if config.brands.get(r)), F.lit(False))

    own = F.coalesce(F.col("article_region").isin(*config.regions), F.lit(False))
    found = F.when(own, F.col("article_region")).otherwise(X.first_of((F.col(f"_g_{r}").isNotNull(), r) for r in regions))
    country = F.lit(None).cast("string")
    for r in config.regions:
        country = F.when(found == r, F.col(f"_g_{r}")).otherwise(country)
    ok = allowed(found)
    mismatch = (own & ~allowed(F.col("article_region"))) | X.any_of(F.col(f"_g_{r}").isNotNull() & ~allowed(F.lit(r)) for r in regions)
    owner = F.lower(F.trim(X.text("query_owner_region")))
    owner_ok = owner.isin(*regions) & (F.trim(X.text("query_owner_competitor")) == F.col("competitor")) & allowed(owner)
    out = X.pinned(out, {"_region": F.when(ok, found), "_country": F.when(ok, country), "_mismatch": mismatch, "_owner": F.when(owner_ok, owner), "_ignore": ignored})
    nowhere = F.col("_region").isNull() & F.col("_country").isNull()
    reason = (
        F.when(F.col("competitor").isNull(), DROP_REASONS[0]).when(F.col("topic_group").isNull(), DROP_REASONS[1]).when(F.col("_ignore"), DROP_REASONS[2])
        .when(nowhere & F.col("_mismatch"), DROP_REASONS[3])
        .when(F.lit(len(regions) > 1) & nowhere & F.col("_owner").isNull(), DROP_REASONS[4])
    )
    details = F.when(reason == DROP_REASONS[2], F.create_map(F.lit("ignored_geo_terms"), F.array_join("_ignored", " | "), F.lit("selected_regions"), F.lit(" | ".join(regions)))).when(
        reason.isNotNull() & (reason != DROP_REASONS[0]), F.create_map(F.lit("competitor"), F.col("competitor")))
    region = F.when(F.lit(len(regions) > 1) & nowhere, F.col("_owner")).otherwise(F.col("_region"))
    out = X.pinned(out, {"drop_reason": reason, "drop_details": details, "region": region, "country_hint": F.col("_country")})
    spoken = F.concat(F.lit(" "), X.fold(X.blob("title", "snippet", "query", "source", "article_region", "language")), F.lit(" "))
    language = F.lit(None).cast("string")
    for r, rc in config.regions.items():
        language = F.when(F.col("region") == r, F.coalesce(X.first_of((F.contains(spoken, F.lit(f" {h.casefold()} ")), h) for h in rc.language_hints), F.lit(rc.language_hints[0]))).otherwise(language)
    out = X.pinned(out, {"language_hint": F.coalesce(F.nullif("language", F.lit("")), language)})
    signal = F.coalesce(F.array_contains("_signals", F.col("topic_group")), F.lit(False))
    points = [
        (F.contains("_text", X.fold("competitor")), F.lit(5), F.lit("competitor_mentioned")),
        (F.size("_hints") > 0, F.lit(1), F.lit("provider_competitor_hint")),
        (F.size("matched_keywords") > 0, F.least(F.size("matched_keywords"), F.lit(3)) * 2, F.concat(F.lit("topic_match:"), "topic_group")),
        (F.col("region").isNotNull(), F.lit(2), F.concat(F.lit("region_match:"), "region")),
        (F.col("country_hint").isNotNull(), F.lit(1), F.concat(F.lit("country_hint:"), "country_hint")),
        (F.col("language_hint").isNotNull(), F.lit(1), F.concat(F.lit("language_hint:"), "language_hint")),
        (signal, F.lit(2), F.lit("priority_signal")),
    ]
    total = sum((F.when(c, p).otherwise(0) for c, p, _ in points), F.lit(0))
    summary = F.concat(F.col("competitor"), F.lit(" / "), F.col("topic_group"), F.when(F.col("country_hint").isNotNull(), F.concat(F.lit(" / "), "country_hint")).otherwise(""), F.lit(": "), X.text("title"))
    out = X.pinned(out, {"score": F.least(total, F.lit(10)), "reasons": F.array_compact(F.array(*[F.when(c, r) for c, _, r in points])), "summary": summary})
    return out.select(*[c for c in out.columns if not c.startswith("_")])


def split(rows: DataFrame, min_score: int = 0) -> tuple[DataFrame, DataFrame]:
    """(candidates, dropped): the two sides of one classification; too low a score is a drop with score and threshold."""
    low = F.col("drop_reason").isNull() & (F.col("score") < min_score)
    tagged = rows.withColumn("drop_details", F.when(low, F.create_map(F.lit("score"), F.col("score").cast("string"), F.lit("threshold"), F.lit(str(min_score)))).otherwise(F.col("drop_details"))).withColumn(
        "drop_reason", F.when(low, "score_below_threshold").otherwise(F.col("drop_reason")))
    return tagged.where("drop_reason is null"), tagged.where("drop_reason is not null").select("seq", "url", "title", F.col("drop_reason").alias("reason"), F.col("drop_details").alias("details"))


def drop_histogram(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")
