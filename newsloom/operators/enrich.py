"""Alert texts, truth checks, strategist block and optional model calls (survey D3 to D11, F19, J17, J20, P25, P32).

Rule-based texts are projections. A model is an injected client, called per Arrow batch on the rows of the enrichment
slice that have a body; any failure of a row falls back to its rule-based text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.config import REGION_LABELS, SignalConfig
from newsloom.functions import text as X
from newsloom.operators.gate import canonical_topic

# Fixed values.
COUNTRY_NAMES = {
    "ae": "United Arab Emirates", "uae": "United Arab Emirates", "u a e": "United Arab Emirates", "sa": "Saudi Arabia", "ksa": "Saudi Arabia", "saudi": "Saudi Arabia",
    "qa": "Qatar", "jo": "Jordan", "bh": "Bahrain", "kw": "Kuwait", "om": "Oman", "iq": "Iraq", "lb": "Lebanon", "eg": "Egypt", "mx": "Mexico", "br": "Brazil", "brasil": "Brazil",
    "co": "Colombia", "pe": "Peru", "cl": "Chile", "ar": "Argentina", "ec": "Ecuador", "uy": "Uruguay", "py": "Paraguay", "bo": "Bolivia", "cr": "Costa Rica",
    "do": "Dominican Republic", "gt": "Guatemala", "pa": "Panama", "za": "South Africa", "ke": "Kenya", "ng": "Nigeria", "ma": "Morocco", "gh": "Ghana", "tz": "Tanzania",
    "ug": "Uganda", "ci": "Cote d'Ivoire", "cote divoire": "Cote d'Ivoire", "sn": "Senegal", "tn": "Tunisia", "dz": "Algeria", "et": "Ethiopia", "id": "Indonesia",
    "th": "Thailand", "vn": "Vietnam", "ph": "Philippines", "sg": "Singapore", "my": "Malaysia", "kh": "Cambodia", "la": "Laos", "mm": "Myanmar", "bn": "Brunei",
    "ru": "Russia", "russian federation": "Russia", "kz": "Kazakhstan", "uz": "Uzbekistan", "by": "Belarus", "kg": "Kyrgyzstan", "ge": "Georgia", "am": "Armenia",
    "az": "Azerbaijan", "tj": "Tajikistan", "mn": "Mongolia",
}
STRATEGIST_TOPICS = ("product_features_innovation", "strategic_operations", "pricing_promo")
GROWTH_TERMS = ("commission", "driver incentive", "driver incentives", "driver recruitment", "feature", "subscription", "pricing", "fare", "discount", "service", "airport", "operations", "supply", "dispatch", "earnings", "marketplace")
PRICE_TERMS = ("commission", "fare", "pricing", "discount")
TAKES = {
    "pricing_promo": ("This pricing move may reshape perceived rider value and driver economics in {market}.", "Risk of value-positioning pressure if the competitor sets a stronger local price anchor or incentive expectation.", "Review local price architecture, promo guardrails, and whether {company} needs a tighter value-proposition response."),
    "product_features_innovation": ("This feature or service move may shift parity expectations for riders or drivers in {market}.", "Risk of feature-gap perception if the competitor turns this capability into a visible user promise.", "Check parity relevance, rollout speed, and whether the response should be product, GTM, or messaging-led."),
    "strategic_operations": ("This operational move may improve service reliability, supply quality, or route-to-market execution in {market}.", "Risk of stronger local execution advantage if partnerships, market-entry mechanics, or service operations improve faster than {company}'s response.", "Validate operational dependencies, market-entry friction, and whether {company} needs a product or ops response beyond communications."),
    "growth_price": ("This growth signal appears tied to price-value mechanics rather than pure marketing in {market}.", "Risk of value-proposition pressure if users or drivers start benchmarking on earnings or price architecture.", "Review whether pricing, incentives, or earnings messaging need a product-backed response."),
    "growth_ops": ("This growth signal appears tied to operational or product mechanics in {market}.", "Risk of stronger supply reliability or marketplace quality if the underlying mechanism scales locally.", "Check whether the response should focus on ops levers, driver experience, or service design."),
}
DEFAULTS = {
    "competitor": "Unknown competitor", "topic": "general movement", "what_happened": "No clear event description available.",
    "why_it_matters": "This signal may matter for competitor positioning or market perception.", "potential_impact": "Potential impact remains unclear and needs validation.",
    "recommended_action": "Review the signal and decide whether any local response is needed.",
}
TEXTS = ("event", "what_happened", "why_it_matters", "potential_impact", "recommended_action")


def region_label(region) -> Column:
    r = X.clean(region)
    out = r
    for k, v in REGION_LABELS.items():
        out = F.when(r == k, v).otherwise(out)
    return out


def topic_label(topic) -> Column:
    return F.replace(canonical_topic(topic), F.lit("_"), F.lit(" "))


def fallback(alerts: DataFrame) -> DataFrame:
    """Rule-based alert texts."""
    topic, country, region = topic_label("topic_group"), X.text("country_hint"), region_label("region")
    market = F.coalesce(F.nullif(country, F.lit("")), F.nullif(region, F.lit("")), F.lit("the market"))
    matched = F.coalesce(F.nullif(F.array_join("matched_keywords", ", "), F.lit("")), topic)
    event = F.concat(X.clean("competitor"), F.lit(" "), topic, F.lit(" move"), F.when(country != "", F.concat(F.lit(" in "), country)).otherwise(""))
    return alerts.withColumns({
        "topic": topic, "country": country, "event": event,
        "what_happened": F.concat("competitor", F.lit(" is reported to have made a "), topic, F.lit(" move. Detected signals: "), matched, F.lit(".")),
        "why_it_matters": F.concat(F.lit("This signal may affect local market messaging, competitive positioning, or supply-demand narrative in "), market, F.lit(".")),
        "potential_impact": F.concat(F.lit("Possible impact on brand narrative, growth messaging, or driver/rider perception around "), market, F.lit(".")),
        "recommended_action": F.lit("Review whether this move needs a local response in messaging, creative, pricing, or partnerships."),
        "is_editorial_fallback": F.lit(False),
    })


def alert_defaults(alerts: DataFrame) -> DataFrame:
    """Missing texts, odd priorities and confidences out of range set right."""
    fixed = {c: F.coalesce(F.nullif(X.clean(c), F.lit("")), F.lit(DEFAULTS[c])) for c in DEFAULTS if c in alerts.columns}
    fixed["priority"] = F.when(F.upper("priority").isin("LOW", "MEDIUM", "HIGH"), F.upper("priority")).otherwise("LOW")
    fixed["confidence"] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))))
    return alerts.withColumns(fixed)


def _country_key(c: Column) -> Column:
    k = X.country_key(c)
    names = F.create_map(*[F.lit(x) for a, name in COUNTRY_NAMES.items() for x in (a, name.casefold())])
    return F.coalesce(F.try_element_at(names, k), k)


def _key(term: str) -> str:
    plain = " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in term.casefold()).split())
    return COUNTRY_NAMES.get(plain, plain).casefold()


def truth(alerts: DataFrame, config: SignalConfig, llm_region: str = "llm_region", llm_country: str = "llm_country") -> DataFrame:
    """Region and country that the evidence allows, with their provenance.

    Region: the pipeline's own; none if the brand works nowhere; its only one; the only one with the country; else ''. Country: the
    pipeline's own, else the model's if the region has it."""
    def given(c):
        return X.clean(c) if c in alerts.columns else F.lit("")

    said_r, said_c = given(llm_region), given(llm_country)
    own_r, own_c = X.clean("region"), X.clean("country_hint")
    brands = list(dict.fromkeys(b for bs in config.brands.values() for b in bs))
    n_allowed = F.lit(0)
    only = F.lit("")
    for b in brands:
        a = config.allowed(b)
        n_allowed, only = F.when(F.col("competitor") == b, len(a)).otherwise(n_allowed), F.when(F.col("competitor") == b, a[0]).otherwise(only)
    alerts = X.pinned(alerts, {"_key": _country_key(F.coalesce(F.nullif(own_c, F.lit("")), F.nullif(said_c, F.lit("")), F.lit(""))), "_says": _country_key(said_c)})
    key, says = F.col("_key"), F.col("_says")
    in_region = {r: key.isin(*dict.fromkeys(_key(t) for t in rc.validation_terms)) & F.col("competitor").isin(*(config.brands.get(r) or ("",))) for r, rc in config.regions.items()}
    matches = sum((c.cast("int") for c in in_region.values()), F.lit(0))
    by_country = X.first_of((c, r) for r, c in in_region.items())
    alerts = X.pinned(alerts, {"_matches": matches, "_by_country": by_country})
    matches, by_country = F.col("_matches"), F.col("_by_country")
    region = F.when(own_r != "", own_r).when(n_allowed == 0, "").when(n_allowed == 1, only).when((key != "") & (matches == 1), by_country).otherwise("")
    r_source = F.when(own_r != "", "pipeline").when((n_allowed > 1) & (key != "") & (matches == 1), "geo_country_override").when((said_r != "") & (region == said_r), "llm").otherwise("empty")
    r_fallback = F.when(own_r != "", ~said_r.isin("") & (said_r != own_r)).otherwise((said_r != "") & (region != said_r))
    term = F.lit(None).cast("string")
    for r, rc in config.regions.items():
        first = {}
        for t in rc.validation_terms:
            first.setdefault(_key(t), t)
        term = F.when(region == r, X.first_of((says == k, t) for k, t in first.items())).otherwise(term)
    kept = (own_c == "") & (said_c != "") & term.isNotNull()
    country = F.when(own_c != "", own_c).when(kept, term).otherwise("")
    c_source = F.when(own_c != "", "pipeline").when(kept, "llm").otherwise("empty")
    c_fallback = F.when(own_c != "", (said_c != "") & (said_c != own_c)).otherwise((said_c != "") & ~kept)
    return alerts.withColumns({"safe_region": region, "country": country, "competitor_source": F.lit("pipeline"), "region_source": r_source, "country_source": c_source, "geo_validation_fallback": r_fallback | c_fallback}).drop("_key", "_says", "_matches", "_by_country")


def strategist(alerts: DataFrame, company: str = "the company") -> DataFrame:
    """Product take, risk and follow-up where the topic calls for it (D9, P32); company names the party that reads the digest."""
    topic = canonical_topic("topic_group")
    blob = X.fold(X.blob("title", "summary", "snippet", "event", "what_happened", "why_it_matters"))
    market = F.coalesce(F.nullif(X.text("country_hint"), F.lit("")), F.nullif(X.text("country"), F.lit("")), F.nullif(region_label("region"), F.lit("")), F.lit("the market"))
    invoked = topic.isin(*STRATEGIST_TOPICS) | ((topic == "performance_growth") & X.contains_any(blob, GROWTH_TERMS))
    kind = F.when(topic == "performance_growth", F.when(X.contains_any(blob, PRICE_TERMS), "growth_price").otherwise("growth_ops")).otherwise(topic)
    out = {}
    for n, name in enumerate(("product_take", "product_risk", "product_follow_up")):
        value = F.lit(None).cast("string")
        for k, lines in TAKES.items():
            value = F.when(kind == k, F.replace(F.lit(lines[n].replace("{company}", company)), F.lit("{market}"), market)).otherwise(value)
        out[name] = F.when(invoked, value)
    return alerts.withColumns({**out, "product_strategist_invoked": invoked, "product_strategist_trigger": F.when(invoked, topic)})


ANSWERS = "content string, answer string, error string"


def content(alerts: DataFrame) -> Column:
    """What a model is asked about, as a hash: the story, not the run."""
    body = F.col("article_body") if "article_body" in alerts.columns else F.col("snippet")
    parts = [X.text(c) for c in ("title", "competitor", "topic_group", "url")] + [X.text(body)]
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def answers(alerts: DataFrame, client: Callable[[], Callable[[dict], str]], known: DataFrame | None = None, workers: int = 8) -> DataFrame:
    """(content, answer, error) for the contents of rows with use_llm that ``known`` (content, answer) lacks.

    ``client()`` runs once per partition and returns a function from a row to a JSON object with the text fields. Up to ``workers`` calls
    of a batch run at a time. A call that fails, or answers no JSON object, is a row with an error.
    """
    asked = alerts.where(F.coalesce("use_llm", F.lit(False))).withColumn("content", content(alerts))
    if known is not None:
        asked = asked.join(known.where("answer is not null").select("content"), "content", "left_anti")
    asked = asked.select("content", F.to_json(F.struct(*[F.col(f"`{c}`") for c in alerts.columns])).alias("row")).dropDuplicates(["content"])

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        ask = client()

        def one(row):
            try:
                said = ask(json.loads(row))
                return (said, None) if isinstance(json.loads(said), dict) else (None, "no JSON object")
            except Exception as e:  # a model's failure must not fail the job
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                found = list(pool.map(one, pdf["row"]))
                yield pd.DataFrame({"content": pdf["content"], "answer": [a for a, _ in found], "error": [e for _, e in found]}, dtype=object)

    return asked.mapInPandas(run, ANSWERS)


def with_answers(alerts: DataFrame, said: DataFrame) -> DataFrame:
    """Alerts with the texts of their answers; what an answer lacks keeps its rule-based text. Adds llm_error and is_editorial_fallback."""
    one = said.groupBy("content").agg(F.max("answer").alias("_answer"), F.max("error").alias("_error"))
    rows = alerts.withColumn("content", content(alerts)).join(one, "content", "left")
    fields = F.from_json("_answer", ", ".join(f"{c} string" for c in TEXTS))
    texts = {c: F.coalesce(F.nullif(X.clean(fields[c]), F.lit("")), F.col(c)) for c in TEXTS if c in alerts.columns}
    wanted = F.coalesce("use_llm", F.lit(False))
    return X.pinned(rows, {
        **texts, "llm_error": F.when(F.col("_answer").isNull(), F.col("_error")).cast("string"), "is_editorial_fallback": wanted & F.col("_answer").isNull(),
    }).drop("content", "_answer", "_error")


def model_texts(alerts: DataFrame, client: Callable[[], Callable[[dict], str]]) -> DataFrame:
    """Texts by a model for rows with use_llm, asked anew; see ``answers`` and ``with_answers``."""
    return with_answers(alerts, answers(alerts, client))


def deliverable(alerts: DataFrame) -> DataFrame:
    """Alerts with real texts and some confidence (P25)."""
    return alerts.where(~F.coalesce("is_editorial_fallback", F.lit(False)) & (F.col("confidence") > 0))


def stamped(alerts: DataFrame, role: str = "editor", version: str = "1") -> DataFrame:
    return alerts.withColumns({"agent_role": F.lit(role), "agent_contract_version": F.lit(version)})
