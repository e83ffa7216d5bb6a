"""Tracked regions, brands, topics and terms; defaults, validation, dimension tables and query expansion.

Survey items S20, S21, J1, J2, J7, F24, F25, F37d, C4, C8, C10. Order is significant throughout: every dimension carries ``ord``.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The vocabulary of the default configuration.
REGIONS = {
    "latam": {
        "label": "Latin America",
        "geo_terms": ["Mexico", "Brazil", "Colombia", "Peru", "Chile", "LATAM"],
        "country_validation_terms": ["Mexico", "MX", "Brazil", "BR", "Colombia", "CO", "Peru", "PE", "Chile", "CL", "Argentina", "AR", "Ecuador", "EC", "Uruguay", "UY", "Paraguay", "PY", "Bolivia", "BO", "Costa Rica", "CR", "Dominican Republic", "DO", "Guatemala", "GT", "Panama", "PA"],
        "language_hints": ["es", "pt", "en"],
    },
    "africa": {
        "label": "Africa",
        "geo_terms": ["South Africa", "Kenya", "Nigeria", "Egypt", "Africa"],
        "country_validation_terms": ["South Africa", "ZA", "Kenya", "KE", "Nigeria", "NG", "Egypt", "EG", "Morocco", "MA", "Ghana", "GH", "Tanzania", "TZ", "Uganda", "UG", "Ivory Coast", "Cote d'Ivoire", "Senegal", "SN", "Tunisia", "TN", "Algeria", "DZ", "Ethiopia", "ET"],
        "language_hints": ["en", "fr", "sw"],
    },
    "mea": {
        "label": "Middle East",
        "geo_terms": ["Saudi Arabia", "UAE", "Qatar", "Jordan", "MEA"],
        "country_validation_terms": ["Saudi Arabia", "SA", "KSA", "UAE", "AE", "United Arab Emirates", "Qatar", "QA", "Jordan", "JO", "Bahrain", "BH", "Kuwait", "KW", "Oman", "OM", "Iraq", "IQ", "Lebanon", "LB", "Egypt", "EG", "Algeria", "DZ", "Morocco", "MA", "Nigeria", "NG", "Kenya", "KE", "South Africa", "ZA"],
        "language_hints": ["ar", "en", "fr"],
    },
    "sea": {
        "label": "Southeast Asia",
        "geo_terms": ["Indonesia", "Thailand", "Vietnam", "Philippines", "SEA"],
        "country_validation_terms": ["Indonesia", "ID", "Thailand", "TH", "Vietnam", "VN", "Philippines", "PH", "Singapore", "SG", "Malaysia", "MY", "Cambodia", "KH", "Laos", "LA", "Myanmar", "MM", "Brunei", "BN"],
        "language_hints": ["en", "id", "th", "vi"],
    },
    "cis_central_asia": {
        "label": "CIS / Central Asia",
        "geo_terms": ["Kazakhstan", "Uzbekistan", "Kyrgyzstan", "Georgia", "CIS", "Central Asia"],
        "country_validation_terms": ["Russia", "RU", "Russian Federation", "Kazakhstan", "KZ", "Uzbekistan", "UZ", "Belarus", "BY", "Kyrgyzstan", "KG", "Georgia", "GE", "Armenia", "AM", "Azerbaijan", "AZ", "Tajikistan", "TJ", "Mongolia", "MN"],
        "language_hints": ["ru", "en", "kk", "uz"],
    },
}
BRANDS = {
    "latam": ["Uber", "DiDi", "Cabify", "99"],
    "africa": ["Bolt", "Uber", "Careem", "Yassir", "Heetch"],
    "mea": ["Bolt", "Uber", "Careem", "Yassir", "Heetch"],
    "sea": ["Grab", "Gojek", "Maxim", "Bolt"],
    "cis_central_asia": ["Yandex Go", "Bolt", "Maxim"],
}
TOPICS = {
    "market_expansion": ["launching in", "new city", "entering market", "expansion"],
    "campaign_launches": ["campaign", "partnership", "brand ambassador", "new feature"],
    "pricing_promo": ["discount", "promo code", "price cut", "subscription"],
    "core_industry_terms": ["ride-hailing", "e-hailing", "on-demand mobility", "ride-sharing", "taxi app", "vtc", "maas"],
    "strategic_operations": ["market entry", "launching operations", "license obtained", "regulatory approval", "strategic partnership", "driver recruitment campaign"],
    "performance_growth": ["first ride free", "discounted rides", "referral bonus", "loyalty program", "low commission for drivers", "bonus for new drivers"],
    "product_features_innovation": ["intercity", "delivery", "courier service", "freight", "fixed price", "bidding model", "safety features"],
}
PRIORITY_TOPICS = ["market_expansion", "campaign_launches", "pricing_promo", "strategic_operations", "performance_growth", "product_features_innovation", "core_industry_terms"]
ALIASES = {
    "Yandex Go": ["Yango", "Yandex Taxi"], "Careem": ["Careem Rides", "Careem Pay"], "Grab": ["GrabTaxi", "GrabCar", "GrabBike"],
    "Gojek": ["Go-Jek", "Go Ride", "GoCar"], "Bolt": ["Bolt Food", "Bolt Drive"], "Uber": ["Uber Eats", "Uber Taxi"],
}
FEEDS = {
    "latam": [("EL PAIS America", "https://feeds.elpais.com/mrss-s/pages/ep/site/elpais.com/section/america/portada", "es"), ("Mexico News Daily", "https://mexiconewsdaily.com/feed/", "en"), ("Buenos Aires Times", "https://www.batimes.com.ar/feed", "en"), ("MercoPress", "https://en.mercopress.com/rss", "en")],
    "africa": [("AllAfrica Kenya", "https://allafrica.com/tools/headlines/rdf/kenya/headlines.rdf", "en"), ("AllAfrica Nigeria", "https://allafrica.com/tools/headlines/rdf/nigeria/headlines.rdf", "en"), ("AllAfrica South Africa", "https://allafrica.com/tools/headlines/rdf/southafrica/headlines.rdf", "en")],
    "mea": [("AGBI", "https://www.agbi.com/feed/", "en"), ("Doha News", "https://dohanews.co/feed/", "en")],
    "sea": [("CNA Asia", "https://www.channelnewsasia.com/api/v1/rss-outbound-feed?_format=xml&category=6511", "en")],
    "cis_central_asia": [("Civil Georgia", "https://civil.ge/feed/", "en"), ("Astana Times", "https://astanatimes.com/feed/", "en"), ("The Times of Central Asia", "https://timesca.com/feed/", "en")],
}
TEMPLATES = ['"{competitor}" {topic_keywords} {geo_terms}', '"{competitor}" {topic_name} {region_label} {language_hints}']
IGNORED_GEO = ["USA", "United States", "North America", "Europe", "UK"]
PROVIDERS = ["gdelt", "google_news_rss", "regional_rss", "guardian"]
DIGEST_LIMIT = 12
TOPIC_ALIASES = {"market_entry": "market_expansion", "pricing": "pricing_promo", "industry_context": "core_industry_terms", "product_launch": "product_features_innovation"}
REGION_LABELS = {"latam": "LATAM", "sea": "SEA", "africa": "Africa & MEA", "mea": "Africa & MEA", "cis_central_asia": "CIS / Central Asia"}
#: Visual monitoring (logos, banners, social scraping) stays out of scope.
VISUAL_ASSETS_IN_SCOPE = False
#: Rows taken from each provider's queries per run, and sizes that the sources are asked for.
QUERY_CAPS = {"gdelt": 10, "guardian": 40, "newsapi": 25}
PAGE_SIZES = {"google_news_rss": 75, "gdelt": 75, "regional_rss": 75, "newsapi": 50, "guardian": 20}


def distinct(values) -> list[str]:
    """Trimmed, without empties, first occurrence kept."""
    return list(dict.fromkeys(v for v in (str(x).strip() for x in values or ()) if v))


@dataclass(frozen=True)
class Region:
    label: str
    geo_terms: tuple[str, ...]
    validation_terms: tuple[str, ...]
    language_hints: tuple[str, ...]


@dataclass(frozen=True)
class SignalConfig:
    regions: dict[str, Region]
    brands: dict[str, tuple[str, ...]]
    topics: dict[str, tuple[str, ...]]
    priority_topics: tuple[str, ...] = ()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    feeds: dict[str, tuple[tuple[str, str, str | None], ...]] = field(default_factory=dict)
    templates: tuple[str, ...] = ()
    ignored_geo: tuple[str, ...] = ()
    digest_limit: int = DIGEST_LIMIT
    providers: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict) -> SignalConfig:
        for key in ("regions", "competitors_by_region", "topic_groups"):
            if not isinstance(raw.get(key), dict) or not raw[key]:
                raise ValueError(f"config needs a mapping {key}")
        regions = {}
        for name, r in raw["regions"].items():
            geo, hints = distinct(r.get("geo_terms")), distinct(r.get("language_hints"))
            if not r.get("label") or not geo or not hints:
                raise ValueError(f"region {name} needs label, geo_terms and language_hints")
            regions[name] = Region(r["label"], tuple(geo), tuple(distinct(r.get("country_validation_terms")) or geo), tuple(hints))
        unknown = set(raw["competitors_by_region"]) - set(regions)
        if unknown:
            raise ValueError(f"brands for unknown regions: {sorted(unknown)}")
        topics = {k: tuple(distinct(v)) for k, v in raw["topic_groups"].items()}
        if unknown := set(raw.get("topic_priority_groups") or ()) - set(topics):
            raise ValueError(f"unknown priority topics: {sorted(unknown)}")
        limit = raw.get("daily_digest_limit", DIGEST_LIMIT)
        if not isinstance(limit, int) or limit < 1:
            raise ValueError("daily_digest_limit must be a positive whole number")
        feeds = {k: tuple((f["name"], f["url"], f.get("language")) if isinstance(f, dict) else tuple(f) for f in v) for k, v in (raw.get("regional_rss_feeds") or {}).items()}
        return cls(
            regions, {k: tuple(distinct(v)) for k, v in raw["competitors_by_region"].items()}, topics, tuple(raw.get("topic_priority_groups") or ()),
            {k: tuple(distinct(v)) for k, v in (raw.get("competitor_aliases") or {}).items()}, feeds, tuple(raw.get("keyword_templates") or ()),
            tuple(distinct(raw.get("ignored_geo_terms"))), limit, tuple(raw.get("enabled_providers") or ()),
        )

    @classmethod
    def load(cls, path: str) -> SignalConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def selected(self, regions=None) -> tuple[str, ...]:
        chosen = tuple(regions or self.regions)
        if unknown := set(chosen) - set(self.regions):
            raise ValueError(f"unknown regions: {sorted(unknown)}")
        return chosen

    def brands_of(self, regions) -> tuple[str, ...]:
        found = dict.fromkeys(b for r in regions for b in self.brands.get(r, ()))
        return tuple(found) or tuple(dict.fromkeys(b for bs in self.brands.values() for b in bs))

    def allowed(self, brand: str) -> tuple[str, ...]:
        return tuple(r for r, bs in self.brands.items() if brand in bs)

    def target_terms(self, regions) -> tuple[str, ...]:
        """Label, geo terms and validation terms of the regions."""
        rs = [self.regions[r] for r in regions if r in self.regions]
        return tuple(dict.fromkeys(t for r in rs for t in (r.label, *r.geo_terms, *r.validation_terms)))

    def topic_order(self, topics=None) -> tuple[str, ...]:
        """Priority topics first, then the rest in order."""
        chosen = tuple(topics or self.topics)
        return tuple(dict.fromkeys([*(t for t in self.priority_topics if t in chosen), *chosen]))

    def dims(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The configuration as small tables with explicit order."""
        def frame(rows, schema):
            return spark.createDataFrame(rows, schema)

        return {
            "region": frame([(k, n, r.label, list(r.language_hints)) for n, (k, r) in enumerate(self.regions.items())], "region string, ord int, label string, language_hints array<string>"),
            "region_term": frame([(k, kind, t, n) for k, r in self.regions.items() for kind, ts in (("geo", r.geo_terms), ("validation", r.validation_terms)) for n, t in enumerate(ts)], "region string, kind string, term string, ord int"),
            "competitor_region": frame([(k, list(self.regions).index(k), b, n) for k, bs in self.brands.items() for n, b in enumerate(bs)], "region string, region_ord int, competitor string, ord int"),
            "topic_keyword": frame([(t, n, self.topic_order().index(t), w, m) for n, (t, ws) in enumerate(self.topics.items()) for m, w in enumerate(ws)], "topic string, topic_ord int, priority_ord int, keyword string, ord int"),
            "alias": frame([(b, a, n) for b, xs in self.aliases.items() for n, a in enumerate(xs)], "competitor string, alias string, ord int"),
            "feed": frame([(k, name, url, lang, n) for k, fs in self.feeds.items() for n, (name, url, lang) in enumerate(fs)], "region string, name string, url string, language string, ord int"),
        }

    def queries(self, spark: SparkSession, regions=None, topics=None) -> DataFrame:
        """Search texts for every region, brand, topic and template, the first of equal texts kept.

        Columns: query, owner_region, owner_competitor, owner_topic, seq.
        """
        dims = self.dims(spark)
        chosen, order = self.selected(regions), self.topic_order(topics)
        brand = dims["competitor_region"].where(F.col("region").isin(*chosen))
        region = dims["region"].alias("r").join(dims["region_term"].where("kind = 'geo'").groupBy("region").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("terms")), "region")
        topic = dims["topic_keyword"].where(F.col("topic").isin(*order)).groupBy("topic", "priority_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "keyword"))).alias("words"))
        template = spark.createDataFrame([(n, t) for n, t in enumerate(self.templates)], "template_ord int, template string")
        rows = brand.join(region.select("region", "label", "language_hints", "terms"), "region").crossJoin(topic).crossJoin(template)
        def joined(c, f):
            return F.array_join(F.transform(c, lambda x: x[f]), " OR ")
        query = F.col("template")
        for key, value in (("competitor", F.col("competitor")), ("topic_keywords", joined("words", "keyword")), ("geo_terms", joined("terms", "term")),
                           ("topic_name", F.replace(F.col("topic"), F.lit("_"), F.lit(" "))), ("region_label", F.col("label")), ("language_hints", F.array_join("language_hints", " OR "))):
            query = F.replace(query, F.lit("{" + key + "}"), value)
        place = F.struct("region_ord", "ord", "priority_ord", "template_ord")
        first = rows.withColumn("query", F.trim(F.regexp_replace(query, r"\s+", " "))).groupBy("query").agg(F.min_by(F.struct("region", "competitor", "topic"), place).alias("own"), F.min(place).alias("place"))
        return first.select("query", F.col("own.region").alias("owner_region"), F.col("own.competitor").alias("owner_competitor"), F.col("own.topic").alias("owner_topic"),
                            F.row_number().over(W.orderBy("place")).alias("seq"))


def provider_query(provider: str, brand: str, region: Region, keywords) -> str:
    """Search text of a provider for a brand, a region and a topic's keywords."""
    def quote(t):
        return f'"{t}"' if " " in t or "/" in t else t

    if provider == "gdelt":
        parts = [brand, *(quote(t) for t in (*keywords[:1], (region.geo_terms or (region.label,))[0]))]
    else:
        n = 4 if provider == "google_news_rss" else 3
        parts = [f'"{brand}"', *map(quote, keywords[:n]), *map(quote, (region.label, *region.geo_terms)[:n])]
    return " ".join(p for p in parts if p)


def provider_queries(spark: SparkSession, config: SignalConfig, regions=None, providers=None, every_brand: bool = False) -> DataFrame:
    """(provider, query, owner_region, owner_competitor, owner_topic, seq) in topic priority order.

    Each region gets its own brands; ``every_brand`` pairs all brands with all regions."""
    chosen = config.selected(regions)
    rows = []
    for p in providers or config.providers:
        for topic in config.topic_order():
            for r in chosen:
                for b in (config.brands_of(chosen) if every_brand else config.brands.get(r, ())):
                    rows.append((p, provider_query(p, b, config.regions[r], config.topics[topic]), r, b, topic, len(rows)))
    frame = spark.createDataFrame(rows, "provider string, query string, owner_region string, owner_competitor string, owner_topic string, seq long")
    first = frame.groupBy("provider", "query").agg(F.min("seq").alias("seq"))
    return frame.join(first, ["provider", "query", "seq"])


def default_config() -> SignalConfig:
    return SignalConfig.from_dict({
        "regions": REGIONS, "competitors_by_region": BRANDS, "topic_groups": TOPICS, "topic_priority_groups": PRIORITY_TOPICS, "competitor_aliases": ALIASES,
        "regional_rss_feeds": {k: [{"name": n, "url": u, "language": l} for n, u, l in v] for k, v in FEEDS.items()}, "keyword_templates": TEMPLATES,
        "ignored_geo_terms": IGNORED_GEO, "daily_digest_limit": DIGEST_LIMIT, "enabled_providers": PROVIDERS,
    })


@dataclass(frozen=True)
class Runtime:
    """Settings of a run; environment variables override the defaults."""

    use_llm: bool = False
    llm_top_n: int = 15
    delivery_limit: int = 15
    body_chars: int = 8000
    min_score: int = 4
    half_life_days: float = 30.0
    freshness_days: int = 7
    history_limit: int = 200
    deferred_days: int = 2
    deferred_limit: int = 100
    channel: str = "daily_digest"
    destination: str = "local"

    @classmethod
    def from_env(cls, prefix: str = "NEWSLOOM_", env=None) -> Runtime:
        env = os.environ if env is None else env
        found = {}
        for name, default in ((f, getattr(cls, f)) for f in cls.__dataclass_fields__):
            if (raw := env.get(prefix + name.upper())) not in (None, ""):
                found[name] = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(raw)
        return cls(**found)
