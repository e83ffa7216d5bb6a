"""Mentions of one company: keyword heuristic, relevance filter, ordering and numbering (survey F32 to F37, P34, W8, O6, O7, A11).

The company's name and its spellings are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators.similar import checkpointed

# Fixed values.
SERVICE = ("taxi", "ride-hailing", "ride hailing", "rideshare", "ride-share", "driver", "passenger", "fare", "delivery", "courier", "freight", "city to city", "такси", "водитель", "пассажир", "доставка", "курьер", "груз")
COMPETITORS = ("uber", "bolt", "grab", "gojek", "didi", "yandex go", "careem")
REGULATION = ("regulation", "law", "ban", "license", "permit", "strike", "protest", "commission", "fuel", "safety", "pricing", "fare cap", "регулирование", "закон", "лицензия", "забастовка", "комиссия", "топливо", "безопасность", "тариф")
NOISE = ("stock market", "crypto", "celebrity", "football", "recipe")
CATEGORIES = (
    ("Безопасность", "regulation", ("safety", "безопасность")),
    ("Регулирование", "regulation", ("regulation", "law", "ban", "license", "permit", "strike", "protest")),
    ("Тарифы", "regulation", ("commission", "fuel", "pricing", "fare cap")),
    ("Тарифы", "service", ("fare",)),
    ("Доставка", "service", ("delivery", "courier", "freight")),
    ("Водители", "service", ("driver",)),
    ("Пассажиры", "service", ("passenger",)),
)
CONTEXTS = {
    "Регулирование": "упоминается в контексте локальных правил, разрешений, лицензий или правового статуса сервиса.",
    "Безопасность": "упоминается в контексте безопасности пользователей, водителей или поездок.",
    "Тарифы": "упоминается в контексте тарифов, комиссий, стоимости топлива или экономики поездки.",
    "Доставка": "упоминается в контексте доставки, курьерских или грузовых сервисов.",
    "Водители": "упоминается в контексте опыта, доходов, условий или поведения водителей.",
    "Пассажиры": "упоминается в контексте опыта пассажиров, доступности поездок или доверия к сервису.",
    "Конкуренты": "упоминается в контексте конкурентной среды ride-hailing или доставки.",
}


def matched(content: Column, terms) -> Column:
    """Sorted distinct terms that stand alone in a folded text (F32)."""
    hits = [F.when(F.contains(content, F.lit(t)) & content.rlike(rf"(^|[^a-z0-9]){X.quoted(t)}([^a-z0-9]|$)"), F.lit(t)) for t in sorted(set(terms))]
    return F.array_compact(F.array(*hits))


def heuristic(rows: DataFrame, company: tuple[str, ...]) -> DataFrame:
    """Relevance 0 to 10, topic, category, texts and matched terms of mentions (F33); rows have title, snippet, url."""
    content = F.trim(F.regexp_replace(X.fold(X.blob("title", "snippet", "url")), r"\s+", " "))
    name = company[0]
    rows = rows.withColumn("_c", content).withColumns({f"_{k}": matched(F.col("_c"), ts) for k, ts in (("company", company), ("service", SERVICE), ("competitors", COMPETITORS), ("regulation", REGULATION), ("noise", NOISE))})

    def has(k):
        return F.size(f"_{k}") > 0

    score = F.when(has("company"), 7).otherwise(0) + F.when(has("service"), 2).otherwise(0) + F.when(has("competitors"), 1).otherwise(0) + F.when(has("regulation"), 1).otherwise(0) - F.when(has("noise") & ~has("company"), 2).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(10), score))
    topic = (
        F.when(has("company") & has("service"), f"Прямое упоминание сервиса {name}").when(has("company"), f"Прямое упоминание {name}").when(has("regulation"), "Регулирование такси или доставки")
        .when(has("competitors"), "Активность конкурентов").when(has("service"), "Рынок мобильности или доставки").otherwise("Низкая релевантность")
    )
    category = F.when(F.lit(False), "")
    for label, kind, terms in CATEGORIES:
        category = category.when(F.arrays_overlap(f"_{kind}", F.array(*map(F.lit, terms))), label)
    category = category.when(has("competitors"), "Конкуренты").otherwise("Общее")
    source = F.coalesce(F.nullif(X.clean("title"), F.lit("")), X.clean("snippet"))
    essence = F.when(source == "", f"В доступном тексте есть упоминание {name}, но суть статьи не определена.").otherwise(F.concat(F.lit("Статья сообщает: "), F.substring(source, 1, 240), F.lit(".")))
    out = rows.withColumns({"relevance_score": score, "main_topic": topic, "category_ru": category, "article_essence_ru": essence})
    context = F.concat(F.lit(f"{name} упоминается как компания или сервис в медиа. Доступный сигнал: "), "article_essence_ru")
    for k, v in CONTEXTS.items():
        context = F.when(F.col("category_ru") == k, f"{name} {v}").otherwise(context)
    terms = F.create_map(*[x for k in ("company", "service", "competitors", "regulation", "noise") for x in (F.lit(k), F.col(f"_{k}"))])
    out = out.withColumns({"mention_context_ru": context, "is_business_critical": F.col("relevance_score") >= 7, "sentiment": F.lit("neutral"), "mentions_company": has("company"), "matched_terms": terms})
    return out.drop("_c", "_company", "_service", "_competitors", "_regulation", "_noise")


def normalized_result(rows: DataFrame) -> DataFrame:
    """Scores clamped and empty texts replaced."""
    return rows.withColumns({
        "relevance_score": F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(F.col("relevance_score").cast("int"), F.lit(0)))),
        "article_essence_ru": F.coalesce(F.nullif(X.clean("article_essence_ru"), F.lit("")), F.lit("Суть статьи не определена.")),
        "category_ru": F.coalesce(F.nullif(X.clean("category_ru"), F.lit("")), F.lit("Общее")),
    })


def relevant(rows: DataFrame, min_score: int) -> DataFrame:
    return rows.where(F.col("relevance_score") >= min_score)


def ordered(rows: DataFrame) -> DataFrame:
    """Best score first, then the later date as text."""
    return rows.orderBy(F.col("relevance_score").desc(), F.col("published_at").desc_nulls_last(), "seq")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds number, 1 to n in an order: rows are dealt by ranges of the order and numbered within them, after all rows of the ranges before."""
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(before, "_range").withColumn("number", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def renumbered(rows: DataFrame, descending: bool = False) -> DataFrame:
    """Numbers by date and title."""
    keys = [F.coalesce("published_at", F.lit("")), F.lower("title"), F.col("seq")]
    return numbered(rows, [k.desc() if descending else k.asc() for k in keys])


def domain(url) -> Column:
    """Authority as written, without ``www.``."""
    return F.replace(F.regexp_extract(X.text(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def company_context(spark, path: str, default: str = "A company that offers rides and deliveries.") -> str:
    """What a context file says about the company, else a sentence that stands for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return default
    return (spark.read.text(path, wholetext=True).head()[0] or "").strip() or default
