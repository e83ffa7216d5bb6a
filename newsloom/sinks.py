"""Outputs: JSON, CSV, Markdown, state appends, deliveries and mirrors (survey K1 to K18, A15, S27, D2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.config import REGION_LABELS
from newsloom.functions import render
from newsloom.operators import state

# Columns of the review, each with the column of the candidate, or of its alert, that fills it.
REVIEW = {c: c for c in ("competitor", "topic_group", "score")} | {"is_expired": "alert.is_expired"} | {c: c for c in ("region", "country_hint", "language_hint")} | {
    "final_competitor": "alert.competitor", "final_region": "alert.region", "final_country": "alert.country", "published_date": "alert.resolved_date", "published_date_source": "alert.resolved_date_source",
    "resolved_publication_date": "alert.resolved_date", "resolved_publication_date_source": "alert.resolved_date_source",
    "competitor_source": "alert.competitor_source", "region_source": "alert.region_source", "country_source": "alert.country_source", "geo_validation_fallback": "alert.geo_validation_fallback",
    "news_gatekeeper_accept": "alert.gate_accepted", "news_gatekeeper_canonical_topic": "alert.canonical_topic", "news_gatekeeper_relevance_reason": "alert.relevance_reason",
    "news_gatekeeper_priority_hint": "alert.priority_hint", "news_gatekeeper_rejection_reason": "alert.rejection_reason",
    "product_take": "alert.product_take", "product_risk": "alert.product_risk", "product_follow_up": "alert.product_follow_up",
    "product_strategist_invoked": "alert.product_strategist_invoked", "product_strategist_trigger": "alert.product_strategist_trigger",
} | {c: c for c in ("title", "source", "published_at", "url", "matched_keywords", "reasons", "summary")}


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("map", "struct"))})


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Candidates, drops, digests and run summaries (K1 to K4)."""
    df.write.mode(mode).json(path)


def digest_json(alerts: DataFrame, path: str) -> None:
    label = F.col("region")
    for k, v in REGION_LABELS.items():
        label = F.when(F.col("region") == k, v).otherwise(label)
    write_json(alerts.withColumn("region_label", label), path)


def review(candidates: DataFrame, alerts: DataFrame) -> DataFrame:
    """Candidates with what became of them as alerts, as text, joined by story key - never by position (K6); lists as ``a | b``, nulls empty."""
    keyed = candidates if "digest_key" in candidates.columns else candidates.withColumn("digest_key", F.concat_ws("::", F.lower("competitor"), "topic_group", "url"))
    one = alerts.groupBy("digest_key").agg(F.min_by(F.struct("*"), F.struct("region", "rank")).alias("alert"))
    rows = keyed.select("digest_key", F.struct(*[F.col(f"`{c}`") for c in candidates.columns]).alias("candidate")).join(one, "digest_key", "left")
    kinds = {f"alert.{c}": t for c, t in alerts.dtypes} | dict(candidates.dtypes)

    def told(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        value = F.col(c if "." in c else f"candidate.{c}")
        flat = F.concat_ws(" | ", value) if kinds[c].startswith("array") else value.cast("string")
        return F.coalesce(flat, F.lit("false" if c == "alert.is_expired" else ""))

    return rows.select(*[told(c).alias(name) for name, c in REVIEW.items()])


def review_csv(candidates: DataFrame, alerts: DataFrame, path: str) -> None:
    review(candidates, alerts).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_markdown(alerts: DataFrame, path: str, generated_at: str) -> None:
    docs = render.markdown_digest(alerts, generated_at)
    docs.select(F.col("document").alias("value"), "region").write.mode("overwrite").partitionBy("region").text(path)


class TableStore:
    """Append-only Parquet tables in one folder (D2): the storage seam; any object with these methods can replace it."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str, schema: str | StructType) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def put(self, name: str, rows: DataFrame, run: str) -> None:
        """Writes a run's rows in the run's own place: a second time replaces the first. Tables written so have a column ``run``."""
        rows.drop("run").write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")

    def prune(self, name: str, before: str) -> None:
        """Deletes the rows of runs whose names sort before ``before``: for tables whose runs are named by time."""
        at, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path, self.spark.sparkContext._jsc.hadoopConfiguration()
        if self.exists(name):
            fs = at(f"{self.root}/{name}").getFileSystem(conf)
            for s in fs.listStatus(at(f"{self.root}/{name}")):
                if "run=" <= s.getPath().getName() < f"run={before}":
                    fs.delete(s.getPath(), True)

    def insert_new(self, name: str, rows: DataFrame, run: str, *keys: str, order: str = "seq") -> None:
        """Stores rows whose key no other run has; the first writer wins."""
        rows = rows.drop("run")
        other = self.read(name, rows.select(*keys, F.lit("").alias("run")).schema).where(F.col("run") != run)
        self.put(name, state.new_rows(rows, other, *keys, order=order), run)


def feed_metric_defaults(rows: DataFrame) -> DataFrame:
    """Nulls to zero, empty text and ``keep``."""
    numbers = [c for c, t in rows.dtypes if t in ("int", "bigint", "double")]
    words = [c for c, t in rows.dtypes if t == "string" and c != "recommendation"]
    return rows.fillna(0, numbers).fillna("", words).fillna("keep", ["recommendation"] if "recommendation" in rows.columns else [])


def mirror_actions(alerts: DataFrame, pages: DataFrame, dry_run: bool = False) -> DataFrame:
    """Create or update per alert, by key, against the mirror's pages (K14, S27); pages has digest_key, page_id."""
    prefix = "would_" if dry_run else ""
    found = alerts.join(pages.select("digest_key", "page_id"), "digest_key", "left")
    return found.withColumn("action", F.when(F.col("page_id").isNull(), prefix + "create").otherwise(prefix + "update")).select("digest_key", "page_id", "action", render.mirror_properties().alias("properties"))


def missing_columns(df: DataFrame, required: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in required.items() if k not in df.columns}
