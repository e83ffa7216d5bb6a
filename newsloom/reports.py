"""Exports of mentions: JSON, audit, CSV, Markdown report and summary (survey K16), of any number of mentions.

The report is numbered and written by ranges of its order: no task and no row ever holds all of it. Its parts are then
joined, a buffer at a time, by the file system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import legacy

# Columns of the CSV export, and lines of an entry of the report with the columns they show.
COLUMNS = (
    "number", "published_at", "source", "title", "url", "provider", "query", "relevance_score", "sentiment", "main_topic", "summary",
    "article_essence_ru", "mention_context_ru", "pm_insight", "pm_importance_ru", "category_ru",
)
ENTRY = (
    ("Source", ("source",)), ("Published", ("published_at",)), ("Relevance", ("relevance_score",)), ("Topic", ("main_topic",)), ("Category", ("category_ru",)), ("Sentiment", ("sentiment",)),
    ("Article essence", ("article_essence_ru", "summary")), ("Mention context", ("mention_context_ru",)), ("Why it matters for PM", ("pm_importance_ru", "pm_insight")), ("URL", ("url",)),
)


def _shown(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """The first of the columns that is there and not empty."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns if c in rows.columns], F.lit(""))


def entries(mentions: DataFrame) -> DataFrame:
    """(number, value): the mentions in order of relevance, each as a piece of Markdown."""
    rows = legacy.numbered(mentions, [F.col("relevance_score").desc(), F.col("published_at").desc_nulls_last(), F.col("seq").asc()])
    lines = [F.concat(F.lit(f"\n- {name}: "), _shown(rows, c), F.lit("/10" if name == "Relevance" else "")) for name, c in ENTRY]
    head = F.concat(F.lit("### "), F.col("number").cast("string"), F.lit(". "), F.coalesce(F.nullif(X.clean("title"), F.lit("")), F.lit("Untitled")), F.lit("\n"))
    return rows.select("number", F.concat(head, *lines, F.lit("\n")).alias("value"))


def _head(name: str, generated_at: str, n: int, min_score: int, stats: list) -> str:
    lines = [f"# {name}", "", f"Generated: {generated_at}", f"Relevant mentions: {n}", f"Minimum relevance score: {min_score}", "", "## Pipeline health", ""]
    for s in stats:
        told = f"- {s['provider']}: attempts={s['attempts']}, successes={s['successes']}, failures={s['failures']}, articles={s['articles']}"
        lines.append(told + (f", last_error={s['last_error']}" if s["last_error"] else ""))
    lines += [""] * bool(stats) + ["## Product manager view", ""]
    return "\n".join(lines if n else [*lines, "No relevant mentions found for the selected window.", ""]) + "\n" * bool(n)


def _joined(spark, parts: str, target: str, head: str) -> None:
    """``head`` and the part files in order, as one file that appears when it is whole."""
    jvm = spark.sparkContext._jvm
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
    folder, out, tmp = at(parts), at(target), at(f"{target}.part")
    fs = folder.getFileSystem(conf)
    stream = fs.create(tmp, True)
    try:
        stream.write(bytearray(head.encode()))
        for path in sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
            source = fs.open(at(path))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 16, False)
            finally:
                source.close()
    finally:
        stream.close()
    fs.delete(out, False)
    fs.rename(tmp, out)
    fs.delete(folder, True)


def write_report(mentions: DataFrame, path: str, generated_at: str, min_score: int = 0, stats: DataFrame | None = None, name: str = "Media mentions report") -> None:
    """The Markdown report of mentions (seq, title, url, relevance_score and what else an entry shows) as one file; ``stats``: a row a provider."""
    made = entries(mentions)
    made.sort("number").select("value").write.mode("overwrite").text(f"{path}.parts")
    n = mentions.count()
    told = [r.asDict() for r in stats.orderBy("provider").collect()] if stats is not None else []  # a row a provider
    _joined(mentions.sparkSession, f"{path}.parts", path, _head(name, generated_at, n, min_score, told))


def export(mentions: DataFrame, folder: str, generated_at: str, min_score: int = 0, audit: DataFrame | None = None, stats: DataFrame | None = None) -> None:
    """mentions.json, mentions_audit.json (what was looked at, else the mentions), mentions.csv, report.md and run_summary.json."""
    mentions.write.mode("overwrite").json(f"{folder}/mentions.json")
    (mentions if audit is None else audit).write.mode("overwrite").json(f"{folder}/mentions_audit.json")
    rows = legacy.numbered(mentions, [F.col("relevance_score").desc(), F.col("published_at").desc_nulls_last(), F.col("seq").asc()])
    table = rows.select(*[_shown(rows, (c,)).alias(c) for c in COLUMNS], F.col("number").alias("_o")).sort("_o").drop("_o")
    table.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{folder}/mentions.csv")
    write_report(mentions, f"{folder}/report.md", generated_at, min_score, stats)
    summary = mentions.agg(F.count("*").alias("relevant_mentions"), F.lit(generated_at).alias("generated_at"), F.lit(min_score).alias("min_score"))
    summary.write.mode("overwrite").json(f"{folder}/run_summary.json")
