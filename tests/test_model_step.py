"""A model in the run: asked once per story, answers kept, failures marked; and a callback that ranks."""

import json

from pyspark.sql import functions as F

from newsloom.operators import enrich
from newsloom.plans import pipeline, run_state, surrogate
from newsloom.sinks import TableStore

SF = "/root/testdata/sf0.001"


def test_second_run_asks_nothing(spark, tmp_path):
    store, asked = TableStore(spark, f"{tmp_path}/state"), spark.sparkContext.accumulator(0)

    def client():
        def ask(row):
            asked.add(1)
            if row["rank"] == 2:
                raise ValueError("busy")
            return json.dumps({"event": "said " + row["title"][:20], "what_happened": "  x   y "})

        return ask

    def go(**kw):
        return pipeline.run(surrogate.articles(spark, SF), surrogate.CONFIG, surrogate.AS_OF, client=client, known=run_state.known_answers(store), ask=3, **kw)

    out = go()
    rows = {(r.region, r["rank"]): r for r in out["digest"].collect()}
    for (_, rank), r in rows.items():
        assert r.event.startswith("said") == (rank in (1, 3)) and (r.what_happened == "x y") == (rank in (1, 3))
        assert r.is_editorial_fallback == (rank == 2) == (r.llm_error is not None and "busy" in r.llm_error)
    first = asked.value
    assert first == sum(rank <= 3 for _, rank in rows) > 2
    run_state.remember(store, out, None, "daily_digest", "box", surrogate.AS_OF)
    again = {(r.region, r["rank"]): (r.event, r.what_happened) for r in go()["digest"].collect()}
    assert again == {k: (r.event, r.what_happened) for k, r in rows.items()}
    assert asked.value - first == sum(rank == 2 for _, rank in rows)  # only what had no answer


def test_ranking_callback(spark):
    run = lambda **kw: pipeline.run(surrogate.articles(spark, SF), surrogate.CONFIG, surrogate.AS_OF, **kw)["digest"].orderBy("region", "rank").collect()
    plain = run()
    turned = run(ranking=lambda rows: rows.withColumn("priority", F.when(F.col("seq") == plain[-1].seq, "HIGH").otherwise("LOW")))
    assert next(r for r in turned if r.region == plain[-1].region).seq == plain[-1].seq


def test_answers_share_a_story(spark):
    rows = spark.createDataFrame([("t", "A", "x", "u", "s", True, "e"), ("t", "A", "x", "u", "s", True, "e"), ("t2", "A", "x", "u", "s", False, "e"), ("bad", "A", "x", "u", "s", True, "e")],
                                 "title string, competitor string, topic_group string, url string, snippet string, use_llm boolean, event string")
    client = lambda: (lambda row: "[]" if row["title"] == "bad" else '{"event": "new"}')
    assert enrich.answers(rows, client).count() == 2
    got = sorted((r.title, r.event, r.is_editorial_fallback) for r in enrich.model_texts(rows, client).collect())
    assert got == [("bad", "e", True), ("t", "new", False), ("t", "new", False), ("t2", "e", False)]
