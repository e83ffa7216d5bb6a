"""Cases where a query once did less than its whole job."""

from pyspark.sql import functions as F


def test_state_queries_read_all_orders(spark):
    from newsloom.plans import registry, surrogate

    d = "/root/testdata/sf0.01"
    orders = spark.read.parquet(f"{d}/orders.parquet")
    assert surrogate.stored_alerts(spark, d).count() == orders.count() > 2801
    assert registry.QUERIES["already_sent_anti"](spark, d).agg(F.max("seq")).head()[0] > 2800
    assert registry.QUERIES["recent_history_topk"](spark, d).count() == 200


def test_summary_is_that_of_the_full_run(spark):
    from newsloom.plans import pipeline, registry, surrogate

    d = "/root/testdata/sf0.001"
    whole = pipeline.run(surrogate.articles(spark, d), surrogate.CONFIG, surrogate.AS_OF)["summary"].withColumn("drop_reasons", F.to_json("drop_reasons"))
    assert [r.asDict() for r in registry.pipeline_summary(spark, d).collect()] == [r.asDict() for r in whole.collect()]
