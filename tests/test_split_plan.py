"""How rows are split by label."""

from pyspark.sql import functions as F

from loomtext.operators import training


def test_texts_are_not_shuffled_by_label(spark):
    """A label's rows don't come to one task, even where no table is small enough to be broadcast unasked."""
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).cast("string").alias("label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fit, held = training.stratified_split(rows, "label", "doc_id")
        plan = held._jdf.queryExecution().executedPlan().toString()
        counts = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}
        assert fit.count() + held.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert counts == {None: 40, "0": 80, "1": 80}
