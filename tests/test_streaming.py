from loomtext.operators.review import last_actions
from loomtext.plans import inputs
from loomtext.streaming.review_stream import last_actions_stream


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    log = inputs.action_log(spark, sf_dir)
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = last_actions_stream(stream).writeStream.outputMode("complete").format("memory").queryName("folded").start()
    query.processAllAvailable()
    query.stop()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(spark.table("folded")) == rows(last_actions(log, "item_id"))
