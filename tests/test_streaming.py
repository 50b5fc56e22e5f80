"""A stream gives what a batch gives."""

from tracewright.sources.ledger import event_ledger
from tracewright.streaming import scoring


def test_stream_agrees_with_batch(spark, tmp_path):
    tx = event_ledger(spark, "/root/testdata/sf0.001").select("hash", "timestamp", "from_addr", "value_eth")
    tx.unionByName(tx.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 5).parquet(str(tmp_path / "in"))
    for name, df in (("uniq", scoring.unique(stream)), ("rapid", scoring.rapid(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("uniq").count() == tx.count()
    assert spark.table("rapid").select("hash").distinct().count() == tx.count() and spark.table("rapid").where("is_rapid").count() > 0
