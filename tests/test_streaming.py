"""Time buckets over a stream against the same buckets of the table."""

from pyspark.sql import functions as F

from tessera.streaming.buckets import bucketed

SF = "/root/testdata/sf0.001"


def test_buckets_of_a_stream(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("key"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = bucketed(stream, "at", "1 day", ["key"], "3650 days", n=F.count("*"))
    query = found.writeStream.format("memory").queryName("buckets").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    ours = sorted(map(tuple, spark.table("buckets").collect()), key=repr)
    theirs = table.groupBy(F.date_trunc("day", "at").alias("bucket"), "key").agg(F.count("*").alias("n"))
    assert ours and ours == sorted(map(tuple, theirs.collect()), key=repr)
