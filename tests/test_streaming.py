from pyspark.sql import functions as F

from skylattice.streaming import arrivals


def test_arrivals(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        arrivals.on_arrival(stream, lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == source.count()
    assert "watermark" in arrivals.event_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")))._jdf.queryExecution().logical().toString().lower()
