from pyspark.sql import functions as F

from gradewalk.streaming.hills import hill_sessions


def test_sessions_stream_as_they_batch(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", g, 1.0) for s, g in ((0, 0.1), (10, 0.08), (15, 0.01), (50, 0.07))] + [("b", "2024-01-01 00:30:00", 0.1, 2.0)]
    df = spark.createDataFrame(rows, "walker string, t string, grade double, climb_m double").select("walker", F.to_timestamp("t").alias("ts"), "grade", "climb_m")
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r["walker"], r["start"], r["n"]) for r in hill_sessions(df).collect()}
    stream = hill_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hills").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    streamed = {(r["walker"], r["start"], r["n"]) for r in spark.table("hills").collect()}
    assert len(batch) == 3 and streamed == {x for x in batch if x[0] == "a"}
