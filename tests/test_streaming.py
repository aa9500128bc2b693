"""A stream of lines gives each statement once."""

from graphloom.streaming import ingest


def test_statements_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("<A> <p> <B> .", "2024-01-01 00:00:00"), ("<A> <p> <B> .", "2024-01-01 00:01:00"), ('<A> <q> "x" .', "2024-01-01 00:02:00"), ("# note", "2024-01-01 00:02:00"), ("bad", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "value string, t string").selectExpr("value", "cast(t as timestamp) as ts").write.parquet(str(source))
    lines = spark.readStream.schema("value string, ts timestamp").parquet(str(source))
    q = ingest.statements(lines).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.s, r.p, r.o) for r in spark.table("found").collect()) == [("<A>", "<p>", "<B>"), ("<A>", "<q>", '"x"')]
    q = ingest.degrees(ingest.statements(lines)).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
