from pyspark.sql import functions as F

from arborlens.streaming.changes import clean_stream, result_counts

REPORTS = "report_id bigint, ruleset string, result string, maybe boolean, reported_at timestamp"


def test_result_counts_take_redelivered_reports_once(spark, tmp_path):
    rows = [(1, "f", "x", False, "2025-01-01 10:05:00"), (1, "f", "x", False, "2025-01-01 10:05:00"), (2, "f", "x", False, "2025-01-01 10:40:00"), (3, "f", "y", True, "2025-01-01 10:10:00"), (4, "f", None, False, "2025-01-01 10:10:00"), (5, "f", "x", False, "2025-01-09 00:00:00")]
    table = spark.createDataFrame(rows, REPORTS.replace("timestamp", "string")).withColumn("reported_at", F.to_timestamp("reported_at"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REPORTS).parquet(str(tmp_path / "in"))
    q = result_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["ruleset"], r["result"], r["start"].hour): r["n"] for r in spark.table("counts").collect() if r["start"].day == 1}
    assert got == {("f", "x", 10): 2}


def test_cleaning_a_table_of_changes(spark):
    df = spark.createDataFrame([("r", "a.md", b"x <!-- no --> me@host.org"), ("r", "b.bin", b"\0"), ("r", "c.md", None)], "repo string, path string, content binary")
    assert [tuple(r) for r in clean_stream(df).collect()] == [("r", "a.md", "x  redacted@example.org")]
