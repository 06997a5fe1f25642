import datetime as dt

from bondflow.streaming import species


def test_counts_close_windows_and_drop_late_rows(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "time timestamp, name string"
    for i, rows in enumerate([[(at(0), "A"), (at(0), "A"), (at(1), "B")], [(at(30), "A")], [(at(0), "A"), (at(50), "C")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = species.counts(stream).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120), i
    got = sorted((r["start"].minute, r["name"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "A", 2), (1, "B", 1), (30, "A", 1)]
