from __future__ import annotations

import __spark_entry__ as e

from cosmolake.streaming import track


def test_every_query_has_a_name_and_every_sql_a_query():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_flagship(spark):
    assert e.entry(spark).columns == ["snap", "haloid", "progid", "common", "rank"]
    assert e.entry(spark).count() >= 0


def test_stream_of_transitions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"key":1,"id":1,"time":"2024-01-01T00:00:00","state":"a"}\n{"key":1,"id":2,"time":"2024-01-01T00:01:00","state":"b"}\n{"key":2,"id":3,"time":"2024-01-01T00:01:00","state":"a"}\n')
    stream = spark.readStream.schema("key long, id long, time timestamp, state string").json(str(tmp_path / "in"))
    q = track.transitions(stream).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("moves").collect()] == [(1, 2, "a", "b")]


def test_stream_of_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = track.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("update").start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("counts").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in track.windowed_counts(events, "ts", "event_type").collect()}
