"""The streaming forms against the batch operators, and BPMN exchange."""

import random

from pyspark.sql import functions as F

from tracewright.model import EventLog
from tracewright.operators import conform, miners, relations
from tracewright.sources import bpmn
from tracewright.streaming import logs


def stream_of(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "case_id string, activity string, t int, event_id int, resource string").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,t)"))
    for k in range(3):  # three files, in order of time
        df.where((F.col("t") >= 20 * k) & (F.col("t") < 20 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    return df, stream


def finished(stream, name, spark, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def rows_of(seed):
    rng = random.Random(seed)
    return [(f"c{rng.randint(0, 4)}", rng.choice("abc"), t, t, rng.choice("xy")) for t in range(60)]


def test_streaming_directly_follows(spark, tmp_path):
    """Events late by less than the watermark find their place; a last event far ahead lets all others out."""
    rows = rows_of(1)
    df, stream = stream_of(spark, tmp_path, rows + [("end", "z", 5000, 5000, "x")])
    late = [(c, a, t - 15, 1000 + t, r) for c, a, t, _, r in rows if t >= 40]
    more = spark.createDataFrame(late, "case_id string, activity string, t int, event_id int, resource string").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,t)"))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.where("t = 5000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = df.where("t < 5000").union(more)
    got = finished(logs.directly_follows(stream), "pairs", spark, tmp_path).groupBy("source", "target").count()
    want = relations.directly_follows(EventLog(df))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streaming_calendar_and_sessions(spark, tmp_path):
    df, stream = stream_of(spark, tmp_path, rows_of(2))
    got = finished(logs.calendar(stream, "10 minutes", "0 seconds"), "buckets", spark, tmp_path)
    want = df.groupBy(F.window("ts", "10 minutes").start.alias("b"), "activity").count()
    assert set(map(tuple, got.collect())) <= set(map(tuple, want.collect())) and got.count() > 0
    runs = finished(logs.sessions(stream, "5 minutes", "0 seconds"), "runs", spark, tmp_path)
    assert runs.count() > 0 and runs.where("size < 1").count() == 0


def test_bpmn_round_trip():
    tree = ("seq", ("act", "a"), ("xor", ("act", "b"), ("tau",)), ("and", ("act", "c"), ("loop", ("act", "d"), ("act", "e"))))
    model = bpmn.from_tree(tree)
    again = bpmn.from_xml(bpmn.to_xml(model))
    assert (again.nodes, again.flows) == (model.nodes, model.flows)
    one, two = conform.Player(bpmn.to_net(again)), conform.Player(miners.tree_to_net(tree))
    for trace in ("acd", "abdc", "adedc", "ab", "acde", "dca"):
        assert one.align(tuple(trace))[0] == two.align(tuple(trace))[0]
