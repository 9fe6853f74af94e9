import datetime

from pyspark.sql import functions as F

from tessera.operators import feedback
from tessera.streaming import stateful

T0 = datetime.datetime(2024, 1, 1)


def drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_signals_in_batch_and_stream(spark, tmp_path):
    asks = [(0, "api token guide"), (30, "api token guide"), (200, "api token guide rest"), (215, "birds over water"), (900, "cats"), (905, "cats"), (961, "")]
    rows = [(k, 1, q, T0 + datetime.timedelta(seconds=s)) for k, (s, q) in enumerate(asks)] + [(100 + k, 2, f"filler{k} word{k}", T0 + datetime.timedelta(seconds=k)) for k in range(25)]
    log = spark.createDataFrame(rows, "query_id long, session long, question string, ts timestamp")
    batch = {(r.by_query_id, r.query_id, r.score, r.signal_type) for r in feedback.signals(log).collect()}
    assert {(1, 0, 0.3, "repeat_query"), (2, 1, 0.5, "refinement"), (3, 2, 0.8, "topic_switch"), (5, 4, 0.3, "repeat_query")} <= batch
    log.select(F.col("session").cast("string"), "query_id", "question", "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, query_id long, question string, ts timestamp").parquet(str(tmp_path / "in"))
    drain(stateful.signals(stream), "signals")
    assert {(r.by_query_id, r.query_id, r.score, r.signal_type) for r in spark.table("signals").collect()} == batch


def test_refused_calls_do_not_count(spark, tmp_path):
    calls = [("k", i, T0 + datetime.timedelta(seconds=i * 10)) for i in range(10)]
    spark.createDataFrame(calls, "key string, call_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, call_id long, ts timestamp").parquet(str(tmp_path / "in"))
    drain(stateful.rate_limiter(stream, most=2, seconds=45), "calls")
    assert [r.allowed for r in spark.table("calls").orderBy("call_id").collect()] == [True, True, False, False, False, True, True, False, False, False]


def test_batches_reach_the_callback(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    q = stateful.maintain(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, n: seen.append((n, df.count())), str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(c for _, c in seen) == 5


def test_a_stream_keeps_the_index(spark, tmp_path):
    from tessera.engine import Engine

    e = Engine(spark, str(tmp_path / "store"))
    schema = "slug string, title string, body string"
    source, check = tmp_path / "in", str(tmp_path / "check")

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = stateful.keep(e, spark.readStream.schema(schema).parquet(str(source)), check).start()
        q.processAllAvailable()
        q.stop()

    send([("cats", "Cats", "Cats purr."), ("dogs", "Dogs", "Dogs bark.")])
    assert {r.slug for r in e.search("purrs").collect()} == {"cats"}
    send([("cats", None, "Cats climb."), ("dogs", None, None), ("birds", "Birds", "Birds sing.")])
    assert {r.slug for r in e.table("documents").collect()} == {"cats", "birds"}
    assert e.search("purrs").count() == 0 and {r.slug for r in e.search("climbs").collect()} == {"cats"}
    before = e.tables.now.number
    stateful.keep(e, spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "other")).trigger(availableNow=True).start().awaitTermination()
    assert e.tables.now.number == before  # batch 0 has been applied
