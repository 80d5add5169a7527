"""Runs with keyed state and tables kept by streams: disorder, repeats, restarts and replays."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexspark.streaming import events as E
from lexspark.streaming import lifecycle as L

SCHEMA = "seq long, run_id long, event string, data string, artifact_id string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    L.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def made(seed, n):
    rng = random.Random(seed)
    kinds = ["values"] * 6 + ["ping"] * 3 + ["end", "error"]
    return [(i, rng.randrange(12), rng.choice(kinds), f"d{i}", rng.choice([None, "a", "b", "c"])) for i in range(n)]


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)


def drained(query):
    query.awaitTermination(180)
    assert query.exception() is None


def last(spark, path):
    return {r.run_id: (r.state, r.n_events, tuple(r.artifacts)) for r in spark.read.schema(L.RUN).json(path).groupBy("run_id").agg(F.max_by(F.struct("state", "n_events", "artifacts"), "version").alias("x")).select("run_id", "x.*").collect()}


def run(spark, source, out, checkpoint, **options):
    drained(L.run_updates(stream(spark, source), **options).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").json(f"{out}/b={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def test_stream_of_runs_equals_the_batch(spark, tmp_path):
    rows = made(1, 240)
    shuffled = rows + rows[40:90]  # out of order, and some events twice
    random.Random(2).shuffle(shuffled)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i in range(0, 180, 60):
        put(spark, shuffled[i : i + 60], source)
    run(spark, source, out, checkpoint)
    for i in range(180, len(shuffled), 60):  # a new query goes on from the checkpoint
        put(spark, shuffled[i : i + 60], source)
    run(spark, source, out, checkpoint)
    batch = {r.run_id: (r.state, r.n_events, tuple(r.artifacts)) for r in E.run_lifecycle(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert last(spark, out) == batch


def test_silent_runs_time_out_and_come_back(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, [(1, 1, "values", "", None), (2, 2, "end", "", "a")], source)
    query = L.run_updates(stream(spark, source), quiet_ms=1000).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").json(f"{out}/b={n}")).option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()

    def until(test):
        for _ in range(120):
            try:
                if test(last(spark, out)):
                    return True
            except Exception:  # noqa: BLE001  no folder yet, or one that is being written
                pass
            time.sleep(0.5)
        return False

    try:
        assert until(lambda x: x == {1: ("timed_out", 1, ()), 2: ("completed", 1, ("a",))})
        put(spark, [(3, 1, "end", "", None)], source)
        assert until(lambda x: x[1] == ("completed", 2, ()))
    finally:
        query.stop()


def test_upserted_tables_equal_the_batch_and_replays_change_nothing(spark, tmp_path):
    rows = made(3, 300)
    random.Random(4).shuffle(rows)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "table", "check"))
    for i in range(0, 300, 50):
        put(spark, rows[i : i + 50], source)
    drained(L.upsert(stream(spark, source), path, checkpoint, L.state_part, L.state_merge, every=4))
    got = lambda: {r.run_id: (r["last"].seq, r["last"].data) for r in L.current(spark, path, L.state_merge).collect()}
    want = {r.run_id: (r.seq, r.data) for r in E.latest_state(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got() == want
    assert len(L._parts(spark, path)) == 3  # a base of four batches and two more

    # batches 1 and 5 are played again, as after a crash between a write and the checkpoint's note of it
    files = sorted((tmp_path / "in").glob("*.json"), key=lambda p: p.stat().st_mtime)
    other = str(tmp_path / "check2")
    drained(L.upsert(stream(spark, source), path, other, L.state_part, L.state_merge, every=4))
    assert len(files) == 6 and got() == want


def test_telemetry_table(spark, tmp_path):
    rows = spark.createDataFrame(made(5, 200), SCHEMA)
    kind = F.when(F.col("event") == "error", "retry").when(F.col("event") == "ping", "poll")
    calls = lambda df: df.select(F.col("run_id").alias("call_id"), kind.alias("kind"), (F.col("seq") % 97 == 0).alias("exhausted"), F.col("event").alias("state"), "seq", F.col("seq").alias("t"))
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "table", "check"))
    for part in rows.randomSplit([1.0, 1.0, 1.0], 7):
        part.coalesce(1).write.mode("append").json(source)
    drained(L.upsert(calls(stream(spark, source)), path, checkpoint, L.telemetry_part, L.telemetry_merge, every=2))
    assert sorted(map(tuple, L.telemetry(L.current(spark, path, L.telemetry_merge)).collect())) == sorted(map(tuple, E.call_telemetry(calls(rows)).collect()))
