"""Runs as a stream with state of their own, and tables that a stream updates batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lexspark.sources.shared import numbered_folders, remove

RUN = "run_id long, state string, n_events long, artifacts array<string>, version long"
FAILED, ENDED = ("error", "errors"), "end"


class RunProcessor(StatefulProcessor):
    """The life of one run: how many different events it had, whether one of them failed or ended it, and its artifacts.

    An event is known by its ``seq``; one that comes again changes nothing, and since only counts, flags and a set are kept, the
    order of arrival does not matter.  A batch asks the state a few times a run, not once an event.  ``quiet_ms`` after a run's last event (processing time) a run that neither failed nor ended is ``timed_out``; its
    state stays, so a late event takes it up again.  What is remembered of a run goes ``keep_ms`` after its last change; 0 keeps it.
    """

    def __init__(self, quiet_ms: int = 0, keep_ms: int = 0) -> None:
        self._quiet, self._keep = quiet_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self._keep or None
        self._handle = handle
        self._run = handle.getValueState("run", "n_events long, failed boolean, ended boolean, version long, top long", ttl)
        self._artifacts = handle.getListState("artifacts", "artifact_id string", ttl)
        self._seen = handle.getListState("seen", "seq long", ttl)

    def _row(self, key: tuple, silent: bool = False) -> Row:
        n, failed, ended, version, _ = self._run.get()
        state = "failed" if failed else "completed" if ended else "timed_out" if silent else "running"
        return Row(run_id=key[0], state=state, n_events=n, artifacts=sorted(r[0] for r in self._artifacts.get()), version=version)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, failed, ended, version, top = self._run.get() if self._run.exists() else (0, False, False, 0, None)
        held = {r[0] for r in self._artifacts.get()} if self._artifacts.exists() else set()
        seen, new, most = None, set(), top
        for r in rows:
            if r.seq in new:
                continue
            if top is not None and r.seq <= top:  # what lies beyond all that was seen is new; only an older one has them looked up
                seen = {x[0] for x in self._seen.get()} if seen is None else seen
                if r.seq in seen:
                    continue
            new.add(r.seq)
            most, n = r.seq if most is None else max(most, r.seq), n + 1
            failed, ended = failed or r.event in FAILED, ended or r.event == ENDED
            if r.artifact_id is not None and r.artifact_id not in held:
                held.add(r.artifact_id)
                self._artifacts.appendValue((r.artifact_id,))
        if not new:
            return
        self._seen.appendList([(x,) for x in new])
        self._run.update((n, failed, ended, version + 1, most))
        if self._quiet:
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
            if not failed and not ended:
                self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._quiet)
        yield self._row(key)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._run.exists():
            n, failed, ended, version, top = self._run.get()
            self._run.update((n, failed, ended, version + 1, top))
            yield self._row(key, silent=True)

    def close(self) -> None:
        pass


def run_updates(events: DataFrame, quiet_ms: int = 0, keep_ms: int = 0) -> DataFrame:
    """(run_id, state, n_events, artifacts, version): a row a run that changed, for each batch of a stream of (seq, run_id, event, artifact_id).

    The row of a run with the largest version says what a batch query says of all its different events.  Needs the RocksDB state store
    (:func:`use_rocksdb`); state is kept by run, so it is dealt over the tasks as the runs are.  Artifacts are those that an event names; null is none.
    """
    rows = events.select("run_id", "seq", "event", "artifact_id").where("run_id is not null and seq is not null").groupBy("run_id")
    mode = "ProcessingTime" if quiet_ms or keep_ms else "None"
    return rows.transformWithState(RunProcessor(quiet_ms, keep_ms), RUN, "Update", mode)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def upsert(rows: DataFrame, path: str, checkpoint: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], every: int = 16) -> StreamingQuery:
    """Start a query that keeps a table at ``path`` up to date with the stream ``rows``; :func:`current` reads it.

    ``partial`` makes a batch's rows a part of the table (at most a row a key), ``merge`` joins such parts (unioned) to one; it must be associative and
    not mind the parts' order.  Batch n writes its part to the folder ``batch=n`` and nothing else, so a batch that is played again after a crash
    overwrites what it wrote and changes nothing.  A batch costs what it brings, whatever the table holds.  After ``every`` batches the parts are
    merged into one base, which is written whole before what it replaces is removed.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n <= _base(spark, path):
            return  # played again after a merge that has it
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if (n + 1) % every == 0:
            merge_parts(spark, path, merge, n)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _base(spark: SparkSession, path: str) -> int:
    return max(numbered_folders(spark, path, "base"), default=-1)


def _parts(spark: SparkSession, path: str) -> list[str]:
    base = _base(spark, path)
    return ([f"{path}/base={base}"] if base >= 0 else []) + [f"{path}/batch={n}" for n in numbered_folders(spark, path, "batch") if n > base]


def current(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table that the batches so far make."""
    return merge(spark.read.parquet(*_parts(spark, path)))


def merge_parts(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """Replace all parts up to batch ``upto`` by one base; what is interrupted leaves the parts as they were."""
    current(spark, path, merge).write.mode("overwrite").parquet(f"{path}/base={upto}")
    for kind in ("base", "batch"):
        for n in numbered_folders(spark, path, kind):
            if n < upto or (kind == "batch" and n == upto):
                remove(spark, f"{path}/{kind}={n}")


def state_part(rows: DataFrame) -> DataFrame:
    """Part of the last snapshots of runs, from (run_id, event, data, seq)."""
    return rows.where("event = 'values'").groupBy("run_id").agg(F.max(F.struct("seq", "data")).alias("last"))


def state_merge(parts: DataFrame) -> DataFrame:
    return parts.groupBy("run_id").agg(F.max("last").alias("last"))


def telemetry_part(rows: DataFrame) -> DataFrame:
    """Part of the calls' telemetry, from (call_id, kind, exhausted, state, seq, t)."""
    return rows.groupBy("call_id").agg(
        F.count_if(F.col("kind") == "retry").alias("retries"), F.bool_or("exhausted").alias("exhausted"), F.count_if(F.col("kind") == "poll").alias("polls"),
        F.max(F.struct("seq", "state")).alias("last"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )


def telemetry_merge(parts: DataFrame) -> DataFrame:
    return parts.groupBy("call_id").agg(F.sum("retries").alias("retries"), F.bool_or("exhausted").alias("exhausted"), F.sum("polls").alias("polls"), F.max("last").alias("last"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))


def telemetry(table: DataFrame) -> DataFrame:
    """The columns of ``events.call_telemetry``."""
    return table.select("call_id", "retries", "exhausted", "polls", F.col("last.state").alias("last_state"), (F.col("last_t") - F.col("first_t")).alias("elapsed"))
