"""Run states kept by a stream: each run moves along allowed transitions, and one that gets stuck ends in an error.

State is one small row for each run, in Spark's state store; ended runs keep theirs, as they take no more news. What one
batch has of a run is sorted in one task, so the number of files of a batch bounds it. A timer in event time ends a run that says nothing for too long, once the
watermark has passed its limit. What is written is each accepted transition, once: a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "run_id long, from_status string, to_status string, at timestamp, accepted boolean, step int"
COLUMNS = ["run_id", "from_status", "to_status", "at", "accepted", "step"]
STATE = "status string, at_us long, step int"


def run_states(allowed: list[tuple[str, str]], terminal: list[str], limit_s: int, error: str = "error") -> StatefulProcessor:
    """``allowed``: the transitions; ``terminal``: the statuses that end a run; ``limit_s``: seconds without news after which a run ends in ``error``.

    The class is made here so that it travels to the workers by value; they need no copy of this library.
    """
    moves, ends, columns, state = set(allowed), set(terminal), COLUMNS, STATE

    class RunStates(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("run", state)

        def _timer(self, at_us: int) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(at_us // 1000 + limit_s * 1000)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            found = pd.concat(list(rows)).sort_values(["at", "event_id"])
            status, at_us, step = self.state.get() if self.state.exists() else (None, None, 0)
            out = []
            for at, to in zip(found["at"], found["status"], strict=True):
                ok = status not in ends and (status is None or (status, to) in moves)
                step += ok
                out.append((key[0], status, to, at, ok, step))
                if ok:
                    status, at_us = to, at.value // 1000
            if status is not None:
                self.state.update((status, at_us, step))
                if status in ends:
                    for t in list(self.handle.listTimers()):
                        self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
                else:
                    self._timer(at_us)
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.state.exists():
                status, at_us, step = self.state.get()
                if status not in ends:
                    at = pd.Timestamp((at_us + limit_s * 1_000_000) * 1000)
                    self.state.update((error, at_us, step + 1))
                    yield pd.DataFrame([(key[0], status, error, at, True, step + 1)], columns=columns)

        def close(self) -> None:
            pass

    return RunStates()


def run_transitions(events: DataFrame, allowed: list[tuple[str, str]], terminal: list[str], limit_s: int, delay: str = "1 hour") -> DataFrame:
    """Transitions of ``events`` (event_id, run_id, status, at), a stream: run_id, from_status, to_status, at, accepted, step (how many were accepted so far).

    A run's first status is always accepted. A status that isn't allowed after the run's is written with accepted = false and changes nothing, and so
    does anything after a terminal status. Events later than ``delay`` behind the newest are dropped by the watermark.
    """
    marked = events.where("run_id is not null and status is not null and at is not null").withWatermark("at", delay)
    return marked.groupBy("run_id").transformWithStateInPandas(statefulProcessor=run_states(allowed, terminal, limit_s), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def start_runs(events: DataFrame, path: str, checkpoint: str, allowed: list[tuple[str, str]], terminal: list[str], limit_s: int, delay: str = "1 hour") -> StreamingQuery:
    """Write transitions as Parquet to ``path``, whose log of batches makes each one appear once, and stop when all files are read."""
    spark = events.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # a query keeps the settings with which it starts
    try:
        out = run_transitions(events, allowed, terminal, limit_s, delay)
        return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id, status, at, steps: the last accepted status of each run, and how many there were."""
    rows = spark.read.schema(OUT).parquet(path).where("accepted")
    return rows.groupBy("run_id").agg(F.max_by(F.struct(F.col("to_status").alias("status"), "at"), "step").alias("r"), F.max("step").alias("steps")).select("run_id", "r.*", "steps")
