"""The machines of ``operators.buffers`` over streams: one state for each session, timers where a session falls idle, and what is left at the end.

Event times drive everything: within a micro-batch a session's events are taken in
order; a stream whose events come in order says what the table of them says.
Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import buffers as B


class Buffers(StatefulProcessor):
    """A session's machine as its state; with ``idle`` a timer empties the buffer once the watermark is so far past its last event."""

    def __init__(self, make, columns: list[str], idle: bool = False):
        self.make, self.columns, self.idle = make, columns, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "state string")

    def machine(self) -> B.Machine:
        made = self.make()
        return made.load(self.state.get()[0]) if self.state.exists() else made

    def kept(self, key, machine: B.Machine, out: list[tuple]) -> Iterator[pd.DataFrame]:
        self.state.update((machine.dump(),))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = self.machine()
        out = list(B.fed(machine, pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if machine.n:
                self.handle.registerTimer(int((machine.end + machine.idle) * 1000) + 1)
        yield from self.kept(key, machine, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self.machine()
        yield from self.kept(key, machine, machine.rest("idle"))

    def close(self) -> None:
        pass


def machines(events: DataFrame, make, schema: str, delay: str, idle: bool = False) -> DataFrame:
    processor = Buffers(make, [c.split()[0] for c in schema.split(", ")], idle)
    timed = events.withWatermark("ts", delay).filter("session_id is not null")
    return timed.groupBy("session_id").transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="EventTime" if idle else "None")


def checkpoints(events: DataFrame, delay: str = "10 minutes", **settings) -> DataFrame:
    """See operators.buffers.checkpoints."""
    return machines(B.as_checkpoints(events), lambda: B.Checkpoints(**settings), B.BUFFER, delay)


def analyses(events: DataFrame, delay: str = "10 minutes", **settings) -> DataFrame:
    """See operators.buffers.analyses."""
    return machines(B.as_analyses(events), lambda: B.Analyses(**settings), B.BUFFER, delay, idle=True)


def rolling(events: DataFrame, delay: str = "10 minutes", **settings) -> DataFrame:
    """See operators.buffers.rolling."""
    return machines(events, lambda: B.Seen(**settings), "session_id long, event_id long", delay)


def left(spark: SparkSession, checkpoint: str, make) -> DataFrame:
    """What sessions still held when a stream ended: read from the state in its checkpoint folder, without running it on."""
    columns = [c.split()[0] for c in B.BUFFER.split(", ")]

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, *row) for key, state in zip(batch["session_id"].tolist(), batch["state"].tolist(), strict=True) for row in make().load(state).rest()]
            if out:
                yield pd.DataFrame(out, columns=columns)

    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "machine").load()
    return held.selectExpr("key.session_id AS session_id", "value.state AS state").mapInPandas(rest, B.BUFFER)
