"""Buffers of sessions that empty themselves: what a window frame can't say, as each trigger begins a new buffer.

A machine takes a session's events in order and keeps a small state; the same machines
run over tables (here) and over streams (streaming.buffers).  Over tables a session's events
are sorted on disk and flow past its machine, so memory holds one state, however long
the session; a session is one task's, as its buffers depend on each other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .sessions import CORRECTED, DECIDED, PATTERNED, seconds

# What tells that a task is complete.
COMPLETE = (r"(?i)(?:tests?\s+(?:are\s+)?(?:passing|passed|pass))", r"(?i)(?:done|finished|complete|ready)", r"(?i)(?:successfully\s+(?:built|compiled|deployed))", r"(?i)(?:all\s+(?:tests?|checks?)\s+passed)")
TEST_TOOLS = r"(?i)test|spec"

BUFFER = "session_id long, buffer int, first_id long, event_id long, n int, trigger string"


class Machine:
    """State of one session; ``feed`` takes an event's columns and returns what it emits."""

    #: What an event is told by, after session_id.
    takes: tuple[str, ...]

    def __init__(self, **settings):
        self.settings = settings
        for name, value in settings.items():
            setattr(self, name, value)
        self.number = 0
        self.clear()

    def clear(self) -> None:
        raise NotImplementedError

    def feed(self, *event) -> list[tuple]:
        raise NotImplementedError

    def rest(self, trigger: str = "end") -> list[tuple]:
        """What a session that ends leaves."""
        return [self.emit(trigger)] if self.n else []

    def emit(self, trigger: str) -> tuple:
        self.number += 1
        out = (self.number, self.first, self.last, self.n, trigger)
        self.clear()
        return out

    def dump(self) -> str:
        return json.dumps({k: v for k, v in vars(self).items() if k != "settings" and k not in self.settings})

    def load(self, state: str) -> Machine:
        vars(self).update(json.loads(state))
        return self


class Checkpoints(Machine):
    """A buffer that ends on a burst of tool outputs, a word of completion among its last five events, or a change of files.

    It ends with ``least`` events at the soonest; files change when none of those of the
    last five events is among the earlier ones (from ten events on).  State: times of
    tool outputs within the burst's seconds, the last five events, earlier files.
    """

    takes = ("event_id", "at", "tool", "done", "path")
    burst, within, least, recent, shifts = 10, 120, 5, 5, 10

    def clear(self) -> None:
        self.n, self.first, self.last, self.tools, self.late, self.early = 0, None, None, [], [], []

    def feed(self, event_id, at, tool, done, path) -> list[tuple]:
        self.n, self.first, self.last = self.n + 1, self.first if self.n else event_id, event_id
        self.tools = [t for t in (*self.tools, *([at] if tool else ())) if t >= at - self.within]
        self.late.append([bool(done), path])
        if len(self.late) > self.recent:
            gone = self.late.pop(0)[1]
            if gone is not None and gone not in self.early:
                self.early.append(gone)
        paths = {p for _, p in self.late if p is not None}
        why = None
        if len(self.tools) >= self.burst:
            why = "tool_burst"
        elif any(d for d, _ in self.late):
            why = "task_complete"
        elif self.n >= self.shifts and self.early and paths and not paths & set(self.early):
            why = "topic_shift"
        return [self.emit(why)] if why and self.n >= self.least else []


class Analyses(Machine):
    """A buffer that is analysed when it is full, or with enough events old or with a learning moment; and when the session was idle.

    Moments: a success after a failure, a decision, a correction, two patterns.
    """

    takes = ("event_id", "at", "exit_code", "decided", "corrected", "patterns")
    most, least, age, idle = 20, 5, 60, 1800

    def clear(self) -> None:
        self.n, self.first, self.last, self.start, self.end, self.failed, self.moment, self.patterns = 0, None, None, 0.0, 0.0, False, False, 0

    def feed(self, event_id, at, exit_code, decided, corrected, patterns) -> list[tuple]:
        out = self.rest("idle") if self.n and at - self.end >= self.idle else []
        if not self.n:
            self.first, self.start = event_id, at
        self.n, self.last, self.end = self.n + 1, event_id, at
        self.patterns |= patterns
        self.moment = bool(self.moment or decided or corrected or self.patterns.bit_count() >= 2 or (self.failed and exit_code == 0))
        self.failed = bool(self.failed or (exit_code is not None and exit_code != 0))
        why = "full" if self.n >= self.most else None
        if not why and self.n >= self.least:
            why = "old" if at - self.start >= self.age else "moment" if self.moment else None
        return [*out, self.emit(why)] if why else out


class Seen(Machine):
    """Keys that were not among the last ones: of more than ``most`` the ``keep`` that came last stay; a key that comes again keeps its place."""

    takes = ("event_id", "key")
    most, keep = 1000, 500

    def clear(self) -> None:
        self.keys, self.n = {}, 0

    def feed(self, event_id, key) -> list[tuple]:
        if key is None or key in self.keys:
            return []
        self.keys[key] = 1
        if len(self.keys) > self.most:
            self.keys = dict.fromkeys(list(self.keys)[-self.keep :], 1)
        return [(event_id,)]


def plain(value):
    """A column's value as Python has it; missing ones are None."""
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def fed(machine: Machine, rows: pd.DataFrame) -> Iterator[tuple]:
    for event in zip(*(rows[c].tolist() for c in machine.takes), strict=True):
        yield from machine.feed(*map(plain, event))


def run(events: DataFrame, make, schema: str, flush: bool = False) -> DataFrame:
    """What ``make()`` emits for each session of events (session_id, ts, event_id and what it takes), in their order; with ``flush`` what is left too."""
    takes = make().takes
    columns = [c.split()[0] for c in schema.split(", ")]
    ordered = events.filter("session_id is not null").repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, machine, out = None, None, []
        for batch in batches:
            for key, *event in zip(batch["session_id"].tolist(), *(batch[c].tolist() for c in takes), strict=True):
                if key != session:
                    if flush and machine:
                        out += [(session, *row) for row in machine.rest()]
                    session, machine = key, make()
                out += [(key, *row) for row in machine.feed(*map(plain, event))]
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if flush and machine and (left := machine.rest()):
            yield pd.DataFrame([(session, *row) for row in left], columns=columns)

    return ordered.select("session_id", *takes).mapInPandas(walk, schema)


def as_checkpoints(events: DataFrame) -> DataFrame:
    """Events (session_id, ts, event_id, event_type, content, tool_name, exit_code, path) as Checkpoints takes them."""
    tool = F.col("event_type") == "tool_output"
    passed = tool & F.coalesce(F.col("exit_code") == 0, F.lit(False)) & F.coalesce(F.col("tool_name").rlike(TEST_TOOLS), F.lit(False))
    said = F.coalesce(text.any_of([F.col("content").rlike(p) for p in COMPLETE]), F.lit(False))
    return events.select("session_id", "ts", "event_id", seconds(F.col("ts")).alias("at"), tool.alias("tool"), (said | passed).alias("done"), "path")


def as_analyses(events: DataFrame) -> DataFrame:
    """Events (session_id, ts, event_id, content, exit_code) as Analyses takes them."""
    low = F.lower("content")
    says = lambda phrase: F.coalesce(F.contains(low, F.lit(phrase)), F.lit(False))
    bits = F.lit(0)
    for i, phrase in enumerate(PATTERNED):
        bits = bits + F.when(says(phrase), 1 << i).otherwise(0)
    any_ = lambda phrases: text.any_of([says(p) for p in phrases])
    return events.select("session_id", "ts", "event_id", seconds(F.col("ts")).alias("at"), "exit_code", any_(DECIDED).alias("decided"), any_(CORRECTED).alias("corrected"), bits.alias("patterns"))


def checkpoints(events: DataFrame, flush: bool = False, **settings) -> DataFrame:
    """session_id, buffer, first_id, event_id, n, trigger of the buffers that end (Checkpoints); with ``flush`` the last, too."""
    return run(as_checkpoints(events), lambda: Checkpoints(**settings), BUFFER, flush)


def analyses(events: DataFrame, flush: bool = True, **settings) -> DataFrame:
    """session_id, buffer, first_id, event_id, n, trigger of the buffers to be analysed (Analyses)."""
    return run(as_analyses(events), lambda: Analyses(**settings), BUFFER, flush)


def rolling(events: DataFrame, **settings) -> DataFrame:
    """session_id, event_id of events (session_id, ts, event_id, key) whose key is not among the session's last ones (Seen)."""
    return run(events, lambda: Seen(**settings), "session_id long, event_id long")
