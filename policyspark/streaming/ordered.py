"""State by device in the order of event time, with timers: Spark's ``transformWithState``.

A row waits in the state until the watermark has passed its time, so that rows which come late within the watermark's lateness, in
whatever micro-batches, are stepped through in the order of (at_ms, seq) as a table would be.  What comes later than the watermark
is dropped by Spark before it gets here.  A timer is set to the next thing that is due: a waiting row, a change of outcome that
only time brings (``Gate.due``), or the end of the state.  The state holds a device's rows of the lateness, and what its gate
remembers; it is removed when nothing waits, no change is due and either the gate has returned to where it began or
``idle_ms`` have passed since the last row.

State lives in RocksDB, which ``transformWithState`` asks for; ``configured`` sets that for a session.
"""

from __future__ import annotations

import json
import pickle
from collections import namedtuple
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Event time is at_ms so much later: Spark's first watermark is the epoch, and a clock that begins at 0 must not be late from the start.
SHIFT_MS = 24 * 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _frozen(x):
    return tuple(_frozen(v) for v in x) if isinstance(x, list) else x


class Ordered(StatefulProcessor):
    """Rows (device, at_ms, seq, the gate's columns) to rows (device, at_ms, seq, outcome); seq is null where time brought the outcome."""

    def __init__(self, gate, rows: T.StructType, idle_ms: int):
        self.gate, self.schema, self.idle_ms = gate, rows, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # rows wait in packs of up to 1,000: each value of a state costs a call
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "state string, last long, outcome string")
        self.row = namedtuple("row", self.schema.names)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, held, own, at = None, [], None, self.schema.names.index("at_ms")
        for r in rows:
            own = own or itemgetter(*map(r.__fields__.index, self.schema.names))
            held.append(own(r))
            first = held[-1][at] if first is None else min(first, held[-1][at])
            if len(held) == 1000:  # a batch's rows aren't held together
                self.waiting.appendValue((pickle.dumps(held),))
                held = []
        if held:
            self.waiting.appendValue((pickle.dumps(held),))
        self._wake(first)
        return iter([])

    def _wake(self, at: int | None) -> None:
        """Keeps one timer, the earliest."""
        known = list(self.handle.listTimers())
        if at is not None and (not known or at + SHIFT_MS < min(known)):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(at + SHIFT_MS, 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark, gate = timerValues.getCurrentWatermarkInMs() - SHIFT_MS, self.gate
        rows = sorted((self.row(*r) for pack in self.waiting.get() for r in pickle.loads(pack[0])), key=lambda r: (r.at_ms, r.seq is None, r.seq))
        ready = [r for r in rows if r.at_ms <= mark]
        kept = self.kept.get()
        state, last, outcome = (_frozen(json.loads(kept[0])), kept[1], kept[2]) if kept else (None, None, None)
        out = []

        def passes(until: int) -> None:
            """Changes that are due before ``until``."""
            nonlocal last, outcome
            while gate.due and state is not None and (at := gate.due(state, last)) is not None and at < until:
                last, found = at, gate.phase(state, at)
                if found != outcome:
                    outcome = found
                    out.append(Row(device=key[0], at_ms=at, seq=None, outcome=found))

        for r in ready:
            passes(r.at_ms)
            if last is not None and r.at_ms - last > self.idle_ms:
                state = None
            outcome, state = gate.step(state, r)
            last = r.at_ms
            out.append(Row(device=key[0], at_ms=r.at_ms, seq=r.seq, outcome=outcome))
        later = rows[len(ready) :]
        passes(mark + 1 if not later else min(mark + 1, later[0].at_ms))
        due = gate.due(state, last) if gate.due and state is not None else None
        over = last is None or due is None and (gate.due is not None and not later or mark - last > self.idle_ms)
        if later:
            if ready:
                self.waiting.put([(pickle.dumps([tuple(r) for r in later[i : i + 1000]]),) for i in range(0, len(later), 1000)])
        else:
            self.waiting.clear()
        if over:
            self.kept.clear()
        else:
            self.kept.update((json.dumps(state), last, outcome))
        ends = [] if over else [last + self.idle_ms + 1] if due is None else [due]
        wake = min([*ends, *(r.at_ms for r in later[:1])], default=None)
        # the timer that has expired is the only one, and Spark removes it
        if wake is not None:
            self.handle.registerTimer(max(wake, mark + 1) + SHIFT_MS)
        return iter(out)


def ordered(df: DataFrame, gate, lateness: str, idle_ms: int) -> DataFrame:
    """device, at_ms, seq, outcome of a stream (device, seq, at_ms, the gate's columns), in append mode; rows without a time take no part."""
    configured(df.sparkSession)
    rows = df.select(F.col("device").cast("string").alias("device"), F.col("at_ms").cast("long").alias("at_ms"), F.col("seq").cast("long").alias("seq"), *gate.columns, F.timestamp_millis(F.col("at_ms").cast("long") + SHIFT_MS).alias("__time"))
    waiting = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in ("device", "__time")])
    timed = rows.where("at_ms is not null").withWatermark("__time", lateness)
    return timed.groupBy("device").transformWithState(Ordered(gate, waiting, idle_ms), "device string, at_ms long, seq long, outcome string", "Append", "EventTime")
