"""Streaming operators with state by device, windowed counts, sessions and policies.

Gates step through a device's rows in the order of event time (see ``ordered``): a stream gives what the table gives, however
its rows are dealt to micro-batches, as long as they come within the watermark's lateness.  The reference processes in arrival
order and has no watermarks; those here are ours.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.walks import walked
from ..sources.state_tables import Published
from .ordered import ordered

#: Rescan interval; frame interval and changed bits; refire gate, reset and repeats of the burst limiter.
RESCAN_MS = 300
FRAME_MS, FRAME_BITS = 1_000, 6
REFIRE_MS, RESET_MS, MOST_IN_A_ROW = 1_200, 5_000, 3
COALESCE_MS = 10_000
#: Rows of a policy table that are broadcast to a stream; more are joined by a merge.
BROADCAST_HOSTS = 500_000
COOLDOWN_MS, READY_MS, DISARM_MS = 15 * 60_000, 5 * 60_000, 10 * 60_000


@dataclass(frozen=True)
class Gate:
    """A gate's state and its step from (state or None, row) to (outcome, new state or the old one).

    ``cut``, where there is one, tells rows whose outcome and state are certain whatever the state before (see operators.walks).
    ``due(state, after)`` is the next time after ``after`` at which time alone may change the outcome, to ``phase(state, time)``; null
    where none is to come.
    """

    columns: tuple[str, ...]
    step: Callable
    cut: Callable | None = None
    due: Callable | None = None
    phase: Callable | None = None


def _screen(own_package: str):
    def step(s, r):
        if r.package == own_package:
            return "self_package", s
        if not r.text:
            return "no_text", s
        if s and s[0] == r.package:
            if s[1] == r.text:
                return "duplicate", s
            if r.at_ms - s[2] < RESCAN_MS:
                return "debounced", s
        return "scanned", (r.package, r.text, r.at_ms)

    return step


def _screen_cut(own_package: str):
    """What was scanned last is of the package of the last row that could be scanned: a change of package is certain to be."""

    def cut(package, r):
        if r.package == own_package or not r.text:
            return False, package
        return package is not None and r.package is not None and package != (r.package,), (r.package,)

    return cut


def _frame(s, r):
    if s:
        if r.at_ms - s[1] < FRAME_MS:
            return "too_soon", s
        if (r.hash ^ s[0]).bit_count() < FRAME_BITS if r.hash >= 0 and s[0] >= 0 else ((r.hash ^ s[0]) & (1 << 64) - 1).bit_count() < FRAME_BITS:
            return "unchanged", s
    return "analyse", (r.hash, r.at_ms)


def _repeat(s, r):
    if s and (s[0], s[1]) == (r.event, r.detail) and 0 <= r.at_ms - s[2] < COALESCE_MS:
        return "coalesced", s
    return "recorded", (r.event, r.detail, r.at_ms)


def _repeat_cut(before, r):
    """What was recorded last is like the row before, at most COALESCE_MS earlier."""
    return before is not None and (before[:2] != (r.event, r.detail) or abs(r.at_ms - before[2]) >= COALESCE_MS), (r.event, r.detail, r.at_ms)


def _burst_cut(before, r):
    """Since the row before, which is no earlier than what was fired last, the limiter has been reset."""
    return before is not None and r.at_ms - before >= RESET_MS, r.at_ms


def _burst(s, r):
    last, n = s or (None, 0)
    if last is not None:
        gap = r.at_ms - last
        if gap < REFIRE_MS:
            return "refire", s
        if gap >= RESET_MS:
            n = 0
    if n >= MOST_IN_A_ROW:
        return "limited", s
    return "fired", (r.at_ms, n + 1)


def _phase(s, at):
    """The phase at a time, after the last request and the last disarm (-1: none)."""
    since = lambda t: at - t if t >= 0 else -1
    asked, done = s
    if 0 <= since(done) < DISARM_MS:
        return "disarmed"
    if not 0 <= since(asked) < COOLDOWN_MS + READY_MS:
        return "armed"
    return "pending" if since(asked) < COOLDOWN_MS else "ready"


def _due(s, after):
    asked, done = s
    ends = [asked + COOLDOWN_MS, asked + COOLDOWN_MS + READY_MS] if asked >= 0 else []
    return min((t for t in [*ends, *([done + DISARM_MS] if done >= 0 else [])] if t > after), default=None)


def _cooldown(s, r):
    """State: when the last request and the last disarm came; the outcome is the phase after the row."""
    asked, done = s or (-1, -1)
    if r.event == "request":
        asked = r.at_ms
    elif r.event == "disarm":
        done = r.at_ms
    return _phase((asked, done), r.at_ms), (asked, done)


def screen_gate(own_package: str) -> Gate:
    """Change and debounce dedupe of screen text: device, seq, at_ms, package, text."""
    return Gate(("package", "text"), _screen(own_package), _screen_cut(own_package))


#: Near-duplicate dedupe of frames: device, seq, at_ms, hash.
FRAME_GATE = Gate(("hash",), _frame)
#: Coalescing log: device, seq, at_ms, event, detail.
REPEAT_GATE = Gate(("event", "detail"), _repeat, _repeat_cut)
#: Burst limiter: device, seq, at_ms.
BURST_GATE = Gate((), _burst, _burst_cut)
#: Cooldown of a release request: device, seq, at_ms, event (request, disarm or any other, a look at the clock).
COOLDOWN_GATE = Gate(("event",), _cooldown, due=_due, phase=_phase)

def gated_batch(df: DataFrame, gate: Gate, parts: int | None = None) -> DataFrame:
    """device, seq, outcome of a table; a device's rows are walked in as many stretches (of ``parts``) as they fill."""
    rows = df.select("device", "seq", "at_ms", *gate.columns)
    return walked(rows, "device", ["at_ms", "seq"], ["at_ms", *gate.columns], gate.step, cut=gate.cut, parts=parts).select(F.col("device").cast("string").alias("device"), "seq", "outcome")


#: A stream's state of a device is forgotten so long after its last row, on the clock of at_ms.
IDLE_MS = 7 * 24 * 3_600_000


def gated_stream(df: DataFrame, gate: Gate, lateness: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """device, seq, outcome of a stream (device, seq, at_ms, the gate's columns); at_ms is its event time.

    An outcome comes when the watermark, ``lateness`` behind the latest row, has passed the row.  A device that is silent for more
    than ``idle_ms`` begins anew.
    """
    return ordered(df, gate, lateness, idle_ms).where("seq is not null").select("device", "seq", "outcome")


def phase_stream(df: DataFrame, gate: Gate, lateness: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """device, at_ms, seq, phase of a stream: after each row, and (seq null) at the time at which no row but the clock changes it."""
    return ordered(df, gate, lateness, idle_ms).withColumnRenamed("outcome", "phase")


def phase_changes(df: DataFrame, gate: Gate, parts: int | None = None) -> DataFrame:
    """device, at_ms, seq, phase of a table, as :func:`phase_stream` has them of a stream that has ended."""

    def between(state, last, phase, until):
        found = []
        while (at := gate.due(state, last)) is not None and (until is None or at < until):
            last, now = at, gate.phase(state, at)
            if now != phase:
                phase = now
                found.append({"at_ms": at, "phase": now})
        return found

    def step(kept, r):
        state, last, phase = kept or (None, None, None)
        changes = between(state, last, phase, r.at_ms) if state is not None else []
        phase, state = gate.step(state, r)
        return json.dumps({"phase": phase, "before": changes, "after": between(state, r.at_ms, phase, None)}), (state, r.at_ms, phase)

    rows = walked(df.select("device", "seq", "at_ms", *gate.columns), "device", ["at_ms", "seq"], ["at_ms", *gate.columns], step, parts=parts)
    change = "array<struct<at_ms:bigint,phase:string>>"
    told = rows.select(F.col("device").cast("string").alias("device"), "at_ms", "seq", F.from_json("outcome", f"phase string, before {change}, after {change}").alias("o"))
    ends = told.groupBy("device").agg(F.max_by("o.after", F.struct("at_ms", "seq")).alias("changes"))
    timed = told.select("device", F.explode("o.before").alias("c")).unionAll(ends.select("device", F.explode("changes").alias("c")))
    return told.select("device", "at_ms", "seq", F.col("o.phase").alias("phase")).unionAll(timed.select("device", "c.at_ms", F.lit(None).cast("long"), "c.phase"))


def live_counts(events: DataFrame, lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """verdict counts of a stream (ts, verdict) by tumbling window."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "verdict").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "verdict", "n")


def idempotent(events: DataFrame, key: str, lateness: str) -> DataFrame:
    """A stream's rows, each client-generated id once; the original event time stays."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """user_id, start, stop, n of the sessions that an activity gap ends; batch or stream."""
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def host_stream(flows: DataFrame, host_actions: DataFrame) -> DataFrame:
    """A stream of lookups (host, ..) with the action of a static policy table (host, action); proxy where it has none."""
    few = host_actions.count() <= BROADCAST_HOSTS
    return flows.join(F.broadcast(host_actions) if few else host_actions.hint("merge"), "host", "left").withColumn("action", F.coalesce("action", F.lit("proxy")))


def policy_stream(flows: DataFrame, policy: Published, write: Callable[[DataFrame, int], None]):
    """A writer that decides each micro-batch of ``flows`` (host, ..) by the published policy (hosts.policy_rows) that is current when the
    batch begins, and hands (the rows with action, decided_by and policy_version, batch id) to ``write``.

    A host is looked up by its normal form, with its parents and the precedence of the tables; one without a normal form is proxied.
    The policy is taken up anew when its manifest has changed, so a new version counts from the next batch on.  A batch that is run
    again may be decided by a newer version: the version is in its rows.
    """
    from ..functions.domains import normalize_domain
    from ..operators.hosts import decided

    held: dict = {}

    def batch(df: DataFrame, n: int) -> None:
        now = policy.manifest()
        if now is None:
            raise ValueError("no policy has been published")
        if held.get("version") != now["version"]:
            held["version"], held["rows"] = policy.load()
        key = df.withColumn("__host", normalize_domain(F.col("host")))
        acts = decided(key.select(F.col("__host").alias("host")), held["rows"]).withColumnRenamed("host", "__of")
        met = key.join(acts.hint("merge"), F.col("__host").eqNullSafe(F.col("__of")), "left")
        write(met.drop("__host", "__of").withColumn("policy_version", F.lit(held["version"])), n)

    return flows.writeStream.foreachBatch(batch)


def verdict_stream(texts: DataFrame, lexicon: DataFrame, write: Callable[[DataFrame, int], None]):
    """A writer that scores each micro-batch of ``texts`` (doc_id, text, lang) and hands (verdicts, batch id) to ``write``."""
    from ..operators.text_policy import verdicts

    return texts.writeStream.foreachBatch(lambda batch, n: write(verdicts(batch, lexicon), n))


