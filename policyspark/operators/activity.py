"""Statistics and state of event tables: counts, histograms, streaks, summaries, sessions, precedence."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from .walks import walked

#: Repeats within 10 s coalesce, 2000 log rows are kept, cooldown, ready and disarm windows, milestones in days.
COALESCE_MS, KEEP_ROWS = 10_000, 2_000
COOLDOWN_MS, READY_MS, DISARM_MS = 15 * 60_000, 5 * 60_000, 10 * 60_000
MILESTONES = (7, 30, 90, 180, 365)
#: Rules of screens that are broadcast; more are joined by a merge.
RULES = 100_000
RANK = {"allow": 0, "warn": 1, "block": 2}


def latest_first(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each key (top-n, ring buffer, log trim)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def first_arrival(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each client-generated id, the first to arrive (idempotent ingest)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def coalesced(log: DataFrame, parts: int | None = None) -> DataFrame:
    """``log`` (device, seq, elapsed_ms, event, detail) without repeats of the last *recorded* row within 10 s.

    A clock that went back is a reboot: the row is kept.  What counts is the last kept row, so rows are walked in order, a device's
    in as many stretches (of ``parts``) as its rows fill.  A row that differs from the one before it is recorded whatever is
    remembered, and so is one whose clock is 10 s away from the one before it.
    """

    def step(last, r):
        now = (r.event, r.detail)
        if last is not None and last[0] == now and 0 <= r.elapsed_ms - last[1] < COALESCE_MS:
            return "coalesced", last
        return "recorded", (now, r.elapsed_ms)

    def cut(before, r):
        now = (r.event, r.detail)
        return before is not None and (before[0] != now or abs(r.elapsed_ms - before[1]) >= COALESCE_MS), (now, r.elapsed_ms)

    return walked(log, "device", ["seq"], ["event", "detail", "elapsed_ms"], step, "__outcome", cut, parts).where("__outcome = 'recorded'").drop("__outcome")


def session_starts(log: DataFrame, connects: DataFrame) -> DataFrame:
    """How each connect (device, now_elapsed) begins, after the device's log (device, seq, elapsed_ms, event).

    first_run without a boundary (connected or disconnected); after_reboot if the clock ever falls from the last boundary to
    now; else clean_restart after a disconnect and unclean_stop after a connect.
    """
    boundary = F.col("event").isin("service_connected", "service_disconnected")
    last = log.where(boundary).groupBy("device").agg(F.max_by(F.struct(F.col("event").alias("be"), F.col("seq").alias("bs")), "seq").alias("b")).select("device", "b.*")
    since = log.join(last, "device").where("seq >= bs")
    w = Window.partitionBy("device").orderBy("seq")
    falls = since.withColumn("fell", F.col("elapsed_ms") < F.lag("elapsed_ms").over(w)).groupBy("device").agg(F.max(F.coalesce("fell", F.lit(False))).alias("fell"), F.max_by("elapsed_ms", "seq").alias("last_elapsed"), F.first("be").alias("be"))
    j = connects.join(falls, "device", "left")
    kind = F.when(F.col("be").isNull(), "first_run").when(F.col("fell") | (F.col("now_elapsed") < F.col("last_elapsed")), "after_reboot").when(F.col("be") == "service_disconnected", "clean_restart").otherwise("unclean_stop")
    return j.select("device", kind.alias("start"))


def edges(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The rows at which a key's state differs from its row before (edge-triggered notices)."""
    prev = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("previous", prev).where(~F.col(state).eqNullSafe(F.col("previous")))


def streaks(days: DataFrame) -> DataFrame:
    """user_id, first_day, last_day, length of each run of neighbouring days.  ``days``: user_id, day."""
    d = days.distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return d.select("user_id", "day", island.alias("i")).groupBy("user_id", "i").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("length")).drop("i")


def clean_streaks(calendar: DataFrame, overrides: DataFrame, disabled: DataFrame | None = None) -> DataFrame:
    """Runs of days without an override.  ``calendar``: user_id, first_day, last_day; ``overrides`` and ``disabled``: user_id, day.

    A day on which protection was disabled ends a run as an override does.
    """
    broken = overrides.select("user_id", "day")
    if disabled is not None:
        broken = broken.unionAll(disabled.select("user_id", "day"))
    spine = calendar.select("user_id", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return streaks(spine.join(broken.distinct().hint("merge"), ["user_id", "day"], "left_anti"))


def milestones(runs: DataFrame) -> DataFrame:
    """user_id and each milestone that any of the user's streaks reaches, once."""
    m = F.explode(F.filter(F.array(*[F.lit(x) for x in MILESTONES]), lambda x: x <= F.col("length")))
    return runs.select("user_id", m.alias("milestone")).distinct()


def rate_limited(events: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Adds in_window (events of the key in the ``seconds`` up to each) and limited.

    Windows are by key and slice of ``seconds``, with the slice's own events and those of the one before, so that a busy key is
    spread over tasks by its time.
    """
    at = F.col("ts").cast("timestamp").cast("long")
    own = events.select(F.struct(*events.columns).alias("e"), F.col(key).alias("k"), at.alias("at"), F.floor(at / seconds).alias("slice"))
    both = own.unionAll(own.select(F.lit(None).cast(own.schema["e"].dataType), "k", "at", F.col("slice") + 1))
    w = Window.partitionBy("k", "slice").orderBy("at").rangeBetween(-seconds + 1, 0)
    counted = both.withColumn("in_window", F.count("*").over(w)).where("e is not null")
    return counted.select("e.*", "in_window").withColumn("limited", F.col("in_window") > most)


def counts_by_verdict(scored: DataFrame, now: Column) -> DataFrame:
    """verdict, lifetime and last_7_days counts."""
    return scored.groupBy("verdict").agg(F.count("*").alias("lifetime"), F.count_if(F.col("ts") > now - F.expr("interval 7 days")).alias("last_7_days"))


def histogram(scored: DataFrame) -> DataFrame:
    """Counts of scores 0 to 100 in 20 buckets."""
    return scored.groupBy(F.least(F.lit(19), F.floor(F.col("score") / 5)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def top_titles(events: DataFrame, title: str, k: int = 5, most: int | None = None) -> DataFrame:
    """The k most frequent titles; with ``most``, of the titles last seen latest (column ts) only so many, as the feature keeps no more."""
    g = events.groupBy(title).agg(F.count("*").alias("n"), *([F.max("ts").alias("seen")] if most else []))
    kept = g.orderBy(F.desc("seen"), title).limit(most).drop("seen") if most else g
    return kept.orderBy(F.desc("n"), title).limit(k)


def weekly_summary(events: DataFrame, zones: DataFrame) -> DataFrame:
    """user_id, week (its local Monday), blocked, warned, overrides, streak.  ``zones``: user_id, tz (UTC where missing).

    streak: days at the week's end, Sunday, since the user's last local day with an override up to it, or since the first event.
    """
    local = F.from_utc_timestamp("ts", F.coalesce("tz", F.lit("UTC")))
    e = events.join(zones.hint("merge"), "user_id", "left").withColumn("day", F.to_date(local)).withColumn("week", F.to_date(F.date_trunc("week", local)))
    override = F.col("verdict") == "override"
    g = e.groupBy("user_id", "week").agg(F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "warn").alias("warned"), F.count_if(override).alias("overrides"), F.max(F.when(override, F.col("day"))).alias("last"), F.min("day").alias("day"))
    so_far = Window.partitionBy("user_id").orderBy("week")
    since = F.coalesce(F.max("last").over(so_far), F.date_sub(F.min("day").over(so_far), 1))
    return g.select("user_id", "week", "blocked", "warned", "overrides", F.date_diff(F.date_add("week", 6), since).alias("streak"))


def protection_mode(verdict: Column, mode: Column, variant: str) -> Column:
    """proxy: only full mode blocks, all else is allowed; daemon: off allows, warn turns block into warn."""
    if variant == "proxy":
        return F.when((mode == "full") & (verdict == "block"), "block").otherwise("allow")
    return F.when(mode == "off", "allow").when((mode == "warn") & (verdict == "block"), "warn").otherwise(verdict)


def cover(action: Column) -> Column:
    return F.when(action == "block", "covered").when(action == "warn", "interstitial").otherwise("clear")


def suppressed(verdicts: DataFrame, dismissals: DataFrame, seconds: int = 600) -> DataFrame:
    """``verdicts`` (user_id, host, ts, verdict) with warn turned to allow within ``seconds`` of the user's dismissal of the host.

    Interval join by equal time slices: a dismissal counts in its own slice and the next.
    """
    slice_of = lambda c: F.floor(c.cast("long") / seconds)
    d = dismissals.select("user_id", "host", F.col("ts").alias("dts"), F.explode(F.array(slice_of(F.col("ts")), slice_of(F.col("ts")) + 1)).alias("slice"))
    # the latest dismissal of a slice up to a verdict is all that matters: both sides are one sorted sequence
    v = verdicts.select(F.struct(*verdicts.columns).alias("v"), "user_id", "host", F.col("ts").alias("at"), slice_of(F.col("ts")).alias("slice"), F.lit(None).cast("timestamp").alias("dts"))
    both = v.unionByName(d.select(F.lit(None).cast(v.schema["v"].dataType).alias("v"), "user_id", "host", F.col("dts").alias("at"), "slice", "dts"))
    w = Window.partitionBy("user_id", "host", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    since = F.col("at").cast("long") - F.max("dts").over(w).cast("long")
    hit = F.coalesce(since < seconds, F.lit(False))
    j = both.withColumn("hit", hit).where("v is not null").select("v.*", "hit")
    return j.select(*[c for c in verdicts.columns if c != "verdict"], F.when(F.col("hit") & (F.col("verdict") == "warn"), "allow").otherwise(F.col("verdict")).alias("verdict"))


def strongest_surface(windows: DataFrame, rules: DataFrame) -> DataFrame:
    """Per event: the surface of the first rule (priority, column, value, surface) that fits, focused windows first.

    ``windows``: event_id, focused, package, resource_id, class_name, of which rules name one.  Rules are broadcast up to RULES.
    """
    few = rules.limit(RULES + 1).count() <= RULES
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("package", "resource_id", "class_name")])).alias("f")
    hit = windows.select("event_id", "focused", fields).select("event_id", "focused", "f.*").join(F.broadcast(rules) if few else rules.hint("merge"), ["column", "value"])
    return hit.groupBy("event_id").agg(F.min_by("surface", F.struct((~F.col("focused")).cast("int"), "priority")).alias("surface"))


def protection_phase(log: DataFrame) -> DataFrame:
    """device, phase, left_ms of ``log`` (device, armed, requested_at, disarmed_at, now)."""
    dis, req = F.col("now") - F.col("disarmed_at"), F.col("now") - F.col("requested_at")
    live = F.coalesce((dis >= 0) & (dis < DISARM_MS), F.lit(False))
    void = F.col("requested_at").isNull() | (req < 0)
    phase = F.when(~F.col("armed"), "off").when(live, "disarmed").when(void, "armed").when(req < COOLDOWN_MS, "pending").when(req < COOLDOWN_MS + READY_MS, "ready").otherwise("armed")
    left = F.when(phase == "disarmed", DISARM_MS - dis).when(phase == "pending", COOLDOWN_MS - req).when(phase == "ready", COOLDOWN_MS + READY_MS - req)
    return log.select("device", phase.alias("phase"), left.alias("left_ms"))


def gate_outcomes(starts: DataFrame, outcomes: DataFrame, seconds: int | None = None) -> DataFrame:
    """Planned in the reference: each gate start with its outcome, open where none came; with ``seconds``, where none came in that time
    (both sides with ts).
    """
    o = outcomes.select(F.col("gate_id").alias("__gate"), F.col("outcome").alias("__outcome"), *([F.col("ts").alias("__at")] if seconds is not None else []))
    within = f" and __at >= ts and __at <= ts + interval {seconds} seconds" if seconds is not None else ""
    return starts.join(o.hint("merge"), F.expr("gate_id = __gate" + within), "left").select(*starts.columns, F.coalesce("__outcome", F.lit("open")).alias("outcome"))


def deferral(flags: DataFrame, scores: DataFrame, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Planned in the reference: a user's flag is accepted where the model is unsure and goes to a human where it is confident."""
    unsure = F.col("score").between(low, high)
    return flags.join(scores.hint("merge"), "item", "left").withColumn("route", F.when(F.col("score").isNull() | unsure, "accept").otherwise("human"))


def fresh(now: Column, sent: Column, seconds: int = 300) -> Column:
    """A request's time stamp is within ``seconds`` of now, either way."""
    return F.abs(now.cast("long") - sent.cast("long")) <= seconds


def signed(body: Column, signature: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of the body under a key that all rows share matches ``signature``, in lower hex; false for nulls.

    By its definition, as Spark has no function for it: the hash of the key's outer block and the hash of its inner block and the body.
    """
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    return F.coalesce(F.sha2(F.concat(pad(0x5C), inner), 256) == signature, F.lit(False))


def effective_status(status: Column, expires_at: Column, now: Column) -> Column:
    """A pending invite past its expiry reads as expired."""
    return F.when((status == "pending") & (expires_at < now), "expired").otherwise(status)


def undelivered(queue: DataFrame) -> DataFrame:
    """The whole queue of what isn't delivered, oldest first: its rows in order over range partitions."""
    return queue.where("delivered_at is null").orderBy("created_at")


def image_admissible(width: Column, height: Column) -> Column:
    """admissible, or the reason against: empty, too_small (96 pixels on the shorter side), too_elongated (8 to 1)."""
    return F.when((width <= 0) | (height <= 0), "empty").when(F.least(width, height) < 96, "too_small").when(F.greatest(width, height) > 8 * F.least(width, height), "too_elongated").otherwise("admissible")


def guard_health(active: Column, service_enabled: Column) -> Column:
    """idle unless the guard is active; then protecting, or unprotected where its service is off."""
    return F.when(~active, "idle").when(service_enabled, "protecting").otherwise("unprotected")


def status_message(health: Column, phase: Column, recognised: Column) -> Column:
    """What a user is told: a guard that isn't running first, then the release phases, then an unverified device."""
    shown = {"pending": "disarm_pending", "ready": "disarm_ready", "disarmed": "disarmed", "off": "idle"}
    message = F.when(health == "unprotected", "guard_not_running")
    for state, text in shown.items():
        message = message.when(phase == state, text)
    return message.when(~recognised, "device_unverified").otherwise("protecting")


def unprotected_notices(checks: DataFrame, order: list[str]) -> DataFrame:
    """The checks (device, .., health) at which a device falls into unprotected; its first check counts as a fall."""
    return edges(checks, "device", order, "health").where("health = 'unprotected'")


def trimmed(log: DataFrame, key: str, order: list[Column], keep: int = KEEP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(the newest rows of each key, how many were dropped: key, dropped)"""
    dropped = log.groupBy(key).agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("dropped"))
    return latest_first(log, key, order, keep), dropped
