"""Queries on event tables and streams, with SQL that states the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import activity as ac
from ..sources import lists as ls
from ..sources.state_tables import KeyedTable
from ..streaming import gates as sg, ingest as si, joins as sj
from .tables import events, scratch_dir, table
from .text import VERDICTS_SQL

_VERDICT = "CASE event_type WHEN 'error' THEN 'block' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'override' ELSE 'allow' END"
_V = f"v AS (SELECT *, {_VERDICT} AS verdict FROM events)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("verdict", F.expr(_VERDICT))


def _day(c: str):
    return F.to_date(c)


def newest_rows(spark, sf_dir):
    return ac.latest_first(events(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


def idempotent_ingest(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("client_id", F.floor(F.col("event_id") / 3))
    return ac.first_arrival(e, "client_id", ["ts", "event_id"]).select("client_id", "event_id", "event_type")


#: A device's events are hours apart; its clock runs so much slower that the gates' windows matter.
_AT = "cast(floor(unix_seconds(ts) / {0}) as bigint)"
_AT_SQL = "floor(floor(epoch(ts)) / {0})::BIGINT"


def _log(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("device"), F.col("event_id").alias("seq"), F.expr(_AT.format(7.2)).alias("elapsed_ms"), F.col("event_type").alias("event"), F.lit("").alias("detail"))


def coalesced_log(spark, sf_dir):
    return ac.coalesced(_log(spark, sf_dir)).select("device", "seq")


#: A gate as SQL: rows are walked by a recursive query, one row of every device a round.
_WALK = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY {order}) AS r FROM ({rows})),
w AS (SELECT e.*, {first} FROM e WHERE r = 1
  UNION ALL SELECT e.*, {step} FROM w s JOIN e ON e.device = s.device AND e.r = s.r + 1)
"""
_LOG_ROWS = f"SELECT user_id::VARCHAR AS device, event_id AS seq, {_AT_SQL.format(7.2)} AS at_ms, event_type AS event FROM events"
_SAME = "e.event = s.last_event AND e.at_ms - s.last_at BETWEEN 0 AND 9999"
_REPEAT = f"NOT ({_SAME}) AS kept, CASE WHEN {_SAME} THEN s.last_event ELSE e.event END AS last_event, CASE WHEN {_SAME} THEN s.last_at ELSE e.at_ms END AS last_at"
COALESCED_SQL = _WALK.format(order="seq", rows=_LOG_ROWS, first="true AS kept, event AS last_event, at_ms AS last_at", step=_REPEAT) + "SELECT device, seq FROM w WHERE kept"
STREAM_COALESCED_SQL = _WALK.format(order="at_ms, seq", rows=_LOG_ROWS, first="true AS kept, event AS last_event, at_ms AS last_at", step=_REPEAT) + "SELECT device, seq, CASE WHEN kept THEN 'recorded' ELSE 'coalesced' END AS outcome FROM w"


def one_device_log(spark, sf_dir):
    """The log as that of one device, walked in as many stretches as its rows fill."""
    return ac.coalesced(_log(spark, sf_dir).withColumn("device", F.lit("all"))).select("device", "seq")


#: Rows differ from the one before, or are 10 s away from it, where a run begins; the recursion is as deep as the longest run.
_RUNS = f"SELECT sum(new) OVER (ORDER BY seq) AS device, seq, at_ms, event FROM (SELECT *, (event IS DISTINCT FROM lag(event) OVER o OR abs(at_ms - lag(at_ms) OVER o) >= 10000)::INTEGER AS new FROM ({_LOG_ROWS}) WINDOW o AS (ORDER BY seq))"
ONE_DEVICE_SQL = _WALK.format(order="seq", rows=_RUNS, first="true AS kept, event AS last_event, at_ms AS last_at", step=_REPEAT) + "SELECT 'all' AS device, seq FROM w WHERE kept"


def session_starts(spark, sf_dir):
    kind = F.when((F.col("event_type") == "signup") & (F.col("value") > 15), "service_connected").when((F.col("event_type") == "purchase") & (F.col("value") > 15), "service_disconnected").otherwise(F.col("event_type"))
    clock = F.expr("unix_seconds(ts) % (86400 * 4)")
    log = events(spark, sf_dir).select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), clock.alias("elapsed_ms"), kind.alias("event"))
    connects = events(spark, sf_dir).groupBy(F.col("user_id").alias("device")).agg(F.lit(200_000).alias("now_elapsed"))
    return ac.session_starts(log, connects)


SESSION_STARTS_SQL = """WITH l AS (SELECT user_id AS device, event_id AS seq, floor(epoch(ts))::BIGINT % (86400 * 4) AS el, CASE WHEN event_type IN ('signup', 'purchase') AND value > 15 THEN event_type ELSE 'x' END AS ev FROM events),
b AS (SELECT device, max(seq) AS bs FROM l WHERE ev IN ('signup', 'purchase') GROUP BY device),
s AS (SELECT l.*, lag(el) OVER (PARTITION BY l.device ORDER BY seq) AS prev FROM l JOIN b ON l.device = b.device AND seq >= bs),
g AS (SELECT device, bool_or(coalesce(el < prev, false)) AS fell, first(el ORDER BY seq DESC) AS last_el, first(ev ORDER BY seq) AS be FROM s GROUP BY device)
SELECT u.device, CASE WHEN be IS NULL THEN 'first_run' WHEN fell OR 200000 < last_el THEN 'after_reboot' WHEN be = 'purchase' THEN 'clean_restart' ELSE 'unclean_stop' END AS start
FROM (SELECT DISTINCT user_id AS device FROM events) u LEFT JOIN g ON u.device = g.device"""


def edge_notices(spark, sf_dir):
    return ac.edges(judged(spark, sf_dir), "user_id", ["ts", "event_id"], "verdict").select("event_id", "verdict", "previous")


def clean_streaks(spark, sf_dir):
    j = judged(spark, sf_dir).withColumn("day", _day("ts"))
    calendar = j.groupBy("user_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return ac.clean_streaks(calendar, j.where("verdict = 'override'"), j.where("value > 75"))


def streak_milestones(spark, sf_dir):
    return ac.milestones(clean_streaks(spark, sf_dir))


_STREAKS = f"""WITH {_V}, d AS (SELECT user_id, ts::DATE AS day, CASE WHEN value > 75 THEN 'override' ELSE verdict END AS verdict FROM v), c AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY user_id),
ok AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = c.user_id AND d.day = c.day AND verdict = 'override')),
i AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS g FROM ok),
s AS (SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS length FROM i GROUP BY user_id, g)"""


def rate_limits(spark, sf_dir):
    return ac.rate_limited(events(spark, sf_dir), "user_id", 3600, 2).select("event_id", "in_window", "limited")


def verdict_counts(spark, sf_dir):
    return ac.counts_by_verdict(judged(spark, sf_dir), F.lit("2024-01-30 00:00:00").cast("timestamp"))


def score_histogram(spark, sf_dir):
    return ac.histogram(events(spark, sf_dir).select(F.least("value", F.lit(100.0)).alias("score")))


def top_titles(spark, sf_dir):
    return ac.top_titles(events(spark, sf_dir).withColumn("title", F.concat("event_type", F.lit("-"), (F.col("user_id") % 40).cast("string"))), "title", most=100)


def weekly_summary(spark, sf_dir):
    zones = events(spark, sf_dir).select("user_id").distinct().where("user_id % 3 > 0").withColumn("tz", F.when(F.col("user_id") % 3 == 1, "Asia/Tokyo").otherwise("America/New_York"))
    return ac.weekly_summary(judged(spark, sf_dir), zones)


def protection_modes(spark, sf_dir):
    j = judged(spark, sf_dir).withColumn("mode", F.element_at(F.array(F.lit("full"), F.lit("warn"), F.lit("off")), (F.col("user_id") % 3 + 1).cast("int")))
    return j.select("event_id", ac.protection_mode(F.col("verdict"), F.col("mode"), "proxy").alias("proxy"), ac.protection_mode(F.col("verdict"), F.col("mode"), "daemon").alias("daemon"), ac.cover(F.col("verdict")).alias("cover"))


def suppressed_warnings(spark, sf_dir):
    e = judged(spark, sf_dir).withColumn("host", F.col("user_id") % 2)
    d = e.where("verdict = 'override'").select("user_id", "host", "ts")
    return ac.suppressed(e.select("event_id", "user_id", "host", "ts", "verdict"), d, 7200).select("event_id", "verdict")


def protection_phases(spark, sf_dir):
    log = events(spark, sf_dir).select(F.col("event_id").alias("device"), (F.col("event_id") % 7 > 0).alias("armed"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") * 1000).alias("requested_at"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") * 700).alias("disarmed_at"), F.lit(1_200_000).alias("now"))
    return ac.protection_phase(log)


PHASES_SQL = """WITH l AS (SELECT event_id AS device, event_id % 7 > 0 AS armed, CASE WHEN event_id % 3 > 0 THEN 1200000 - event_id * 1000 END AS req, CASE WHEN event_id % 5 = 0 THEN 1200000 - event_id * 700 END AS dis FROM events),
p AS (SELECT *, CASE WHEN NOT armed THEN 'off' WHEN dis >= 0 AND dis < 600000 THEN 'disarmed' WHEN req IS NULL OR req < 0 THEN 'armed' WHEN req < 900000 THEN 'pending' WHEN req < 1200000 THEN 'ready' ELSE 'armed' END AS phase FROM l)
SELECT device, phase, CASE phase WHEN 'disarmed' THEN 600000 - dis WHEN 'pending' THEN 900000 - req WHEN 'ready' THEN 1200000 - req END AS left_ms FROM p"""


def gap_sessions(spark, sf_dir):
    return sg.sessions(events(spark, sf_dir), "6 hours", "1 hour")


def worst_verdicts(spark, sf_dir):
    from ..operators.text_policy import worst

    return worst(judged(spark, sf_dir).where("verdict <> 'override'").select(F.col("user_id").alias("item"), F.col("verdict").alias("action")))


def event_props(spark, sf_dir):
    lines = events(spark, sf_dir).select(F.when(F.col("event_id") % 6 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct(F.lit("scan").alias("type"), F.expr(_VERDICT).alias("verdict"), F.col("value").alias("score"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("windowTitle"), F.col("event_id").cast("string").alias("at")))).alias("value"))
    return ls.scan_events(lines).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("points"))


def surfaces(spark, sf_dir):
    rules = spark.createDataFrame([(1, "package", "error", "settings"), (2, "resource_id", "3", "uninstall"), (3, "class_name", "even", "self")], "priority int, column string, value string, surface string")
    w = events(spark, sf_dir).select(F.floor(F.col("event_id") / 4).alias("event_id"), (F.col("event_id") % 4 == 1).alias("focused"), F.col("event_type").alias("package"), (F.col("user_id") % 5).cast("string").alias("resource_id"), F.when(F.col("event_id") % 2 == 0, "even").alias("class_name"))
    return ac.strongest_surface(w, rules)


SURFACES_SQL = """WITH w AS (SELECT event_id // 4 AS event_id, event_id % 4 = 1 AS f, event_type AS p, user_id % 5 AS r, event_id % 2 = 0 AS e FROM events),
h AS (SELECT event_id, f, 1 AS pr, 'settings' AS s FROM w WHERE p = 'error' UNION ALL SELECT event_id, f, 2, 'uninstall' FROM w WHERE r = 3 UNION ALL SELECT event_id, f, 3, 'self' FROM w WHERE e)
SELECT event_id, first(s ORDER BY NOT f, pr) AS surface FROM h GROUP BY event_id"""

WEEKLY_SQL = f"""WITH {_V}, l AS (SELECT user_id, verdict, CASE user_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL 9 HOUR ELSE ts - INTERVAL 5 HOUR END AS local FROM v),
g AS (SELECT user_id, date_trunc('week', local)::DATE AS week, count(*) FILTER (verdict = 'block') AS blocked, count(*) FILTER (verdict = 'warn') AS warned, count(*) FILTER (verdict = 'override') AS overrides FROM l GROUP BY ALL)
SELECT *, date_diff('day', coalesce((SELECT max(local::DATE) FROM l WHERE l.user_id = g.user_id AND verdict = 'override' AND local::DATE < week + 7), (SELECT min(local::DATE) FROM l WHERE l.user_id = g.user_id) - 1), week + 6)::INTEGER AS streak FROM g"""

# --- gates with state by device; a stream of the table gives what the table gives


def _screens(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").cast("string").alias("device"), F.col("event_id").alias("seq"), F.expr(_AT.format(120)).alias("at_ms"), F.concat(F.lit("p"), (F.col("event_id") % 11 % 3).cast("string")).alias("package"), F.when(F.col("event_id") % 13 > 0, F.col("event_type")).alias("text"), "ts")


def _frames(e: DataFrame) -> DataFrame:
    shifted = F.call_function("shiftright", F.col("event_id") * 40_503, F.lit(6))
    return e.select(F.col("user_id").cast("string").alias("device"), F.col("event_id").alias("seq"), F.expr(_AT.format(7.2)).alias("at_ms"), shifted.bitwiseAND(F.lit(4095).cast("long")).alias("hash"), F.col("event_type").alias("event"), F.lit("").alias("detail"), "ts")


_SCREEN_ROWS = f"SELECT user_id::VARCHAR AS device, event_id AS seq, {_AT_SQL.format(120)} AS at_ms, 'p' || (event_id % 11 % 3) AS package, CASE WHEN event_id % 13 > 0 THEN event_type END AS text FROM events"
_SCREEN = "CASE WHEN e.package = 'p2' THEN 'self_package' WHEN coalesce(e.text, '') = '' THEN 'no_text' WHEN e.package = s.sp AND e.text = s.st THEN 'duplicate' WHEN e.package = s.sp AND e.at_ms - s.sa < 300 THEN 'debounced' ELSE 'scanned' END"
_TAKE = lambda new, old, hit: f"CASE WHEN {hit} THEN {new} ELSE {old} END"
_SCREEN_FIRST = "CASE WHEN package = 'p2' THEN 'self_package' WHEN coalesce(text, '') = '' THEN 'no_text' ELSE 'scanned' END"
_FS = f"({_SCREEN_FIRST}) = 'scanned'"
SCREEN_SQL = _WALK.format(
    order="at_ms, seq", rows=_SCREEN_ROWS, first=f"{_SCREEN_FIRST} AS outcome, CASE WHEN {_FS} THEN package END AS sp, CASE WHEN {_FS} THEN text END AS st, CASE WHEN {_FS} THEN at_ms END AS sa",
    step=f"{_SCREEN} AS outcome, " + ", ".join(_TAKE(f"e.{a}", f"s.{b}", f"({_SCREEN}) = 'scanned'") + f" AS {b}" for a, b in (("package", "sp"), ("text", "st"), ("at_ms", "sa"))),
) + "SELECT device, seq, outcome FROM w"
_FRAME_ROWS = f"SELECT user_id::VARCHAR AS device, event_id AS seq, {_AT_SQL.format(7.2)} AS at_ms, ((event_id * 40503) >> 6) & 4095 AS hash FROM events"
_FRAME = "CASE WHEN e.at_ms - s.sa < 1000 THEN 'too_soon' WHEN bit_count(xor(e.hash, s.sh)) < 6 THEN 'unchanged' ELSE 'analyse' END"
FRAME_SQL = _WALK.format(order="at_ms, seq", rows=_FRAME_ROWS, first="'analyse' AS outcome, hash AS sh, at_ms AS sa", step=f"{_FRAME} AS outcome, " + ", ".join(_TAKE(f"e.{a}", f"s.{b}", f"({_FRAME}) = 'analyse'") + f" AS {b}" for a, b in (("hash", "sh"), ("at_ms", "sa")))) + "SELECT device, seq, outcome FROM w"
_RUN = "CASE WHEN e.at_ms - s.sa >= 5000 THEN 0 ELSE s.k END"
_BURST = f"CASE WHEN e.at_ms - s.sa < 1200 THEN 'refire' WHEN ({_RUN}) >= 3 THEN 'limited' ELSE 'fired' END"
BURST_SQL = _WALK.format(order="at_ms, seq", rows=_FRAME_ROWS, first="'fired' AS outcome, at_ms AS sa, 1 AS k", step=f"{_BURST} AS outcome, " + _TAKE("e.at_ms", "s.sa", f"({_BURST}) = 'fired'") + " AS sa, " + _TAKE(f"({_RUN}) + 1", "s.k", f"({_BURST}) = 'fired'") + " AS k") + "SELECT device, seq, outcome FROM w"


def screen_gate(spark, sf_dir):
    return sg.gated_batch(_screens(events(spark, sf_dir)), sg.screen_gate("p2"))


def frame_gate(spark, sf_dir):
    return sg.gated_batch(_frames(events(spark, sf_dir)), sg.FRAME_GATE)


def burst_gate(spark, sf_dir):
    return sg.gated_batch(_frames(events(spark, sf_dir)), sg.BURST_GATE)


def _asked(e: DataFrame) -> DataFrame:
    """Requests, disarms and looks at the clock, a device's hours as minutes."""
    kind = F.when(F.col("event_type") == "error", "request").when(F.col("event_type") == "signup", "disarm").otherwise("tick")
    return e.select(F.col("user_id").cast("string").alias("device"), F.col("event_id").alias("seq"), F.expr(_AT.format(0.1)).alias("at_ms"), kind.alias("event"), "ts")


def cooldown_gate(spark, sf_dir):
    return sg.gated_batch(_asked(events(spark, sf_dir)), sg.COOLDOWN_GATE)


COOLDOWN_SQL = f"""WITH e AS (SELECT user_id::VARCHAR AS device, event_id AS seq, {_AT_SQL.format(0.1)} AS at_ms, event_type FROM events),
s AS (SELECT *, at_ms - max(CASE WHEN event_type = 'error' THEN at_ms END) OVER w AS asked, at_ms - max(CASE WHEN event_type = 'signup' THEN at_ms END) OVER w AS done FROM e WINDOW w AS (PARTITION BY device ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING))
SELECT device, seq, CASE WHEN done < 600000 THEN 'disarmed' WHEN asked IS NULL OR asked >= 1200000 THEN 'armed' WHEN asked < 900000 THEN 'pending' ELSE 'ready' END AS outcome FROM s"""


#: A time that closes everything before it, at the end of a bounded run.
_END = "9000-01-01"


def _streamed(spark: SparkSession, sf_dir: str, of, closing: bool | tuple[str, ...] = False) -> DataFrame:
    """What ``of`` (events stream to stream) appends, run to the end of the input and read back.

    ``closing``: a last row (one for each event type named), at a time far ahead, moves the watermarks past all others, so that no
    window stays open; its own never closes.  Its numbers are -1, as filters on nulls that joins imply go below watermarks; a query
    whose rows pass at once drops it from what it reads back.
    """
    out = scratch_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    read = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    if closing:
        own = {"ts": F.lit(_END), "event_type": F.col("kind"), "event_id": F.lit(-1), "user_id": F.lit(-1)}
        end = [own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        kinds = spark.createDataFrame([(k,) for k in (closing if isinstance(closing, tuple) else (None,))], "kind string")
        kinds.select(*end).toDF(*schema.names).write.parquet(f"{out}/end")
        read = read.unionByName(spark.readStream.schema(schema).parquet(f"{out}/end"))
    stream = of(read.withColumn("ts", F.col("ts").cast("timestamp")))
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_screen_gate(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: sg.gated_stream(_screens(e), sg.screen_gate("p2"), "10 seconds"), True)


def stream_coalesced(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: sg.gated_stream(_frames(e), sg.REPEAT_GATE, "10 seconds"), True)


def stream_frame_gate(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: sg.gated_stream(_frames(e), sg.FRAME_GATE, "10 seconds"), True)


def stream_burst_gate(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: sg.gated_stream(_frames(e), sg.BURST_GATE, "10 seconds"), True)


def stream_cooldown_gate(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: sg.gated_stream(_asked(e), sg.COOLDOWN_GATE, "10 minutes"), True)


def phase_changes(spark, sf_dir):
    """Phases after each row, and those that time alone brings."""
    return sg.phase_changes(_asked(events(spark, sf_dir)), sg.COOLDOWN_GATE)


def stream_phases(spark, sf_dir):
    """The same of a stream, by timers."""
    return _streamed(spark, sf_dir, lambda e: sg.phase_stream(_asked(e), sg.COOLDOWN_GATE, "10 minutes"), True)


#: A request is pending for 15 minutes and ready for 5, a disarm lasts 10; at each such end before the device's next row the phase may change.
PHASE_CHANGES_SQL = f"""WITH e AS (SELECT user_id::VARCHAR AS device, event_id AS seq, {_AT_SQL.format(0.1)} AS at_ms, event_type FROM events),
s AS (SELECT *, max(CASE WHEN event_type = 'error' THEN at_ms END) OVER w AS asked, max(CASE WHEN event_type = 'signup' THEN at_ms END) OVER w AS done, lead(at_ms) OVER o AS next_at FROM e
  WINDOW w AS (PARTITION BY device ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY device ORDER BY at_ms, seq)),
t AS (SELECT DISTINCT device, t, asked, done, at_ms, seq FROM (SELECT *, unnest([at_ms, asked + 900000, asked + 1200000, done + 600000]) AS t FROM s) WHERE t = at_ms OR t > at_ms AND (next_at IS NULL OR t < next_at)),
p AS (SELECT *, CASE WHEN t - done < 600000 THEN 'disarmed' WHEN asked IS NULL OR t - asked >= 1200000 THEN 'armed' WHEN t - asked < 900000 THEN 'pending' ELSE 'ready' END AS phase FROM t),
c AS (SELECT *, lag(phase) OVER (PARTITION BY device, seq ORDER BY t) AS before FROM p)
SELECT device, t AS at_ms, CASE WHEN t = at_ms THEN seq END AS seq, phase FROM c WHERE t = at_ms OR phase <> before"""


def stream_live_counts(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: sg.live_counts(e.withColumn("verdict", F.expr(_VERDICT))), True)


def stream_suppressed(spark, sf_dir):
    """suppressed_warnings of two streams."""

    def of(e):
        e = e.withColumn("verdict", F.expr(_VERDICT)).withColumn("host", F.col("user_id") % 2)
        d = e.where("verdict = 'override'").select("user_id", "host", "ts")
        return sj.suppressed_stream(e.select("event_id", "user_id", "host", "ts", "verdict"), d, "event_id", 7200).select("event_id", "verdict")

    return _streamed(spark, sf_dir, of, ("signup", "purchase")).where("event_id >= 0")


def _gate_sides(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Starts, and outcomes of every second event after one; many starts have none."""
    starts = e.where("event_type = 'error'").select(F.col("event_id").alias("gate_id"), "user_id", "ts")
    return starts, e.where("event_type = 'click'").select((F.col("event_id") - 2).alias("gate_id"), "ts", F.when(F.col("value") > 10, "left").otherwise("stayed").alias("outcome"))


def gate_outcomes_in_time(spark, sf_dir):
    return ac.gate_outcomes(*_gate_sides(events(spark, sf_dir)), 600).select("gate_id", "user_id", "outcome")


def stream_gate_outcomes(spark, sf_dir):
    """The same of two streams."""
    return _streamed(spark, sf_dir, lambda e: sj.outcome_stream(*_gate_sides(e), 600).select("gate_id", "user_id", "outcome"), ("error", "click")).where("gate_id >= 0")


def stream_hosts(spark, sf_dir):
    policy = spark.createDataFrame([("error", "block"), ("click", "allow")], "host string, action string")
    return _streamed(spark, sf_dir, lambda e: sg.host_stream(e.select("event_id", F.col("event_type").alias("host")), policy))


def stream_sessions(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda e: sg.sessions(e, "6 hours", "1 hour"), True)


def stream_verdicts(spark, sf_dir):
    """Verdicts of a stream of documents, written batch by batch."""
    from ..operators import text_policy as tp
    from .text import LEXICON

    out = scratch_dir(spark)
    schema = table(spark, sf_dir, "documents").schema
    texts = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    # a batch is written once more where it is run again, under its own number
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
    sg.verdict_stream(texts, tp.lexicon_table(spark, LEXICON), write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


def stream_idempotent(spark, sf_dir):
    e = lambda e: sg.idempotent(e.withColumn("client_id", F.floor(F.col("event_id") / 3)), "client_id", "60 days").select("client_id")
    return _streamed(spark, sf_dir, e)


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_ingested(spark, sf_dir):
    """idempotent_ingest of a stream, against the stored table; the stream is then run once more from its beginning, which adds nothing."""
    root = scratch_dir(spark)
    kept = KeyedTable(spark, f"{root}/table", "client_id long, event_id long, event_type string", "client_id", buckets=16)
    for run in range(2):
        rows = _event_stream(spark, sf_dir).select(F.floor(F.col("event_id") / 3).alias("client_id"), "event_id", "event_type", "ts")
        si.exact_ingest(rows, kept, ["ts", "event_id"], f"run{run}").option("checkpointLocation", f"{root}/state{run}").trigger(availableNow=True).start().awaitTermination()
    return kept.load()


def stream_rolling_counts(spark, sf_dir):
    """Counts of each day and of the 7 days up to it, from day totals that a stream keeps."""
    root = scratch_dir(spark)
    days = si.day_table(spark, f"{root}/table")
    si.day_totals(_event_stream(spark, sf_dir).withColumn("verdict", F.expr(_VERDICT)), days).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return si.rolling(days.load())


# --- rules on single rows and small joins


def trimmed_log(spark, sf_dir):
    """Rows dropped from each device's log where 50 are kept."""
    _, dropped = ac.trimmed(_log(spark, sf_dir), "device", [F.desc("seq")], 50)
    return dropped


def newest_log_rows(spark, sf_dir):
    kept, _ = ac.trimmed(_log(spark, sf_dir), "device", [F.desc("seq")], 50)
    return kept.select("device", "seq")


def guard_status(spark, sf_dir):
    phase = F.element_at(F.array(*[F.lit(x) for x in ("off", "armed", "pending", "ready", "disarmed")]), (F.col("event_id") % 5 + 1).cast("int"))
    e = events(spark, sf_dir).select(F.col("user_id").alias("device"), "event_id", (F.col("event_id") % 3 > 0).alias("active"), (F.col("event_type") != "error").alias("on"), phase.alias("phase"), (F.col("event_id") % 7 > 0).alias("known"))
    e = e.withColumn("health", ac.guard_health(F.col("active"), F.col("on")))
    return e.select("event_id", "health", ac.status_message(F.col("health"), F.col("phase"), F.col("known")).alias("message"))


GUARD_SQL = """WITH h AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'idle' WHEN event_type <> 'error' THEN 'protecting' ELSE 'unprotected' END AS health FROM events)
SELECT event_id, health, CASE WHEN health = 'unprotected' THEN 'guard_not_running' WHEN event_id % 5 = 2 THEN 'disarm_pending' WHEN event_id % 5 = 3 THEN 'disarm_ready' WHEN event_id % 5 = 4 THEN 'disarmed' WHEN event_id % 5 = 0 THEN 'idle' WHEN event_id % 7 = 0 THEN 'device_unverified' ELSE 'protecting' END AS message FROM h"""


def unprotected_notices(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("device"), "event_id", F.when(F.col("event_type") == "error", "unprotected").otherwise("protecting").alias("health"))
    return ac.unprotected_notices(e, ["event_id"]).select("event_id")


def _requests(spark, sf_dir):
    """One request an event, signed with the key, every fourth badly; sent up to 400 s before or after its time."""
    return events(spark, sf_dir).select("event_id", "ts", F.expr("timestampadd(SECOND, event_id % 801 - 400, ts)").alias("sent"), F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("body"))


def request_checks(spark, sf_dir):
    import hashlib

    key = b"k" * 64
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    # HMAC by its definition for a key of one block, as the signer's side
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.col("body").cast("binary")), 256))
    mac = F.sha2(F.concat(pad(0x5C), inner), 256)
    signed = _requests(spark, sf_dir).withColumn("signature", F.when(F.col("event_id") % 4 > 0, mac).otherwise(F.lit(hashlib.sha256(key).hexdigest())))
    return signed.select("event_id", ac.fresh(F.col("ts"), F.col("sent")).alias("fresh"), ac.signed(F.col("body"), F.col("signature"), key).alias("signed"))


def invite_states(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "click", "accepted").otherwise("pending").alias("status"), F.expr("timestampadd(HOUR, event_id % 100, ts)").alias("expires_at"))
    return e.select("event_id", ac.effective_status(F.col("status"), F.col("expires_at"), F.lit("2024-01-16").cast("timestamp")).alias("status"))


def undelivered(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.col("event_id").alias("created_at"), F.when(F.col("event_type") != "error", F.col("ts")).alias("delivered_at"))
    return ac.undelivered(e).select("event_id", "created_at")


def gate_outcomes(spark, sf_dir):
    e = events(spark, sf_dir)
    starts = e.where("event_type = 'error'").select(F.col("event_id").alias("gate_id"), "user_id")
    outcomes = e.where("event_type = 'click'").select((F.col("event_id") - 1).alias("gate_id"), F.when(F.col("value") > 10, "left").otherwise("stayed").alias("outcome"))
    return ac.gate_outcomes(starts, outcomes)


def feedback_routes(spark, sf_dir):
    e = events(spark, sf_dir)
    flags = e.where("event_type = 'signup'").select(F.col("event_id").alias("item"))
    scores = e.where("user_id % 3 > 0").select(F.col("event_id").alias("item"), (F.col("value") % 1).alias("score"))
    return ac.deferral(flags, scores).select("item", "route")


def image_sizes(spark, sf_dir):
    w, h = F.col("page_id") % 400, F.length("url") * 30 % 1300
    return table(spark, sf_dir, "pages").select("page_id", ac.image_admissible(w, h).alias("admissible"))


def homoglyph_folds(spark, sf_dir):
    from ..functions import text as fx

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.translate("text", "aeopx", "аеорх").alias("spoofed"))
    return d.select("doc_id", F.md5(fx.homoglyph_fold(F.col("spoofed"))).alias("folded"), F.md5(fx.squeeze(F.col("text"))).alias("squeezed"), F.md5(fx.ocr_fold(F.col("text"))).alias("ocr"))


QUERIES = {
    "newest_rows": newest_rows, "idempotent_ingest": idempotent_ingest, "coalesced_log": coalesced_log, "one_device_log": one_device_log, "session_starts": session_starts, "edge_notices": edge_notices, "clean_streaks": clean_streaks,
    "streak_milestones": streak_milestones, "rate_limits": rate_limits, "verdict_counts": verdict_counts, "score_histogram": score_histogram, "top_titles": top_titles, "weekly_summary": weekly_summary,
    "protection_modes": protection_modes, "suppressed_warnings": suppressed_warnings, "protection_phases": protection_phases, "gap_sessions": gap_sessions, "worst_verdicts": worst_verdicts, "event_props": event_props,
    "surfaces": surfaces, "screen_gate": screen_gate, "frame_gate": frame_gate, "burst_gate": burst_gate, "stream_screen_gate": stream_screen_gate, "stream_coalesced": stream_coalesced, "stream_frame_gate": stream_frame_gate, "stream_burst_gate": stream_burst_gate, "stream_cooldown_gate": stream_cooldown_gate,
    "stream_ingested": stream_ingested, "stream_rolling_counts": stream_rolling_counts, "stream_suppressed": stream_suppressed, "gate_outcomes_in_time": gate_outcomes_in_time, "stream_gate_outcomes": stream_gate_outcomes, "phase_changes": phase_changes, "stream_phases": stream_phases, "stream_idempotent": stream_idempotent,
    "cooldown_gate": cooldown_gate, "stream_live_counts": stream_live_counts, "stream_hosts": stream_hosts, "stream_sessions": stream_sessions, "stream_verdicts": stream_verdicts,
    "trimmed_log": trimmed_log, "newest_log_rows": newest_log_rows, "guard_status": guard_status, "unprotected_notices": unprotected_notices, "request_checks": request_checks, "invite_states": invite_states,
    "undelivered": undelivered, "gate_outcomes": gate_outcomes, "feedback_routes": feedback_routes, "image_sizes": image_sizes, "homoglyph_folds": homoglyph_folds,
}
SQL = {
    "newest_rows": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5",
    "idempotent_ingest": "SELECT event_id // 3 AS client_id, first(event_id ORDER BY ts, event_id) AS event_id, first(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY 1",
    "coalesced_log": COALESCED_SQL,
    "one_device_log": ONE_DEVICE_SQL,
    "session_starts": SESSION_STARTS_SQL,
    "edge_notices": f"WITH {_V}, l AS (SELECT event_id, verdict, lag(verdict) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM v) SELECT * FROM l WHERE verdict IS DISTINCT FROM previous",
    "clean_streaks": _STREAKS + " SELECT * FROM s",
    "streak_milestones": _STREAKS + " SELECT DISTINCT user_id, m AS milestone FROM s, (VALUES (7), (30), (90), (180), (365)) x(m) WHERE m <= length",
    "rate_limits": "WITH e AS (SELECT *, epoch(ts)::BIGINT AS s0, floor(epoch(ts))::BIGINT AS s FROM events), w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM e) SELECT *, in_window > 2 AS limited FROM w",
    "verdict_counts": f"WITH {_V} SELECT verdict, count(*) AS lifetime, count(*) FILTER (ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS last_7_days FROM v GROUP BY verdict",
    "score_histogram": "SELECT least(19, floor(least(value, 100) / 5))::INTEGER AS bucket, count(*) AS n FROM events GROUP BY 1",
    "top_titles": "WITH t AS (SELECT event_type || '-' || (user_id % 40) AS title, count(*) AS n, max(ts) AS seen FROM events GROUP BY 1 ORDER BY seen DESC, title LIMIT 100) SELECT title, n FROM t ORDER BY n DESC, title LIMIT 5",
    "weekly_summary": WEEKLY_SQL,
    "protection_modes": f"WITH {_V} SELECT event_id, CASE WHEN user_id % 3 = 0 AND verdict = 'block' THEN 'block' ELSE 'allow' END AS proxy, CASE WHEN user_id % 3 = 2 THEN 'allow' WHEN user_id % 3 = 1 AND verdict = 'block' THEN 'warn' ELSE verdict END AS daemon, CASE verdict WHEN 'block' THEN 'covered' WHEN 'warn' THEN 'interstitial' ELSE 'clear' END AS cover FROM v",
    "suppressed_warnings": f"WITH {_V} SELECT event_id, CASE WHEN verdict = 'warn' AND EXISTS (SELECT 1 FROM v d WHERE d.user_id = v.user_id AND d.verdict = 'override' AND d.ts <= v.ts AND floor(epoch(v.ts)) - floor(epoch(d.ts)) <= 7199) THEN 'allow' ELSE verdict END AS verdict FROM v",
    "protection_phases": PHASES_SQL,
    "gap_sessions": "WITH g AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k",
    "worst_verdicts": f"WITH {_V} SELECT user_id AS item, CASE max(CASE verdict WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'block' WHEN 1 THEN 'warn' ELSE 'allow' END AS action FROM v WHERE verdict <> 'override' GROUP BY user_id",
    "event_props": f"WITH {_V} SELECT verdict, count(*) AS n, round(sum(value), 4) AS points FROM v WHERE event_id % 6 > 0 AND verdict <> 'override' GROUP BY verdict",
    "surfaces": SURFACES_SQL,
    "screen_gate": SCREEN_SQL, "stream_screen_gate": SCREEN_SQL, "frame_gate": FRAME_SQL, "burst_gate": BURST_SQL, "stream_coalesced": STREAM_COALESCED_SQL, "cooldown_gate": COOLDOWN_SQL,
    "stream_suppressed": f"WITH {_V} SELECT event_id, CASE WHEN verdict = 'warn' AND EXISTS (SELECT 1 FROM v d WHERE d.user_id = v.user_id AND d.verdict = 'override' AND d.ts <= v.ts AND floor(epoch(v.ts)) - floor(epoch(d.ts)) <= 7199) THEN 'allow' ELSE verdict END AS verdict FROM v",
    "gate_outcomes_in_time": "SELECT a.event_id AS gate_id, a.user_id, CASE WHEN b.event_id IS NULL THEN 'open' WHEN b.value > 10 THEN 'left' ELSE 'stayed' END AS outcome FROM events a LEFT JOIN events b ON b.event_type = 'click' AND b.event_id = a.event_id + 2 AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 600 SECOND WHERE a.event_type = 'error'",
    "stream_gate_outcomes": "SELECT a.event_id AS gate_id, a.user_id, CASE WHEN b.event_id IS NULL THEN 'open' WHEN b.value > 10 THEN 'left' ELSE 'stayed' END AS outcome FROM events a LEFT JOIN events b ON b.event_type = 'click' AND b.event_id = a.event_id + 2 AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 600 SECOND WHERE a.event_type = 'error'",
    "stream_ingested": "SELECT event_id // 3 AS client_id, first(event_id ORDER BY ts, event_id) AS event_id, first(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY 1",
    "stream_rolling_counts": f"WITH {_V}, d AS (SELECT ts::DATE AS day, verdict, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day), f AS (SELECT s.day, x.verdict, coalesce(n, 0) AS n FROM s CROSS JOIN (SELECT DISTINCT verdict FROM d) x LEFT JOIN d ON d.day = s.day AND d.verdict = x.verdict) SELECT day, verdict, n, sum(n) OVER (PARTITION BY verdict ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)::BIGINT AS rolling FROM f",
    "stream_frame_gate": FRAME_SQL, "stream_burst_gate": BURST_SQL, "stream_cooldown_gate": COOLDOWN_SQL, "phase_changes": PHASE_CHANGES_SQL, "stream_phases": PHASE_CHANGES_SQL,
    "stream_live_counts": f"WITH {_V} SELECT date_trunc('day', ts)::TIMESTAMP AS day, verdict, count(*) AS n FROM v GROUP BY ALL",
    "stream_hosts": "SELECT event_id, event_type AS host, CASE event_type WHEN 'error' THEN 'block' WHEN 'click' THEN 'allow' ELSE 'proxy' END AS action FROM events",
    "stream_sessions": "WITH g AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_verdicts": VERDICTS_SQL,
    "trimmed_log": "SELECT user_id::VARCHAR AS device, greatest(count(*) - 50, 0) AS dropped FROM events GROUP BY user_id",
    "newest_log_rows": "SELECT user_id::VARCHAR AS device, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50",
    "guard_status": GUARD_SQL,
    "unprotected_notices": "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type = 'error' AND before IS DISTINCT FROM 'error'",
    "request_checks": "SELECT event_id, abs(event_id % 801 - 400) <= 300 AS fresh, event_id % 4 > 0 AS signed FROM events",
    "invite_states": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'accepted' WHEN ts + to_hours((event_id % 100)::INTEGER) < TIMESTAMP '2024-01-16' THEN 'expired' ELSE 'pending' END AS status FROM events",
    "undelivered": "SELECT event_id, event_id AS created_at FROM events WHERE event_type = 'error' ORDER BY event_id",
    "gate_outcomes": "SELECT a.event_id AS gate_id, a.user_id, CASE WHEN b.event_id IS NULL THEN 'open' WHEN b.value > 10 THEN 'left' ELSE 'stayed' END AS outcome FROM events a LEFT JOIN events b ON b.event_type = 'click' AND b.event_id = a.event_id + 1 WHERE a.event_type = 'error'",
    "feedback_routes": "SELECT event_id AS item, CASE WHEN user_id % 3 = 0 OR value % 1 BETWEEN 0.35::DOUBLE AND 0.65::DOUBLE THEN 'accept' ELSE 'human' END AS route FROM events WHERE event_type = 'signup'",
    "image_sizes": "WITH s AS (SELECT page_id, page_id % 400 AS w, length(url) * 30 % 1300 AS h FROM pages) SELECT page_id, CASE WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN least(w, h) < 96 THEN 'too_small' WHEN greatest(w, h) > 8 * least(w, h) THEN 'too_elongated' ELSE 'admissible' END AS admissible FROM s",
    "homoglyph_folds": """WITH l AS (SELECT doc_id, text, string_split(text, '') AS c FROM documents)
SELECT doc_id, md5(text) AS folded, md5(array_to_string(list_filter(c, lambda x, i: x = chr(10) OR i < 3 OR x <> c[i - 1] OR x <> c[i - 2]), '')) AS squeezed,
  md5(translate(replace(replace(replace(text, 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), '0|!', 'oll')) AS ocr FROM l""",
    "stream_idempotent": "SELECT DISTINCT event_id // 3 AS client_id FROM events",
}
