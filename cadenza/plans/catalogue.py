"""The engine's queries over the event tables, each with its SQL form.

The tables stand in for the data model: events are frames, users are sessions,
values are stage durations, event types are operations, toggles and streams.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import binary
from cadenza.functions import scalars as S
from cadenza.operators import flow, joins, ordering, pacing, rates, sync
from cadenza.schema import FORMATS, FPS_DEFAULT, IPC_SLOTS, MAX_FRAME_BYTES, PROTOCOL_VERSION, QUEUE_SECONDS
from cadenza.sources import commit, timing_log

# Units of the queries: an hour for rates (a week for one user's), five minutes for schedules, an hour for ticks, a day for windows.
UNIT_MS, USER_UNIT_MS = 3_600_000, 604_800_000
HOUR_US, DAY_US, THROTTLE_US = 3_600_000_000, 86_400_000_000, 300_000_000
USER, ORDER = ["user_id"], ["ts_us", "event_id"]


def events(spark, sf_dir: str) -> DataFrame:
    """Events with times in microseconds and, truncated, milliseconds."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", S.micros(F.col("ts")).alias("ts_us"))
    return raw.withColumn("ts_ms", S.bucket_of(F.col("ts_us"), 1000))


def _global(spark, sf: str) -> DataFrame:
    return ordering.with_global_intervals(events(spark, sf), ORDER)


def _by_user(spark, sf: str) -> DataFrame:
    return ordering.with_intervals(events(spark, sf), USER, ORDER)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})


_STATS = {"mean_ms": 4, "stddev_ms": 4, "rate": 6, "target_ms": 4, "cov": 6}


def pacing_summary(spark, sf: str) -> DataFrame:
    return _rounded(pacing.pacing_summary(_global(spark, sf), [], UNIT_MS), **_STATS)


def pacing_summary_by_user(spark, sf: str) -> DataFrame:
    return _rounded(pacing.pacing_summary(_by_user(spark, sf), USER, USER_UNIT_MS), **_STATS)


def interval_classes(spark, sf: str) -> DataFrame:
    return _rounded(pacing.classify_intervals(_by_user(spark, sf), USER, USER_UNIT_MS), ratio=6).select("event_id", "user_id", "interval_ms", "ratio", "class", "is_spike")


def interval_class_counts(spark, sf: str) -> DataFrame:
    return pacing.classify_intervals(_global(spark, sf), [], UNIT_MS).groupBy("class").agg(F.count("*").alias("n"))


def worst_gaps(spark, sf: str) -> DataFrame:
    return _rounded(pacing.worst_gaps(pacing.classify_intervals(_global(spark, sf), [], UNIT_MS)), ratio=6).select("frame_index", "ts_ms", "interval_ms", "ratio", "class")


def worst_gaps_by_user(spark, sf: str) -> DataFrame:
    return pacing.worst_gaps(pacing.classify_intervals(_by_user(spark, sf), USER, USER_UNIT_MS), 3, USER).select("user_id", "gap_rank", "frame_index", "interval_ms", "class")


def chart_scale(spark, sf: str) -> DataFrame:
    return _rounded(pacing.chart_scale(pacing.pacing_summary(_by_user(spark, sf), USER, USER_UNIT_MS), USER), scale_ms=4)


def summary_texts(spark, sf: str) -> DataFrame:
    return pacing.format_summary(pacing.pacing_summary(_by_user(spark, sf), USER, USER_UNIT_MS), USER).select("user_id", "frames", "range", "verdict")


def timing_log_rows(spark, sf: str) -> DataFrame:
    return _global(spark, sf).select("frame_index", F.col("ts_ms").alias("timestamp_ms"), "interval_ms")


def timing_log_scan(spark, sf: str) -> DataFrame:
    """Lines of a log, some of them damaged, read back."""
    line = F.when(F.col("event_id") % 11 == 3, F.concat_ws(",", F.col("event_id").cast("string"), F.lit(""), F.lit("5"))).when(F.col("event_id") % 11 == 5, F.concat_ws(",", F.col("event_id").cast("string"), F.lit("abc"), F.lit("7"))).when(F.col("event_id") % 11 == 7, F.col("event_id").cast("string")).otherwise(F.concat_ws(",", F.col("event_id").cast("string"), F.col("ts_ms").cast("string"), F.lit("9\r")))
    rows = timing_log.split_lines(events(spark, sf).select("user_id", F.col("event_id").alias("at"), line.alias("line")))
    return timing_log.coerced(rows, USER, ["at"]).filter("row_no > 0").select("user_id", "frame_index", "timestamp_ms", "interval_ms", "row_no")


def label_sample(spark, sf: str) -> DataFrame:
    return ordering.sample_evenly(_global(spark, sf)).select("label_no", "frame_index", "ts_ms")


def throttle(spark, sf: str) -> DataFrame:
    return flow.throttle(events(spark, sf), THROTTLE_US, USER, ORDER).select("event_id", "user_id", "accepted")


def drain_latest(spark, sf: str) -> DataFrame:
    wakeup = S.bucket_of(F.col("ts_us"), HOUR_US)
    return flow.drain_latest(events(spark, sf), wakeup, [], ORDER, ["event_id", "value"])


def tick_collisions(spark, sf: str) -> DataFrame:
    return flow.tick_collisions(events(spark, sf), HOUR_US, USER)


def repeat_last(spark, sf: str) -> DataFrame:
    return flow.repeat_last(events(spark, sf), DAY_US, USER, ["event_id"], "value").select("user_id", "tick_us", "last")


def delay_one(spark, sf: str) -> DataFrame:
    return ordering.delay_one(events(spark, sf), USER, ORDER, ["event_type"], "value").select("event_id", "user_id", "event_type", "delayed")


def carry_forward(spark, sf: str) -> DataFrame:
    sized = events(spark, sf).withColumn("size", F.when(F.col("event_type") == "purchase", F.col("value")))
    return ordering.carry_forward(sized, ["size"], USER, ORDER).select("event_id", "last_size")


def live_rate_tumbling(spark, sf: str) -> DataFrame:
    return rates.live_rate_tumbling(events(spark, sf), DAY_US, [], HOUR_US)


def live_rate_greedy(spark, sf: str) -> DataFrame:
    return rates.live_rate_greedy(events(spark, sf), DAY_US, USER, ORDER, HOUR_US).select("user_id", "window_no", "start_us", "end_us", "n", "rate")


def stage_means(spark, sf: str) -> DataFrame:
    day = S.bucket_of(F.col("ts_us"), DAY_US)
    return _rounded(rates.stage_means(events(spark, sf), day, [], ORDER, ["value"], F.col("event_type") == "view"), avg_value=4)


def stage_means_greedy(spark, sf: str) -> DataFrame:
    return _rounded(rates.closed_stage_means(events(spark, sf), DAY_US, USER, ORDER, ["value"]), avg_value=4)


def push_source(spark, sf: str) -> DataFrame:
    return flow.pushed_frames(events(spark, sf), S.bucket_of(F.col("ts_us"), HOUR_US), 6 * HOUR_US, USER, ORDER, ["value"]).select("user_id", "wakeup", "drained", "event_id", "value")


def write_stats(spark, sf: str) -> DataFrame:
    return _rounded(rates.write_stats(events(spark, sf), S.bucket_of(F.col("ts_us"), DAY_US), [], "value"), avg_write=4)


def slow_writes(spark, sf: str) -> DataFrame:
    return rates.slow_writes(events(spark, sf), "value").select("event_id", "value")


def _ops(spark, sf: str) -> DataFrame:
    return events(spark, sf).withColumn("op", F.when(F.col("event_type").isin("view", "click"), "pop").otherwise("push"))


def bounded_queue(spark, sf: str) -> DataFrame:
    return flow.bounded_queue(_ops(spark, sf), 6, USER, ORDER).select("user_id", "ts_us", "event_id", "op", "ok", "occupancy")


def ipc_queue(spark, sf: str) -> DataFrame:
    return flow.bounded_queue(_ops(spark, sf), IPC_SLOTS, USER, ORDER).groupBy("user_id").agg(F.count_if(F.col("ok") & (F.col("op") == "push")).alias("pushed"), F.count_if(~F.col("ok") & (F.col("op") == "push")).alias("dropped"), F.count_if(~F.col("ok") & (F.col("op") == "pop")).alias("empty"))


def queue_counters(spark, sf: str) -> DataFrame:
    pushes = events(spark, sf).select("user_id", (F.col("value") < 400).alias("ok"), (F.col("event_type") == "view").alias("is_backfill"))
    return rates.queue_counters(pushes, USER)


def completion_times(spark, sf: str) -> DataFrame:
    jobs = events(spark, sf).withColumn("service", (F.round(F.col("value")) * 60_000_000).cast("bigint"))
    return flow.completion_times(jobs, "ts_us", "service", USER, ORDER).select("event_id", "done", "waited")


def stage_deltas(spark, sf: str) -> DataFrame:
    marks = events(spark, sf).select("event_id", F.col("ts_us").alias("t0"), (F.col("ts_us") + F.round(F.col("value")).cast("bigint")).alias("t1"), (F.col("ts_us") + F.round(F.col("value") * 3).cast("bigint")).alias("t2"))
    return ordering.stage_deltas(marks, ["t0", "t1", "t2"]).select("event_id", "d_t1", "d_t2", "d_total")


def slots(spark, sf: str) -> DataFrame:
    return _by_user(spark, sf).select("event_id", S.slot_of(F.col("frame_index") + 1, FPS_DEFAULT * QUEUE_SECONDS).alias("slot"))


def sessionize(spark, sf: str) -> DataFrame:
    return ordering.sessionize(events(spark, sf), F.col("event_type") == "signup", USER, ORDER).select("event_id", "toggles", "recording", "recording_no", S.state_label(F.col("recording")).alias("label"))


def session_rate(spark, sf: str) -> DataFrame:
    return _rounded(sync.session_rate(events(spark, sf), USER, 30.0, HOUR_US), elapsed=4, rate=6)


def sync_offsets(spark, sf: str) -> DataFrame:
    e = events(spark, sf)
    video = sync.first_anchor(e, USER, F.col("event_type") == "view")
    tracks = sync.first_anchor(e.filter("event_type IN ('click', 'purchase')").withColumnRenamed("event_type", "stream"), ["user_id", "stream"], F.lit(True))
    return _rounded(sync.sync_offsets(video, tracks, USER, unit_us=HOUR_US), raw_s=6, track_s=6, video_s=6)


def audio_summary(spark, sf: str) -> DataFrame:
    packets = events(spark, sf).select("user_id", F.col("event_type").alias("stream"), "ts_us", F.floor("value").cast("int").alias("num_frames"), F.lit(8).alias("block_align"), (F.col("event_id") % 4).cast("int").alias("flags"))
    return _rounded(sync.audio_summary(packets, ["user_id", "stream"]), seconds=6)


def zipped_tracks(spark, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_id", "event_type", "value")
    return sync.zip_tracks({k: e.filter(F.col("event_type") == k).select("event_id", "value") for k in ("view", "click")})


def candidate_processes(spark, sf: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("pid"), (F.col("o_orderstatus") == "O").alias("visible"), F.col("o_orderpriority").alias("title"))
    return joins.candidate_processes(customers, orders)


def process_lines(spark, sf: str) -> DataFrame:
    return timing_log.tab_separated(candidate_processes(spark, sf), ["pid", "name"])


def admissible(spark, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/part.parquet")
    formats = F.array(*map(F.lit, (*FORMATS, "R16G16B16A16_FLOAT")))
    shaped = parts.select("p_partkey", F.element_at(formats, (F.col("p_partkey") % 5 + 1).cast("int")).alias("format"), (F.col("p_size") * 64).alias("width"), (F.col("p_size") * 32).alias("height"))
    size = F.col("width").cast("bigint") * F.col("height") * 4
    return shaped.select("p_partkey", S.admissible(F.col("format"), F.col("width"), F.col("height")).alias("admissible"), S.fits_slot(size).alias("fits"))


def parameters(spark, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_id", (F.col("event_id") % 400 - 50).alias("x"))
    text = F.when(F.col("x") % 7 == 0, "abc").when(F.col("x") % 7 == 1, F.concat(F.col("x").cast("string"), F.lit("fps"))).otherwise(F.col("x").cast("string"))
    fps = S.effective_fps(text)
    return e.select(
        "event_id",
        fps.cast("bigint").alias("fps"),
        S.even(F.col("x")).alias("even"),
        S.poll_timeout_ms(fps).alias("timeout_ms"),
        F.round(S.refresh_hz(F.lit(60_000.0), (F.col("x") % 5).cast("double")), 4).alias("hz"),
        S.is_float_format((F.col("x") % 4).cast("int"), F.lit(0), F.lit(0)).alias("is_float"),
    )


def recording_rates(spark, sf: str) -> DataFrame:
    return _rounded(sync.recording_rates(events(spark, sf), F.col("event_type") == "signup", USER, ORDER, 30.0, HOUR_US), elapsed=4, rate=6)


def coalesced_wakeups(spark, sf: str) -> DataFrame:
    return flow.coalesced_wakeups(events(spark, sf), DAY_US, 6 * HOUR_US, USER, ORDER).select("event_id", "user_id", "wakeup_no", "wakeup_us", "timeouts")


def frame_polls(spark, sf: str) -> DataFrame:
    return flow.polls(events(spark, sf), DAY_US, USER, ORDER, ["event_id", "value"])


def cleared_queue(spark, sf: str) -> DataFrame:
    """A queue that some operations empty."""
    ops = events(spark, sf).withColumn("op", F.when(F.col("event_type") == "view", "pop").when(F.col("event_type") == "signup", "clear").otherwise("push"))
    return flow.bounded_queue(ops, 6, USER, ORDER).select("event_id", "op", "ok", "occupancy", (F.col("occupancy") == 0).alias("is_empty"))


def chart_points(spark, sf: str) -> DataFrame:
    rows = _by_user(spark, sf)
    return _rounded(pacing.chart_points(rows, pacing.pacing_summary(rows, USER, USER_UNIT_MS), USER), x=4, y=4).select("event_id", "user_id", "x", "y")


def epoch_stamps(spark, sf: str) -> DataFrame:
    """The stamp of every session's file, and how many sessions have the same."""
    raw = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.min("ts").alias("ts"))
    return raw.groupBy(S.epoch_seconds(F.col("ts")).alias("stamp")).agg(F.count("*").alias("sessions"))


def arguments(spark, sf: str) -> DataFrame:
    """Command lines with flags and values, some of them missing."""
    e = events(spark, sf).select("event_id")
    n = F.col("event_id")
    parts = F.filter(
        F.array(F.lit("rec"), F.when(n % 2 == 0, "--fps"), F.when(n % 6 == 0, (n % 300 - 20).cast("string")), F.when(n % 3 == 0, "--mic"), F.when(n % 5 == 0, "--inject"), F.when(n % 10 == 0, (n * 7).cast("string")), F.when(n % 7 == 0, "--list-processes")),
        lambda x: x.isNotNull(),
    )
    return e.select(
        "event_id",
        S.effective_fps(S.argument_of(parts, "--fps")).cast("bigint").alias("fps"),
        S.target_pid(parts).cast("bigint").alias("pid"),
        S.has_flag(parts, "--mic").alias("mic"),
        S.has_flag(parts, "--list-processes").alias("lists"),
    )


def _stages(spark, sf: str) -> DataFrame:
    """Six durations of a capture iteration; they are whole numbers, so that means are exact."""
    v = F.floor(F.col("value") * 100)
    return events(spark, sf).select("event_id", "user_id", "event_type", "ts_us", *((F.floor(v / k)).cast("double").alias(c) for k, c in enumerate(CAPTURE_STAGES, 1)))


def capture_stage_means(spark, sf: str) -> DataFrame:
    """All six stages of recording iterations, over windows that the iterations restart."""
    recording = _stages(spark, sf).filter("event_type <> 'view'")
    told = rates.closed_stage_means(recording, DAY_US, USER, ORDER, list(CAPTURE_STAGES))
    return _rounded(told, **{f"avg_{c}": 4 for c in CAPTURE_STAGES}).select("user_id", "window_no", "n", *(f"avg_{c}" for c in CAPTURE_STAGES))


def present_stage_means(spark, sf: str) -> DataFrame:
    """All seven stages of a presented frame from its marks, by window, and the frames that were still drawing."""
    marks = ["t0", *(f"t{k}" for k in range(1, 7))]
    timed = events(spark, sf).select("event_id", "ts_us", (F.col("event_id") % 5 == 0).alias("still_drawing"), *((F.col("ts_us") + F.floor(F.col("value") * (k * k)).cast("bigint")).alias(m) for k, m in enumerate(marks)))
    deltas = ordering.stage_deltas(timed, marks)
    names = [f"d_t{k}" for k in range(1, 7)] + ["d_total"]
    told = rates.stage_means(deltas, S.bucket_of(F.col("ts_us"), DAY_US), [], ORDER, names, F.col("still_drawing"))
    return _rounded(told, **{f"avg_{c}": 4 for c in names}).select("window", "n", "n_counted", *(f"avg_{c}" for c in names))


def committed_table(spark, sf: str) -> DataFrame:
    """A table that is written, read, and replaced by what was read from it."""
    path = f"{commit.shared_folder(spark)}/committed-{uuid.uuid4().hex}"
    commit.replace_parquet(events(spark, sf).select("event_id", "event_type", "value"), path)
    commit.replace_parquet(spark.read.parquet(path).filter("event_type = 'purchase'"), path)
    return spark.read.parquet(path).select("event_id", "value")


def source_fallback(spark, sf: str) -> DataFrame:
    """The first source isn't there, so the second one counts."""
    return timing_log.first_available(lambda: spark.read.parquet(f"{sf}/no_such_table.parquet"), lambda: events(spark, sf)).select("event_id", "value")


def version_gate(spark, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_id", F.lit(PROTOCOL_VERSION).alias("version"))
    return timing_log.require_version(rows, F.col("version")).select("event_id")


def pixels(spark, sf: str) -> DataFrame:
    """Two rows of one pixel and two bytes of padding, as hexadecimal text."""
    e = events(spark, sf).select("event_id", F.lpad(F.hex(F.col("event_id")), 8, "0").alias("x"))
    data = F.unhex(F.concat("x", F.lit("AAAA"), F.reverse("x"), F.lit("BBBB")))
    return e.select("event_id", F.hex(binary.normalize_pixels(data, F.lit(1), F.lit(2), F.lit(6), F.col("event_id") % 2 == 0)).alias("pixels"))


def wav_headers(spark, sf: str) -> DataFrame:
    """Headers of sounds of several formats, decoded."""
    made = [(k, binary.wav_header(k % 2 == 1, 1 + k % 2, 48_000, 16 * (1 + k % 2), 1000 * k)) for k in range(6)]
    table = spark.createDataFrame(made, "k bigint, header binary")
    w = binary.decoded_wav_header(F.col("header"))
    return events(spark, sf).select("event_id", (F.col("event_id") % 6).alias("k")).join(F.broadcast(table), "k").select("event_id", w["format"].alias("format"), w["channels"].alias("channels"), w["byte_rate"].alias("byte_rate"), w["block_align"].alias("block_align"), w["bits"].alias("bits"), w["riff_size"].alias("riff_size"), w["data_size"].alias("data_size"))


CAPTURE_STAGES = ("capture_ms", "cache_ms", "push_ms", "requested_sleep_ms", "actual_sleep_ms", "total_ms")


def queries() -> dict:
    return {
        "recording_rates": recording_rates,
        "coalesced_wakeups": coalesced_wakeups,
        "frame_polls": frame_polls,
        "cleared_queue": cleared_queue,
        "chart_points": chart_points,
        "epoch_stamps": epoch_stamps,
        "arguments": arguments,
        "capture_stage_means": capture_stage_means,
        "present_stage_means": present_stage_means,
        "committed_table": committed_table,
        "source_fallback": source_fallback,
        "version_gate": version_gate,
        "pixels": pixels,
        "wav_headers": wav_headers,
        "pacing_summary": pacing_summary,
        "pacing_summary_by_user": pacing_summary_by_user,
        "interval_classes": interval_classes,
        "interval_class_counts": interval_class_counts,
        "worst_gaps": worst_gaps,
        "worst_gaps_by_user": worst_gaps_by_user,
        "chart_scale": chart_scale,
        "summary_texts": summary_texts,
        "timing_log": timing_log_rows,
        "timing_log_scan": timing_log_scan,
        "label_sample": label_sample,
        "throttle": throttle,
        "drain_latest": drain_latest,
        "tick_collisions": tick_collisions,
        "repeat_last": repeat_last,
        "delay_one": delay_one,
        "carry_forward": carry_forward,
        "live_rate_tumbling": live_rate_tumbling,
        "live_rate_greedy": live_rate_greedy,
        "stage_means": stage_means,
        "stage_means_greedy": stage_means_greedy,
        "push_source": push_source,
        "write_stats": write_stats,
        "slow_writes": slow_writes,
        "bounded_queue": bounded_queue,
        "ipc_queue": ipc_queue,
        "queue_counters": queue_counters,
        "completion_times": completion_times,
        "stage_deltas": stage_deltas,
        "slots": slots,
        "sessionize": sessionize,
        "session_rate": session_rate,
        "sync_offsets": sync_offsets,
        "audio_summary": audio_summary,
        "zipped_tracks": zipped_tracks,
        "candidate_processes": candidate_processes,
        "process_lines": process_lines,
        "admissible": admissible,
        "parameters": parameters,
    }


_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS ts_us, epoch_us(ts) // 1000 AS ts_ms FROM events)"
_G = f"{_E}, g AS (SELECT *, row_number() OVER o - 1 AS frame_index, coalesce(ts_ms - lag(ts_ms) OVER o, 0) AS interval_ms FROM e WINDOW o AS (ORDER BY ts_us, event_id))"
_U = f"{_E}, g AS (SELECT *, row_number() OVER o - 1 AS frame_index, coalesce(ts_ms - lag(ts_ms) OVER o, 0) AS interval_ms FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts_us, event_id))"


def _summary(keys: str) -> str:
    """CTEs a (aggregates) and s (summary) over g."""
    unit = USER_UNIT_MS if keys else UNIT_MS
    pre, by = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""a AS (SELECT {pre}count(*) AS n, avg(interval_ms) AS mean_ms, stddev_pop(interval_ms) AS stddev_ms, min(interval_ms) AS min_ms, max(interval_ms) AS max_ms FROM g WHERE frame_index > 0 {by}),
b AS (SELECT *, CASE WHEN mean_ms <> 0 THEN {unit} / mean_ms END AS rate, CASE WHEN mean_ms <> 0 THEN stddev_ms / mean_ms END AS cov FROM a WHERE n >= 2),
s AS (SELECT *, CASE WHEN floor(rate + 0.5) <> 0 THEN {unit} / floor(rate + 0.5) END AS target_ms, CASE WHEN cov < 0.15 THEN 'good' WHEN cov < 0.4 THEN 'warn' ELSE 'crit' END AS severity FROM b)"""


_SUMMARY_COLUMNS = "n, n + 1 AS frames, round(mean_ms, 4) AS mean_ms, round(stddev_ms, 4) AS stddev_ms, min_ms, max_ms, round(rate, 6) AS rate, round(target_ms, 4) AS target_ms, round(cov, 6) AS cov, severity"
_CLASS = "CASE WHEN interval_ms / target_ms > 1.5 THEN 'crit' WHEN interval_ms / target_ms > 1.15 THEN 'warn' ELSE 'good' END"
_QUEUE = """o AS (SELECT user_id, ts_us, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'pop' ELSE 'push' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS i FROM e),
q AS (SELECT user_id, ts_us, event_id, op, i, op = 'push' AS ok, (op = 'push')::BIGINT AS occupancy FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.ts_us, o.event_id, o.op, o.i, CASE o.op WHEN 'push' THEN q.occupancy < {held} ELSE q.occupancy > 0 END,
    q.occupancy + CASE WHEN o.op = 'push' AND q.occupancy < {held} THEN 1 WHEN o.op = 'pop' AND q.occupancy > 0 THEN -1 ELSE 0 END
  FROM q JOIN o ON o.user_id = q.user_id AND o.i = q.i + 1)"""


_RESTARTED = f"""o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS i FROM e),
w AS (SELECT user_id, i, ts_us, event_id, value, NULL::BIGINT AS no, ts_us AS next_start, 0 AS next_no, false AS closes FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i, o.ts_us, o.event_id, o.value, w.next_no, CASE WHEN o.ts_us - w.next_start >= {DAY_US} THEN o.ts_us ELSE w.next_start END, w.next_no + (o.ts_us - w.next_start >= {DAY_US})::INT, o.ts_us - w.next_start >= {DAY_US}
  FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)"""


_CLEARED = """o AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'pop' WHEN 'signup' THEN 'clear' ELSE 'push' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS i FROM e),
q AS (SELECT user_id, event_id, op, i, op <> 'pop' AS ok, (op = 'push')::BIGINT AS occupancy FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.op, o.i, CASE o.op WHEN 'push' THEN q.occupancy < 5 WHEN 'pop' THEN q.occupancy > 0 ELSE true END,
    CASE o.op WHEN 'push' THEN least(q.occupancy + 1, 5) WHEN 'pop' THEN greatest(q.occupancy - 1, 0) ELSE 0 END
  FROM q JOIN o ON o.user_id = q.user_id AND o.i = q.i + 1)"""


def _waits() -> str:
    later = "o.ts_us > w.wakeup_us"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS i FROM e),
w AS (SELECT user_id, i, event_id, 0::BIGINT AS wakeup_no, ts_us AS wakeup_us, 0::BIGINT AS timeouts FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i, o.event_id, w.wakeup_no + ({later})::BIGINT, CASE WHEN {later} THEN greatest(o.ts_us, w.wakeup_us + {DAY_US}) ELSE w.wakeup_us END,
    CASE WHEN {later} THEN greatest(0, (o.ts_us - w.wakeup_us - {DAY_US}) // {6 * HOUR_US}) ELSE w.timeouts END
  FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)"""


def oracle_sql() -> dict[str, str]:
    day, hour = DAY_US, HOUR_US
    stages = ", ".join(f"floor(floor(value * 100) / {k}) AS {c}" for k, c in enumerate(CAPTURE_STAGES, 1))
    marks = ", ".join(f"floor(value * {k * k})::BIGINT - floor(value * {(k - 1) ** 2})::BIGINT AS d_t{k}" for k in range(1, 7))
    deltas = [f"d_t{k}" for k in range(1, 7)] + ["d_total"]
    return {
        "recording_rates": f"WITH {_E}, t AS (SELECT *, event_type = 'signup' AS toggle, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts_us, event_id)::BIGINT AS toggles FROM e), r AS (SELECT user_id, (toggles + 1) // 2 AS recording_no, min(ts_us) FILTER (toggle AND toggles % 2 = 1) AS started_us, max(ts_us) FILTER (toggle AND toggles % 2 = 0) AS stopped_us, count(*) FILTER (NOT toggle) AS n FROM t WHERE toggles % 2 = 1 OR (toggle AND toggles > 0) GROUP BY 1, 2) SELECT user_id, recording_no, started_us, stopped_us, n, round((stopped_us - started_us) / {hour}.0::DOUBLE, 4) AS elapsed, round(CASE WHEN stopped_us > started_us THEN n / ((stopped_us - started_us) / {hour}.0::DOUBLE) ELSE 30 END, 6) AS rate FROM r WHERE stopped_us IS NOT NULL",
        "coalesced_wakeups": f"WITH RECURSIVE {_E}, {_waits()} SELECT event_id, user_id, wakeup_no, wakeup_us, timeouts FROM w",
        "frame_polls": f"WITH {_E}, d AS (SELECT user_id, ts_us // {day} + 1 AS wakeup, count(*) AS drained, arg_max(event_id, (ts_us, event_id)) AS event_id, arg_max(value, (ts_us, event_id)) AS value FROM e GROUP BY 1, 2), t AS (SELECT user_id, unnest(generate_series(min(wakeup), max(wakeup))) AS wakeup FROM d GROUP BY user_id) SELECT t.user_id, t.wakeup * {day} AS poll_us, d.user_id IS NOT NULL AS got, coalesce(drained, 0) AS drained, event_id, value FROM t LEFT JOIN d ON d.user_id = t.user_id AND d.wakeup = t.wakeup",
        "cleared_queue": f"WITH RECURSIVE {_E}, {_CLEARED} SELECT event_id, op, ok, occupancy, occupancy = 0 AS is_empty FROM q",
        "chart_points": f"WITH {_U}, {_summary('user_id')} SELECT event_id, user_id, round(50 + (frame_index - 1)::DOUBLE / (n - 1) * (greatest(700, n * 4) - 66), 4) AS x, round(192 - interval_ms / greatest(max_ms, coalesce(target_ms * 1.5, 0)) * 180, 4) AS y FROM g JOIN s USING (user_id) WHERE frame_index > 0",
        "epoch_stamps": f"WITH {_E} SELECT stamp, count(*) AS sessions FROM (SELECT user_id, min(ts_us) // 1000000 AS stamp FROM e GROUP BY user_id) GROUP BY stamp",
        "arguments": "SELECT event_id, CASE WHEN event_id % 6 = 0 AND event_id % 300 - 20 > 0 THEN least(240, event_id % 300 - 20) ELSE 30 END AS fps, CASE WHEN event_id % 10 = 0 THEN event_id * 7 ELSE 0 END AS pid, event_id % 3 = 0 AS mic, event_id % 7 = 0 AS lists FROM events",
        "capture_stage_means": f"WITH RECURSIVE {_E}, c AS (SELECT * FROM e WHERE event_type <> 'view'), {_RESTARTED.replace('FROM e)', 'FROM c)')}, v AS (SELECT *, {stages} FROM w) SELECT user_id, no AS window_no, count(*) AS n, {', '.join(f'round(avg({c}), 4) AS avg_{c}' for c in CAPTURE_STAGES)} FROM v WHERE no IS NOT NULL GROUP BY user_id, no HAVING bool_or(closes)",
        "present_stage_means": f"WITH {_E}, m AS (SELECT ts_us, event_id % 5 = 0 AS still, {marks}, floor(value * 36)::BIGINT AS d_total FROM e) SELECT ts_us // {day} AS \"window\", count(*) AS n, count(*) FILTER (still) AS n_counted, {', '.join(f'round(avg({c}), 4) AS avg_{c}' for c in deltas)} FROM m GROUP BY 1",
        "committed_table": "SELECT event_id, value FROM events WHERE event_type = 'purchase'",
        "source_fallback": "SELECT event_id, value FROM events",
        "version_gate": "SELECT event_id FROM events",
        "pixels": "WITH x AS (SELECT event_id, lpad(printf('%X', event_id), 8, '0') AS a, reverse(lpad(printf('%X', event_id), 8, '0')) AS b FROM events) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN a[5:6] || a[3:4] || a[1:2] || a[7:8] || b[5:6] || b[3:4] || b[1:2] || b[7:8] ELSE a || b END AS pixels FROM x",
        "wav_headers": "WITH x AS (SELECT event_id, event_id % 6 AS k FROM events) SELECT event_id, CASE WHEN k % 2 = 1 THEN 3 ELSE 1 END::BIGINT AS format, 1 + k % 2 AS channels, 48000 * (1 + k % 2) * 2 * (1 + k % 2) AS byte_rate, (1 + k % 2) * 2 * (1 + k % 2) AS block_align, 16 * (1 + k % 2) AS bits, 36 + 1000 * k AS riff_size, 1000 * k AS data_size FROM x",
        "pacing_summary": f"WITH {_G}, {_summary('')} SELECT {_SUMMARY_COLUMNS} FROM s",
        "pacing_summary_by_user": f"WITH {_U}, {_summary('user_id')} SELECT user_id, {_SUMMARY_COLUMNS} FROM s",
        "interval_classes": f"WITH {_U}, {_summary('user_id')} SELECT event_id, user_id, interval_ms, round(interval_ms / target_ms, 6) AS ratio, {_CLASS} AS class, coalesce(interval_ms / target_ms > 1.5, false) AS is_spike FROM g JOIN s USING (user_id) WHERE frame_index > 0",
        "interval_class_counts": f"WITH {_G}, {_summary('')} SELECT {_CLASS} AS class, count(*) AS n FROM g, s WHERE frame_index > 0 GROUP BY 1",
        "worst_gaps": f"WITH {_G}, {_summary('')} SELECT frame_index, ts_ms, interval_ms, round(interval_ms / target_ms, 6) AS ratio, {_CLASS} AS class FROM g, s WHERE frame_index > 0 ORDER BY interval_ms DESC, frame_index LIMIT 25",
        "worst_gaps_by_user": f"WITH {_U}, {_summary('user_id')} SELECT user_id, gap_rank, frame_index, interval_ms, {_CLASS} AS class FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY interval_ms DESC, frame_index) AS gap_rank FROM g JOIN s USING (user_id) WHERE frame_index > 0) WHERE gap_rank <= 3",
        "chart_scale": f"WITH {_U}, {_summary('user_id')} SELECT user_id, round(greatest(max_ms, coalesce(target_ms * 1.5, 0)), 4) AS scale_ms FROM s",
        "summary_texts": f"WITH {_U}, {_summary('user_id')} SELECT user_id, (n + 1)::VARCHAR AS frames, printf('%d-%d', min_ms, max_ms) AS range, CASE severity WHEN 'good' THEN 'steady pacing' WHEN 'warn' THEN 'moderate jitter' ELSE 'severe jitter' END || '; largest gap ' || max_ms || ' ms, target ' || coalesce(printf('%.1f', target_ms), 'none') || ' ms' AS verdict FROM s",
        "timing_log": f"WITH {_G} SELECT frame_index, ts_ms AS timestamp_ms, interval_ms FROM g",
        "timing_log_scan": f"WITH {_E}, r AS (SELECT user_id, event_id::DOUBLE AS frame_index, CASE WHEN event_id % 11 = 3 THEN 0.0 WHEN event_id % 11 IN (5, 7) THEN NULL ELSE ts_ms::DOUBLE END AS timestamp_ms, CASE WHEN event_id % 11 = 3 THEN 5.0 ELSE 9.0 END AS interval_ms, event_id FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_no FROM r WHERE timestamp_ms IS NOT NULL) SELECT user_id, frame_index, timestamp_ms, interval_ms::DOUBLE AS interval_ms, row_no FROM n WHERE row_no > 0",
        "label_sample": f"WITH {_G}, c AS (SELECT count(*) AS n, least(8, count(*)) AS k FROM g), l AS (SELECT i AS label_no, CASE WHEN k > 1 THEN floor(i * (n - 1) / (k - 1) + 0.5) ELSE 0 END::BIGINT AS frame_index FROM c, range(8) t(i) WHERE i < k) SELECT label_no, frame_index, ts_ms FROM l JOIN g USING (frame_index)",
        "throttle": f"WITH {_E}, c AS (SELECT *, row_number() OVER o AS i, (ts_us - first(ts_us) OVER o) // {THROTTLE_US} + 1 AS c FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts_us, event_id)), a AS (SELECT *, i + min(c - i) OVER (PARTITION BY user_id ORDER BY i) AS a FROM c) SELECT event_id, user_id, a > coalesce(lag(a) OVER (PARTITION BY user_id ORDER BY i), 0) AS accepted FROM a",
        "drain_latest": f"WITH {_E} SELECT ts_us // {hour} AS wakeup, count(*) AS drained, arg_max(event_id, (ts_us, event_id)) AS event_id, arg_max(value, (ts_us, event_id)) AS value FROM e GROUP BY 1",
        "tick_collisions": f"WITH {_E} SELECT user_id, count(*) AS n, count(DISTINCT ts_us // {hour}) AS ticks, count(*) - count(DISTINCT ts_us // {hour}) AS merged FROM e GROUP BY user_id",
        "repeat_last": f"WITH {_E}, b AS (SELECT user_id, min(ts_us) // {day} * {day} AS lo, max(ts_us) // {day} * {day} AS hi FROM e GROUP BY user_id), t AS (SELECT user_id, unnest(generate_series(lo, hi, {day})) AS tick_us FROM b), r AS (SELECT t.user_id, tick_us, arg_max(value, (ts_us, event_id)) AS last FROM t LEFT JOIN e ON e.user_id = t.user_id AND e.ts_us <= t.tick_us GROUP BY t.user_id, tick_us) SELECT * FROM r",
        "delay_one": f"WITH {_E}, c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER o OR row_number() OVER o = 1)::INT AS ch FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts_us, event_id)), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS run FROM c), l AS (SELECT event_id, user_id, event_type, lag(value) OVER q AS delayed, row_number() OVER q AS k FROM r WINDOW q AS (PARTITION BY user_id, run ORDER BY ts_us, event_id)) SELECT event_id, user_id, event_type, delayed FROM l WHERE k > 1",
        "carry_forward": f"WITH {_E} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS last_size FROM e",
        "live_rate_tumbling": f"WITH {_E} SELECT ts_us // {day} * {day} AS window_us, count(*) AS n, floor(count(*) / 24.0 + 0.5)::INT AS rate FROM e GROUP BY 1",
        "live_rate_greedy": f"WITH RECURSIVE {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS i FROM e), w AS (SELECT user_id, i, ts_us, NULL::BIGINT AS no, ts_us AS start_us, ts_us AS next_start, 0 AS next_no, false AS closes FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.ts_us, w.next_no, w.next_start, CASE WHEN o.ts_us - w.next_start >= {day} THEN o.ts_us ELSE w.next_start END, w.next_no + (o.ts_us - w.next_start >= {day})::INT, o.ts_us - w.next_start >= {day} FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1) SELECT user_id, no AS window_no, start_us, max(CASE WHEN closes THEN ts_us END) AS end_us, count(*) AS n, floor(count(*) / ((max(CASE WHEN closes THEN ts_us END) - start_us) / {hour}.0) + 0.5)::INT AS rate FROM w WHERE no IS NOT NULL GROUP BY user_id, no, start_us HAVING max(CASE WHEN closes THEN ts_us END) IS NOT NULL",
        "stage_means": f"WITH {_E} SELECT ts_us // {day} AS \"window\", count(*) AS n, round(avg(value), 4) AS avg_value, arg_max(value, (ts_us, event_id)) AS last_value, count(*) FILTER (event_type = 'view') AS n_counted FROM e GROUP BY 1",
        "stage_means_greedy": f"WITH RECURSIVE {_E}, {_RESTARTED} SELECT user_id, no AS window_no, count(*) AS n, round(avg(value), 4) AS avg_value, arg_max(value, (ts_us, event_id)) AS last_value FROM w WHERE no IS NOT NULL GROUP BY user_id, no HAVING bool_or(closes)",
        "push_source": f"WITH {_E}, d AS (SELECT user_id, ts_us // {hour} AS wakeup, count(*) AS drained, arg_max(ts_us, (ts_us, event_id)) AS ts_us, arg_max(event_id, (ts_us, event_id)) AS event_id, arg_max(value, (ts_us, event_id)) AS value FROM e GROUP BY 1, 2), c AS (SELECT *, row_number() OVER o AS i, (ts_us - first(ts_us) OVER o) // {6 * hour} + 1 AS c FROM d WINDOW o AS (PARTITION BY user_id ORDER BY ts_us, event_id)), a AS (SELECT *, i + min(c - i) OVER (PARTITION BY user_id ORDER BY i) AS a FROM c), l AS (SELECT *, lag(a) OVER (PARTITION BY user_id ORDER BY i) AS b FROM a) SELECT user_id, wakeup, drained, event_id, value FROM l WHERE a > coalesce(b, 0)",
        "write_stats": f"WITH {_E} SELECT ts_us // {day} AS \"window\", round(avg(value), 4) AS avg_write, max(value) AS max_write, count(value) AS n, count(*) FILTER (value > 20) AS slow FROM e GROUP BY 1",
        "slow_writes": f"WITH {_E} SELECT event_id, value FROM e WHERE value > 20",
        "bounded_queue": f"WITH RECURSIVE {_E}, {_QUEUE.format(held=5)} SELECT user_id, ts_us, event_id, op, ok, occupancy FROM q",
        "ipc_queue": f"WITH RECURSIVE {_E}, {_QUEUE.format(held=3)} SELECT user_id, count(*) FILTER (ok AND op = 'push') AS pushed, count(*) FILTER (NOT ok AND op = 'push') AS dropped, count(*) FILTER (NOT ok AND op = 'pop') AS empty FROM q GROUP BY user_id",
        "queue_counters": f"WITH {_E} SELECT user_id, count(*) FILTER (value < 400) AS recorded, count(*) FILTER (NOT value < 400 AND event_type <> 'view') AS dropped FROM e GROUP BY user_id",
        "completion_times": f"WITH {_E}, j AS (SELECT *, (round(value) * 60000000)::BIGINT AS service FROM e), s AS (SELECT *, sum(service) OVER o AS s FROM j WINDOW o AS (PARTITION BY user_id ORDER BY ts_us, event_id)), d AS (SELECT *, s + max(ts_us - (s - service)) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS done FROM s) SELECT event_id, done::BIGINT AS done, (done - service - ts_us)::BIGINT AS waited FROM d",
        "stage_deltas": f"WITH {_E} SELECT event_id, round(value)::BIGINT AS d_t1, round(value * 3)::BIGINT - round(value)::BIGINT AS d_t2, round(value * 3)::BIGINT AS d_total FROM e",
        "slots": f"WITH {_U} SELECT event_id, (frame_index % 150)::INT AS slot FROM g",
        "sessionize": f"WITH {_E}, t AS (SELECT event_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts_us, event_id)::BIGINT AS toggles FROM e) SELECT event_id, toggles, toggles % 2 = 1 AS recording, CASE WHEN toggles % 2 = 1 THEN (toggles + 1) // 2 END AS recording_no, CASE WHEN toggles % 2 = 1 THEN 'REC' ELSE 'IDLE' END AS label FROM t",
        "session_rate": f"WITH {_E}, r AS (SELECT user_id, count(*) AS n, (max(ts_us) - min(ts_us)) / {hour}.0::DOUBLE AS elapsed FROM e GROUP BY user_id) SELECT user_id, n, round(elapsed, 4) AS elapsed, round(CASE WHEN elapsed <> 0 THEN n / elapsed ELSE 30 END, 6) AS rate FROM r",
        "sync_offsets": f"WITH {_E}, v AS (SELECT user_id, min(ts_us) AS v FROM e WHERE event_type = 'view' GROUP BY user_id), t AS (SELECT user_id, event_type AS stream, min(ts_us) AS anchor_us FROM e WHERE event_type IN ('click', 'purchase') GROUP BY user_id, event_type), r AS (SELECT user_id, stream, (anchor_us - v) / {hour}.0::DOUBLE AS raw FROM t JOIN v USING (user_id)), m AS (SELECT user_id, least(0, min(raw)) AS m FROM r GROUP BY user_id) SELECT user_id, stream, round(raw, 6) AS raw_s, round(raw - m, 6) AS track_s, round(-m + 0.0, 6) AS video_s FROM r JOIN m USING (user_id)",
        "audio_summary": f"WITH {_E} SELECT user_id, event_type AS stream, count(*) AS packets, sum(floor(value)::BIGINT)::BIGINT AS frames, sum(CASE WHEN (event_id % 4) & 2 <> 0 THEN floor(value)::BIGINT ELSE 0 END)::BIGINT AS silent_frames, sum(floor(value)::BIGINT * 8)::BIGINT AS bytes, (sum(floor(value)::BIGINT * 8) % 4294967296)::BIGINT AS header_bytes, round(sum(floor(value)::BIGINT) / 48000.0::DOUBLE, 6) AS seconds, min(CASE WHEN floor(value) > 0 THEN ts_us END) AS anchor_us FROM e GROUP BY user_id, event_type",
        "zipped_tracks": "SELECT event_id, value, event_type AS track_id FROM events WHERE event_type IN ('view', 'click')",
        "candidate_processes": "SELECT c_custkey AS pid, c_name AS name FROM customer WHERE c_custkey <> 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND length(o_orderpriority) > 0)",
        "process_lines": "SELECT c_custkey || chr(9) || c_name AS line FROM customer WHERE c_custkey <> 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND length(o_orderpriority) > 0)",
        "admissible": f"SELECT p_partkey, p_partkey % 5 < 4 AND p_size * 64 <= 1920 AND p_size * 32 <= 1080 AS admissible, p_size::BIGINT * 64 * p_size * 32 * 4 <= {MAX_FRAME_BYTES} AS fits FROM part",
        "parameters": f"WITH {_E}, x AS (SELECT event_id, event_id % 400 - 50 AS x FROM e), f AS (SELECT *, CASE WHEN x % 7 = 0 OR x <= 0 THEN 30 ELSE greatest(1, least(240, x)) END AS fps FROM x) SELECT event_id, fps, trunc(x / 2)::BIGINT * 2 AS even, greatest(1, (1000 // fps) // 2) AS timeout_ms, round(CASE WHEN x % 5 <> 0 THEN 60000.0::DOUBLE / (x % 5) ELSE 0 END, 4) AS hz, x % 4 = 3 AS is_float FROM f",
    }
