"""Scalar rules as column expressions; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.schema import CLASS_CRIT, CLASS_WARN, FORMATS, FPS_DEFAULT, FPS_MAX, FPS_MIN, MAX_FRAME_BYTES, MAX_HEIGHT, MAX_WIDTH, SEVERITY_GOOD, SEVERITY_WARN, SILENT_FLAG, SLOW_WRITE_MS


def micros(ts: Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer quotient towards zero; null for a zero divisor."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def bucket_of(x: Column, unit: int) -> Column:
    """Number of the unit that an integer falls in, rounded down in integer arithmetic."""
    x = x.cast("bigint")
    size = F.lit(unit).cast("bigint")
    return F.call_function("div", x - F.pmod(x, size), size)


def severity(cov: Column) -> Column:
    """Pacing severity of a coefficient of variation; null is the worst."""
    return F.when(cov < SEVERITY_GOOD, "good").when(cov < SEVERITY_WARN, "warn").otherwise("crit")


def interval_class(ratio: Column) -> Column:
    """Class of an interval by its ratio to the target; a null ratio (no finite target) is good."""
    return F.when(ratio > CLASS_CRIT, "crit").when(ratio > CLASS_WARN, "warn").otherwise("good")


def is_spike(ratio: Column) -> Column:
    return F.coalesce(ratio > CLASS_CRIT, F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, as text."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double")))


def verdict(cov: Column, largest: Column, target: Column) -> Column:
    """A sentence for the severity, naming the largest gap and the target."""
    grade = severity(cov)
    gap, goal = fixed(largest, 0), F.coalesce(fixed(target, 1), F.lit("none"))
    return (
        F.when(grade == "good", F.concat(F.lit("steady pacing; largest gap "), gap, F.lit(" ms, target "), goal, F.lit(" ms")))
        .when(grade == "warn", F.concat(F.lit("moderate jitter; largest gap "), gap, F.lit(" ms, target "), goal, F.lit(" ms")))
        .otherwise(F.concat(F.lit("severe jitter; largest gap "), gap, F.lit(" ms, target "), goal, F.lit(" ms")))
    )


def admissible(fmt: Column, width: Column, height: Column) -> Column:
    """Whether a producer accepts a frame: known format, and no larger than a slot."""
    return F.coalesce(fmt.isin(*FORMATS) & (width <= MAX_WIDTH) & (height <= MAX_HEIGHT), F.lit(False))


def fits_slot(byte_count: Column) -> Column:
    return F.coalesce(byte_count <= MAX_FRAME_BYTES, F.lit(False))


def is_slow_write(write_ms: Column, threshold_ms: float = SLOW_WRITE_MS) -> Column:
    return F.coalesce(write_ms > threshold_ms, F.lit(False))


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, 0 without one or beyond 32 bits."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def effective_fps(argument: Column) -> Column:
    """The frame rate that a text argument sets: the default for missing, malformed or non-positive ones, else clamped."""
    value = leading_int(argument)
    return F.when(value <= 0, FPS_DEFAULT).otherwise(F.least(F.lit(FPS_MAX), F.greatest(F.lit(FPS_MIN), value)))


def even(x: Column) -> Column:
    return floor_div(x, 2) * 2


def poll_timeout_ms(fps: Column) -> Column:
    """Half the frame interval in whole milliseconds, 1 at least."""
    return F.greatest(F.lit(1).cast("bigint"), floor_div(floor_div(F.lit(1000), fps), 2))


def refresh_hz(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def state_label(recording: Column) -> Column:
    return F.when(recording, "REC").otherwise("IDLE")


def silenced_frames(num_frames: Column, flags: Column) -> Column:
    """Frames that a packet's flag turns to silence; they keep their duration."""
    return F.when(flags.bitwiseAND(SILENT_FLAG) != 0, num_frames).otherwise(0)


def is_float_format(tag: Column, extension_size: Column, sub_format: Column) -> Column:
    """Whether samples are floating point: by tag 3, or by sub-format 3 of an extended tag (65534)."""
    return F.coalesce((tag == 3) | ((tag == 65534) & (extension_size >= 22) & (sub_format == 3)), F.lit(False))


def slot_of(row_number: Column, capacity: int) -> Column:
    """Slot of the n-th (from 1) write to a ring."""
    return F.pmod(row_number - 1, F.lit(capacity)).cast("int")


def number_or_null(text: Column) -> Column:
    """A text as a number: blank counts as 0, missing and malformed as null."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    plain = F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
    return F.when(trimmed == "", F.lit(0.0)).otherwise(plain)


def rounded_rate(frames: Column, seconds: Column) -> Column:
    """Frames a second, halves up, as a whole number."""
    return F.floor(F.try_divide(frames, seconds) + 0.5).cast("int")


def directory_of(path: Column) -> Column:
    """What stands before and at the last slash or backslash."""
    return F.regexp_extract(path, r"^(.*[\\/])", 1)


def without_suffix(path: Column, length: int = 4) -> Column:
    return F.substring(path, F.lit(1), F.greatest(F.length(path) - length, F.lit(0)))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds of a TIMESTAMP_NTZ since 1970, rounded down: the stamp in a file's name."""
    return bucket_of(micros(ts), 1_000_000)


def argument_of(arguments: Column, name: str) -> Column:
    """What follows the first such name that anything follows, in a list of arguments whose first is the program; null if nothing does."""
    rest = F.slice(arguments, 2, F.greatest(F.size(arguments) - 1, F.lit(0)))
    at = F.array_position(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), name)
    return F.when(at > 0, F.get(rest, at.cast("int")))


def has_flag(arguments: Column, name: str) -> Column:
    """Whether a list of arguments, whose first is the program, has this one."""
    return F.coalesce(F.array_contains(F.slice(arguments, 2, F.greatest(F.size(arguments) - 1, F.lit(0))), name), F.lit(False))


def target_pid(arguments: Column) -> Column:
    """The process that ``--inject`` names, 0 for none."""
    return leading_int(argument_of(arguments, "--inject"))
