"""How events flow: throttles, queues, coalescing, gap filling, service times."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import bucket_of
from cadenza.operators.ordering import in_order


def throttle(df: DataFrame, interval_us: int, keys: list[str], order: list[str], time: str = "ts_us") -> DataFrame:
    """Adds ``accepted``: a fixed schedule whose next slot moves by one interval with every accepted row.

    With c the number of slots begun, the count accepted up to row i is
    i + min over j <= i of (c_j - j): two windows, no state.
    """
    w = in_order(keys, order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    begun = bucket_of(F.col(time) - F.first(time).over(running), interval_us) + 1
    counted = df.withColumn("__i", F.row_number().over(w).cast("bigint")).withColumn("__c", begun).withColumn("__a", F.col("__i") + F.min(F.col("__c") - F.col("__i")).over(running))
    return counted.withColumn("accepted", F.col("__a") > F.coalesce(F.lag("__a").over(w), F.lit(0))).drop("__i", "__c", "__a")


def drain_latest(df: DataFrame, wakeup: Column, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Of each wake-up the newest row's columns, and how many were drained."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys, wakeup.alias("wakeup")).agg(newest.alias("__v"), F.count("*").alias("drained")).select(*keys, "wakeup", "drained", "__v.*")


def tick_collisions(df: DataFrame, tick_us: int, keys: list[str], time: str = "ts_us") -> DataFrame:
    """Rows, distinct ticks, and rows that share a tick with an earlier one. Ticks are summed before sessions are, so no key is hot."""
    ticks = df.groupBy(*keys, bucket_of(F.col(time), tick_us).alias("__tick")).agg(F.count("*").alias("__n"))
    whole = ticks.groupBy(*keys) if keys else ticks.groupBy()
    return whole.agg(F.sum("__n").cast("bigint").alias("n"), F.count("*").alias("ticks"), (F.sum("__n") - F.count("*")).cast("bigint").alias("merged"))


#: Ticks that one gap between rows may fill; a longer one is taken for a wrong clock.
MAX_GAP_TICKS = 10_000_000


def _ticks(first: Column, last: Column, tick_us: int, most: int) -> Column:
    """The ticks from one to another, none if they are the wrong way round; fails where there are too many."""
    many = (last - first) / F.lit(tick_us) >= most
    wrong = F.raise_error(F.concat(F.lit(f"more than {most} ticks between two rows, at "), first.cast("string"))).cast("array<bigint>")
    return F.when(many, wrong).when(first <= last, F.sequence(first, last, F.lit(tick_us).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def repeat_last(df: DataFrame, tick_us: int, keys: list[str], order: list[str], value: str, time: str = "ts_us", most: int = MAX_GAP_TICKS) -> DataFrame:
    """(keys, tick_us, last): for every tick from the session's first to its last the value of the newest row at or before it, null before the first.

    Every row fills the ticks up to the next one, so no session's ticks meet in one
    row; a gap of ``most`` ticks or more is an error.
    """
    session = Window.partitionBy(*keys)
    w = session.orderBy(time, *order)
    at = F.col("__at")
    rows = df.select(*keys, F.col(time).cast("bigint").alias("__at"), F.col(value).alias("__v"), F.lead(time).over(w).alias("__next"), F.lag(time).over(w).isNull().alias("__first"))
    from_ = (bucket_of(at + (tick_us - 1), tick_us) * tick_us).alias("from")
    until = F.when(F.col("__next").isNull(), bucket_of(at, tick_us)).otherwise(bucket_of(F.col("__next") - 1, tick_us)) * tick_us
    own = F.transform(_ticks(from_, until, tick_us, most), lambda t: F.struct(t.alias("tick_us"), F.col("__v").alias("last")))
    # The session's first tick, if it lies before the first row.
    before = F.when(F.col("__first") & (from_ > at), F.array(F.struct((from_ - tick_us).alias("tick_us"), F.lit(None).cast(dict(df.dtypes)[value]).alias("last")))).otherwise(F.array().cast(f"array<struct<tick_us:bigint,last:{dict(df.dtypes)[value]}>>"))
    return rows.select(*keys, F.explode(F.concat(before, own)).alias("t")).select(*keys, "t.tick_us", "t.last")


def polls(df: DataFrame, period_us: int, keys: list[str], order: list[str], columns: list[str], time: str = "ts_us", most: int = MAX_GAP_TICKS) -> DataFrame:
    """(keys, poll_us, got, drained, columns): what a poll at the end of every period finds, the newest row of the period or none."""
    found = drain_latest(df, bucket_of(F.col(time), period_us) + 1, keys, order, columns)
    following = F.lead("wakeup").over(Window.partitionBy(*keys).orderBy("wakeup"))
    told = found.withColumn("__next", F.coalesce(following, F.col("wakeup") + 1))
    spread = told.withColumn("__poll", F.explode(_ticks(F.col("wakeup"), F.col("__next") - 1, 1, most)))
    got = F.col("__poll") == F.col("wakeup")
    return spread.select(*keys, (F.col("__poll") * period_us).alias("poll_us"), got.alias("got"), F.when(got, F.col("drained")).otherwise(0).alias("drained"), *(F.when(got, F.col(c)).alias(c) for c in columns))


def completion_times(df: DataFrame, arrival: str, service: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``done``, when a single server ends each job: f_i = max(a_i, f_(i-1)) + s_i, unrolled to a running sum and a running maximum; and ``waited``."""
    running = in_order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("__s", F.sum(service).over(running))
    done = F.col("__s") + F.max(F.col(arrival) - (F.col("__s") - F.col(service))).over(running)
    return summed.withColumn("done", done).withColumn("waited", F.col("done") - F.col(service) - F.col(arrival)).drop("__s")


def folded(df: DataFrame, keys: list[str], order: list[str], carried: list[str], columns: list[str], scan: Callable, kind: str) -> DataFrame:
    """Rows in session order through a path-dependent scan, streamed: a task holds one batch and one state, however long a session is.

    ``scan(state, begins, *arrays of carried)`` gets a batch, where sessions begin in
    it and what it returned for the batch before (None at first), and returns the new
    columns as arrays and its state. Only the columns that are asked for go to Python.
    """
    whole = df.select(*dict.fromkeys([*keys, *order, *carried, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)
    names, n_keys = whole.columns, len(keys)
    schema = ", ".join(f"`{n}` {t}" for n, t in whole.dtypes) + ", " + kind
    at = [names.index(c) for c in carried]
    added = [part.strip().split(" ")[0] for part in kind.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = np.zeros(batch.num_rows, bool)
            for i in range(n_keys):
                told = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                begins[1:] |= told[1:] != told[:-1]
            begins[0] = session != [batch.column(i)[0].as_py() for i in range(n_keys)]
            session = [batch.column(i)[-1].as_py() for i in range(n_keys)]
            new, state = scan(state, begins, *(batch.column(i) for i in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], [*names, *added])

    return whole.mapInArrow(run, schema)


def clamped_sums(add: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Running values x = min(max(x + add, low), high), the first of them from a constant (low = high).

    Such steps compose to steps of the same form, so all prefixes come from a few
    passes, each of which joins every step with that of the last pass before it.
    """
    a, lo, hi = add.copy(), low.copy(), high.copy()
    reach = 1
    while reach < len(a):
        a2, lo2, hi2 = a[reach:], lo[reach:], hi[reach:]
        new_lo, new_hi = (np.minimum(np.maximum(x[:-reach] + a2, lo2), hi2) for x in (lo, hi))
        a[reach:], lo[reach:], hi[reach:] = a[:-reach] + a2, new_lo, new_hi
        reach *= 2
    return lo


def queue_steps(held: int, before: int, begins: np.ndarray, push: np.ndarray, pop: np.ndarray, clear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each operation succeeds on a ring that holds so many, and its occupancy then; ``before`` is that before the first, unless a session begins."""
    add = push.astype(np.int64) - pop
    low, high = np.zeros(len(add), np.int64), np.full(len(add), held, np.int64)
    fixed = begins.copy()
    fixed[0] = True
    start = np.zeros(len(add), np.int64)
    start[0] = 0 if begins[0] else before
    low[fixed] = high[fixed] = np.clip(start + add, 0, held)[fixed]
    add[fixed] = 0
    add[clear], low[clear], high[clear] = 0, 0, 0
    occupancy = clamped_sums(add, low, high)
    earlier = np.where(fixed, start, np.append(0, occupancy[:-1]))
    return np.where(push, earlier < held, np.where(pop, earlier > 0, clear)), occupancy


def bounded_queue(ops: DataFrame, capacity: int, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """Adds ``ok`` and ``occupancy`` after each operation on a ring that holds one less than its capacity and starts empty in every session.

    ``push`` drops the newest when the ring is full, ``pop`` fails when it is empty;
    ``clear`` and ``attach`` (a producer that comes back) empty it and always succeed;
    anything else, null too, leaves it as it is and does not succeed.
    """
    held = capacity - 1

    def scan(state, begins, what):
        one = lambda *names: pc.is_in(what, pa.array(names)).to_numpy(zero_copy_only=False)
        ok, occupancy = queue_steps(held, state or 0, begins, one("push"), one("pop"), one("clear", "attach"))
        return (ok, occupancy), int(occupancy[-1])

    return folded(ops, keys, order, [op], [], scan, "ok boolean, occupancy bigint")


def segments(begins: np.ndarray) -> list[tuple[int, int]]:
    """Where the sessions of a batch begin and end."""
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(begins), [len(begins)]])).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def coalesced_wakeups(df: DataFrame, busy_us: int, timeout_us: int, keys: list[str], order: list[str], time: str = "ts_us") -> DataFrame:
    """Adds ``wakeup_no``, ``wakeup_us`` and ``timeouts``: which wake-up of a waiting consumer takes each signal.

    A wake-up takes all signals that are there and keeps the consumer busy for
    ``busy_us``; signals meanwhile collapse into the next one, which follows at once.
    Without any the consumer waits, and ``timeouts`` counts the waits of ``timeout_us``
    that ended empty before the wake-up. ``order`` has to begin with ``time``.
    """

    def scan(state, begins, when):
        t = when.to_numpy(zero_copy_only=False).astype(np.int64)
        number, at, empty = (np.zeros(len(t), np.int64) for _ in range(3))
        for a, b in segments(begins):
            if begins[a]:
                no, now, waits, i = 0, int(t[a]), 0, a
            else:
                (no, now, waits), i = state, a
            while i < b:
                if t[i] > now:
                    free = now + busy_us
                    waits = max(0, (int(t[i]) - free) // timeout_us)
                    no, now = no + 1, max(int(t[i]), free)
                j = i + int(np.searchsorted(t[i:b], now, side="right"))
                number[i:j], at[i:j], empty[i:j] = no, now, waits
                i = j
            state = no, now, waits
        return (number, at, empty), state

    return folded(df, keys, order, [time], [], scan, "wakeup_no bigint, wakeup_us bigint, timeouts bigint")


def pushed_frames(df: DataFrame, wakeup: Column, interval_us: int, keys: list[str], order: list[str], columns: list[str], time: str = "ts_us") -> DataFrame:
    """What a push source delivers: of each wake-up the newest row, if the fixed schedule accepts it."""
    kept = [*dict.fromkeys([time, *order, *columns])]
    newest = drain_latest(df, wakeup, keys, order, kept)
    return throttle(newest, interval_us, keys, order, time).filter("accepted").drop("accepted")
