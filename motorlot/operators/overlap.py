"""Booking intervals. An interval covers the days from its start up to, not including, its end."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlot.session import checkpointed


def overlaps(start: str, end: str, other_start: Column, other_end: Column) -> Column:
    return (F.col(start) < other_end) & (F.col(end) > other_start)


def overlapping_span(bookings: DataFrame, start: date, end: date, start_col: str, end_col: str) -> DataFrame:
    """Bookings that touch a span."""
    return bookings.where(overlaps(start_col, end_col, F.lit(start.isoformat()).cast("date"),
                                   F.lit(end.isoformat()).cast("date")))


def clash_counts(bookings: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Add ``clashes``: how many other bookings of the same key overlap each booking.

    The number overlapping [s, e) is the number that start before e less the number that end by s.
    Both come from running counts over the days of a key, so no pairs are formed, and a busy key
    costs one row per day. Bookings must not be empty (start < end).
    """
    proper = F.col(start) < F.col(end)
    marks = (
        bookings.where(proper).select(key, F.inline(F.array(
            F.struct(F.col(start).alias("_day"), F.lit(1).alias("_in"), F.lit(0).alias("_out")),
            F.struct(F.col(end).alias("_day"), F.lit(0).alias("_in"), F.lit(1).alias("_out")),
        )))
        .groupBy(key, "_day").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    )
    days = Window.partitionBy(key).orderBy("_day")
    # Checkpointed because both joins below read it.
    counts = checkpointed(marks.select(
        key, "_day",
        F.coalesce(F.sum("_in").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_started"),
        F.sum("_out").over(days.rowsBetween(Window.unboundedPreceding, 0)).alias("_ended"),
    ))
    at_end = counts.select(key, F.col("_day").alias(end), "_started")
    at_start = counts.select(key, F.col("_day").alias(start), "_ended")
    return (
        bookings.join(at_end, [key, end], "left").join(at_start, [key, start], "left")
        .withColumn("clashes", F.when(proper, F.col("_started") - F.col("_ended") - 1))
        .select(*bookings.columns, "clashes")
    )


# Days that are swept for a key at a time, and the rows that a task of the sweep is meant to get.
SWEEP_DAYS, SWEEP_ROWS = 128, 500_000


def _swept(requests: DataFrame, bookings: DataFrame, key: str, start: str, booking_start: str, booking_end: str,
           first: Column, sweep_days: int, sweep_rows: int) -> DataFrame:
    """(_key, _day, _best): the least ``first`` of the bookings of a key that end after each day on which a request starts.

    It is found by a sweep from the latest end to the earliest that carries that minimum, in stretches of ``sweep_days``;
    the minimum of all later stretches comes from one row for each stretch. Bookings and days are dealt to as many tasks as
    their number asks for and merged there by (key, day) before they are sorted, so a task holds about ``sweep_rows`` rows
    whatever the size of the tables, and of a busy key no more than the days of a stretch.
    """
    ends = bookings.where((F.col(booking_start) < F.col(booking_end)) & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(booking_end).alias("_day"), F.lit(False).alias("_asks"), first.alias("_first"))
    asked = requests.select(F.col(key).alias("_key"), F.col(start).alias("_day"), F.lit(True).alias("_asks"), F.lit(None).cast(ends.schema["_first"].dataType).alias("_first"))
    tasks = max(1, -(-(ends.count() + asked.count()) // sweep_rows))
    marks = ends.unionByName(asked).withColumn("_stretch", F.floor(F.datediff(F.to_date("_day"), F.lit("1970-01-01").cast("date")) / sweep_days))
    marks = marks.repartition(tasks, "_key", "_stretch").groupBy("_key", "_stretch", "_day", "_asks").agg(F.min("_first").alias("_first"))
    # At equal days a request comes first: a booking that ends when it starts does not block it.
    inside = Window.partitionBy("_key", "_stretch").orderBy(F.col("_day").desc(), F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("_key").orderBy(F.col("_stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("_key", "_stretch").agg(F.min("_first").alias("_own")).select("_key", "_stretch", F.min("_own").over(later).alias("_carried"))
    seen = marks.withColumn("_seen", F.min("_first").over(inside)).where("_asks")
    return seen.join(carried, ["_key", "_stretch"]).select("_key", "_day", F.least("_seen", "_carried").alias("_best"))


def first_blocker(requests: DataFrame, bookings: DataFrame, key: str, start: str, end: str, booking: str,
                  booking_start: str, booking_end: str, sweep_days: int = SWEEP_DAYS, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """requests plus ``blocker`` and ``blocker_start``: the earliest booking of the same key that overlaps each, else null.

    Of the bookings that end after a request starts, the one with the smallest (start, id) blocks it if any does; a sweep
    finds it, so no pairs are formed. Empty intervals and null keys neither block nor are blocked.
    """
    asked = requests.where((F.col(start) < F.col(end)) & F.col(key).isNotNull())
    first = F.struct(F.col(booking_start).alias("s"), F.col(booking).alias("id"))
    swept = _swept(asked, bookings, key, start, booking_start, booking_end, first, sweep_days, sweep_rows)
    named = requests.join(swept, (F.col(key) == F.col("_key")) & (F.col(start) == F.col("_day")), "left")
    blocks = (F.col("_best.s") < F.col(end)) & (F.col(start) < F.col(end))
    return named.select(*[requests[c] for c in requests.columns], F.when(blocks, F.col("_best.id")).alias("blocker"), F.when(blocks, F.col("_best.s")).alias("blocker_start"))


def with_blocked(requests: DataFrame, bookings: DataFrame, key: str, start: str, end: str, booking_start: str,
                 booking_end: str, sweep_days: int = SWEEP_DAYS, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """requests plus ``blocked``: whether a booking of the same key overlaps each. The same sweep carries the start alone."""
    asked = requests.where((F.col(start) < F.col(end)) & F.col(key).isNotNull())
    swept = _swept(asked, bookings, key, start, booking_start, booking_end, F.col(booking_start), sweep_days, sweep_rows)
    named = requests.join(swept, (F.col(key) == F.col("_key")) & (F.col(start) == F.col("_day")), "left")
    blocks = (F.col("_best") < F.col(end)) & (F.col(start) < F.col(end))
    return named.select(*[requests[c] for c in requests.columns], F.coalesce(blocks, F.lit(False)).alias("blocked"))


def clip_days(start: Column, end: Column, first: date, last: date) -> Column:
    """Days of an interval inside a span; not cut at zero, so filter to overlapping rows first."""
    return F.datediff(
        F.least(F.to_date(end), F.lit(last.isoformat()).cast("date")),
        F.greatest(F.to_date(start), F.lit(first.isoformat()).cast("date")),
    )


def valid_at(facts: DataFrame, intervals: DataFrame, key: str, moment: Column, start: str, end: str) -> DataFrame:
    """Left join to the interval of the same key that contains a moment (both ends included)."""
    facts = facts.withColumn("_at", moment)
    return facts.join(
        intervals.withColumnRenamed(key, "_key"),
        (F.col(key) == F.col("_key")) & F.col("_at").between(F.col(start), F.col(end)), "left",
    ).drop("_at", "_key")
