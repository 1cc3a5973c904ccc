"""Clock strings, service windows and the three-valued running state."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .geo import col


def clean_clock(value) -> Column:
    """HHMM, 2400 allowed; anything else is no service."""
    text = F.trim(col(value).cast("string"))
    well_formed = text.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$") | (text == "2400")
    return F.when(well_formed, text)


def clock_minutes(value) -> Column:
    value = col(value)
    return F.substring(value, 1, 2).cast("int") * 60 + F.substring(value, 3, 2).cast("int")


def day_window(day, which: str) -> Column:
    """First or last bus of a weekday (Monday is 0)."""
    day = col(day)
    return (
        F.when(day == 5, F.col(f"saturday_{which}"))
        .when(day == 6, F.col(f"sunday_{which}"))
        .otherwise(F.col(f"weekday_{which}"))
    )


def service_state(day, minute) -> tuple[Column, Column, Column]:
    """(in operation, first, last) for a weekday and a minute of that day.

    Null means unknown and is kept: a missing window never reads as stopped.
    A window that wraps past midnight belongs to the day it started on.
    """
    day, minute = col(day), col(minute)
    before = F.pmod(day - 1, F.lit(7))
    y_first, y_last = day_window(before, "first"), day_window(before, "last")
    first, last = day_window(day, "first"), day_window(day, "last")
    y_known = y_first.isNotNull() & y_last.isNotNull()
    y_start, y_end = clock_minutes(y_first), clock_minutes(y_last)
    tail = F.when(y_known, (y_start > y_end) & (minute <= y_end))
    known = first.isNotNull() & last.isNotNull()
    start, end = clock_minutes(first), clock_minutes(last)
    state = (
        F.when(F.coalesce(tail, F.lit(False)), F.lit(True))
        .when(~known, F.lit(None).cast("boolean"))
        .when(start == end, F.lit(None).cast("boolean"))
        .when(
            start < end,
            F.when((minute >= start) & (minute <= end), F.lit(True))
            .when((minute < start) & ~y_known, F.lit(None).cast("boolean"))
            .otherwise(F.lit(False)),
        )
        .when(minute >= start, F.lit(True))
        .when(~y_known, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )
    in_tail = F.coalesce(tail, F.lit(False))
    shown_first = F.when(in_tail, y_first).otherwise(first)
    shown_last = F.when(in_tail, y_last).otherwise(last)
    return state, shown_first, shown_last


def pretty_clock(value) -> Column:
    value = col(value)
    return F.when(value == "2400", "midnight").otherwise(
        F.concat(F.substring(value, 1, 2), F.lit(":"), F.substring(value, 3, 2))
    )


def hours_text(first, last) -> Column:
    first, last = col(first), col(last)
    return F.when(
        first.isNotNull() & last.isNotNull(),
        F.concat(F.lit("First bus "), pretty_clock(first), F.lit(", last bus "), pretty_clock(last)),
    )


def monday_zero(ts) -> Column:
    return F.weekday(col(ts))


def minute_of_day(ts) -> Column:
    ts = col(ts)
    return F.hour(ts) * 60 + F.minute(ts)
