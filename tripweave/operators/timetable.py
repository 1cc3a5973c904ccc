"""Bus stops, timetable rows, running state, arrivals and shop hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params
from ..functions import clock

CLOCK_FIELDS = {
    "wd_first": "weekday_first", "wd_last": "weekday_last", "sat_first": "saturday_first",
    "sat_last": "saturday_last", "sun_first": "sunday_first", "sun_last": "sunday_last",
}


def last_capture(rows: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The latest record per key. One aggregate: a hot key is reduced map-side."""
    rest = [c for c in rows.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct("capture_seq", *ties)).alias("kept")
    return rows.groupBy(*keys).agg(latest).select(*keys, "kept.*")


def stops(raw: DataFrame) -> DataFrame:
    """Usable stop records: five-digit code, real coordinates, last capture wins."""
    typed = raw.select(
        F.trim("stop_code").alias("stop_code"),
        F.nullif(F.trim("road_name"), F.lit("")).alias("road_name"),
        F.nullif(F.trim("description"), F.lit("")).alias("description"),
        F.expr("nullif(try_cast(latitude AS double), 0e0)").alias("lat"),
        F.expr("nullif(try_cast(longitude AS double), 0e0)").alias("lon"),
        "capture_seq",
    ).filter(F.col("stop_code").rlike("^[0-9]{5}$") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return last_capture(typed, ["stop_code"], ["description", "road_name", "lat", "lon"])


def routes(raw: DataFrame) -> DataFrame:
    """Timetable rows keyed (service, direction, sequence), last capture wins."""
    typed = raw.filter(
        (F.trim(F.coalesce("service_no", F.lit(""))) != "") & F.trim("stop_code").rlike("^[0-9]{5}$")
    ).select(
        F.trim("service_no").alias("service_no"),
        F.expr("try_cast(direction AS int)").alias("direction"),
        F.expr("try_cast(stop_sequence AS bigint)").alias("stop_sequence"),
        F.trim("stop_code").alias("stop_code"),
        F.expr("try_cast(distance_km AS double)").alias("distance_km"),
        "capture_seq",
        *[clock.clean_clock(old).alias(new) for old, new in CLOCK_FIELDS.items()],
    ).filter("direction IS NOT NULL AND stop_sequence IS NOT NULL")
    return last_capture(
        typed, ["service_no", "direction", "stop_sequence"], ["stop_code", "distance_km", *CLOCK_FIELDS.values()]
    )


def stop_name() -> Column:
    joined = F.concat_ws(", ", F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("road_name"), F.lit("")))
    return F.when(joined != "", joined).otherwise(F.col("stop_code"))


def service_windows(stop_rows: DataFrame, route_rows: DataFrame) -> DataFrame:
    """Each stop with every service calling there, one row per direction."""
    return route_rows.join(stop_rows.select("stop_code", stop_name().alias("stop_name")), "stop_code", "left")


def service_state_at(route_rows: DataFrame, weekdays, minutes) -> DataFrame:
    """Every timetable row at a small table of moments of the week."""
    moments = F.array(*[F.struct(F.lit(d).alias("weekday"), F.lit(m).alias("minute")) for d in weekdays for m in minutes])
    rows = route_rows.withColumn("moment", F.explode(moments)).select("*", "moment.weekday", "moment.minute").drop("moment")
    state, first, last = clock.service_state("weekday", "minute")
    return rows.withColumn("in_operation", state).withColumn("hours_text", clock.hours_text(first, last))


def running_counts(route_rows: DataFrame, weekdays, minutes) -> DataFrame:
    """Per service and moment of the week: timetable rows that run, are stopped or unknown, and the least hours text.

    The state depends on the clocks alone, and a service has few different ones, so its rows are
    counted by their clocks before they meet the moments.
    """
    alike = route_rows.groupBy("service_no", *CLOCK_FIELDS.values()).agg(F.count("*").alias("n"))
    rows = service_state_at(alike, weekdays, minutes)

    def counted(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    state = F.col("in_operation")
    return rows.groupBy("service_no", "weekday", "minute").agg(
        counted(state).alias("running"), counted(~state).alias("stopped"), counted(state.isNull()).alias("unknown"), F.min("hours_text").alias("hours_text")
    )


def arrival_operation(arrivals: DataFrame, route_rows: DataFrame) -> DataFrame:
    """Arrival estimates with the running state of their service at that stop.

    Any running direction makes the service running; otherwise the first direction
    decides, and unknown stays unknown.
    """
    timetable = route_rows.select("stop_code", "service_no", "direction", "stop_sequence", *CLOCK_FIELDS.values())
    moment = arrivals.withColumn("weekday", clock.monday_zero("observed_at")).withColumn(
        "minute", clock.minute_of_day("observed_at")
    )
    rows = moment.join(timetable, ["stop_code", "service_no"], "left")
    state, first, last = clock.service_state("weekday", "minute")
    rows = rows.withColumn("state", state).withColumn("text", clock.hours_text(first, last))
    place = F.struct("direction", "stop_sequence")
    keep = [c for c in arrivals.columns if c != "event_id"]
    running = F.col("state") == True  # noqa: E712
    known = F.col("state").isNotNull()
    return rows.groupBy("event_id").agg(
        *[F.first(c).alias(c) for c in keep],
        F.bool_or("state").alias("in_operation"),
        F.coalesce(
            F.min_by(F.when(running, F.col("text")), F.when(running, place)),
            F.min_by(F.when(known, F.col("text")), F.when(known, place)),
            F.max_by(F.when(F.col("direction").isNotNull(), F.col("text")), F.when(F.col("direction").isNotNull(), place)),
        ).alias("operating_hours"),
    )


# --- shop hours ---------------------------------------------------------------

DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
RULE = r"^\s*(?:(Mo|Tu|We|Th|Fr|Sa|Su)(?:-(Mo|Tu|We|Th|Fr|Sa|Su))?\s+)?(off|[0-9]{2}:[0-9]{2}-[0-9]{2}:[0-9]{2})\s*$"


def _day_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DAYS]), name) - 1


def parse_hours(hours: DataFrame, column: str = "opening_hours") -> DataFrame:
    """Distinct hours strings to windows.

    One row per string: ``known`` is false for unsupported, overlapping or zero-length
    rules; ``windows`` holds (day, start, end), end past 1440 when it wraps.
    """
    distinct = hours.select(F.col(column).alias("hours")).filter("hours IS NOT NULL AND hours <> ''").distinct()

    def rule(text: Column) -> Column:
        first, last = F.regexp_extract(text, RULE, 1), F.regexp_extract(text, RULE, 2)
        span = F.regexp_extract(text, RULE, 3)
        start_at, stop_at = _day_number(first), _day_number(last)
        days = (
            F.when(first == "", F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint")))
            .when(last == "", F.array(start_at))
            .otherwise(F.transform(F.sequence(start_at, start_at + F.pmod(stop_at - start_at, F.lit(7))), lambda d: d % 7))
        )

        def part(at: int) -> Column:
            return F.when(~span.isin("", "off"), F.substring(span, at, 2).cast("int"))

        start, end = part(1) * 60 + part(4), part(7) * 60 + part(10)
        good = (span != "") & F.coalesce(
            (part(4) <= 59) & (part(10) <= 59) & (start <= 1440) & (end <= 1440) & (start != end), span == "off"
        )
        return F.struct(days.alias("days"), start.alias("start"), end.alias("end"), good.alias("good"))

    parsed = distinct.withColumn("rules", F.transform(F.split("hours", ";"), rule))
    all_days = F.flatten(F.transform("rules", lambda r: r["days"]))
    windows = F.flatten(
        F.transform(
            F.filter("rules", lambda r: r["start"].isNotNull()),
            lambda r: F.transform(
                r["days"],
                lambda d: F.struct(
                    d.cast("int").alias("day"), r["start"].alias("start"),
                    F.when(r["end"] <= r["start"], r["end"] + 1440).otherwise(r["end"]).alias("end"),
                ),
            ),
        )
    )
    always = F.trim("hours") == "24/7"
    known = always | (F.forall("rules", lambda r: r["good"]) & (F.size(all_days) == F.size(F.array_distinct(all_days))))
    return parsed.select("hours", always.alias("always"), known.alias("known"), F.when(known & ~always, windows).alias("windows"))


def hours_windows(places: DataFrame, key: str) -> DataFrame:
    """One row per place and weekly window."""
    parsed = parse_hours(places).filter("known AND NOT always").select("hours", F.explode("windows").alias("w"))
    return places.join(parsed, F.col("opening_hours") == F.col("hours")).select(
        key, F.col("w.day").alias("day"), F.col("w.start").alias("start_minute"), F.col("w.end").alias("end_minute")
    )


def open_status(visits: DataFrame) -> DataFrame:
    """Visits (opening_hours, arrival, dwell_minutes) with the status on arrival.

    Each distinct hours string is parsed once and joined back; yesterday's window is
    looked at first, since it may run past midnight.
    """
    parsed = parse_hours(visits)
    rows = visits.join(parsed, F.col("opening_hours") == F.col("hours"), "left")
    day = F.weekday("arrival")
    minute = F.hour("arrival") * 60 + F.minute("arrival") + F.extract(F.lit("SECOND"), "arrival").cast("double") / 60.0

    def holding(offset: int) -> Column:
        at = minute + 1440 * offset
        hit = F.filter(
            "windows",
            lambda w: (w["day"] == F.pmod(day - offset, F.lit(7))) & (w["start"] <= at) & (at < w["end"]),
        )
        return F.try_element_at(F.transform(hit, lambda w: w["end"] - at), F.lit(1))

    left = F.coalesce(holding(1), holding(0))
    status = (
        F.when(F.col("arrival").isNull() | F.col("hours").isNull(), "unknown")
        .when(F.col("always"), "open")
        .when(~F.col("known"), "unknown")
        .when(left.isNull(), "closed")
        .when(F.col("dwell_minutes") > left, "closing_soon")
        .otherwise("open")
    )
    return rows.withColumn("status", status).drop("hours", "always", "known", "windows")
