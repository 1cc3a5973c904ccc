"""Timetable, arrival and shop-hours queries."""

from pyspark.sql import functions as F

from .. import params
from ..operators import timetable
from ..tables import BINDINGS
from .registry import define, query

RAW_STOP = """SELECT CASE WHEN l_orderkey % 53 = 0 THEN 'X' || CAST(l_suppkey AS STRING)
      ELSE LPAD(CAST(10000 + l_suppkey AS STRING), 5, '0') END AS stop_code,
 CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'Road ' || CAST(l_suppkey % 40 AS STRING) END AS road_name,
 CASE WHEN l_orderkey % 6 = 0 THEN '  ' ELSE 'Opp Blk ' || CAST(l_partkey % 900 AS STRING) END AS description,
 CASE WHEN l_orderkey % 9 = 0 THEN '0' WHEN l_orderkey % 11 = 0 THEN 'n/a'
      ELSE '1.' || LPAD(CAST(2200 + (l_suppkey * 6113) % 2500 AS STRING), 4, '0') END AS latitude,
 '103.' || LPAD(CAST(6200 + (l_suppkey * 3571) % 3800 AS STRING), 4, '0') AS longitude,
 l_orderkey * 10 + l_linenumber AS capture_seq FROM lineitem"""
BINDINGS["b_raw_stop"] = RAW_STOP
# A visit per line item: arrival is the ship date plus some minutes.
BINDINGS["b_visit"] = """SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber AS visit_id,
 l_partkey * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS outlet_id, l_shipdate AS ship_day, (l_orderkey * 7 + l_linenumber * 131) % 1440 AS minute_of_day
 FROM lineitem"""

CLOCK = """CASE WHEN regexp_matches(trim({c}), '^([01][0-9]|2[0-3])[0-5][0-9]$') OR trim({c}) = '2400' THEN trim({c}) END"""
_clocks = ", ".join(f"{CLOCK.format(c=old)} AS {new}" for old, new in timetable.CLOCK_FIELDS.items())


def _minutes(c):
    return f"(CAST(substr({c},1,2) AS INTEGER)*60+CAST(substr({c},3,2) AS INTEGER))"


def _pretty(c):
    return f"(CASE WHEN {c}='2400' THEN 'midnight' ELSE substr({c},1,2)||':'||substr({c},3,2) END)"


def _window(day, which):
    return f"(CASE {day} WHEN 5 THEN saturday_{which} WHEN 6 THEN sunday_{which} ELSE weekday_{which} END)"


def state_sql(source: str) -> str:
    """Running state per row of ``source``, which has weekday and minute beside the timetable."""
    return f"""SELECT *, CASE WHEN tail THEN TRUE WHEN f IS NULL OR l IS NULL THEN NULL WHEN {_minutes('f')}={_minutes('l')} THEN NULL
 WHEN {_minutes('f')}<{_minutes('l')} THEN CASE WHEN minute BETWEEN {_minutes('f')} AND {_minutes('l')} THEN TRUE
   WHEN minute<{_minutes('f')} AND (yf IS NULL OR yl IS NULL) THEN NULL ELSE FALSE END
 WHEN minute>={_minutes('f')} THEN TRUE WHEN yf IS NULL OR yl IS NULL THEN NULL ELSE FALSE END AS state,
 CASE WHEN (CASE WHEN tail THEN yf ELSE f END) IS NULL OR (CASE WHEN tail THEN yl ELSE l END) IS NULL THEN NULL
   ELSE 'First bus ' || {_pretty('(CASE WHEN tail THEN yf ELSE f END)')} || ', last bus ' || {_pretty('(CASE WHEN tail THEN yl ELSE l END)')} END AS hours_text
 FROM (SELECT *, COALESCE(yf IS NOT NULL AND yl IS NOT NULL AND {_minutes('yf')}>{_minutes('yl')} AND minute<={_minutes('yl')}, FALSE) AS tail
  FROM (SELECT *, {_window('weekday','first')} AS f, {_window('weekday','last')} AS l,
   {_window('((weekday+6)%7)','first')} AS yf, {_window('((weekday+6)%7)','last')} AS yl FROM {source}) w) t"""


HOURS_RULE = timetable.RULE
define(
    x_stop="""SELECT stop_code, road_name, description, lat, lon, capture_seq FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY stop_code ORDER BY capture_seq DESC, description DESC NULLS LAST, road_name DESC NULLS LAST) AS rn FROM (
  SELECT trim(stop_code) AS stop_code, NULLIF(trim(road_name),'') AS road_name, NULLIF(trim(description),'') AS description,
   NULLIF(TRY_CAST(latitude AS DOUBLE),0) AS lat, NULLIF(TRY_CAST(longitude AS DOUBLE),0) AS lon, capture_seq FROM b_raw_stop) r
 WHERE regexp_matches(stop_code,'^[0-9]{5}$') AND lat IS NOT NULL AND lon IS NOT NULL) d WHERE rn=1""",
    x_route_clean=f"""SELECT service_no, direction, stop_sequence, stop_code, distance_km, capture_seq, {_clocks} FROM b_bus_route""",
    x_route="""SELECT service_no, direction, stop_sequence, stop_code, distance_km, capture_seq, weekday_first, weekday_last, saturday_first, saturday_last, sunday_first, sunday_last
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY service_no, direction, stop_sequence ORDER BY capture_seq DESC, stop_code DESC, distance_km DESC,
  weekday_first DESC NULLS LAST, weekday_last DESC NULLS LAST, saturday_first DESC NULLS LAST) AS rn FROM x_route_clean) d WHERE rn=1""",
    x_stop_name="""SELECT stop_code, CASE WHEN description IS NOT NULL AND road_name IS NOT NULL THEN description || ', ' || road_name
 ELSE COALESCE(description, road_name, stop_code) END AS stop_name FROM x_stop""",
    x_moment="SELECT * FROM (VALUES (10),(330),(720),(1430)) AS m(minute), (VALUES (0),(1),(2),(3),(4),(5),(6)) AS d(weekday)",
    x_route_moment="SELECT * FROM x_route, x_moment",
    x_state=state_sql("x_route_moment"),
    x_arrival_row="""SELECT a.event_id, a.stop_code, a.service_no, direction, stop_sequence, CAST(isodow(observed_at) AS INTEGER)-1 AS weekday,
 CAST(hour(observed_at)*60+minute(observed_at) AS INTEGER) AS minute, weekday_first, weekday_last, saturday_first, saturday_last, sunday_first, sunday_last
 FROM b_arrival a LEFT JOIN x_route r ON a.stop_code=r.stop_code AND a.service_no=r.service_no""",
    x_arrival_state=state_sql("x_arrival_row"),
    x_hours="SELECT DISTINCT opening_hours AS hours FROM b_outlet WHERE opening_hours IS NOT NULL AND opening_hours<>''",
    x_rule=f"""SELECT hours, i, regexp_extract(r, '{HOURS_RULE}', 1) AS d1, regexp_extract(r, '{HOURS_RULE}', 2) AS d2, regexp_extract(r, '{HOURS_RULE}', 3) AS span
 FROM (SELECT hours, UNNEST(string_split(hours,';')) AS r, generate_subscripts(string_split(hours,';'),1) AS i FROM x_hours) s""",
    x_dayname="SELECT * FROM (VALUES ('Mo',0),('Tu',1),('We',2),('Th',3),('Fr',4),('Sa',5),('Su',6)) AS t(dn, di)",
    x_rule_day="""SELECT r.hours, r.i, d.di AS day, span,
 CASE WHEN span NOT IN ('','off') THEN CAST(substr(span,1,2) AS INTEGER)*60+CAST(substr(span,4,2) AS INTEGER) END AS s,
 CASE WHEN span NOT IN ('','off') THEN CAST(substr(span,7,2) AS INTEGER)*60+CAST(substr(span,10,2) AS INTEGER) END AS e,
 CASE WHEN span NOT IN ('','off') THEN CAST(substr(span,4,2) AS INTEGER)<=59 AND CAST(substr(span,10,2) AS INTEGER)<=59 ELSE span='off' END AS fine
 FROM x_rule r JOIN x_dayname d ON r.d1='' OR (r.d2='' AND d.dn=r.d1)
  OR (r.d2<>'' AND (d.di - (SELECT di FROM x_dayname WHERE dn=r.d1) + 7) % 7 <= ((SELECT di FROM x_dayname WHERE dn=r.d2) - (SELECT di FROM x_dayname WHERE dn=r.d1) + 7) % 7)""",
    x_hours_known="""SELECT hours, trim(hours)='24/7' AS always, trim(hours)='24/7' OR (bool_and(fine AND (s IS NULL OR (s<=1440 AND e<=1440 AND s<>e))) AND COUNT(*)=COUNT(DISTINCT day)) AS known
 FROM x_rule_day GROUP BY hours""",
    x_window="""SELECT r.hours, r.day, s AS start_minute, CASE WHEN e<=s THEN e+1440 ELSE e END AS end_minute FROM x_rule_day r JOIN x_hours_known k ON k.hours=r.hours
 WHERE k.known AND NOT k.always AND s IS NOT NULL""",
    x_visit_row="""SELECT visit_id, v.outlet_id, o.opening_hours, c.dwell_minutes, v.ship_day, v.minute_of_day AS minute, CAST(isodow(v.ship_day) AS INTEGER)-1 AS day
 FROM (SELECT DISTINCT * FROM b_visit) v JOIN b_outlet o ON o.outlet_id=v.outlet_id JOIN b_category c ON c.category_idx=o.category_idx""",
    x_visit_left="""SELECT v.visit_id, COALESCE(MAX(CASE WHEN w.day=(v.day+6)%7 AND w.start_minute<=v.minute+1440 AND v.minute+1440<w.end_minute THEN w.end_minute-v.minute-1440 END),
 MAX(CASE WHEN w.day=v.day AND w.start_minute<=v.minute AND v.minute<w.end_minute THEN w.end_minute-v.minute END)) AS remaining
 FROM x_visit_row v JOIN x_window w ON w.hours=v.opening_hours GROUP BY v.visit_id""",
)


def visits(g):
    """Visits with the hours of the place and the dwell of its category."""
    return (
        g.visit.distinct()
        .join(g.outlet.select("outlet_id", "category_idx", "opening_hours"), "outlet_id")
        .join(g.category.select("category_idx", "dwell_minutes"), "category_idx")
        .withColumn("arrival", F.col("ship_day").cast("timestamp") + F.make_dt_interval(mins=F.col("minute_of_day").cast("int")))
    )


@query("src_bus_stops", "SELECT stop_code, road_name, description, lat, lon FROM x_stop")
def _(g):
    return timetable.stops(g.raw_stop).drop("capture_seq")


@query(
    "src_bus_routes",
    """SELECT service_no, CAST(direction AS INTEGER) AS direction, stop_sequence, stop_code, distance_km, weekday_first, weekday_last,
 saturday_first, saturday_last, sunday_first, sunday_last FROM x_route""",
)
def _(g):
    return timetable.routes(g.bus_route).drop("capture_seq")


@query(
    "prj_service_state",
    """SELECT service_no, weekday, minute, COUNT(CASE WHEN state THEN 1 END) AS running, COUNT(CASE WHEN NOT state THEN 1 END) AS stopped,
 COUNT(CASE WHEN state IS NULL THEN 1 END) AS unknown, MIN(hours_text) AS hours_text FROM x_state GROUP BY service_no, weekday, minute""",
)
def _(g):
    return timetable.running_counts(timetable.routes(g.bus_route), range(7), (10, 330, 720, 1430))


@query("prj_hours_windows", "SELECT o.outlet_id, CAST(w.day AS INTEGER) AS day, start_minute, end_minute FROM b_outlet o JOIN x_window w ON w.hours=o.opening_hours")
def _(g):
    return timetable.hours_windows(g.outlet, "outlet_id")


@query(
    "join_service_windows",
    """SELECT r.stop_code, stop_name, service_no, CAST(direction AS INTEGER) AS direction, stop_sequence, weekday_first, weekday_last, saturday_first, saturday_last, sunday_first, sunday_last
 FROM x_route r LEFT JOIN x_stop_name n ON n.stop_code=r.stop_code""",
)
def _(g):
    return timetable.service_windows(timetable.stops(g.raw_stop), timetable.routes(g.bus_route)).select(
        "stop_code", "stop_name", "service_no", "direction", "stop_sequence", *timetable.CLOCK_FIELDS.values()
    )


@query(
    "join_arrival_operation",
    """SELECT a.event_id, a.stop_code, a.service_no, a.eta_seconds, CAST(FLOOR(GREATEST(a.eta_seconds,0)/60) AS BIGINT) AS minutes_away,
 s.in_operation, s.operating_hours FROM b_arrival a JOIN (
 SELECT event_id, bool_or(state) AS in_operation, COALESCE(arg_min(CASE WHEN state THEN hours_text END, CASE WHEN state THEN direction*100000000+stop_sequence END),
  arg_min(CASE WHEN state IS NOT NULL THEN hours_text END, CASE WHEN state IS NOT NULL THEN direction*100000000+stop_sequence END),
  arg_max_null(hours_text, direction*100000000+stop_sequence)) AS operating_hours
 FROM x_arrival_state GROUP BY event_id) s ON s.event_id=a.event_id""",
)
def _(g):
    rows = timetable.arrival_operation(g.arrival, timetable.routes(g.bus_route))
    away = F.floor(F.greatest(F.col("eta_seconds"), F.lit(0)) / 60)
    return rows.select("event_id", "stop_code", "service_no", "eta_seconds", away.alias("minutes_away"), "in_operation", "operating_hours")


@query(
    "join_open_at_arrival",
    """SELECT v.visit_id, v.outlet_id, CASE WHEN v.opening_hours IS NULL OR v.opening_hours='' THEN 'unknown' WHEN k.always THEN 'open' WHEN NOT k.known THEN 'unknown'
 WHEN l.remaining IS NULL THEN 'closed' WHEN v.dwell_minutes>l.remaining THEN 'closing_soon' ELSE 'open' END AS status
 FROM x_visit_row v LEFT JOIN x_hours_known k ON k.hours=v.opening_hours LEFT JOIN x_visit_left l ON l.visit_id=v.visit_id""",
)
def _(g):
    return timetable.open_status(visits(g)).select("visit_id", "outlet_id", "status")


@query(
    "flt_boarding_imminent",
    """SELECT event_id, stop_code, eta_seconds FROM b_arrival WHERE regexp_matches(stop_code,'^[0-9]{5}$') AND eta_seconds BETWEEN -180 AND 1800""",
)
def _(g):
    return g.arrival.filter(
        F.col("stop_code").rlike("^[0-9]{5}$") & F.col("eta_seconds").between(-180, 1800)
    ).select("event_id", "stop_code", "eta_seconds")
