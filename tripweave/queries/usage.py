"""Usage queries over the event table."""

from ..operators import usage
from .registry import define, query

define(
    x_search_flag="""SELECT search_id,
 MAX(CASE WHEN event_type='search_started' THEN 1 ELSE 0 END) started,
 MAX(CASE WHEN event_type='optimization_completed' THEN 1 ELSE 0 END) completed,
 MAX(CASE WHEN event_type='interpretation_corrected' THEN 1 ELSE 0 END) corrected,
 MAX(CASE WHEN event_type='no_convenient_option' THEN 1 ELSE 0 END) no_result,
 MAX(CASE WHEN event_type='recommendation_selected' THEN 1 ELSE 0 END) selected,
 MAX(CASE WHEN event_type='alternative_selected' THEN 1 ELSE 0 END) alternative,
 MAX(CASE WHEN event_type='navigation_clicked' THEN 1 ELSE 0 END) navigated,
 MAX(CASE WHEN event_type='recommendation_selected' AND recommendation_rank=1 THEN 1 ELSE 0 END) rank_one
 FROM b_event WHERE search_id IS NOT NULL GROUP BY search_id""",
    x_totals="""SELECT SUM(started) started, SUM(completed) completed, SUM(corrected) corrected, SUM(no_result) no_result,
 SUM(selected) selected, SUM(alternative) alternative, SUM(navigated) navigated, SUM(rank_one) rank_one FROM x_search_flag""",
    x_search_rates="""SELECT CAST(started AS BIGINT) searches, ROUND(completed*1e0/started,4) completion_rate,
 ROUND(corrected*1e0/started,4) parse_correction_rate, ROUND(no_result*1e0/started,4) no_result_rate FROM x_totals""",
    x_selection_rates="""SELECT ROUND(rank_one*1e0/completed,4) rank_one_acceptance_rate,
 CASE WHEN selected>0 THEN ROUND(alternative*1e0/selected,4) ELSE 0e0 END alternative_selection_rate,
 ROUND(navigated*1e0/completed,4) navigation_click_rate FROM x_totals""",
    x_feedback="""SELECT kind, name, COUNT(*) n FROM (
 SELECT 'value' kind, feedback_value name FROM b_event WHERE event_type='feedback_submitted'
 UNION ALL SELECT 'reason', feedback_reason FROM b_event WHERE event_type='feedback_submitted') u
 WHERE name IS NOT NULL AND name<>'' GROUP BY kind, name""",
    x_latency_ranked="""SELECT latency_ms, ROW_NUMBER() OVER (ORDER BY latency_ms)-1 AS i, COUNT(*) OVER () AS n
 FROM b_event WHERE event_type='optimization_completed' AND latency_ms IS NOT NULL""",
    x_quantile="SELECT * FROM (VALUES (0.5e0),(0.95e0)) AS t(q)",
    x_latency="""SELECT 'nearest_rank' AS "rule", q AS quantile, ROUND(MAX(latency_ms),2) AS latency_ms FROM x_latency_ranked, x_quantile
 WHERE i = LEAST(n-1, CAST(FLOOR((n-1)*q+0.999999e0) AS BIGINT)) GROUP BY q
 UNION ALL SELECT 'scaled_count', q, ROUND(MAX(latency_ms),2) FROM x_latency_ranked, x_quantile WHERE i = LEAST(n-1, CAST(FLOOR(n*q) AS BIGINT)) GROUP BY q
 UNION ALL SELECT 'scaled_span', q, ROUND(MAX(latency_ms),2) FROM x_latency_ranked, x_quantile WHERE i = CAST(FLOOR((n-1)*q) AS BIGINT) GROUP BY q
 UNION ALL SELECT 'linear', 0.5e0, ROUND(quantile_cont(latency_ms,0.5),2) FROM x_latency_ranked
 UNION ALL SELECT 'linear', 0.95e0, ROUND(quantile_cont(latency_ms,0.95),2) FROM x_latency_ranked""",
    x_user="SELECT user_id, COUNT(DISTINCT CAST(occurred_at AS DATE)) AS days, MAX(CAST(occurred_at AS DATE)) AS last_day FROM b_event GROUP BY user_id",
    x_today="SELECT CAST(MAX(occurred_at) AS DATE) today FROM b_event",
    x_active="""SELECT CAST(MAX(today) AS VARCHAR) today, COUNT(CASE WHEN last_day=today THEN 1 END) active_users_one_day,
 COUNT(CASE WHEN last_day >= today - 6 THEN 1 END) active_users_seven_day FROM x_user, x_today""",
    x_returning="""SELECT COUNT(*) unique_users, COUNT(CASE WHEN days>=2 THEN 1 END) returning_users,
 ROUND(COUNT(CASE WHEN days>=2 THEN 1 END)*1e0/COUNT(*),4) return_usage_rate FROM x_user""",
    x_report="""SELECT a.today, r.unique_users AS unique_anonymous_users, s.*, ROUND(s.searches*1e0/r.unique_users,3) searches_per_user, l.*,
 (SELECT CAST(COALESCE(SUM(n),0) AS BIGINT) FROM x_feedback WHERE kind='value' AND name='positive') positive_feedback,
 (SELECT CAST(COALESCE(SUM(n),0) AS BIGINT) FROM x_feedback WHERE kind='value' AND name='negative') negative_feedback,
 (SELECT string_agg(name || '=' || n, ';' ORDER BY n DESC, name) FROM x_feedback WHERE kind='reason') feedback_reasons,
 (SELECT latency_ms FROM x_latency WHERE "rule"='linear' AND quantile=0.5) median_latency_ms,
 (SELECT latency_ms FROM x_latency WHERE "rule"='nearest_rank' AND quantile=0.95) p95_latency_ms,
 a.active_users_one_day, a.active_users_seven_day, r.returning_users, r.return_usage_rate,
 (SELECT COUNT(*) FROM b_event WHERE event_type='return_usage') explicit_return_events,
 (SELECT string_agg(event_type || '=' || n, ';' ORDER BY event_type) FROM (SELECT event_type, COUNT(*) n FROM b_event GROUP BY event_type) e) event_counts
 FROM x_active a, x_returning r, x_search_rates s, x_selection_rates l""",
)


@query("agg_event_counts", "SELECT event_type, COUNT(*) AS n FROM b_event GROUP BY event_type")
def _(g):
    return usage.event_counts(usage.facts(g.event, "type"))


@query("agg_search_rates", "SELECT * FROM x_search_rates")
def _(g):
    return usage.search_rates(usage.facts(g.event, "type", "search"))


@query("agg_selection_rates", "SELECT * FROM x_selection_rates")
def _(g):
    return usage.selection_rates(usage.facts(g.event, "type", "search"))


@query("agg_feedback", "SELECT * FROM x_feedback")
def _(g):
    return usage.feedback(usage.facts(g.event, "value", "reason"))


@query("agg_latency_percentiles", "SELECT * FROM x_latency")
def _(g):
    return usage.latency_percentiles(usage.facts(g.event, "latency"))


@query("agg_active_users", "SELECT * FROM x_active")
def _(g):
    return usage.active_users(usage.facts(g.event, "user"))


@query("agg_returning_users", "SELECT * FROM x_returning")
def _(g):
    return usage.returning_users(usage.facts(g.event, "user"))


@query("agg_usage_report", "SELECT * FROM x_report")
def _(g):
    return usage.usage_report(g.keep("usage facts", lambda: usage.facts(g.event)))


@query("pipe_usage", "SELECT * FROM x_report")
def _(g):
    accepted = usage.split_by_contract(g.event).filter("reject_reason IS NULL")
    return usage.usage_report(g.keep("accepted usage facts", lambda: usage.facts(accepted)))


@query(
    "flt_event_contract",
    """SELECT COALESCE(CASE WHEN event_id IS NULL OR user_id IS NULL THEN 'missing id'
 WHEN event_type NOT IN ('app_opened','search_started','intent_parsed','clarification_requested','interpretation_corrected','optimization_completed','optimization_failed','no_convenient_option','recommendation_viewed','recommendation_selected','navigation_clicked','alternative_selected','feedback_submitted','trip_feedback_submitted','return_usage') THEN 'event type'
 WHEN NOT recommendation_rank BETWEEN 1 AND 3 THEN 'rank'
 WHEN feedback_value NOT IN ('positive','negative','roughly_accurate','took_longer','took_less_time','did_not_make_trip') THEN 'feedback value'
 WHEN feedback_reason NOT IN ('too_much_walking','too_much_detour','too_many_transfers','bad_shop_location','shop_closed','misunderstood_request','preferred_another_option','other') THEN 'feedback reason'
 WHEN NOT latency_ms BETWEEN 0 AND 300000 THEN 'latency' END, 'accepted') AS verdict, event_id FROM b_event""",
)
def _(g):
    from pyspark.sql import functions as F

    return usage.split_by_contract(g.event).select(F.coalesce("reject_reason", F.lit("accepted")).alias("verdict"), "event_id")
