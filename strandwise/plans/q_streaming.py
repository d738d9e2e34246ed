"""Queries of streaming.events, in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..streaming import events as E
from .registry import n, query, r

START = lambda w: f"epoch_us(time_bucket(INTERVAL '{w}', ts, TIMESTAMP '1970-01-01'))"
US = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


@query("tumbling_windows", f"SELECT {START('1 hour')} AS start, event_type, {n('count(*)')} AS events, {r('sum(value)', 3)} AS value FROM events GROUP BY ALL")
def _(t):
    return E.tumbling(t.events).select(US("start").alias("start"), "event_type", "events", R.rounded(F.col("value"), 3).alias("value"))


@query("sliding_windows", f"SELECT {START('30 minutes')} - k * 1800000000 AS start, {n('count(*)')} AS events FROM events, range(0, 4) s(k) GROUP BY ALL")
def _(t):
    return E.sliding(t.events).select(US("start").alias("start"), "events")


@query("session_windows", f"""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
 SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS stop, {n('count(*)')} AS events FROM g GROUP BY user_id, g""")
def _(t):
    return E.sessions(t.events).select("user_id", US("start").alias("start"), US("stop").alias("stop"), "events")


@query("dedup_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) x WHERE rn = 1")
def _(t):
    return E.first_of_each(t.events, ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("late_rows", "WITH b AS (SELECT *, event_id // 500 AS b FROM events), m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b GROUP BY b) SELECT event_id FROM b JOIN m USING (b) WHERE ts < mark - INTERVAL 3600 SECOND")
def _(t):
    return E.late_rows(t.events, 3600).select("event_id")


@query("event_props", f"SELECT event_type, {n("sum(CAST(json_extract_string(props, '$.k') AS BIGINT))")} AS k FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).cast("long").alias("k"))
