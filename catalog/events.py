"""Event windows, admission, audit figures, and streams over the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import rnd, table
from catalog.privacy import SALT, laplace_sql, mask_name_sql, pseudonym_sql
from doppel.operators import events
from doppel.streaming import admission, privacy, rates

WINDOW, LIMIT = 6 * 3600, 4
STREAM_RULES = [
    {"column": "c_name", "method": "mask", "col_type": "name"},
    {"column": "c_mktsegment", "method": "pseudonymize", "salt": SALT},
    {"column": "c_acctbal", "method": "noise", "epsilon": 1.0, "sensitivity": 100.0},
]


def log(df):
    """Events as audit entries."""
    return df.select("event_id", "ts", (F.col("event_id") % 500).alias("row_count"), F.col("value").alias("execution_time_ms"),
                     (F.col("event_type") == "purchase").alias("privacy_noise"))


def stream(spark, d, name):
    return privacy.folder_stream(spark, d, table(spark, d, name).schema, f"{name}.parquet")


def rated(spark, d):
    out = events.request_rate(table(spark, d, "events"), "user_id", "ts", WINDOW, LIMIT)
    return out.select("event_id", "user_id", "used", "remaining")


def admitted(spark, d):
    out = events.rate_limit_admission(table(spark, d, "events").select("event_id", "ts", "user_id"), "user_id", "ts", "event_id", WINDOW, LIMIT)
    return out.select("event_id", "user_id", "admitted")


def admitted_null_key(spark, d):
    """The same where every seventh user is unknown."""
    rows = table(spark, d, "events").select("event_id", "ts", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"))
    return events.rate_limit_admission(rows, "user_id", "ts", "event_id", WINDOW, LIMIT).select("event_id", "user_id", "admitted")


def private_stream(spark, d):
    out = privacy.run_available(privacy.stream_privacy(stream(spark, d, "customer"), STREAM_RULES, ["c_custkey"]))
    return out.select("c_custkey", "c_name", F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


def rate_stream(spark, d):
    out = privacy.run_available(rates.stream_request_rate(stream(spark, d, "events"), "user_id", "ts", "6 hours", "3 hours", "1 hour", LIMIT))
    return out.select(F.unix_seconds("window_start").alias("window_start"), "user_id", "used", "remaining")


def audit_stream(spark, d):
    out = privacy.run_available(rates.stream_audit_stats(log(stream(spark, d, "events")), "ts", "6 hours", "1 hour"))
    return out.select(F.unix_seconds("window_start").alias("window_start"), "total_events", "total_rows_generated",
                      "avg_execution_time_ms", "privacy_noise_usage_pct")


def admission_stream(spark, d):
    out = privacy.run_available(admission.stream_admission(stream(spark, d, "events"), "user_id", "ts", "event_id", WINDOW, LIMIT))
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("key").cast("bigint").alias("user_id"), "admitted")


_US = "epoch_us(ts)"
ADMISSION_SQL = f"""with recursive e as (select event_id, user_id, {_US} as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    r as (select user_id, rn, event_id, [t] as adm, true as admitted from e where rn = 1
          union all
          select e.user_id, e.rn, e.event_id,
                 case when len(list_filter(r.adm, lambda x: x >= e.t - {WINDOW * 1000000})) < {LIMIT}
                      then list_append(list_filter(r.adm, lambda x: x >= e.t - {WINDOW * 1000000}), e.t)
                      else list_filter(r.adm, lambda x: x >= e.t - {WINDOW * 1000000}) end,
                 len(list_filter(r.adm, lambda x: x >= e.t - {WINDOW * 1000000})) < {LIMIT}
          from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
    select event_id, user_id, admitted from r"""
# Spark keeps the watermark in whole milliseconds.
_MARK = "(select (max(epoch_ms(ts)) - 3600000) from events)"


def windows_sql(step: int, size: int) -> str:
    """Each event in every window it falls in whose end the watermark has passed."""
    return (f"(select *, w * {step} as window_start from (select *, unnest(range((epoch_us(ts) // 1000000) // {step} - {size // step - 1}, "
            f"(epoch_us(ts) // 1000000) // {step} + 1)) as w from events) where (w * {step} + {size}) * 1000 <= {_MARK})")


QUERIES = {
    "request_rate": rated,
    "rate_limit_admission": admitted,
    "rate_limit_admission_null_key": admitted_null_key,
    "audit_stats": lambda sp, d: events.audit_stats(log(table(sp, d, "events")), "ts", "event_id"),
    "audit_recent": lambda sp, d: events.audit_recent(log(table(sp, d, "events")), "ts", "event_id").select("event_id", "row_count", "execution_time_ms"),
    "stream_privacy": private_stream,
    "stream_request_rate": rate_stream,
    "stream_audit_stats": audit_stream,
    "stream_admission": admission_stream,
}

ORACLES = {
    "request_rate": f"""select event_id, user_id, used, greatest(0, {LIMIT} - used)::bigint as remaining from (
        select event_id, user_id, count(*) over (partition by user_id order by {_US} range between {WINDOW * 1000000} preceding and current row) as used
        from events)""",
    "rate_limit_admission": ADMISSION_SQL,
    "rate_limit_admission_null_key": ADMISSION_SQL.replace("from events)", "from (select * replace (case when user_id % 7 <> 0 then user_id end as user_id) from events))")
        .replace("e.user_id = r.user_id", "e.user_id is not distinct from r.user_id"),
    "audit_stats": f"""select count(*) as total_events, sum(event_id % 500)::bigint as total_rows_generated, {rnd('avg(value)', 2)} as avg_execution_time_ms,
        {rnd("avg(case when event_type = 'purchase' then 1.0::double else 0.0::double end) * 100", 1)} as privacy_noise_usage_pct
        from (select * from events order by ts desc, event_id desc limit 1000)""",
    "audit_recent": "select event_id, event_id % 500 as row_count, value as execution_time_ms from events order by ts desc, event_id desc limit 50",
    "stream_privacy": f"""select c_custkey, {mask_name_sql('c_name')} as c_name,
        round(c_acctbal + {laplace_sql('noise:c_acctbal', ['c_custkey'], '100.0::double')}, 6) as c_acctbal,
        {pseudonym_sql('c_mktsegment')} as c_mktsegment from customer""",
    "stream_request_rate": f"""select window_start, user_id, count(*) as used, greatest(0, {LIMIT} - count(*))::bigint as remaining
        from {windows_sql(10800, 21600)} group by 1, 2""",
    "stream_audit_stats": f"""select window_start, count(*) as total_events, sum(event_id % 500)::bigint as total_rows_generated,
        {rnd('avg(value)', 2)} as avg_execution_time_ms,
        {rnd("avg(case when event_type = 'purchase' then 1.0::double else 0.0::double end) * 100", 1)} as privacy_noise_usage_pct
        from {windows_sql(21600, 21600)} group by 1""",
    "stream_admission": ADMISSION_SQL,
}
