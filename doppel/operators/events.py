"""Request rates, admission and audit figures over a table of events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doppel.checkpoint import settled
from doppel.functions.columns import col, quoted
from doppel.functions.normal import round_even

# Limits of the rate window and of the audit log.
WINDOW_SECONDS = 60
MAX_REQUESTS = 60
LOG_EVENTS = 1000
RECENT_EVENTS = 50
BLOCK_WINDOWS = 10  # a block of time that one task looks at, in windows


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {quoted(ts)})")
    return F.unix_micros(col(ts))


def request_rate(events: DataFrame, key: str, ts: str, window_seconds: int = WINDOW_SECONDS,
                 max_requests: int = MAX_REQUESTS) -> DataFrame:
    """Add `used` (requests of the key in the window up to and including the event) and `remaining`.

    Time is cut into blocks, and the events of the last window of a block are
    also shown to the next one. A busy key is so spread over its blocks.
    """
    span = window_seconds * 1_000_000
    block = span * BLOCK_WINDOWS
    at = events.withColumn("_at", micros(events, ts)).withColumn("_block", F.floor(F.col("_at") / block))
    late = (F.col("_block") + 1) * block - F.col("_at") <= span
    shown = at.withColumn("_in", F.explode(F.when(late, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))))
    w = Window.partitionBy(col(key), "_in").orderBy("_at").rangeBetween(-span, 0)
    used = shown.withColumn("used", F.count(F.lit(1)).over(w)).filter(F.col("_in") == F.col("_block"))
    return used.select(*[col(c) for c in events.columns], "used",
                       F.greatest(F.lit(0), F.lit(max_requests) - F.col("used")).cast("bigint").alias("remaining"))


def admit_sorted(at: np.ndarray, held: list[int], span: int, max_requests: int) -> tuple[np.ndarray, list[int]]:
    """Verdicts on events in time order after the admitted times `held`, and the admitted times still in the last window.

    While the window has room for k more, the next k events are admitted as a set; while it is full, all events up to the
    end of the oldest admitted one's window are rejected as a set.
    """
    ok, held, i = np.zeros(len(at), bool), deque(held), 0
    while i < len(at):
        while held and held[0] < at[i] - span:
            held.popleft()
        room = max_requests - len(held)
        if room > 0:
            ok[i:i + room] = True
            held.extend(at[i:i + room].tolist())
            i += room
        elif held:
            i += int(np.searchsorted(at[i:], held[0] + span, "right"))
        else:
            break  # nothing is ever admitted
    return ok, list(held)


def _admit(span: int, max_requests: int, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            run_of, at = batch["_run"].to_numpy(np.int64), batch["_at"].to_numpy(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(run_of[1:] != run_of[:-1]) + 1, [len(at)]]).tolist()
            verdicts = np.zeros(len(at), bool)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if run_of[a] != current:
                    current, held = run_of[a], []
                verdicts[a:b], held = admit_sorted(at[a:b], held, span, max_requests)
            yield batch[columns].assign(admitted=verdicts)[~batch["_before"].to_numpy(bool)]
    return run


def rate_limit_admission(events: DataFrame, key: str, ts: str, event_id: str, window_seconds: int = WINDOW_SECONDS,
                         max_requests: int = MAX_REQUESTS) -> DataFrame:
    """Add `admitted`: false when the window already holds max_requests admitted requests of the key.

    A rejected request is not recorded, so a verdict may depend on earlier ones. It does not where the window holds
    at most max_requests events of any kind: these are admitted without looking further, spread over blocks of time.
    Only the others need an order. They form runs, which break where a whole window passes without one of them; a run
    starts from the sure events of the window before it, so runs of one key are independent. The rows of a
    run stream through a task in time order, whole sets of them decided at once.
    """
    span = window_seconds * 1_000_000
    names = events.columns
    # Events at one time count for each other here, which only makes fewer of them sure.
    counted = request_rate(events.withColumn("_key", F.struct(col(key))), "_key", ts, window_seconds, max_requests)
    at = counted.withColumn("_at", micros(events, ts)).withColumn("_slot", F.floor(F.col("_at") / span)).drop("remaining")
    busy = at.filter(F.col("used") > max_requests).select("_key", "_slot").distinct()
    # A slot without an unsure event between two with some is more than a window.
    runs = busy.withColumn("_run", F.xxhash64("_key", F.col("_slot") - F.row_number().over(Window.partitionBy("_key").orderBy("_slot"))))
    before = runs.groupBy("_key", "_run").agg((F.min("_slot") - 1).alias("_slot"))
    parts = settled(runs.select("_key", "_slot", "_run", F.lit(False).alias("_before")).unionByName(
        before.select("_key", "_slot", "_run", F.lit(True).alias("_before"))))
    schema = T.StructType([*events.schema.fields, T.StructField("admitted", T.BooleanType())])
    sure = at.join(parts.filter("not _before").select("_key", "_slot"), ["_key", "_slot"], "left_anti").select(
        *[col(c) for c in names], F.lit(True).alias("admitted"))
    rows = at.join(parts, ["_key", "_slot"]).repartition("_run").sortWithinPartitions("_run", "_at", event_id)
    judged = rows.select(*[col(c) for c in names], "_run", "_at", "_before").mapInPandas(_admit(span, max_requests, names), schema)
    return sure.unionByName(judged)


def audit_recent(log: DataFrame, ts: str, event_id: str, n: int = RECENT_EVENTS) -> DataFrame:
    """The last n events by time, then id."""
    return log.orderBy(F.desc(ts), F.desc(event_id)).limit(n)


def audit_totals(log: DataFrame) -> DataFrame:
    """total_events, total_rows_generated, avg_execution_time_ms, privacy_noise_usage_pct of a log.

    The log has row_count, execution_time_ms and privacy_noise.
    """
    return log.agg(
        F.count(F.lit(1)).alias("total_events"), F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("total_rows_generated"),
        F.coalesce(round_even(F.avg(F.coalesce("execution_time_ms", F.lit(0.0))), 2), F.lit(0.0)).alias("avg_execution_time_ms"),
        F.coalesce(round_even(F.avg(F.when(F.col("privacy_noise"), 1.0).otherwise(0.0)) * 100, 1), F.lit(0.0))
        .alias("privacy_noise_usage_pct"),
    )


def audit_stats(log: DataFrame, ts: str, event_id: str, n: int = LOG_EVENTS) -> DataFrame:
    """Totals over the last n events."""
    return audit_totals(audit_recent(log, ts, event_id, n))
