"""Rate-limit admission on a stream: the admitted times of one window are the state of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doppel.functions.columns import col
from doppel.operators.events import MAX_REQUESTS, WINDOW_SECONDS, admit_sorted, micros

VERDICTS = "key string, event_id string, at bigint, admitted boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_admission(events: DataFrame, key: str, ts: str, event_id: str, window_seconds: int = WINDOW_SECONDS,
                     max_requests: int = MAX_REQUESTS, delay: str | None = None) -> DataFrame:
    """key, event_id, at (microseconds), admitted.

    Without a `delay`, verdicts follow at once: events of a micro-batch are taken in time order, and one that comes in a later batch
    than younger ones is judged after them; the times of a key stay. With a `delay`, events wait until no older ones
    can come, so that verdicts are those of the batch form in whatever order events arrive; older ones than that are dropped, as are
    the times of a key once it was silent for a window. Events younger than the last watermark are not judged yet.
    """
    span = window_seconds * 1_000_000
    flat = events.select(col(key).cast("string").alias("key"), col(event_id).cast("string").alias("event_id"), micros(events, ts).alias("at"))
    if delay is not None:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # timers need it
        timed = flat.withColumn("_ts", F.timestamp_micros("at")).withWatermark("_ts", delay)
        return timed.groupBy("key").transformWithStateInPandas(_Ordered(span, max_requests), VERDICTS, "append", "eventTime")

    def admit(group_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        verdicts, held = admit_sorted(rows["at"].to_numpy(np.int64), held, span, max_requests)
        state.update((held,))
        yield pd.DataFrame({"key": group_key[0], "event_id": rows["event_id"].to_numpy(), "at": rows["at"].to_numpy(), "admitted": verdicts})

    return flat.groupBy("key").applyInPandasWithState(admit, VERDICTS, "times array<bigint>", "append", GroupStateTimeout.NoTimeout)


def _verdicts(key: str | None, ids: list, at: np.ndarray, admitted: np.ndarray) -> pd.DataFrame:
    # Plain objects: the state API does not take columns of Arrow's own strings.
    return pd.DataFrame({"key": pd.Series([key] * len(ids), dtype=object), "event_id": pd.Series(ids, dtype=object),
                         "at": at.astype(np.int64), "admitted": admitted.astype(bool)})


class _Ordered(StatefulProcessor):
    """Events wait for the watermark and are then judged in time order; a timer stands at the next one, or at the end of the window."""

    def __init__(self, span: int, max_requests: int):
        self.span, self.max_requests = span, max_requests

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<bigint>")
        self.waiting = handle.getListState("waiting", "at bigint, event_id string")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                self.waiting.appendList(list(zip(frame["at"].astype(int).tolist(), frame["event_id"].tolist())))
                self._wake(int(frame["at"].min()))
        yield _verdicts(None, [], np.zeros(0), np.zeros(0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((int(a), e) for a, e in self.waiting.get()), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        ready = [r for r in rows if r[0] <= passed]
        later = rows[len(ready):]
        held = list(self.held.get()[0]) if self.held.exists() else []
        at = np.array([a for a, _ in ready], np.int64)
        verdicts, held = admit_sorted(at, held, self.span, self.max_requests)
        held = [t for t in held if t >= passed - self.span]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        if held:
            self.held.update((held,))
            self._wake(held[-1] + self.span + 1000)
        else:
            self.held.clear()
        yield _verdicts(key[0], [e for _, e in ready], at, verdicts)

    def close(self) -> None:
        pass
