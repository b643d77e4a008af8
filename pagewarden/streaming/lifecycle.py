"""Issue lifecycles over a stream of run observations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewarden.functions import terms as T

OUT = "issue_key string, run_day int, status string, discovery_count int, recurred_count int"
STATE = "last_day int, facts string, discovery int, recurred int"


def statuses(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Each appearance of an issue as new, persisting, changed, or recurred after a day without it."""
    last, facts, seen, recurred = state.get if state.exists else (None, None, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["run_day", "facts"]).drop_duplicates("run_day", keep="last")
    out = []
    for day, own in zip(rows["run_day"].tolist(), rows["facts"].tolist(), strict=True):
        if last is not None and day <= last:
            continue  # late: that run is already told
        status = T.NEW if last is None else T.RECURRED if day - last > 1 else T.PERSISTING if own == facts else T.CHANGED
        seen, recurred, last, facts = seen + 1, recurred + (status == T.RECURRED), day, own
        out.append((key[0], day, status, seen, recurred))
    if last is not None:
        state.update((last, facts, seen, recurred))
    yield pd.DataFrame(out, columns=["issue_key", "run_day", "status", "discovery_count", "recurred_count"])


def lifecycle_stream(observations: DataFrame) -> DataFrame:
    """observations: streaming (issue_key, run_day, facts); state is one small row an issue."""
    return observations.groupBy("issue_key").applyInPandasWithState(statuses, OUT, STATE, "append", "NoTimeout")


DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(day: int) -> int:
    """The event time of a run; that of day 0 isn't 0, which a watermark has before any row."""
    return (day + 1) * DAY_MS


class Lifecycles(StatefulProcessor):
    """Statuses of an issue over consecutive daily runs, also of the run that doesn't see it any more.

    Each sighting sets a timer to the next run's day. It goes off once the watermark is there, which is when that run's
    observations were read, and unless the issue was seen again it is resolved then. A second timer forgets a resolved issue
    after the days of retention, so that state doesn't grow with all issues there ever were.
    """

    def __init__(self, retention_days: int):
        self.retention = retention_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE + ", resolved boolean")

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, facts, seen, recurred, resolved = self.held.get() if self.held.exists() else (None, None, 0, 0, False)
        table = pd.concat(list(rows)).sort_values(["run_day", "facts"]).drop_duplicates("run_day", keep="last")
        out = []
        for day, own in zip(table["run_day"].tolist(), table["facts"].tolist(), strict=True):
            if last is not None and day <= last:
                continue  # late: that run is already told
            if last is not None and day - last > 1 and not resolved:
                out.append((key[0], last + 1, T.RESOLVED, seen, recurred))
                resolved = True
            status = T.NEW if last is None else T.RECURRED if resolved else T.PERSISTING if own == facts else T.CHANGED
            seen, recurred, last, facts, resolved = seen + 1, recurred + (status == T.RECURRED), day, own, False
            out.append((key[0], day, status, seen, recurred))
        if out:
            self.held.update((last, facts, seen, recurred, resolved))
            self._timer(_ms(last + 1))
        yield pd.DataFrame(out, columns=["issue_key", "run_day", "status", "discovery_count", "recurred_count"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            last, facts, seen, recurred, resolved = self.held.get()
            if resolved:
                self.held.clear()
            else:
                self.held.update((last, facts, seen, recurred, True))
                self.handle.registerTimer(_ms(last + 1 + self.retention))
                out.append((key[0], last + 1, T.RESOLVED, seen, recurred))
        yield pd.DataFrame(out, columns=["issue_key", "run_day", "status", "discovery_count", "recurred_count"])

    def close(self) -> None:
        pass


def resolving_stream(observations: DataFrame, retention_days: int = 365) -> DataFrame:
    """observations: streaming (issue_key, run_day, facts) of runs whose sources were healthy, a run each day in order. Needs the state store provider ROCKSDB.

    Rows (issue_key, run_day, status, discovery_count, recurred_count): of each sighting, and of the day after the last one as resolved. An issue
    that comes back after the retention is new. Of several rows of a day the greatest facts count; late rows are left out.
    """
    timed = observations.withColumn("at", F.timestamp_millis((F.col("run_day").cast("bigint") + 1) * DAY_MS)).withWatermark("at", "0 seconds")
    return timed.groupBy("issue_key").transformWithStateInPandas(statefulProcessor=Lifecycles(retention_days), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def verdict_windows(checked: DataFrame, late: str = "2 hours", size: str = "1 day") -> DataFrame:
    """Pages by verdict in windows of time, of a stream (checked_at, target_id, verdict); rows later than late are left out."""
    w = F.window("checked_at", size)
    return checked.withWatermark("checked_at", late).groupBy(w, "target_id").agg(*[F.count_if(F.col("verdict") == v).alias(n) for v, n in zip(T.VERDICTS, ("ok", "review", "error", "uncheckable", "excluded"), strict=True)])
