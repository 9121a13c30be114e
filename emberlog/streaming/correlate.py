"""Escalation chains and logging gaps over event streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog import rules
from emberlog.schema import actor_of


def followers(events: DataFrame, access: Sequence[str] = rules.ACCESS, escalation: Sequence[str] = rules.ESCALATION, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """(actor, access_time, access_event, time, event): a stream-stream join; state ends with watermark and window."""
    e = events.withWatermark("event_ts", late).select(actor_of().alias("actor"), "event_ts", "row_id", "event_name").filter("actor <> ''")
    a = e.filter(F.col("event_name").isin(*access)).select("actor", F.col("event_ts").alias("access_ts"), F.col("row_id").alias("access_row"), F.col("event_name").alias("access_event"))
    b = e.filter(F.col("event_name").isin(*escalation)).select(F.col("actor").alias("__actor"), F.col("event_ts").alias("ts"), "row_id", F.col("event_name").alias("event"))
    on = (F.col("actor") == F.col("__actor")) & (F.col("ts") >= F.col("access_ts")) & (F.col("ts") <= F.col("access_ts") + F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("row_id") != F.col("access_row"))
    return a.join(b, on).drop("__actor")


_TURN = "event_ts timestamp, row_id string, event_name string, actor string"
_GAP = "account string, region string, resource string, start timestamp, end timestamp, disabled_by string, duration_minutes double, still_open boolean"


class _Gaps(StatefulProcessor):
    """Turns of one key wait until the watermark has passed them and are then applied in order of time, however late or disordered they came.

    State: the turns that wait, in a list with a timer for each of their times; and the last disabling event.  An open gap is reported once it has lasted ``report`` and
    forgotten after ``forget`` more without a turn, so that no key's state stays for ever.
    """

    def __init__(self, on: set[str], off: set[str], report: timedelta, forget: timedelta):
        self.on, self.off, self.report, self.forget = on, off, report, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _TURN)
        self.open = handle.getValueState("open", "start timestamp, actor string, reported boolean")

    @staticmethod
    def _millis(at: datetime) -> int:
        return int(pd.Timestamp(at).value // 1_000_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch[batch["event_ts"].notna()]
            if len(batch):
                self.waiting.appendList([(r.event_ts.to_pydatetime(), r.row_id, r.event_name, r.actor) for r in batch.itertuples()])
                for at in set(batch["event_ts"]):
                    self.handle.registerTimer(self._millis(at) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        turns = sorted((tuple(t) for t in self.waiting.get()), key=lambda t: (t[0], t[1]))
        due = [t for t in turns if self._millis(t[0]) < now]
        if due:
            rest = turns[len(due) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
        start, actor, reported = self.open.get() if self.open.exists() else (None, None, False)
        out = []
        for at, _, name, who in due:
            if name in self.off:
                start, actor, reported = at, who, False
                for wait in (self.report, self.report + self.forget):
                    self.handle.registerTimer(self._millis(at + wait))
            elif start is not None:
                out.append((*key, start, at, actor, round((at - start).total_seconds() / 60, 1), False))
                start = None
        if start is not None and now >= self._millis(start + self.report) and not reported:
            out.append((*key, start, None, actor, None, True))
            reported = True
        if start is None or now >= self._millis(start + self.report + self.forget):
            self.open.clear()
        else:
            self.open.update((start, actor, reported))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _GAP.split(", ")])
            yield frame.astype({"start": "datetime64[ns]", "end": "datetime64[ns]", "duration_minutes": "float64"})


def logging_gaps(events: DataFrame, resource: str, disable: Sequence[str] = rules.DISABLE, enable: Sequence[str] = rules.ENABLE, late: str = "10 minutes", report: timedelta = timedelta(hours=1), forget: timedelta = timedelta(days=7)) -> DataFrame:
    """Gaps as they close, and those still open after ``report``.  A later disabling event of a key replaces an earlier one.

    ``resource`` is an SQL expression.  Event-time timers order the turns of a key: rows up to ``late`` behind the latest time take their place, later ones are left out.  An open gap
    is forgotten ``forget`` after it was reported.  Needs the RocksDB state store; rows without a readable time are left out.
    """
    turns = events.withWatermark("event_ts", late).filter(F.col("event_name").isin(*disable, *enable)).select(
        F.coalesce("account", F.lit("")).alias("account"), F.coalesce("region", F.lit("")).alias("region"), F.expr(resource).alias("resource"), "event_ts", "row_id", "event_name", actor_of().alias("actor")
    )
    return turns.groupBy("account", "region", "resource").transformWithStateInPandas(_Gaps(set(enable), set(disable), report, forget), _GAP, "Append", "EventTime")


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by actor and tumbling window, with late rows up to the watermark."""
    return events.withWatermark("event_ts", late).groupBy(F.window("event_ts", window), actor_of().alias("actor")).agg(F.count("*").alias("n"))
