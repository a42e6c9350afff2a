"""A cache kept in the state of a stream: put, get, delete with a reason, and entries that end by themselves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

OPERATIONS = "bucket string, key string, op string, value string, at timestamp, ttl_seconds long, reason string"
OUTCOMES = "bucket string, key string, at timestamp, outcome string, value string, reason string"
_COLUMNS = ["bucket", "key", "at", "outcome", "value", "reason"]


def _ms(at) -> int:
    return int(pd.Timestamp(at).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(at).tzinfo is None else int(pd.Timestamp(at).timestamp() * 1000)


class CacheProcessor(StatefulProcessor):
    """One key's entry as (value, end in milliseconds or 0), with a timer at its end."""

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, ends long")

    def _held(self):
        return self.entry.get() if self.entry.exists() else None

    def _forget_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues):
        told = pd.concat(list(rows), ignore_index=True).sort_values(["at", "op"], kind="stable")
        out = []
        for r in told.itertuples(index=False):
            held, at, value, reason, outcome = self._held(), _ms(r.at), None, None, "ignored"
            ended = held is not None and 0 < held[1] <= at
            if r.op == "put":
                ends = at + int(r.ttl_seconds) * 1000 if r.ttl_seconds == r.ttl_seconds and r.ttl_seconds else 0
                self._forget_timers()
                self.entry.update((r.value, ends))
                if ends:
                    self.handle.registerTimer(ends)
                value, outcome = r.value, "stored"
            elif r.op == "delete":
                outcome, reason = "miss", r.reason or "invalid"
                if held is not None:
                    self.entry.clear()
                    self._forget_timers()
                    outcome = "deleted"
            elif r.op == "get":
                outcome, value = ("miss", None) if held is None else ("expired", None) if ended else ("hit", held[0])
                if ended:
                    self.entry.clear()
                    self._forget_timers()
            out.append((*key, r.at, outcome, value, reason))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, at = self._held(), expiredTimerInfo.getExpiryTimeInMs()
        if held is not None and held[1] == at:
            self.entry.clear()
            yield pd.DataFrame([(*key, pd.Timestamp(at, unit="ms"), "expired", None, "ttl")], columns=_COLUMNS)

    def close(self) -> None:
        pass


def cached(operations: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """operations (see OPERATIONS) -> a row for each, and one for each entry that ends: see OUTCOMES.

    get: hit with the value, expired (which removes the entry) or miss; put: stored, over
    what was there, for ``ttl_seconds`` or for good; delete: deleted with its reason, or
    miss. Operations of a key count in the order of their times. An entry whose time is
    over goes when the watermark, ``delay`` behind the latest time, passes it, though
    nobody asks. Rows later than the watermark, and null times, are dropped; other
    operations are ignored. State lives by key in the state store, so a query that
    starts again goes on with it, and no key's past is kept.
    """
    timed = operations.where("at is not null").select("bucket", "key", "op", "value", "at", "ttl_seconds", "reason").withWatermark("at", delay)
    return timed.groupBy("bucket", "key").transformWithStateInPandas(CacheProcessor(), OUTCOMES, "Append", "EventTime")
