"""Outreach delivery as a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, version bigint, state string, retry_count bigint, decided_at timestamp, retry_at timestamp"
_STATE = "version bigint, ok_at bigint, ok_id bigint, hard_at bigint, hard_id bigint, soft array<struct<at: bigint, id: bigint>>"


class DeliveryState(StatefulProcessor):
    """Keeps the first success, the first bounce and the first soft failures of a lead.

    These few values decide the outcome whatever the order of arrival, so the
    rows of a key are folded in chunk by chunk and never held together.
    """

    def __init__(self, max_retries: int = 1, retry_delay_sec: int = 60) -> None:
        self.max_retries = max_retries
        self.delay_us = retry_delay_sec * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("delivery", _STATE)

    def fold(self, rows: Iterator[pd.DataFrame]) -> tuple:
        """(version, first success, first bounce, first soft failures) with the rows of a batch; kept."""
        version, ok, hard, soft = 0, None, None, []
        if self.store.exists():
            version, ok_at, ok_id, hard_at, hard_id, kept = self.store.get()
            ok = None if ok_at is None else (ok_at, ok_id)
            hard = None if hard_at is None else (hard_at, hard_id)
            soft = [(s[0], s[1]) for s in kept or []]
        for chunk in rows:
            chunk = chunk.sort_values(["at", "event_id"])
            first = {kind: [tuple(map(int, r)) for r in part[["at", "event_id"]].head(self.max_retries + 1).to_numpy()]
                     for kind, part in chunk.groupby("outcome")}
            ok = min([x for x in [ok, *first.get("ok", [])[:1]] if x], default=None)
            hard = min([x for x in [hard, *first.get("hard_bounce", [])[:1]] if x], default=None)
            soft = sorted(soft + first.get("soft_fail", []))[: self.max_retries + 1]
        version += 1
        self.store.update((version, *(ok or (None, None)), *(hard or (None, None)), soft))
        return version, ok, hard, soft

    def end(self, ok, hard, soft) -> tuple:
        """((time, id), state) of the attempt that decides, or (None, retry)."""
        ends = [(ok, "contacted"), (hard, "dead")]
        if len(soft) > self.max_retries:
            ends.append((soft[self.max_retries], "dead"))
        return min([e for e in ends if e[0]], default=(None, "retry"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([self._row(key[0], *self.fold(rows))])

    def _row(self, key, version, ok, hard, soft) -> dict:
        at, state = self.end(ok, hard, soft)
        retries = [s for s in soft if at is None or s < at][: self.max_retries]
        stamp = lambda us: pd.NaT if us is None else pd.Timestamp(us, unit="us")
        return {
            "key": str(key), "version": version, "state": state, "retry_count": len(retries),
            "decided_at": stamp(at and at[0]),
            "retry_at": stamp(retries[-1][0] + self.delay_us if at is None and retries else None),
        }

    def close(self) -> None:
        pass


class RetryTimer(DeliveryState):
    """Emits a retry when it is due: a timer per soft failure, which nothing has decided until it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def _due_ms(self, at: int) -> int:
        return -(-(at + self.delay_us) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *_, soft = self.fold(rows)
        passed = timerValues.getCurrentWatermarkInMs()
        for at, _ in soft[: self.max_retries]:
            if self._due_ms(at) > passed:
                self.handle.registerTimer(self._due_ms(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, ok_at, ok_id, hard_at, hard_id, kept = self.store.get()
        soft = [(s[0], s[1]) for s in kept or []]
        end, _ = self.end(None if ok_at is None else (ok_at, ok_id), None if hard_at is None else (hard_at, hard_id), soft)
        due = [(n, at) for n, (at, _) in enumerate(soft[: self.max_retries], 1)
               if self._due_ms(at) == expiredTimerInfo.getExpiryTimeInMs() and (end is None or end[0] > at + self.delay_us)]
        if due:
            stamp = lambda us: pd.Timestamp(us, unit="us")
            yield pd.DataFrame([{"key": str(key[0]), "attempt": n, "failed_at": stamp(at), "due_at": stamp(at + self.delay_us)}
                                for n, at in due])


def retries_due(deliveries: DataFrame, key: str = "email", max_retries: int = 1, retry_delay_sec: int = 60,
                lateness: str = "0 seconds") -> DataFrame:
    """(key, attempt, failed_at, due_at) from a stream of attempts (key, ts, event_id, outcome), each when it is due.

    A soft failure is retried ``retry_delay_sec`` later, up to ``max_retries``
    times, unless a success, a bounce or one soft failure too many comes first.
    Time is event time: a retry is emitted once the watermark (the latest ts
    less ``lateness``) has passed it, also if the lead itself is never heard of again.
    """
    useful = deliveries.withWatermark("ts", lateness).where(F.col("outcome").isin("ok", "soft_fail", "hard_bounce"))
    return useful.select(
        F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"),
        F.col("event_id").cast("bigint").alias("event_id"), "outcome",
    ).groupBy("key").transformWithStateInPandas(
        statefulProcessor=RetryTimer(max_retries, retry_delay_sec),
        outputStructType="key string, attempt bigint, failed_at timestamp, due_at timestamp", outputMode="Append", timeMode="EventTime")


def delivery_states(deliveries: DataFrame, key: str = "email", max_retries: int = 1,
                    retry_delay_sec: int = 60) -> DataFrame:
    """State changes from a stream of attempts (key, ts, event_id, outcome).

    One row per lead and micro-batch; the highest ``version`` is current. Bound
    the micro-batches (``maxFilesPerTrigger``) to bound the work of one key.
    """
    useful = deliveries.where(F.col("outcome").isin("ok", "soft_fail", "hard_bounce"))
    return useful.select(
        F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("at"),
        F.col("event_id").cast("bigint").alias("event_id"), "outcome",
    ).groupBy("key").transformWithStateInPandas(
        statefulProcessor=DeliveryState(max_retries, retry_delay_sec), outputStructType=OUTPUT,
        outputMode="Update", timeMode="None")


def current_states(changes: DataFrame, key: str = "email") -> DataFrame:
    """Latest state per lead from the written changes."""
    rest = ["state", "retry_count", "decided_at", "retry_at"]
    last = changes.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("r"))
    return last.select(F.col("key").alias(key), "r.*")
