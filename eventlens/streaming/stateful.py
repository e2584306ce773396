"""Keyed state over event time: behaviour profiles, decaying risk, and reset-on-fire counting.

Each processor handles the rows of one key of one micro-batch in time order. How many that can be is
set by the source's rate option (`maxOffsetsPerTrigger`, `maxFilesPerTrigger`).
"""

from __future__ import annotations

import math
import sys
from array import array

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventlens.functions.fields import event_time, field, first_text
from eventlens.functions.spans import span_seconds
from eventlens.operators.behavior import ENTITY_FIELDS
from eventlens.operators.rules import Rule, rule_column

MICROS = 1_000_000
NONE = -(1 << 63)
SLICE = 1 << 16

# executors get the processors themselves and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Profile(StatefulProcessor):
    """Hours, addresses and processes seen per entity; emits the anomalies of each event, then learns it.

    Events without a time come first in their batch and never count as travel.
    """

    def __init__(self, travel_seconds: int):
        self.travel = travel_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour int", "n bigint")
        self.processes = handle.getMapState("processes", "name string", "n bigint")
        self.last = handle.getValueState("last", "ip string, at bigint, total bigint, process_total bigint, process_known bigint")

    def handleInputRows(self, key, rows, timerValues):
        # numbers in place of rows and texts; state is read once and written once per hour and name, not per row
        texts: dict[str | None, int] = {None: 0}
        at_, id_, hour_, ip_, name_ = (array(kind) for kind in "qqbqq")
        for row in rows:
            at_.append(NONE if row.at is None else row.at)
            id_.append(NONE if row.event_id is None else row.event_id)
            hour_.append(-1 if row.hour is None else row.hour)
            ip_.append(texts.setdefault(row.src_ip, len(texts)))
            name_.append(texts.setdefault(row.process_name, len(texts)))
        text = list(texts)
        ip, at, total, process_total, known = self.last.get() if self.last.exists() else (None, NONE, 0, 0, 0)
        at = NONE if at is None else at
        hours: dict[int, int] = {}
        processes: dict[int, int] = {}
        columns = [np.frombuffer(c, c.typecode) for c in (at_, id_, hour_, ip_, name_)]
        order = np.lexsort((columns[1], columns[0]))
        for begin in range(0, len(order), SLICE):
            for row_at, event_id, hour, src, name in zip(*(c[order[begin : begin + SLICE]].tolist() for c in columns), strict=True):
                if hour not in hours:
                    hours[hour] = self._count(self.hours, hour)
                if total > 50 and hours[hour] < total // 48:
                    yield self._found(key, event_id, "AfterHoursActivity", "medium")
                if src and ip is not None and ip != text[src] and NONE < row_at < at + self.travel:
                    yield self._found(key, event_id, "ImpossibleTravel", "high")
                if name:
                    if name not in processes:
                        processes[name] = self._count(self.processes, text[name])
                    count = processes[name]
                    if count and process_total > 100 and count < process_total // 100:
                        yield self._found(key, event_id, "RareProcess", "medium")
                    elif not count and known > 10:
                        yield self._found(key, event_id, "RareProcess", "high")
                    processes[name] = count + 1
                    process_total, known = process_total + 1, known + (count == 0)
                hours[hour] += 1
                total, at, ip = total + 1, row_at, text[src] if src else ip
        for hour, count in hours.items():
            self.hours.updateValue((hour,), (count,))
        for name, count in processes.items():
            self.processes.updateValue((text[name],), (count,))
        self.last.update((ip, at, total, process_total, known))

    @staticmethod
    def _count(state, key) -> int:
        return state.getValue((key,))[0] if state.containsKey((key,)) else 0

    @staticmethod
    def _found(key, event_id, kind, severity):
        return Row(event_id=None if event_id == NONE else event_id, entity=key[0], anomaly_type=kind, severity=severity)

    def close(self) -> None:
        pass


def stream_ueba(events: DataFrame, entity=ENTITY_FIELDS, travel: str = "5m", delay: str = "10 minutes") -> DataFrame:
    """Behaviour anomalies as in `operators.behavior.ueba_anomalies`, learned event by event."""
    timed = event_time(events)
    rows = timed.select(
        "event_id",
        first_text(timed, list(entity)).alias("entity"),
        "ts",
        F.unix_micros("ts").alias("at"),
        F.hour("ts").alias("hour"),
        field(timed, "src_ip").cast("string").alias("src_ip"),
        field(timed, "process_name").cast("string").alias("process_name"),
    ).where("entity is not null and entity <> ''")
    return (
        rows.withWatermark("ts", delay)
        .groupBy("entity")
        .transformWithState(Profile(span_seconds(travel)), "event_id bigint, entity string, anomaly_type string, severity string", "append", "none")
    )


class Spaced(StatefulProcessor):
    """Passes a key's event on if none was accepted less than a gap before; forgets the key once the watermark is past that."""

    def __init__(self, gap_seconds: int, names: list[str], tie: str):
        self.gap, self.names, self.tie = gap_seconds * MICROS, names, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for row in sorted(rows, key=lambda r: (r._at, r[self.tie] if self.tie in r else 0)):
            if last is None or row._at - last >= self.gap:
                last = row._at
                yield Row(**{n: row[n] for n in self.names})
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer((last + self.gap) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and self.last.get()[0] + self.gap < expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class Risk(StatefulProcessor):
    """Score per entity, capped at 100; each interval that ends multiplies it by the factor, truncated."""

    def __init__(self, factor: float, interval_seconds: int):
        self.factor, self.interval = factor, interval_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.score = handle.getValueState("score", "score int, slot bigint")

    def _decay(self, score: int, times: int) -> int:
        # a factor below 1 brings any whole score to 0 within 101 steps
        for _ in range(min(times, 101)):
            score = math.floor(score * self.factor)
        return score

    def handleInputRows(self, key, rows, timerValues):
        score, slot = self.score.get() if self.score.exists() else (0, None)
        for row in sorted(rows, key=lambda r: (r.at, r.event_id)):
            current = row.at // MICROS // self.interval
            if slot is not None and current > slot:
                score = self._decay(score, current - slot)
            slot = current if slot is None else max(slot, current)
            score = min(100, score + row.score)
        self.score.update((score, slot))
        if score > 0:
            self.handle.registerTimer((slot + 1) * self.interval * 1000)
        yield Row(entity=key[0], score=score, slot=slot)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.score.exists():
            return
        score, slot = self.score.get()
        # the watermark may have passed several intervals at once
        due = timerValues.getCurrentWatermarkInMs() // 1000 // self.interval
        if due > slot:
            score, slot = self._decay(score, due - slot), due
            if score > 0:
                self.score.update((score, slot))
                self.handle.registerTimer((slot + 1) * self.interval * 1000)
            else:
                self.score.clear()
            yield Row(entity=key[0], score=score, slot=slot)

    def close(self) -> None:
        pass


def stream_risk(increments: DataFrame, factor: float = 0.5, interval: str = "1h", delay: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    """Score per entity after each batch and each decay step (columns entity, ts, score in; entity, score, slot out)."""
    timed = event_time(increments)
    rows = timed.select("entity", "ts", F.unix_micros("ts").alias("at"), F.col(tie).alias("event_id"), F.col("score").cast("int").alias("score"))
    grouped = rows.withWatermark("ts", delay).groupBy("entity")
    return grouped.transformWithState(Risk(factor, span_seconds(interval)), "entity string, score int, slot bigint", "update", "eventtime")


class Reset(StatefulProcessor):
    """Buffer of recent matches per key; emits and clears it when it reaches the threshold."""

    def __init__(self, need: int, window_seconds: int):
        self.need, self.window = need, window_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "at bigint, event_id bigint")

    def handleInputRows(self, key, rows, timerValues):
        kept = list(self.buffer.get())
        for row in sorted(rows, key=lambda r: (r.at, r.event_id)):
            kept = [k for k in kept if k[0] > row.at - self.window] + [(row.at, row.event_id)]
            if len(kept) >= self.need:
                yield Row(key=key[0], trigger_id=row.event_id, source_ids=[k[1] for k in kept])
                kept = []
        self.buffer.clear()
        if kept:
            self.buffer.put(kept)

    def close(self) -> None:
        pass


def stream_reset(events: DataFrame, rule: Rule, by: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Signals of a threshold rule, counting afresh after each (per rule, or per value of `by`)."""
    timed = event_time(events)
    hits = timed.where(rule_column(timed, rule))
    key = F.lit(rule.id) if by is None else field(timed, by).cast("string")
    rows = hits.select(key.alias("key"), "ts", F.unix_micros("ts").alias("at"), "event_id").withWatermark("ts", delay)
    reset = Reset(rule.threshold, span_seconds(rule.window))
    return rows.groupBy("key").transformWithState(reset, "key string, trigger_id bigint, source_ids array<bigint>", "append", "none")
