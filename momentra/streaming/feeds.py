"""Structured Streaming over the append-only feeds. Each function also runs on a batch frame."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, ListState, TimerValues

from momentra.functions import streams


def stream_status(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """events (event_id, scene_id, channel, status, ts) -> latest status of each scene and channel; an event_id counts once."""
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    x = once.groupBy("scene_id", F.lower(F.trim("channel")).alias("channel")).agg(
        F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("l"), F.count(F.lit(1)).alias("events")
    )
    return x.select("scene_id", "channel", "l.status", "l.ts", "events")


def stream_phase_windows(timings: DataFrame, width: str = "1 hour", watermark: str = "2 hours", session_gap: str | None = None) -> DataFrame:
    """timings (ts, phase, sec) -> count, mean and maximum by tumbling window, or by session with session_gap; rows beyond the watermark are late and dropped."""
    x = timings.withWatermark("ts", watermark) if timings.isStreaming else timings
    w = F.session_window("ts", session_gap) if session_gap else F.window("ts", width)
    out = x.where("sec > 0").groupBy(w.alias("w"), "phase").agg(F.count(F.lit(1)).alias("n"), F.avg("sec").alias("avg_sec"), F.max("sec").alias("max_sec"))
    return out.select(F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "phase", "n", F.round("avg_sec", 6).alias("avg_sec"), "max_sec")


def stream_feedback_mix(feedback: DataFrame) -> DataFrame:
    """Running counts of decisions by scene."""
    d = F.lower(F.trim("decision"))
    return feedback.groupBy("scene_id", F.when(d.isin("keep", "maybe", "reject"), d).otherwise("other").alias("decision")).agg(F.count(F.lit(1)).alias("n"))


SIEVE = "scene_id string, obs_id long, timestamp_sec double, floor double, verdict string"
SIEVED = [c.split()[0] for c in SIEVE.split(", ")]


class Sieve(streams.Greedy):
    """One scene's rows (scene_id, obs_id, timestamp_sec, sharpness, brightness, motion, phash) in time order -> verdicts.

    State: the last `rows` values of sharpness, in order and sorted, the last `hashes` kept hashes, and the last time.
    """

    def __init__(self, rows: int, hashes: int, threshold: int, dark: float, motion_cap: float) -> None:
        self.rows, self.dark, self.motion_cap = rows, dark, motion_cap
        self.sharp: deque[float] = deque()
        self.sorted: list[float] = []
        self.kept = streams.Hashes(threshold, hashes)
        self.head = float("-inf")

    def see(self, sharpness: float) -> None:
        self.sharp.append(sharpness)
        bisect.insort(self.sorted, sharpness)
        if len(self.sharp) > self.rows:
            del self.sorted[bisect.bisect_left(self.sorted, self.sharp.popleft())]

    def floor(self) -> float:
        """The 10th percentile of the values seen, linear, from 30 values on; 50 at least."""
        n = len(self.sorted)
        if n < 30:
            return 50.0
        at = (n - 1) * 0.1
        a, b = self.sorted[int(at)], self.sorted[min(int(at) + 1, n - 1)]
        part = at - int(at)
        return max(50.0, a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part))

    def feed(self, row: tuple) -> tuple[tuple, ...]:
        scene, i, t, sharpness, brightness, motion, phash = row
        if t < self.head:
            return ((scene, i, t, None, "late"),)
        self.head = t
        if brightness is not None and brightness < self.dark:
            return ((scene, i, t, None, "dark"),)
        self.see(sharpness)
        floor = self.floor()
        if sharpness < floor:
            verdict = "below_floor"
        elif motion is not None and motion > self.motion_cap:
            verdict = "high_motion"
        elif self.kept.first_near(phash) is not None:
            verdict = "duplicate"
        else:
            verdict = "kept"
            self.kept.add(phash)
        return ((scene, i, t, round(floor, 4), verdict),)


class SieveProcessor(StatefulProcessor):
    """The sieve as a stateful operator: two lists, to which a batch's values are appended and which are cut to their bounds
    when twice as long, and a value (the last time, the timer that is set)."""

    def __init__(self, args: tuple, idle_ms: int, event_time: bool, ttl_ms: int | None) -> None:
        self.args, self.idle_ms, self.event_time, self.ttl_ms = args, idle_ms, event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sharp = handle.getListState("sharp", "v double", self.ttl_ms)
        self.hashes = handle.getListState("hashes", "h long", self.ttl_ms)
        self.last = handle.getValueState("last", "t double, timer long, sharp int, hashes int", self.ttl_ms)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        most_sharp, most_hashes, *_ = self.args
        sieve = Sieve(*self.args)
        timer, n_sharp, n_hashes = -1, 0, 0
        if self.last.exists():
            sieve.head, timer, n_sharp, n_hashes = self.last.get()
            for (v,) in list(self.sharp.get())[-most_sharp:]:
                sieve.see(v)
            for (h,) in list(self.hashes.get())[-most_hashes:]:
                sieve.kept.add(h)
        x = pd.concat(list(rows)).sort_values(["timestamp_sec", "obs_id"], kind="stable")
        seen, kept, out = [], [], []
        for row in zip(*(x[c].tolist() for c in SIEVE_INPUT)):
            for verdict in sieve.feed(row):
                out.append(verdict)
                if verdict[4] not in ("late", "dark"):
                    seen.append((row[3],))
                if verdict[4] == "kept":
                    kept.append((row[6],))
        n_sharp, n_hashes = (self._append(*s) for s in ((self.sharp, seen, n_sharp, most_sharp), (self.hashes, kept, n_hashes, most_hashes)))
        if self.event_time:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentWatermarkInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.last.update((sieve.head, timer, n_sharp, n_hashes))
        yield pd.DataFrame(out, columns=SIEVED)

    def _append(self, state: ListState, new: list[tuple], n: int, most: int) -> int:
        if n + len(new) > 2 * most:
            state.put([*(state.get() if n else ()), *new][-most:])
            return most
        if new:
            state.appendList(new)
        return n + len(new)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.sharp, self.hashes, self.last):
            state.clear()
        return iter([])


SIEVE_INPUT = ["scene_id", "obs_id", "timestamp_sec", "sharpness", "brightness", "motion", "phash"]


def stream_sieve(
    obs: DataFrame, state_rows: int = 200, state_hashes: int = 600, threshold: int = 5, dark: float = 0.1, motion_cap: float = 4.5,
    event_time: str | None = None, watermark: str = "1 hour", idle_ms: int = 3_600_000, ttl_ms: int | None = None
) -> DataFrame:
    """obs (scene_id, obs_id, timestamp_sec, sharpness, brightness, motion, phash) -> each row's floor and verdict; see verdict_counts.

    Rows without a phash, a time or a sharpness are left out; null brightness is light, null motion still. State of a scene:
    two bounded lists and the last time; rows before it are late, not put in order. With event_time, a timestamp column, a
    timer forgets a scene that is idle for idle_ms beyond the watermark; without, ttl_ms of processing time does (run it
    with no_data=False), or nothing.
    On a batch frame a scene's rows stream in time order past the same state. A stream needs the RocksDB state store; see
    run.run_available, which sets it and goes on from where an earlier run has stopped.
    """
    args = (state_rows, state_hashes, threshold, dark, motion_cap)
    rows = obs.select(*SIEVE_INPUT, *([event_time] if event_time else [])).where("phash is not null and timestamp_sec is not null and sharpness is not null")
    if not obs.isStreaming:
        return streams.sorted_pass(rows.select(*SIEVE_INPUT), ["timestamp_sec", "obs_id"], SIEVE, lambda: Sieve(*args))
    rows = rows.withWatermark(event_time, watermark) if event_time else rows
    mode = "EventTime" if event_time else "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy("scene_id").transformWithStateInPandas(SieveProcessor(args, idle_ms, bool(event_time), None if event_time else ttl_ms), SIEVE, "Append", mode)


def verdict_counts(sieved: DataFrame) -> DataFrame:
    """The sieve's counters: rows of each scene and verdict, over its rows so far."""
    return sieved.groupBy("scene_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
