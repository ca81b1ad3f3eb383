"""Coarse ground contacts of a stream of frames (an extension: contacts.coarse_contacts over a table is the reference point).

Frames of many clips may come in any order and in any micro-batches. What is kept of a leg (a clip and a side): frames that the watermark has
not passed, and of those before them only what the next contact needs, the taps of the filter and the last contacts.
Frames are worked on in order once the watermark has passed them, so none can come before them any more; a frame number that
never came counts as a frame without a value. A frame behind the watermark is late and is dropped. When the watermark is
`idle` beyond the last frame of a leg, a timer ends it: the filter is reflected at its end, the last contacts go out, and its state goes.
A contact goes out as soon as the one after it is known. All is in the state store, so a query that starts again from its checkpoint goes on as if it had not stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.windows import gaussian_weights

CONTACTS = "clip_id long, leg string, frame long, confidence double, toe_off long, gct_ms double"


@dataclass
class Leg:
    """What the next frames of a leg need of those before them."""

    n: int = 0  # frames so far
    known_at: int = -1  # the last frame with a value
    known: float = 0.0
    full: list[float] = field(default_factory=list)  # values without gaps up to the last known one, the last taps of them
    vis: list[float] = field(default_factory=list)  # of the last frames
    smoothed: int = 0  # frames that the filter has given
    tail: list[float] = field(default_factory=list)  # the last two of them
    speed: float | None = None
    taken: int = -1
    staged: list[float] = field(default_factory=list)  # frame and confidence of the last contact taken
    kept: list[float] = field(default_factory=list)  # of the last one of a fair duration


STATE = ", ".join(f"{f.name} {({'int': 'long', 'float': 'double', 'float | None': 'double', 'list[float]': 'array<double>'})[f.type]}" for f in fields(Leg))


class Detector:
    """Feeds frames to a Leg and gives its contacts as tuples of frame, confidence, toe_off, gct_ms."""

    def __init__(self, leg: Leg, threshold: float, fps: float, sigma: float = 2.0, low_ms: float = 80, high_ms: float = 400):
        self.leg, self.threshold, self.fps, self.low, self.high = leg, threshold, fps, low_ms, high_ms
        self.weights = gaussian_weights(sigma)
        self.reach = len(self.weights) // 2
        self.out: list[tuple[int, float, int, float]] = []

    def push(self, value: float | None, vis: float) -> None:
        """The next frame."""
        s = self.leg
        s.vis.append(vis)
        if value is not None:
            for t in range(s.known_at + 1, s.n):  # the gap before it
                s.full.append(s.known + (value - s.known) * ((t - s.known_at) / (s.n - s.known_at)) if s.known_at >= 0 else value)
            s.full.append(value)
            s.known_at, s.known = s.n, value
        s.n += 1
        while s.known_at >= s.smoothed + self.reach:
            self._smooth(None)
        if s.known_at >= 0:
            # the filter looks back as far as it reaches, a contact two frames more; frames after the last value have none yet
            self._forget(s.full, s.known_at + 1, s.smoothed - self.reach - 1)
        self._forget(s.vis, s.n, s.smoothed - 3)

    def finish(self) -> None:
        """The leg has no more frames."""
        s = self.leg
        if s.known_at >= 0:
            s.full += [s.known] * (s.n - 1 - s.known_at)
            while s.smoothed < s.n:
                self._smooth(s.n)
        self._stage([])

    @staticmethod
    def _forget(values: list[float], end: int, first: int) -> None:
        """Drop values before the frame first, if the last one is of the frame before end."""
        gone = first - (end - len(values))
        if gone > 0:
            del values[:gone]

    def _smooth(self, n: int | None) -> None:
        """The filter at the next frame; n: frames of the leg, if known."""
        s, t = self.leg, self.leg.smoothed
        base = (n if n is not None else s.known_at + 1) - len(s.full)
        total = 0.0
        for w, at in zip(self.weights, range(t - self.reach, t + self.reach + 1)):
            if n is not None:
                at %= 2 * n
                at = at if at < n else 2 * n - 1 - at
            elif at < 0:
                at = -1 - at
            total += w * s.full[at - base]
        s.smoothed += 1
        if t == 1:
            self._speed(0, total - s.tail[-1])
        elif t > 1:
            self._speed(t - 1, (total - s.tail[-2]) / 2.0)
        s.tail = [*s.tail[-1:], total]

    def _speed(self, t: int, v: float) -> None:
        s = self.leg
        if t and s.speed > self.threshold >= v and (s.taken < 0 or t - s.taken >= int(0.1 * self.fps)):
            s.taken = t
            seen = s.vis[t - (s.n - len(s.vis))]
            self._stage([float(t), min(1.0, max(0.2, seen / 0.6))])
        s.speed = v

    def _stage(self, contact: list[float]) -> None:
        """A contact is taken (or none is left): the one before it has its stance."""
        s = self.leg
        if s.staged and self.low < self._stance(s.staged, contact)[1] < self.high:
            self._keep(s.staged)
        s.staged = contact
        if not contact:
            self._keep([])

    def _keep(self, contact: list[float]) -> None:
        s = self.leg
        if s.kept:
            toe_off, ms = self._stance(s.kept, contact)
            self.out.append((int(s.kept[0]), s.kept[1], toe_off, ms))
        s.kept = contact

    def _stance(self, contact: list[float], after: list[float]) -> tuple[int, float]:
        frame = int(contact[0])
        toe_off = min(frame + int(0.18 * self.fps), int(after[0]) - 2 if after else self.leg.n - 1)
        return toe_off, (toe_off - frame) / self.fps * 1000.0


class ContactProcessor(StatefulProcessor):
    """A leg's frames, waiting and done, in the state store."""

    def __init__(self, threshold: float, fps: float, sigma: float, idle_ms: int):
        self.threshold, self.fps, self.sigma, self.idle_ms = threshold, fps, sigma, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leg = handle.getValueState("leg", STATE)
        # as arrays: one value, read and written at once
        self.waiting = handle.getValueState("waiting", "frame array<long>, at array<long>, comp array<double>, vis array<double>")
        self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(f), int(a), None if pd.isna(c) else float(c), float(v)) for pdf in rows for f, a, c, v in zip(pdf["frame"], pdf["at_ms"], pdf["comp"], pdf["vis"])]
        waiting = self._waiting() + fresh
        last = max(a for _, a, _, _ in waiting)
        if self.ends.exists():
            before = self.ends.get()[0]
            last = max(last, before - self.idle_ms)
            if before != last + self.idle_ms:
                self.handle.deleteTimer(before)
                self._end_at(last + self.idle_ms)
        else:
            self._end_at(last + self.idle_ms)
        yield from self._advance(key, waiting, timerValues.getCurrentWatermarkInMs(), False)

    def _waiting(self) -> list[tuple]:
        return list(zip(*self.waiting.get())) if self.waiting.exists() else []

    def _end_at(self, at: int) -> None:
        self.ends.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ends.exists() or self.ends.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        yield from self._advance(key, self._waiting(), timerValues.getCurrentWatermarkInMs(), True)
        for state in (self.leg, self.waiting, self.ends):
            state.clear()

    def _advance(self, key, waiting: list[tuple], watermark: int, over: bool) -> Iterator[pd.DataFrame]:
        # no frame of a time up to the watermark can still come
        ready = sorted((r for r in waiting if over or r[1] <= watermark), key=lambda r: r[0])
        if not over:
            later = [r for r in waiting if r[1] > watermark]
            self.waiting.update(tuple(map(list, zip(*later)))) if later else self.waiting.clear()
            if not ready:
                return  # the leg is as it was
        leg = Leg(**{f.name: list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") else v for f, v in zip(fields(Leg), self.leg.get())}) if self.leg.exists() else Leg()
        detector = Detector(leg, self.threshold, self.fps, self.sigma)
        for frame, _, comp, vis in ready:
            if frame < leg.n:
                continue  # a second frame of one number
            while leg.n < frame:
                detector.push(None, 0.0)
            detector.push(comp, vis)
        if over:
            detector.finish()
        else:
            self.leg.update(tuple(asdict(leg).values()))
        if detector.out:
            found = pd.DataFrame(detector.out, columns=["frame", "confidence", "toe_off", "gct_ms"])
            yield found.assign(clip_id=key[0], leg=key[1])[["clip_id", "leg", "frame", "confidence", "toe_off", "gct_ms"]]

    def close(self) -> None:
        pass


def stream_contacts(frames: DataFrame, height: float, fps: float, sigma: float = 2.0, late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """clip_id, leg, frame, confidence, toe_off, gct_ms of a stream of frames: clip_id, leg, frame, at (timestamp), comp, vis.

    Frames of a leg have times in their order. The session's state store must be RocksDB (with_rocksdb); the output mode is append."""
    timed = frames.withWatermark("at", late)
    rows = timed.select("clip_id", "leg", "frame", "at", F.unix_millis("at").alias("at_ms"), F.col("comp").cast("double").alias("comp"), F.coalesce(F.col("vis").cast("double"), F.lit(0.0)).alias("vis"))
    processor = ContactProcessor(0.001 * height, fps, sigma, idle_ms)
    return rows.groupBy("clip_id", "leg").transformWithStateInPandas(processor, CONTACTS, "Append", "EventTime")


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
