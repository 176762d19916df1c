"""Stateful streams on event time: nearest frames by the midpoint rule, tracklets, checked ledger transitions, and a sink that replays harmlessly.

A stream decides a row only when the watermark shows that nothing earlier can
come, so its results are those of the batch operators however the rows are cut
into micro-batches, as long as none is later than `late`. Times are microseconds;
watermarks and timers are milliseconds. State ends with the
rows it is needed for, or by a timer.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import TRANSITIONS
from ..operators.tracks import BREAK_GAP, CLOSE_GAP, MIN_IOU, iou

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(events: DataFrame, late: str) -> DataFrame:
    """events with a watermark on pts, shifted as a stream's first watermark is 0 and drops what isn't after it; rows without pts are left out. The session gets the state store that such state needs."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.where("pts IS NOT NULL").withColumn("event_time", F.timestamp_micros(F.col("pts") + 1)).withWatermark("event_time", late)


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    kinds = {"long": "Int64", "string": "object", "boolean": "boolean"}
    names = [c.split(" ") for c in columns.split(", ")]
    return pd.DataFrame(rows, columns=[n for n, _ in names]).astype({n: kinds[k] for n, k in names})


class _Timed(StatefulProcessor):
    """Settles what the watermark allows, on rows and on timers; subclasses keep state and say when to look again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def take(self, rows: pd.DataFrame) -> None:
        raise NotImplementedError

    def settle(self, key: tuple, known: int) -> tuple[list[tuple], list[int]]:
        """What is decided now that all rows up to `known` have come, and the times at which to look again."""
        raise NotImplementedError

    def _out(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        known = timers.getCurrentWatermarkInMs() * 1000 - 1
        rows, again = self.settle(key, known)
        for at in {-(-(t + 1) // 1000) for t in again if t > known}:
            self.handle.registerTimer(at)
        yield _frame(rows, self.COLUMNS)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for part in rows:
            self.take(part)
        yield from self._out(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._out(key, timerValues)

    def close(self) -> None:
        pass


ASSIGNED = "video_id string, target_pts long, frame_id long, frame_pts long, error_code string"


class NearestFrames(_Timed):
    """Map state: frames that a waiting or coming target may need, and waiting targets by their number; last time and end of the video."""

    COLUMNS = ASSIGNED

    def __init__(self, max_distance: int | None, idle: int) -> None:
        self.max_distance, self.idle = max_distance, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.frames = handle.getMapState("frames", "pts long", "frame_id long")
        self.waiting = handle.getMapState("waiting", "pts long", "n long")
        self.last = handle.getValueState("last", "pts long, ended boolean")

    def take(self, rows: pd.DataFrame) -> None:
        last, ended = self.last.get() if self.last.exists() else (0, False)
        for kind, pts, frame in zip(rows["kind"], rows["pts"].astype(int), rows["frame_id"], strict=True):
            if kind == "frame":
                old = self.frames.getValue((pts,))[0] if self.frames.containsKey((pts,)) else frame
                self.frames.updateValue((pts,), (int(min(old, frame)),))
            elif kind == "target":
                n = self.waiting.getValue((pts,))[0] if self.waiting.containsKey((pts,)) else 0
                self.waiting.updateValue((pts,), (n + 1,))
            ended = ended or kind == "end"
            last = max(last, pts)
        self.last.update((int(last), bool(ended)))

    def settle(self, key: tuple, known: int) -> tuple[list[tuple], list[int]]:
        frames = {int(k[0]): int(v[0]) for k, v in self.frames.iterator()}
        waiting = {int(k[0]): int(v[0]) for k, v in self.waiting.iterator()}
        last, ended = self.last.get() if self.last.exists() else (known, True)
        ended = ended or known >= last + self.idle
        times, out, again = sorted(frames), [], [last + self.idle]
        for target, n in sorted(waiting.items()):
            at = bisect_right(times, target)
            near = [t for t in times[max(0, at - 1) : at + 1]]
            best = min(near, key=lambda t: (abs(t - target), t), default=None)  # noqa: B023
            # A frame that is still to come is no nearer than this.
            until = None if best is None else target + abs(best - target)
            if not ended and (until is None or until > known):
                again += [until] if until is not None else []
                continue
            far = best is not None and self.max_distance is not None and abs(best - target) > self.max_distance
            error = "no_decodable_frame" if best is None else "nearest_frame_too_far" if far else None
            out += [(key[0], target, None if error else frames[best], None if error else best, error)] * n
            self.waiting.removeKey((target,))
            del waiting[target]
        if ended:
            for state in (self.frames, self.waiting, self.last):
                state.clear()
            return out, []
        first = min([known + 1, *waiting])
        for t in times[: max(0, bisect_right(times, first) - 1)]:  # the last one before `first` stays
            self.frames.removeKey((t,))
        return out, again


def nearest_stream(events: DataFrame, max_distance: int | None = None, late: str = "1 second", idle: int = 3_600_000_000) -> DataFrame:
    """events: (video_id, kind, pts, frame_id) with kind target, frame or end. Each target's nearest frame; on a tie the earlier one.

    A target is decided once no nearer frame can come. It may itself come up to
    `late` after its time: frames since then, and the one before, are retained.
    `end` closes a video, also if it is silent for `idle` microseconds of the
    stream's time: what waits gets the nearest frame so far or `no_decodable_frame`.
    Rows without a time are ignored, unknown kinds only tell the time.
    """
    rows = _timed(events.select("video_id", "kind", F.col("pts").cast("long").alias("pts"), F.col("frame_id").cast("long").alias("frame_id")), late)
    return rows.groupBy("video_id").transformWithStateInPandas(NearestFrames(max_distance, idle), ASSIGNED, "Append", "EventTime")


PLACED = "video_id string, camera_id string, label string, event string, detection_id long, tracklet long, gap long, continuity string"


class Tracklets(_Timed):
    """Map state: detections that wait for the watermark; list state: the open tracks, oldest first."""

    COLUMNS = PLACED

    def __init__(self, close_gap: int, break_gap: int, min_iou: float) -> None:
        self.close_gap, self.break_gap, self.min_iou = close_gap, break_gap, min_iou

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pending = handle.getMapState("pending", "pts long, detection_id long", "x0 double, y0 double, x1 double, y1 double")
        self.open = handle.getListState("open", "x0 double, y0 double, x1 double, y1 double, pts long, tracklet long, interrupted boolean")

    def take(self, rows: pd.DataFrame) -> None:
        for pts, d, *box in zip(*(rows[c] for c in ("pts", "detection_id", "x0", "y0", "x1", "y1")), strict=True):
            self.pending.updateValue((int(pts), int(d)), tuple(map(float, box)))

    def settle(self, key: tuple, known: int) -> tuple[list[tuple], list[int]]:
        pending = sorted(((int(k[0]), int(k[1])), [*v]) for k, v in self.pending.iterator())
        open_ = [[list(t[:4]), int(t[4]), int(t[5]), bool(t[6])] for t in self.open.get()]
        out: list[tuple] = []
        said = lambda t: "interrupted" if t[3] else "continuous"

        def close(before: int) -> None:
            out.extend((*key, "closed", None, t[2], None, said(t)) for t in open_ if before - t[1] > self.close_gap)
            open_[:] = [t for t in open_ if before - t[1] <= self.close_gap]

        for (pts, d), box in (p for p in pending if p[0][0] <= known):
            self.pending.removeKey((pts, d))
            close(pts)
            fits = [(iou(t[0], box), -t[1], -i) for i, t in enumerate(open_)]
            best = max((f for f in fits if f[0] >= self.min_iou), default=None)
            if best is None:
                open_.append([box, pts, d, False])
                out.append((*key, "placed", d, d, None, "continuous"))
            else:
                t = open_[-best[2]]
                gap = pts - t[1]
                t[0], t[1], t[3] = box, pts, t[3] or gap > self.break_gap
                out.append((*key, "placed", d, t[2], gap, said(t)))
        close(known)
        if open_:
            self.open.put([(*map(float, t[0]), t[1], t[2], t[3]) for t in open_])
        else:
            self.open.clear()
        return out, [*(p[0][0] for p in pending if p[0][0] > known), *(t[1] + self.close_gap + 1 for t in open_)]


def tracklet_stream(detections: DataFrame, close_gap: int = CLOSE_GAP, break_gap: int = BREAK_GAP, min_iou: float = MIN_IOU, late: str = "1 second") -> DataFrame:
    """(video_id, camera_id, detection_id, pts, label, x0, y0, x1, y1) -> `placed` rows, each detection's tracklet, and a `closed` row a tracklet.

    The rule of `operators.tracks.associate`. gap is the pause before the detection,
    and continuity says what the pauses mean for the track so far. A timer closes a
    track when no detection can join it any more.
    """
    keys = ["video_id", "camera_id", "label"]
    rows = _timed(detections.withColumn("pts", F.col("pts").cast("long")), late)
    return rows.groupBy(*keys).transformWithStateInPandas(Tracklets(close_gap, break_gap, min_iou), PLACED, "Append", "EventTime")


CHECKED = "video_id string, target_pts long, seq long, status string, before string, legal boolean"


class Transitions(StatefulProcessor):
    """Value state: a tick's last state, its number and time; a timer ends it."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, seq long, pts long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        before, at, time = self.last.get() if self.last.exists() else (None, None, 0)
        out = []
        for seq, status, pts in sorted((int(s), x, int(t)) for part in rows for s, x, t in zip(part["seq"], part["status"], part["pts"], strict=True)):
            if at is not None and seq <= at:
                continue  # replayed
            legal = status == "pending" if before is None else status in TRANSITIONS.get(before, [])
            out.append((key[0], int(key[1]), seq, status, before, legal))
            before, at, time = status, seq, max(time, pts)
        self.last.update((before, int(at), int(time)))
        self.handle.registerTimer(max(-(-(time + self.keep) // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield _frame(out, CHECKED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.last.exists() and self.last.get()[2] + self.keep <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.last.clear()
        yield _frame([], CHECKED)

    def close(self) -> None:
        pass


def ledger_stream(changes: DataFrame, keep: int = 7 * 86_400_000_000, late: str = "1 hour") -> DataFrame:
    """(video_id, target_pts, seq, status, at) -> each change once, with the state before it and whether that change is legal.

    The rule of `operators.ledger.transitions`; a tick's changes come in order of
    seq from batch to batch, and one with a number already seen is a replay. at is
    a change's time; a tick without changes for `keep` microseconds of the stream's
    time is forgotten. Rows with a null in these columns are left out.
    """
    known = changes.where("video_id IS NOT NULL AND target_pts IS NOT NULL AND seq IS NOT NULL AND status IS NOT NULL")
    rows = _timed(known.withColumn("pts", F.col("at").cast("long")), late)
    return rows.groupBy("video_id", "target_pts").transformWithStateInPandas(Transitions(keep), CHECKED, "Append", "EventTime")


def write_block(path: str):
    """A foreachBatch function: a batch replaces the folder of its own number, so one that is replayed is written once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
