"""Online forms: tracking (W1, W2), sliding metrics (W3), memory banks (W4) and metric lines.

State is typed: each variable has a schema of its own in the session's state store, which is
RocksDB, so that a changed program reads what an older one wrote, and a micro-batch writes
only what it changes.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pathline.operators.tracking import TRACK, Tracker, Tracking, Tracks, fold, is_sound

BOX = ["x1", "y1", "x2", "y2"]
#: What stands for a null among whole numbers on the way: it comes first in order, as a null does.
_NULL = -(1 << 63)
#: Key of rows without a camera: a null key would take in the rows of another key beside it.
_NO_CAMERA = -(1 << 31)
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    """rows by key through a processor; typed state needs RocksDB, which the session gets here."""
    rows.sparkSession.conf.set(_STORE, _ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", time)


def _or_null(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(_NULL)).alias(column)


class _Camera(StatefulProcessor):
    """Tracks of a camera, and the detections of its newest frame, which may not be whole yet."""

    HELD = ["frame", "ts", "det_id", *BOX]

    def __init__(self, p: Tracking, tracker: Callable[[Tracking], Tracker], timed: bool):
        self.p, self.tracker, self.timed = p, tracker, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.camera = handle.getValueState("camera", "frame int, born long, late long, timer long")
        self.tracks = handle.getListState("tracks", self.tracker(self.p).STATE)
        self.held = handle.getListState("held", "frame int, ts long, det_id long, x1 double, y1 double, x2 double, y2 double")

    def _folded(self, camera: int, frame: int, born: int, rows: pd.DataFrame) -> tuple[list[tuple], int, int]:
        """Rows reported for whole frames, and the last frame and number of tracks after them."""
        state = self.tracker(self.p)
        state.restore(frame, born, list(self.tracks.get()) if self.tracks.exists() else [])
        rows = rows.sort_values(["frame", "det_id", *BOX])
        at, boxes = rows["frame"].to_numpy(), rows[BOX].to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
        whole = ((int(at[k]), boxes[k:to]) for k, to in pairwise(ends))
        out = [(camera, f, i, *b) for f, ids, shown in fold(whole, state) for i, b in zip(ids.tolist(), shown.tolist(), strict=True)]
        if left := state.save():
            self.tracks.put(left)
        else:
            self.tracks.clear()
        return out, state.frame, state.born

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        if key[0] == _NO_CAMERA:  # time alone
            return
        frame, born, late, timer = self.camera.get() if self.camera.exists() else (0, 0, 0, _NULL)
        before = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=self.HELD)
        done = []
        if timer != _NULL and timerValues.getCurrentWatermarkInMs() > timer:  # due, though new rows come before its timer
            done, frame, born = self._folded(key[0], frame, born, before)
            before = before.iloc[:0]
            self.held.clear()
            self.handle.deleteTimer(timer)
            timer = _NULL
        dropped = int((new["frame"] <= frame).sum())
        new = new.loc[new["frame"] > frame, self.HELD]
        out = done + [(key[0], -1, late + dropped, 0.0, 0.0, 0.0, 0.0)] * (dropped > 0)
        if len(new):
            every = pd.concat([before, new]) if len(before) else new
            newest = every["frame"].max()
            ready, left = every[every["frame"] < newest], every[every["frame"] == newest]
            if len(ready):
                shown, frame, born = self._folded(key[0], frame, born, ready)
                out = shown + out
            self.held.put([(int(f), int(t), int(d), *map(float, b)) for f, t, d, *b in left.itertuples(index=False)])
            at = int(left["ts"].max())
            if self.timed and at != timer:
                if timer != _NULL:
                    self.handle.deleteTimer(timer)
                if at != _NULL:
                    self.handle.registerTimer(at)
                timer = at
        self.camera.update((int(frame), int(born), late + dropped, timer))
        yield pd.DataFrame(out, columns=["camera_id", "frame", "track_id", *BOX])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the newest frame: it is whole, whether a later one comes or not."""
        frame, born, late, _ = self.camera.get()
        rows = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=self.HELD)
        out, frame, born = self._folded(key[0], frame, born, rows)
        self.held.clear()
        self.camera.update((int(frame), int(born), late, _NULL))
        yield pd.DataFrame(out, columns=["camera_id", "frame", "track_id", *BOX])

    def close(self) -> None:
        pass


def track_stream(dets: DataFrame, p: Tracking = Tracking(), tracker: Callable[[Tracking], Tracker] = Tracks, delay: str | None = None) -> DataFrame:
    """Tracks as frames arrive, with state for each camera; the same rows as `track` gives for all at once.

    A frame's detections may be spread over micro-batches. It is folded when a later one of its
    camera has come. W2: with `delay` (such as "10 seconds") the stream's time `ts` has a
    watermark so far behind the newest row of any camera, and a frame is also folded when the
    watermark has passed its newest row, so a camera that falls silent has its last frame
    reported. Rows without a camera only carry time: a source that sends them now and then
    closes the frames of all cameras. Rows of a frame that is folded already are dropped and
    counted, however old they are: a row with frame -1 has the number so far as track_id.
    Unsound rows (see `sound`) are left out; those with a null det_id stay, and come first.
    """
    ts = F.lit(_NULL) if delay is None else F.coalesce(F.unix_millis("ts"), F.lit(_NULL))
    rows = dets if delay is None else dets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # ts goes on as a number: the store would drop late rows by their watermark, uncounted
    rows = rows.filter(F.col("camera_id").isNull() | is_sound()).select(F.coalesce("camera_id", F.lit(_NO_CAMERA)).alias("camera_id"), F.coalesce("frame", F.lit(0)).cast("int").alias("frame"), _or_null("det_id"), *BOX, ts.alias("ts"))
    return _stateful(rows, "camera_id", _Camera(p, tracker, delay is not None), TRACK, "None" if delay is None else "EventTime")


class _Series(StatefulProcessor):
    """The newest rows of a name in order of iteration and seq, in buckets of iterations."""

    SPAN = 2048
    CHUNK = 1 << 17  # rows whose windows are made together, about

    def __init__(self, n: int, keep: int | None):
        self.n, self.keep = n, keep if keep is None else max(keep, n)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.about = handle.getValueState("about", "held long, low long, dropped long, revision long")
        self.buckets = handle.getMapState("buckets", "bucket long", "iteration array<long>, seq array<long>, value array<double>")

    def _bucket(self, k: int) -> tuple[np.ndarray, ...]:
        """Iterations, seqs and values of a bucket, and that none of its rows is new."""
        i, s, v = self.buckets.getValue((k,))
        return np.array(i, dtype=np.int64), np.array(s, dtype=np.int64), np.array(v, dtype=float), np.zeros(len(i), dtype=bool)

    def _merged(self, k: int, known: bool, i: np.ndarray, s: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """A bucket with new rows in their places, which is written."""
        rows = i, s, v, np.ones(len(i), dtype=bool)
        if known:
            rows = tuple(np.concatenate(x) for x in zip(self._bucket(k), rows, strict=True))
        i, s, v, _ = rows
        order = np.lexsort((v, np.isnan(v), s, i))
        i, s, v, new = (x[order] for x in rows)
        # arrays go to the store whole (of whole numbers those of C, of 8 bytes), lists value by value
        values = [None if x != x else x for x in v.tolist()] if np.isnan(v).any() else array("d", v.tobytes())
        self.buckets.updateValue((k,), (array("l", i.tobytes()), array("l", s.tobytes()), values))
        return i, s, v, new

    def _near(self, keys: list[int], fresh: dict[int, Callable]) -> Iterator[tuple | None]:
        """Buckets in order: each changed one, and around it so many others that every window of a changed row is there. A None
        comes before a bucket that does not follow the one before it."""
        at, after = 0, self.n - 1  # the bucket after those given out, and the rows since the last changed one
        for k in sorted(fresh):
            to, before, held = bisect_left(keys, k), 0, []
            while at < to and after < self.n - 1:
                rows = self._bucket(keys[at])
                yield rows
                at, after = at + 1, after + len(rows[0])
            while to - len(held) > at and before < self.n - 1:
                held.append(self._bucket(keys[to - len(held) - 1]))
                before += len(held[-1][0])
            if to - len(held) > at:
                yield None
            yield from reversed(held)
            yield fresh[k]()
            at, after = to + 1, 0
        while at < len(keys) and after < self.n - 1:
            rows = self._bucket(keys[at])
            yield rows
            at, after = at + 1, after + len(rows[0])

    def _windows(self, near: Iterator[tuple | None]) -> Iterator[tuple[np.ndarray, ...]]:
        """Iteration, seq, value, median and mean of the rows whose windows have a new row, some CHUNK rows at a time."""
        line, size = [], 0
        past = none = np.zeros(0), np.zeros(0, dtype=bool)  # values of the n - 1 rows before those in hand, and whether they are new
        while True:
            rows = next(near, done := ())
            if rows:
                line.append(rows)
                size += len(rows[0])
            if line and (not rows or size >= self.CHUNK):
                i, s, v, new = (np.concatenate(x) for x in zip(*line, strict=True))
                line, size, before = [], 0, len(past[0])
                v, new = (np.concatenate(x) for x in zip(past, (v, new), strict=True))
                count = np.concatenate([[0], np.cumsum(new)])
                end = np.arange(before + 1, len(v) + 1)
                shown = np.flatnonzero(count[end] > count[np.maximum(0, end - self.n)])
                last = pd.Series(v).rolling(self.n, min_periods=1)
                yield i[shown], s[shown], v[before:][shown], *(x.to_numpy()[before:][shown] for x in (last.median(), last.mean()))
                past = tuple(x[max(0, len(x) - self.n + 1) :] for x in (v, new))
            if rows is None:
                past = none
            elif rows is done:
                return

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        held, low, dropped, revision = self.about.get() if self.about.exists() else (0, _NULL, 0, 0)
        i, s, v = (new[c].to_numpy(t) for c, t in (("iteration", np.int64), ("seq", np.int64), ("value", float)))
        k = i // self.SPAN
        order = np.argsort(k, kind="stable")
        order = order[int(np.searchsorted(k[order], low)) :]
        late = len(k) - len(order)
        i, s, v, k = (x[order] for x in (i, s, v, k))
        known = {k for (k,) in self.buckets.keys()} if self.buckets.exists() else set()
        first = np.flatnonzero(np.diff(k, prepend=k[:1] - 1)).tolist()
        fresh = {(b := int(k[a])): partial(self._merged, b, b in known, i[a:to], s[a:to], v[a:to]) for a, to in pairwise([*first, len(k)])}
        keys = sorted(known | fresh.keys())
        names = ["iteration", "seq", "value", "median", "mean"]
        for out in self._windows(self._near(keys, fresh)):
            yield pd.DataFrame({"name": key[0], **dict(zip(names, out, strict=True)), "revision": revision + 1})
        held += len(k)
        while self.keep is not None and len(keys) > 1 and held - (size := len(self._bucket(keys[0])[0])) >= self.keep:
            self.buckets.removeKey((keys.pop(0),))
            held, low = held - size, keys[0]
        self.about.update((held, low, dropped + late, revision + 1))
        if late:
            yield pd.DataFrame([(key[0], -1, dropped + late, np.nan, np.nan, np.nan, revision + 1)], columns=["name", *names, "revision"])

    def close(self) -> None:
        pass


def rolling_stream(metrics: DataFrame, n: int = 20, keep: int | None = None) -> DataFrame:
    """With each row the median and mean of the last n of its name in order of iteration and seq, as `rolling` has them.

    Rows may come in any order: a late one is put in its place, and it and the up to n - 1 rows
    after it are given out (again) with a higher `revision`; see `revised`. The rows of a name are state
    in buckets of iterations, of which a micro-batch reads and writes what it touches. With `keep` only the newest so many rows
    (at least, in whole buckets) stay; a row older than those is dropped and counted: a row with iteration -1 has
    the number so far as seq. Null and NaN values count for nothing; a null name is a series of its own.
    """
    # a null key would take in the rows of another key beside it, so names are told by a mark before them
    name = F.coalesce(F.concat(F.lit("="), F.col("name")), F.lit("")).alias("name")
    rows = metrics.select(name, _or_null("iteration"), _or_null("seq"), F.col("value").cast("double").alias("value"))
    out = _stateful(rows, "name", _Series(n, keep), "name string, iteration long, seq long, value double, median double, mean double, revision long")
    real = lambda c: F.when(F.col(c) != _NULL, F.col(c)).alias(c)
    return out.select(F.when(F.col("name") != "", F.substring("name", 2, 1 << 30)).alias("name"), real("iteration"), real("seq"), "value", "median", "mean", "revision")


def revised(out: DataFrame) -> DataFrame:
    """What `rolling_stream` has given out so far (as a table), the last revision of each row; rows of a name differ in iteration or seq."""
    rest = F.struct("revision", "value", "median", "mean")
    keys = ["name", "iteration", "seq"]  # dealt first, so that rows are sorted once, not before and after a shuffle
    rows = out.filter("iteration IS NULL OR iteration <> -1").repartition(*keys).groupBy(*keys).agg(F.max(rest).alias("r"))
    return rows.select("name", "iteration", "seq", "r.value", "r.median", "r.mean")


class _Bank(StatefulProcessor):
    """A ring of vectors: row number `place` of a bank is in slot place % size."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "place long")
        self.slots = handle.getMapState("slots", "slot int", "place long, vec_id long, label int, embedding array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("vec_id", kind="stable")
        place = self.next.get()[0] if self.next.exists() else 0
        past = place + len(new)
        new = new.tail(self.size)  # what a whole turn overwrites is not written
        new.insert(1, "place", np.arange(past - len(new), past))
        for p, v, label, e in zip(new["place"].tolist(), new["vec_id"].tolist(), new["label"].tolist(), new["embedding"], strict=True):
            self.slots.updateValue((p % self.size,), (p, v, label, np.asarray(e, dtype=float).tolist()))
        self.next.update((past,))
        yield new[["bank", "place", "vec_id", "label", "embedding"]]

    def close(self) -> None:
        pass


def bank_stream(features: DataFrame, size: int = 8192) -> DataFrame:
    """Bank, place, vec_id, label, embedding (unit length): vectors as they enter their bank, which holds the newest `size`.

    place counts a bank's vectors in order of micro-batches, and of vec_id within one; the bank is what has the last `size`
    places (see `banked`), and is in the state's variable `slots` too, of which a micro-batch writes its own slots alone.
    Null vectors, those with a null entry, and rows with a null vec_id or label are left out.
    """
    e = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull()) & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("bank").isNotNull()
    norm = F.greatest(F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    unit = F.transform(e, lambda x: x / norm).alias("embedding")
    rows = features.filter(sound).select(F.col("bank").cast("int").alias("bank"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), unit)
    return _stateful(rows, "bank", _Bank(size), "bank int, place long, vec_id long, label int, embedding array<double>")


def banked(entered: DataFrame, size: int = 8192) -> DataFrame:
    """What each bank holds after all that `bank_stream` has given out (as a table)."""
    past = entered.groupBy("bank").agg(F.max("place").alias("last"))
    return entered.join(past, "bank").filter(F.col("place") > F.col("last") - size).drop("last")


def write_lines(lines: DataFrame, path: str, checkpoint: str):
    """Metric lines appended to text files; the checkpoint remembers what is written."""
    return lines.writeStream.outputMode("append").format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
