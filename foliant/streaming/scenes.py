"""Scene timelines over an unbounded stream of steps (T19 to T26), with keyed state in event time.

A scene's state is its clock, the elements that are there or idle, and the steps that have come but
that the watermark has not passed. Steps are played in order of time once the watermark is beyond
them, so they may come in any order within the delay; what comes later than that is late and is not
played. Elements that are closed and not idle are forgotten, and so is a scene that has ended.

Steps wait in slots of ten minutes, in pieces, and are read and played a slot at a time; elements are held for some
ten thousands of them. So a task holds a slot of a scene and never all of it, however long it waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliant.operators.scenes import element_facts, wait_seconds
from foliant.sources.scenes import event_steps

PLAYED = "scene_id string, ts timestamp, step_no long, action string, run_s double, wall_s double, start_s double, played long, active_idle long"
#: A step as it waits in the state, in the order in which steps are played.
STEP = ("ts_us", "event_id", "action", "target", "wait_s", "known", "spawn_s", "remove_s", "can_idle", "move_s", "can_move")
WAITING = pa.schema([("ts_us", pa.int64()), ("event_id", pa.int64()), ("action", pa.string()), ("target", pa.string()), ("wait_s", pa.float64()), ("known", pa.bool_()), ("spawn_s", pa.float64()), ("remove_s", pa.float64()), ("can_idle", pa.bool_()), ("move_s", pa.float64()), ("can_move", pa.bool_())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds of a slot; steps that are held before they go to their slots; elements whose state is held at once.
SLOT_US, HELD, TOUCHED = 600_000_000, 50_000, 20_000


class Player(StatefulProcessor):
    """Plays a scene's steps up to the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "step_no long, clock double, active long, played_to long")
        self.slots = handle.getMapState("slots", "slot long", "pieces int, first_us long")
        self.pieces = handle.getMapState("pieces", "slot long, piece int", "steps binary")
        self.elements = handle.getMapState("elements", "t string", "there boolean, idle boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # marks; a filter on them would be moved below the watermark, which then would not see them
            return
        _, _, _, played_to = self._clock()
        held, ends = [], None
        for batch in rows:
            batch = batch[batch["ts_us"] > played_to]  # what is not later than what was played is late
            if len(batch):
                held.append(pa.RecordBatch.from_pandas(batch[list(STEP)], WAITING, preserve_index=False))
                ends = max(ends or 0, int(batch["ends_us"].max()))
            if sum(len(b) for b in held) >= HELD:
                self._wait(held)
                held = []
        if held:
            self._wait(held)
        if ends is not None:
            self.handle.registerTimer(ends // 1000 + 1)
        yield from self._play(key, timerValues.getCurrentWatermarkInMs() * 1000, ends)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._play(key, timerValues.getCurrentWatermarkInMs() * 1000, None)

    def close(self) -> None:
        pass

    def _clock(self) -> tuple[int, float, int, int]:
        return tuple(self.clock.get()) if self.clock.exists() else (0, 0.0, 0, -(1 << 62))

    def _wait(self, batches: list[pa.RecordBatch]) -> None:
        """Puts steps into their slots, a piece for each."""
        steps = pa.Table.from_batches(batches).sort_by([("ts_us", "ascending"), ("event_id", "ascending")]).combine_chunks()
        slots = [ts // SLOT_US for ts in steps["ts_us"].to_pylist()]
        begins = [i for i, s in enumerate(slots) if i == 0 or s != slots[i - 1]]
        for at, end in zip(begins, [*begins[1:], len(slots)]):
            first = steps["ts_us"][at].as_py()
            n, least = self.slots.getValue((slots[at],)) or (0, first)
            self.pieces.updateValue((slots[at], n), (packed(steps.slice(at, end - at)),))
            self.slots.updateValue((slots[at],), (n + 1, min(first, least)))

    def _play(self, key: tuple, upto: int, ends: int | None) -> Iterator[pd.DataFrame]:
        waiting = sorted((s[0], *v) for s, v in self.slots.iterator())
        ready = [(slot, n) for slot, n, first in waiting if first <= upto]
        later = [first for _, _, first in waiting if first > upto]
        step_no, clock, active, _ = self._clock()
        touched: dict[str, tuple[bool, bool]] = {}
        for slot, n in ready:
            steps = pa.concat_tables([unpacked(self.pieces.getValue((slot, i))[0]) for i in range(n)]).sort_by([("ts_us", "ascending"), ("event_id", "ascending")])
            due = sum(ts <= upto for ts in steps["ts_us"].to_pylist())
            for i in range(n):
                self.pieces.removeKey((slot, i))
            self.slots.removeKey((slot,))
            if due < len(steps):
                later.append(steps["ts_us"][due].as_py())
                self._wait(steps.slice(due).to_batches())
            out = []
            columns = [c.to_pylist() for c in steps.slice(0, due).columns]
            for ts, _, action, t, wait_s, known, spawn_s, remove_s, can_idle, move_s, can_move in zip(*columns):
                step_no, run, played = step_no + 1, 0.0, 0
                if action == "wait":
                    run = wait_s if active > 0 else 0.0
                elif known and t is not None:
                    if t not in touched:
                        if len(touched) >= TOUCHED:
                            self._keep(touched)
                            touched = {}
                        touched[t] = tuple(self.elements.getValue((t,)) or (False, False))
                    there, idle = touched[t]
                    was = there and idle
                    if action == "spawn":
                        run, played, there = spawn_s or 0.0, 1, True
                    elif action == "close":
                        run, played, there, idle = (remove_s or 0.0 if there else 0.0), int(there), False, False
                    elif action == "move" and there and can_move:
                        run, played = max(0.0, move_s), 1
                    elif action == "idle" and can_idle:
                        played, idle = 1, True
                    active += int(there and idle) - int(was)
                    touched[t] = there, idle
                out.append((key[0], pd.Timestamp(ts, unit="us"), step_no, action, run, wait_s + run if action == "wait" else run, clock, played, active))
                clock += run
            yield pd.DataFrame(out, columns=["scene_id", "ts", "step_no", "action", "run_s", "wall_s", "start_s", "played", "active_idle"])
        if ready:
            self._keep(touched)
            self.clock.update((step_no, clock, active, upto))
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)
        elif not ready and ends is None and self.clock.exists():
            self._forget()

    def _keep(self, touched: dict[str, tuple[bool, bool]]) -> None:
        """Writes the state of elements; those that are neither there nor idle have none."""
        for t, state in touched.items():
            if any(state):
                self.elements.updateValue((t,), state)
            else:
                self.elements.removeKey((t,))

    def _forget(self) -> None:
        self.clock.clear()
        self.slots.clear()
        self.pieces.clear()
        self.elements.clear()


def packed(steps: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, WAITING) as writer:
        writer.write_table(steps)
    return out.getvalue().to_pybytes()


def unpacked(steps: bytes) -> pa.Table:
    return pa.ipc.open_stream(steps).read_all()


def played_steps(steps: DataFrame, elements: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The streamed twin of operators.scenes.timeline: PLAYED rows of a stream of steps.

    steps is a stream of (scene_id, ts, event_id, action, target, duration, ends), each acting on one
    target at most; ends is when its scene is over. A row whose scene_id is null moves the
    watermark and is not played. elements are resolved and do not stream.
    """
    facts = element_facts(elements).withColumnsRenamed({"t": "target"}).withColumn("known", F.lit(True))
    marked = steps.withWatermark("ts", delay).withColumn("action", F.lower("action"))
    joined = marked.join(facts, ["scene_id", "target"], "left")
    rows = joined.select("scene_id", "ts", F.unix_micros("ts").alias("ts_us"), "event_id", "action", "target", wait_seconds(F.col("duration")).alias("wait_s"), F.coalesce("known", F.lit(False)).alias("known"), "spawn_s", "remove_s", "can_idle", "move_s", "can_move", F.unix_micros("ends").alias("ends_us"))
    return rows.groupBy("scene_id").transformWithStateInPandas(Player(), PLAYED, "Append", "EventTime")


def day_steps(events: DataFrame) -> DataFrame:
    """Steps of one scene a day from a stream of events; events without a user only move the watermark."""
    steps = event_steps(events, marks=True)
    return steps.withColumn("ends", F.date_trunc("day", "ts") + F.expr("interval 1 day"))


def play_events(spark: SparkSession, events: str, marks: str, elements: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", per_batch: int | None = 8, **trigger: object) -> StreamingQuery:
    """Plays the events of Parquet files under `events` and appends the played steps as Parquet to `out`.

    marks is a folder for rows like events that only move the watermark (see ended). A run that is
    stopped goes on where its checkpoint ends; the file sink takes each batch once. Files that are in no
    order of time go in one batch (per_batch None), as those of later batches would be late.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # the stores of an executor share one bounded cache, where each had write buffers of its own
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    schema = spark.read.parquet(events).schema
    options = {"maxFilesPerTrigger": per_batch} if per_batch else {}
    read = lambda path: spark.readStream.schema(schema).options(**options).parquet(path)
    rows = played_steps(day_steps(read(events).unionByName(read(marks))), elements, delay)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ended(spark: SparkSession, events: str, marks: str) -> None:
    """Says that nothing earlier comes any more: a mark far in the future."""
    schema = spark.read.parquet(events).schema
    row = spark.range(1).select(*[(F.timestamp_seconds(F.lit(4_102_444_800)) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    row.coalesce(1).write.mode("append").parquet(marks)
