"""Timelines by composed state and as a stream."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import scenes as C
from foliant.queries import _event_elements
from foliant.sources import scenes as X
from foliant.streaming import scenes as P

TYPES = ("signup", "click", "view", "purchase", "error", "other")
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"
COLUMNS = ("scene_id", "step_no", "action", "run_s", "wall_s", "start_s", "played", "active_idle")


def made(n, seed=2, days=2):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(i, start + dt.timedelta(seconds=r.randrange(days * 86400)), r.choice([1, 2, 3, 4, 5, 6, None]), r.choice(TYPES), float(r.randrange(500))) for i in range(n)]


def played(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*COLUMNS).collect()), key=str)


def replayed(events):
    """The steps of every day one after the other, with elements as objects."""
    out, days = [], {}
    for i, ts, user, kind, value in sorted((e for e in events if e[2] is not None), key=lambda e: (e[1], e[0])):
        day = days.setdefault(ts.strftime("%Y-%m-%d"), {"n": 0, "clock": 0.0, "there": set(), "idle": set()})
        day["n"] += 1
        run, count, wall = 0.0, 0, None
        if kind == "signup":
            run, count = 0.5 * (user % 3 + 1), 1
            day["there"].add(user)
        elif kind == "error":
            day["idle"].discard(user)
            if user in day["there"]:
                run, count = 0.25 * (user % 2 + 1), 1
            day["there"].discard(user)
        elif kind == "click" and user in day["there"] and user % 3:
            run, count = max(1, user % 3) * (2 if user % 2 == 0 else 1) * 0.25 * (user % 4 + 1), 1
        elif kind == "view" and user % 2 == 0:
            day["idle"].add(user)
            count = 1
        elif kind == "purchase":
            wait = value / 100
            run = wait if day["idle"] & day["there"] else 0.0
            wall = wait + run
        names = {"signup": "spawn", "click": "move", "view": "idle", "purchase": "wait", "error": "close"}
        wall = run if wall is None else wall
        out.append((ts.strftime("%Y-%m-%d"), day["n"], names.get(kind), *(round(x, 6) for x in (run, wall, day["clock"])), count, len(day["idle"] & day["there"])))
        day["clock"] += run
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 8, 64])
def test_a_scene_cut_in_ranges(spark, ranges):
    events = made(192, days=1)
    df = spark.createDataFrame(events, EVENT)
    elements, steps = X.scene_from_events(df, range_s=86400 // ranges)
    assert played(C.timeline(_event_elements(elements), steps, span=-(-192 // ranges))) == replayed(events)


def test_stream_restarted_in_the_middle(spark, tmp_path):
    events = made(240, seed=5)
    source, marks, out, check = (str(tmp_path / x) for x in ("events", "marks", "out", "check"))
    elements = _event_elements(X.scene_from_events(spark.createDataFrame(events, EVENT))[0])
    spark.createDataFrame([], EVENT).write.parquet(marks)
    # batches overlap in time by less than the delay
    moved = sorted(events, key=lambda e: e[1] + dt.timedelta(minutes=random.Random(e[0]).randrange(40)))
    run = lambda: P.play_events(spark, source, marks, elements, out, check, per_batch=1).awaitTermination()
    for part in (moved[:90], moved[90:130]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(source)
    run()
    before = spark.read.schema(P.PLAYED).parquet(out).count()
    assert 0 < before < 130
    spark.createDataFrame(moved[130:], EVENT).coalesce(1).write.mode("append").parquet(source)
    late = [(9000, events[0][1].replace(year=2023), 1, "signup", 1.0)]
    spark.createDataFrame(late, EVENT).coalesce(1).write.mode("append").parquet(source)
    run()
    P.ended(spark, source, marks)
    run()
    assert played(spark.read.schema(P.PLAYED).parquet(out)) == replayed(events)


def test_state_of_closed_elements_goes(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    events = [(i, day + dt.timedelta(minutes=i), 2 + i // 2, "error" if i % 2 else "signup", 1.0) for i in range(20)] + [(50, day + dt.timedelta(days=3), 2, "signup", 1.0)]
    source, marks, out, check = (str(tmp_path / x) for x in ("events", "marks", "out", "check"))
    spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(source)
    spark.createDataFrame([], EVENT).write.parquet(marks)
    elements = _event_elements(X.scene_from_events(spark.createDataFrame(events, EVENT))[0])
    P.play_events(spark, source, marks, elements, out, check).awaitTermination()
    assert spark.read.schema(P.PLAYED).parquet(out).count() == 20
    state = spark.read.format("statestore").option("path", check).option("stateVarName", "elements").load()
    assert state.where("key.scene_id = '2024-01-01'").count() == 0


class Kept(dict):
    """A map or value state in memory."""

    getValue, updateValue, containsKey, iterator = dict.get, dict.__setitem__, dict.__contains__, dict.items

    def removeKey(self, key):
        self.pop(key, None)

    def exists(self):
        return bool(self)

    def get(self):
        return self[()]

    def update(self, value):
        self[()] = value


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Kept())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def test_a_task_holds_a_slot_and_not_a_scene(monkeypatch):
    """all steps of a scene were lists of one task, of one message to the state and of one frame."""
    import pandas as pd

    monkeypatch.setattr(P, "HELD", 500)
    monkeypatch.setattr(P, "TOUCHED", 16)
    r, day = random.Random(4), 1_704_067_200_000_000
    made = [(day + r.randrange(86_400) * 1_000_000, i, r.choice(["spawn", "idle", "close", "move", "wait"]), f"u{r.randrange(100)}") for i in range(3000)]
    frame = pd.DataFrame([(ts, i, a, None if a == "wait" else t, 0.5 if a == "wait" else None, a != "wait", 1.0, 0.5, True, 0.25, True, day + 86_400_000_000) for ts, i, a, t in made], columns=[*P.STEP, "ends_us"])
    player, handle, noon = P.Player(), Handle(), day + 43_200_000_000
    player.init(handle)
    frames = list(player.handleInputRows(("d",), iter(frame[k : k + 250] for k in range(0, 3000, 250)), Watermark(noon)))
    assert sum(map(len, frames)) == sum(ts <= noon for ts, *_ in made) and min(handle.states["slots"])[0] >= noon // P.SLOT_US
    frames += player.handleExpiredTimer(("d",), Watermark(day + 90_000_000_000), None)
    assert len(frames) > 140 and max(map(len, frames)) < 60
    assert all((f["ts"].max() - f["ts"].min()).total_seconds() < 600 for f in frames)
    assert not handle.states["slots"] and not handle.states["pieces"] and all(any(v) for v in handle.states["elements"].values())
    there, idle, want, clock = set(), set(), [], 0.0
    for n, (ts, _, a, t) in enumerate(sorted(made)):
        run, count = 0.0, 0
        if a == "wait":
            run = 0.5 if there & idle else 0.0
        elif a == "close":
            run, count = (0.5, 1) if t in there else (0.0, 0)
            there, idle = there - {t}, idle - {t}
        elif a == "move":
            run, count = (0.25, 1) if t in there else (0.0, 0)
        else:
            (there if a == "spawn" else idle).add(t)
            run, count = (1.0, 1) if a == "spawn" else (0.0, 1)
        want.append((n + 1, a, run, clock, count, len(there & idle)))
        clock += run
    got = pd.concat(frames)[["step_no", "action", "run_s", "start_s", "played", "active_idle"]]
    assert [tuple(x) for x in got.itertuples(index=False)] == want
    assert list(player.handleExpiredTimer(("d",), Watermark(day + 90_000_000_000), None)) == [] and not any(handle.states.values())


def test_files_in_no_order_of_time(spark, tmp_path):
    """The ninth file was read in a second batch, after the watermark had passed its steps."""
    from foliant import queries as Q

    events = spark.createDataFrame(made(200, seed=8), EVENT)
    events.repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 8
    rows = Q.scene_stream(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, Q.scene_timeline(spark, str(tmp_path)).collect()), key=str)
