"""The scene language, from text to timeline."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import scenes as C
from foliant.operators import sinks as K
from foliant.queries import SCENE
from foliant.sources import scenes as X


def parse(text):
    return C.Parser(text).parse()


def element(spark, body, kind="shape"):
    return C.scene_elements(C.statements(spark.createDataFrame([("s", f"ELEMENT A TYPE {kind}\n{body}\nEND")], "scene_id string, text string"))).first()


def test_grammar():
    assert parse("") == []
    for bad in ("ELEMENT A TYPE shape END", "ELEMENT A TYPE blob SIZE 1 END", "SEQUENCE END", "SEQUENCE WAIT x END", "ELEMENT A TYPE shape SIZE 1", "WAIT 1", "ELEMENT A TYPE shape SIZE 1 END ?"):
        with pytest.raises(C.SceneError):
            parse(bad)
    assert parse("ELEMENT A TYPE Shape MOVE straight PATH [(1,2),(3,4),] DURATION 1 REVERSE END")[0]["path"] == [[1.0, 2.0], [3.0, 4.0]]


def test_move_before_position(spark):
    assert element(spark, "MOVE bent TO (1,2) DURATION 1 POSITION (5,5)")["movement"]["path"] == [[0.0, 0.0], [1.0, 2.0]]
    assert element(spark, "POSITION (5,5) MOVE bent TO (1,2) DURATION 1")["movement"]["path"] == [[5.0, 5.0], [1.0, 2.0]]


def test_last_statement_counts(spark):
    assert element(spark, "SIZE 1 SIZE 2")["size"] == 2.0


def test_arrow_path(spark):
    one = element(spark, "MOVE straight PATH [(1,1)] DURATION 1", "arrow")
    assert one["from"] is None and one["movement"] is None
    three = element(spark, "MOVE straight PATH [(0,0),(1,1),(2,0)] DURATION 1", "arrow")
    assert (three["from"], three["to"], three["path"]) == ([0.0, 0.0], [2.0, 0.0], [[1.0, 1.0]])


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "flow.scene").write_text(SCENE)
    (tmp_path / "other.txt").write_text("no scene")
    scenes = X.read_scenes(spark, str(tmp_path))
    done = C.compiled(scenes)
    text = K.scene_json(done).first()
    data = json.loads(text["json"])
    assert text["json"] == json.dumps(data, indent=2) + "\n"
    assert text["file"] == "flow.render.json" and [e["name"] for e in data["elements"]] == ["GATE", "LOGO", "WIRE", "PULSE", "SWING"]
    arrow = data["elements"][2]
    assert arrow["from"] == [0.0, 0.0] and arrow["to"] == [2.0, 0.0] and arrow["path"] == [[1.0, 1.0]] and "movement" not in arrow
    assert data["sequence"][0] == {"action": "spawn", "target": "GATE", "targets": ["GATE", "LOGO"]} and data["sequence"][1] == {"action": "wait", "duration": 0.5}
    (tmp_path / "flow.render.json").write_text(text["json"])
    back = X.first_render(X.read_render(spark, str(tmp_path))).first()
    assert back["scene_id"] == "flow" and len(back["elements"]) == 5 and len(back["sequence"]) == 15


def test_timeline_is_the_sum_of_its_steps(spark):
    s = C.statements(spark.createDataFrame([("s", SCENE)], "scene_id string, text string"))
    t = C.timeline(C.resolved(C.scene_elements(s)), C.scene_steps(s)).orderBy("step_no").collect()
    at = 0.0
    for r in t:
        assert r["start_s"] == pytest.approx(at)
        at += r["run_s"]
    assert at == pytest.approx(7.0)


def test_idle_runs_along_a_wait(spark):
    text = "ELEMENT A TYPE arrow SPAWN unidirectional_solid_spawn 2 IDLE dotted_unidirectional_idle 1 REMOVE x 1 END SEQUENCE IDLE A WAIT 1 SPAWN A WAIT 2 CLOSE A, B WAIT 3 CLOSE A FOO END".replace(" FOO", "")
    s = C.statements(spark.createDataFrame([("s", text)], "scene_id string, text string"))
    t = C.timeline(C.resolved(C.scene_elements(s)), C.scene_steps(s)).orderBy("step_no").collect()
    assert [(r["run_s"], r["wall_s"]) for r in t] == [(0.0, 0.0), (0.0, 1.0), (2.0, 2.0), (2.0, 4.0), (0.5, 0.5), (0.0, 3.0), (0.0, 0.0)]


def test_curve_and_ticks(spark):
    df = spark.createDataFrame([("curve", [[0.0, 0.0], [2.0, 0.0]]), ("downwardsbent", [[0.0, 0.0], [2.0, 0.0]]), ("straight", [[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]])], "k string, p array<array<double>>")
    curve, bent, straight = (r[0] for r in df.select(C.broken_down(F.col("k"), F.col("p"))).collect())
    assert len(curve) == 13 and curve[6] == [1.0, 0.5] and straight == [[0.0, 0.0], [2.0, 0.0]] and bent[2] == [1.0, -1.0]
    assert C.wait_ticks(1.0) == 6 and C.wait_ticks(2.0) == 11 and C.wait_ticks(0) == 0


def test_seconds_stand_in_for_a_duration(spark):
    elements, _ = X.scene_from_events(spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double"))
    missing = {"shape": "string", "url": "string", "text": "string", "position": "array<double>", "from": "array<double>", "to": "array<double>", "path": "array<array<double>>", "size": "double", "fill_color": "string", "border_color": "string"}
    none = C.resolved(elements.select("*", *[F.lit(None).cast(t).alias(c) for c, t in missing.items()]))
    steps = spark.createDataFrame([("s", 1, "wait", None, None, None, 1.5), ("s", 2, "WAIT", None, None, 2.0, 9.0)], "scene_id string, step_no int, action string, target string, targets array<string>, duration double, seconds double")
    assert [r["wall_s"] for r in C.timeline(none, steps).orderBy("step_no").collect()] == [1.5, 2.0]


def test_instructions_are_found(tmp_path, monkeypatch):
    monkeypatch.delenv("RENDERER_INSTRUCTIONS_FILE", raising=False)
    there, first = str(tmp_path / "b.json"), str(tmp_path / "a.json")
    assert X.instructions_path(str(tmp_path / "none"), (first, there)) == first
    (tmp_path / "b.json").write_text("{}")
    assert X.instructions_path(str(tmp_path / "none"), (first, there)) == there
    (tmp_path / "z.render.json").write_text("{}")
    (tmp_path / "y.render.json").write_text("{}")
    assert X.instructions_path(str(tmp_path), (first, there)) == str(tmp_path / "y.render.json")
    monkeypatch.setenv("RENDERER_INSTRUCTIONS_FILE", "/x")
    assert X.instructions_path(str(tmp_path)) == "/x"


def test_settings(tmp_path):
    (tmp_path / "c.cfg").write_text("[ingestion]\ntable_y_tolerance = 4\nreading_order_stride = x\n")
    (tmp_path / "d.cfg").write_text("[ingestion]\nreading_order_stride = -3\n")
    assert X.Settings.read(str(tmp_path / "d.cfg")).reading_order_stride == 1 and X.Settings.read(str(tmp_path / "c.cfg")).reading_order_stride == 100_000
    assert X.Settings.read(str(tmp_path / "c.cfg")).table_y_tolerance == 4.0 and X.Settings.read("/none").table_y_tolerance == 3.0
