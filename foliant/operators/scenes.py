"""The scene language: parsing, compiling, defaults, paths and the timeline."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.scans import two_level
from foliant.storage import written

POINT = "array<double>"
STATEMENT = f"struct<scope:string,element_no:int,name:string,type:string,stmt_no:int,kind:string,word:string,num:double,path:array<{POINT}>,is_to:boolean,repeat:int,reverse:boolean,targets:array<string>>"

TOKEN = re.compile(r'\s*(?:("(?:[^"\\\n]|\\.)*")|([+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z0-9_]*)|([\[\](),]))')
ANIMATED = {"SPAWN": "spawn", "IDLE": "idle", "REMOVE": "remove"}


class SceneError(ValueError):
    """The text does not follow the grammar."""


class Parser:
    """Recursive descent over the tokens of one scene: elements, then at most one sequence."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SceneError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            self.tokens.append((("string", "number", "word", "sign")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at, self.out = 0, []

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *kinds: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise SceneError(f"expected {' or '.join(kinds)}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def expect(self, value: str) -> None:
        if self.peek() != value:
            raise SceneError(f"expected {value}, found {self.peek()!r}")
        self.at += 1

    def accept(self, value: str) -> bool:
        hit = self.peek() == value
        self.at += hit
        return hit

    def number(self) -> float:
        return float(self.take("number"))

    def whole(self) -> int:
        word = self.take("number")
        if not word.isdigit():
            raise SceneError(f"expected a whole number, found {word}")
        return int(word)

    def point(self) -> list[float]:
        self.expect("(")
        x = self.number()
        self.expect(",")
        y = self.number()
        self.expect(")")
        return [x, y]

    def points(self) -> list[list[float]]:
        self.expect("[")
        out = [self.point()]
        while self.accept(","):
            if self.peek() == "]":
                break
            out.append(self.point())
        self.expect("]")
        return out

    def add(self, scope: str, no: int, name: str | None, type_: str | None, stmt: int, kind: str, **more: object) -> None:
        row = dict(scope=scope, element_no=no, name=name, type=type_, stmt_no=stmt, kind=kind, word=None, num=None, path=None, is_to=None, repeat=None, reverse=None, targets=None)
        self.out.append(row | more)

    def statement(self) -> tuple[str, dict]:
        word = self.take("word")
        if word in ("TEXT", "URL"):
            return word.lower(), {"word": self.take("string")[1:-1]}
        if word == "POSITION":
            return "position", {"path": [self.point()]}
        if word == "SIZE":
            return "size", {"num": self.number()}
        if word == "SHAPE":
            return "shape", {"word": self.take("word").lower()}
        if word in ("FILL", "BORDER"):
            colour = self.take("word", "string")
            return word.lower(), {"word": colour[1:-1] if colour[:1] == '"' else colour}
        if word in ANIMATED:
            return ANIMATED[word], {"word": self.take("word").lower(), "num": self.number()}
        if word == "MOVE":
            kind = self.take("word").lower()
            to = self.accept("TO")
            if not to:
                self.expect("PATH")
            path = [self.point()] if to else self.points()
            self.expect("DURATION")
            own = {"word": kind, "path": path, "is_to": to, "num": self.number()}
            return "move", own | {"repeat": self.whole() if self.accept("REPEAT") else 1, "reverse": self.accept("REVERSE")}
        raise SceneError(f"{word} is no statement")

    def parse(self) -> list[dict]:
        no = 0
        while self.accept("ELEMENT"):
            no += 1
            name = self.take("word")
            self.expect("TYPE")
            type_ = self.take("word").lower()
            if type_ not in ("shape", "arrow", "image"):
                raise SceneError(f"{type_} is no element type")
            stmt = 0
            while not self.accept("END"):
                stmt += 1
                kind, own = self.statement()
                self.add("element", no, name, type_, stmt, kind, **own)
            if not stmt:
                raise SceneError(f"element {name} has no statement")
        if self.accept("SEQUENCE"):
            step = 0
            while not self.accept("END"):
                step += 1
                action = self.take("word")
                if action in ("SPAWN", "CLOSE"):
                    targets = [self.take("word")]
                    while self.accept(","):
                        targets.append(self.take("word"))
                    self.add("step", 0, None, None, step, action.lower(), word=targets[0], targets=targets)
                elif action in ("IDLE", "MOVE"):
                    self.add("step", 0, None, None, step, action.lower(), word=self.take("word"))
                elif action == "WAIT":
                    self.add("step", 0, None, None, step, "wait", num=self.number())
                else:
                    raise SceneError(f"{action} is no action")
            if not step:
                raise SceneError("the sequence has no step")
        if self.peek() is not None:
            raise SceneError(f"unexpected {self.peek()!r}")
        return self.out


def _parsed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: Parser(t or "").parse())


def statements(scenes: DataFrame) -> DataFrame:
    """One row per statement or step of (scene_id, text); a text that does not parse is an error."""
    return scenes.select("scene_id", F.explode(F.pandas_udf(_parsed, f"array<{STATEMENT}>")("text")).alias("s")).select("scene_id", "s.*")


def scene_elements(stmts: DataFrame) -> DataFrame:
    """One row per element; of repeated statements the last counts.

    MOVE ... TO starts where the last POSITION before it put the element, else at (0, 0). An
    arrow's MOVE gives from, to and inner points instead of a movement; a path of one point
    does nothing to it.
    """
    own = stmts.where("scope = 'element'")
    so_far = Window.partitionBy("scene_id", "element_no").orderBy("stmt_no").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("kind") == "position", F.col("path")[0]), ignorenulls=True).over(so_far)
    origin = F.array(F.lit(0.0), F.lit(0.0))
    path = F.when(F.col("is_to"), F.array(F.coalesce(at, origin), F.col("path")[0])).otherwise(F.col("path"))
    own = own.withColumn("path", F.when(F.col("kind") == "move", path).otherwise(F.col("path")))
    last = lambda value, test: F.max_by(value, F.when(test, F.col("stmt_no")))
    kind, arrow = F.col("kind"), F.col("type") == "arrow"
    word = lambda k: last(F.col("word"), kind == k)
    animation = lambda k: last(F.struct(F.col("word").alias("type"), F.col("num").alias("duration")), kind == k)
    moved = (kind == "move") & arrow & (F.size("path") >= 2)
    inner = F.when(F.size("path") > 2, F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0))))
    ends = F.struct(F.element_at("path", 1).alias("from"), F.element_at("path", -1).alias("to"), inner.alias("path"))
    movement = F.struct(F.col("word").alias("type"), "path", F.col("num").alias("duration"), "repeat", "reverse")
    out = own.groupBy("scene_id", "element_no", "name", "type").agg(
        word("shape").alias("shape"), word("url").alias("url"), word("text").alias("text"),
        last(F.col("path")[0], kind == "position").alias("position"), last(ends, moved).alias("__e"), last(F.col("num"), kind == "size").alias("size"),
        word("fill").alias("fill_color"), word("border").alias("border_color"),
        animation("spawn").alias("spawn_animation"), animation("idle").alias("idle_animation"), animation("remove").alias("remove_animation"),
        last(movement, (kind == "move") & ~arrow).alias("movement"),
    )
    return out.select(
        "scene_id", "element_no", "name", "type", "shape", "url", "text", "position", F.col("__e.from").alias("from"), F.col("__e.to").alias("to"), F.col("__e.path").alias("path"),
        "size", "fill_color", "border_color", "spawn_animation", "idle_animation", "remove_animation", "movement",
    )


def scene_steps(stmts: DataFrame) -> DataFrame:
    """(scene_id, step_no, action, target, targets, duration)."""
    return stmts.where("scope = 'step'").select("scene_id", F.col("stmt_no").alias("step_no"), F.col("kind").alias("action"), F.col("word").alias("target"), "targets", F.when(F.col("kind") == "wait", F.col("num")).alias("duration"))


def compiled(scenes: DataFrame) -> DataFrame:
    """One row per scene: elements and sequence in order; a scene without either has empty arrays."""
    stmts = statements(scenes)
    elements = scene_elements(stmts)
    steps = scene_steps(stmts)
    fields = [c for c in elements.columns if c not in ("scene_id", "element_no")]
    e = elements.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("element_no", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("elements"))
    own = F.struct("action", "target", "targets", "duration")
    s = steps.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_no", own.alias("s")))), lambda x: x["s"]).alias("sequence"))
    joined = scenes.select("scene_id").join(e, "scene_id", "left").join(s, "scene_id", "left")
    return joined.select("scene_id", F.coalesce("elements", F.array()).alias("elements"), F.coalesce("sequence", F.array()).alias("sequence"))


# ------------------------------------------------------------------ defaults

# Fixed values.
SHAPES = ("circle", "rectangle", "square")
ARROWS = ("unidirectional_solid", "bidirectional_solid", "bidirectional_dotted", "solid", "dotted", "unidirectional_dotted")
IDLE = ("dotted_unidirectional_idle", "dotted_bidirectional_idle")
ARROW_PHASES = {
    "spawn": ("unidirectional_dotted_spawn", "unidirectional_solid_spawn", "bidirectional_dotted_spawn", "bidirectional_solid_spawn"),
    "remove": ("unidirectional_dotted_remove", "unidirectional_solid_remove", "bidirectional_dotted_remove", "bidirectional_solid_remove"),
}
MOVEMENTS = ("straight", "bent", "upwardsbent", "downwardsbent", "curve", "upwardscurve", "downwardscurve")
QUARTER_TURN = 1.5708


def phase_animation(elements: DataFrame, phase: str) -> Column:
    """struct(name, duration) of a phase, or null.

    Shapes and images have a spawn and a remove animation whatever its name, and no idle one.
    An arrow's is looked up by name. Where spawn or remove resolve to none, elements fade in
    or out in 0.5 seconds.
    """
    column = f"{phase}_animation"
    given = F.col(column)
    name, duration = F.lower(F.coalesce(given["type"], F.lit(""))), T.number(given["duration"], 0.45)
    arrow, plain = F.col("type") == "arrow", F.col("type").isin("shape", "image")
    if phase == "idle":
        return F.when(given.isNotNull() & arrow & name.isin(*IDLE), F.struct(name.alias("name"), duration.alias("duration")))
    fade = "fade_in" if phase == "spawn" else "fade_out"
    found = F.when(given.isNotNull() & plain, F.struct(F.lit(fade).alias("name"), duration.alias("duration")))
    found = found.when(given.isNotNull() & arrow & name.isin(*ARROW_PHASES[phase]), F.struct(name.alias("name"), duration.alias("duration")))
    return found.otherwise(F.struct(F.lit(fade).alias("name"), F.lit(0.5).alias("duration")))


def resolved(elements: DataFrame) -> DataFrame:
    """Elements with defaults applied; of equal names in a scene the last counts.

    drawable is the object that is drawn; width and height its size; angle and start_angle
    the turns of an arrow's tips.
    """
    if "element_no" in elements.columns:
        last = Window.partitionBy("scene_id", "name").orderBy(F.desc("element_no"))
        elements = elements.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    kind, shape = F.lower(F.coalesce("type", F.lit("shape"))), F.lower(F.coalesce("shape", F.lit("")))
    image = (kind == "image") & F.col("url").isNotNull()
    drawable = F.when(image, "image").when((kind == "arrow") & shape.isin(*ARROWS), shape).when(kind == "arrow", "unidirectional_dotted").when((kind == "shape") & shape.isin(*SHAPES), shape).otherwise("square")
    size = F.when(image, T.number(F.col("size"), 1.5)).when(kind == "shape", T.number(F.col("size"), 1.6)).when(kind != "arrow", F.lit(1.6))
    width = F.when(drawable == "circle", 2 * size).otherwise(size)
    three = lambda c, d: F.when(F.size(c) >= 2, F.array(c[0].cast("double"), c[1].cast("double"), F.coalesce(F.get(c, F.lit(2)).cast("double"), F.lit(0.0)))).otherwise(F.array(*[F.lit(x) for x in d]))
    start, end = three(F.col("from"), (0.0, 0.0, 0.0)), three(F.col("to"), (1.0, 0.0, 0.0))
    inner = F.coalesce(F.transform("path", lambda p: three(p, (0.0, 0.0, 0.0))), F.array().cast("array<array<double>>"))
    turn = lambda a, b: F.atan2(b[1] - a[1], b[0] - a[0]) - F.lit(QUARTER_TURN)
    before, after = F.when(F.size(inner) > 0, F.element_at(inner, -1)).otherwise(start), F.when(F.size(inner) > 0, F.element_at(inner, 1)).otherwise(end)
    arrow = kind == "arrow"
    m = F.col("movement")
    move = F.when(
        m.isNotNull(),
        F.struct(
            F.when(F.lower(F.coalesce(m["type"], F.lit("straight"))).isin(*MOVEMENTS), F.lower(F.coalesce(m["type"], F.lit("straight")))).otherwise("straight").alias("type"),
            F.transform(F.coalesce(m["path"], F.array().cast("array<array<double>>")), lambda p: T.point(p)).alias("path"),
            T.number(m["duration"], 1.0).alias("duration"),
            T.integer(m["repeat"]).alias("repeat"),
            F.coalesce(m["reverse"], F.lit(False)).alias("reverse"),
        ),
    )
    return elements.select(
        "scene_id", "name", kind.alias("type"), drawable.alias("drawable"), width.alias("width"), F.when(drawable == "rectangle", 2 * size).otherwise(width).alias("height"),
        T.point(F.col("position")).alias("position"), F.when(kind == "image", F.coalesce("text", "name")).otherwise(F.col("text")).alias("text"),
        F.col("fill_color"), F.coalesce("border_color", F.lit("WHITE")).alias("border_color"),
        F.when(arrow, start).alias("from"), F.when(arrow, end).alias("to"), F.when(arrow, inner).alias("path"),
        F.when(arrow, turn(before, end)).alias("angle"), F.when(arrow & drawable.startswith("bi"), turn(after, start)).alias("start_angle"),
        phase_animation(elements, "spawn").alias("spawn"), phase_animation(elements, "idle").alias("idle"), phase_animation(elements, "remove").alias("remove"), move.alias("movement"),
    )


# ------------------------------------------------------------------ paths


def broken_down(kind: Column, path: Column) -> Column:
    """The way a movement of at least two points takes.

    straight goes from the first to the last point; bent and curve keep more than two points,
    else bend at the middle, up unless the name says downwards.
    """
    a, b = path[0], path[1]
    ax, ay, bx, by = a[0], a[1], b[0], b[1]
    sign = F.when(kind.startswith("downwards"), F.lit(-1.0)).otherwise(F.lit(1.0))
    mx, my = (ax + bx) / 2, (ay + by) / 2
    dx, dy = F.abs(bx - ax), F.abs(by - ay)
    bent = F.array(a, F.array(mx, ay), F.array(mx, ay + sign * F.greatest(F.lit(0.8), dy, dx / 2)), b)
    cx, cy = mx, my + sign * F.greatest(F.lit(1.0), dx, dy) / 2

    def on_curve(i: Column) -> Column:
        t = i / 12.0
        u = 1.0 - t
        return F.array(u * u * ax + 2 * u * t * cx + t * t * bx, u * u * ay + 2 * u * t * cy + t * t * by)

    curve = F.transform(F.sequence(F.lit(0), F.lit(12)), on_curve)
    return F.when(kind == "straight", F.array(F.element_at(path, 1), F.element_at(path, -1))).when(F.size(path) > 2, path).when(kind.contains("bent"), bent).when(kind.contains("curve"), curve).otherwise(F.array(F.element_at(path, 1), F.element_at(path, -1)))


def movement_paths(elements: DataFrame) -> DataFrame:
    """(scene_id, name, path_no, path, duration) of every leg, forward and, if reversed, back."""
    m = F.col("movement")
    way = broken_down(m["type"], m["path"])
    legs = F.flatten(F.array_repeat(F.when(m["reverse"], F.array(way, F.reverse(way))).otherwise(F.array(way)), m["repeat"]))
    rows = elements.where(m.isNotNull() & (F.size(m["path"]) >= 2)).select("scene_id", "name", m["duration"].alias("duration"), F.posexplode(legs).alias("p", "path"))
    return rows.select("scene_id", "name", (F.col("p") + 1).alias("path_no"), "path", "duration")


def move_duration(m: Column) -> Column:
    """Legs times duration; 0 without a movement of two points."""
    legs = F.greatest(F.lit(1), m["repeat"]) * F.when(m["reverse"], 2).otherwise(1)
    return F.when(m.isNotNull() & (F.size(m["path"]) >= 2), legs * m["duration"]).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ timeline


def targets_of() -> Column:
    """The list of targets, else the one target."""
    several = F.filter(F.coalesce("targets", F.array().cast("array<string>")), lambda t: t.isNotNull())
    one = F.when(F.col("target").isNotNull(), F.array("target")).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("action").isin("spawn", "close") & (F.size(several) > 0), several).otherwise(one)


#: Steps of a scene that one task plays.
STEPS = 1 << 14


def element_facts(elements: DataFrame) -> DataFrame:
    """What a step needs to know of a resolved element: (scene_id, t, spawn_s, remove_s, can_idle, move_s, can_move)."""
    return elements.select("scene_id", F.col("name").alias("t"), F.col("spawn.duration").alias("spawn_s"), F.col("remove.duration").alias("remove_s"), F.col("idle").isNotNull().alias("can_idle"), move_duration(F.col("movement")).alias("move_s"), (F.col("movement").isNotNull() & (F.size("movement.path") >= 2)).alias("can_move"))


def wait_seconds(duration: Column) -> Column:
    return F.greatest(F.lit(0.0), T.number(duration, 0.0))


def timeline(elements: DataFrame, steps: DataFrame, span: int = STEPS) -> DataFrame:
    """(scene_id, step_no, action, run_s, wall_s, start_s, played, active_idle).

    elements are resolved. run_s is the time of video a step makes, wall_s the time it takes
    (a wait plays its time where an idle animation is active, and sleeps it in either case; its
    duration may be given as `seconds`), start_s the video time before
    it; played counts the targets it acts on, active_idle the idle animations that run along.
    State is not mutated but read off the events: an element is there if its last spawn or
    close before the step is a spawn, and its idle animation runs if its last idle or close is
    an idle. A close is seen by its own step for idle animations, and by later steps for
    presence. Unknown targets, actions and elements without what a step needs do nothing.

    A scene is cut in ranges of `span` steps. What a range does to the state is a summary (an element's
    last spawn or close and its last idle or close, the sum of idle animations begun and ended, the
    seconds run); summaries compose in order, so a task plays a range and not a scene, whatever its length.
    """
    rounds = F.floor(F.col("step_no") / span)
    # numbered and played steps are read several times below
    steps = written(steps.withColumn("action", F.lower("action")), "scene-steps")
    acts = steps.select("scene_id", "step_no", "action", F.explode(F.array_distinct(targets_of())).alias("t")).join(element_facts(elements), ["scene_id", "t"])
    action = F.col("action")
    present = F.when(action.isin("spawn", "close"), action == "spawn")
    idling = F.when((action == "idle") & F.col("can_idle"), True).when(action == "close", False)
    acts = two_level(acts, ["scene_id", "t"], rounds, ["step_no"], lasts={"there": present, "idle": idling})
    there, idle = F.coalesce("there", F.lit(False)), F.coalesce("idle", F.lit(False))
    runs = F.when(action == "spawn", True).when(action == "close", there).when(action == "move", there & F.col("can_move")).when(action == "idle", F.col("can_idle")).otherwise(False)
    seconds = F.when(action == "spawn", F.col("spawn_s")).when(action == "close", F.col("remove_s")).when(action == "move", F.greatest(F.lit(0.0), F.col("move_s")))
    # an idle animation is shown while its element is there: +1 and -1 where that begins and ends, summed over the steps
    shown = F.coalesce(idling, idle) & F.coalesce(present, there)
    acts = acts.select("scene_id", "step_no", F.when(runs, seconds).alias("act_s"), runs.cast("int").alias("ran"), (shown.cast("int") - (idle & there).cast("int")).alias("change"))
    per_step = acts.groupBy("scene_id", "step_no").agg(F.max("act_s").alias("act_s"), F.sum("ran").alias("played"), F.sum("change").alias("change"))
    given = F.coalesce("duration", "seconds") if "seconds" in steps.columns else F.col("duration")
    rows = steps.select("scene_id", "step_no", "action", given.alias("duration")).join(per_step, ["scene_id", "step_no"], "left")
    rows = written(rows, "scene-acts")
    rows = two_level(rows, ["scene_id"], rounds, ["step_no"], {"active_idle": F.coalesce("change", F.lit(0))})
    wait, waits = wait_seconds(F.col("duration")), action == "wait"
    run = F.when(waits, F.when(F.col("active_idle") > 0, wait).otherwise(F.lit(0.0))).otherwise(F.coalesce("act_s", F.lit(0.0)))
    rows = rows.withColumn("run_s", run).withColumn("wall_s", F.when(waits, wait + F.col("run_s")).otherwise(F.col("run_s")))
    rows = two_level(rows, ["scene_id"], rounds, ["step_no"], {"ends_s": F.col("run_s")})
    return rows.select("scene_id", "step_no", "action", "run_s", "wall_s", (F.col("ends_s") - F.col("run_s")).alias("start_s"), F.coalesce("played", F.lit(0)).cast("long").alias("played"), F.col("active_idle").cast("long").alias("active_idle"))


def wait_ticks(seconds: float, tick: float = 0.2) -> int:
    """How many ticks a wait is played in, with the rounding of repeated subtraction."""
    left, n = max(seconds, 0.0), 0
    while left > 0.0:
        left -= min(max(tick, 0.01), left)
        n += 1
        if not math.isfinite(left):
            raise ValueError("a wait has no end")
    return n
