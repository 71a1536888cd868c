"""Scene and render files, settings, and scenes made from events."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.scans import two_level

MOVEMENT = "struct<type:string,path:array<array<double>>,duration:double,repeat:int,reverse:boolean>"
ANIMATION = "struct<type:string,duration:double>"
ELEMENT = (
    "name string, type string, shape string, url string, text string, position array<double>, `from` array<double>, to array<double>, path array<array<double>>, size double, "
    f"fill_color string, border_color string, spawn_animation {ANIMATION}, idle_animation {ANIMATION}, remove_animation {ANIMATION}, movement {MOVEMENT}"
)
STEP = "action string, target string, targets array<string>, duration double, seconds double"
RENDER = f"elements array<struct<{ELEMENT.replace(' string', ':string').replace(' array', ':array').replace(' double', ':double').replace(' struct', ':struct')}>>, sequence array<struct<action:string,target:string,targets:array<string>,duration:double,seconds:double>>"


def read_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """(scene_id, text) of the *.scene files of a folder, whole files; scene_id is the file's stem."""
    files = spark.read.option("pathGlobFilter", "*.scene").text(folder, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.scene$", "").alias("scene_id"), F.col("value").alias("text"))


def read_render(spark: SparkSession, folder: str) -> DataFrame:
    """(scene_id, elements, sequence) of the *.render.json files of a folder."""
    files = spark.read.schema(RENDER).option("multiLine", True).option("pathGlobFilter", "*.render.json").json(folder)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.render\.json$", "").alias("scene_id"), "elements", "sequence")


def first_render(rendered: DataFrame, wanted: str | None = None) -> DataFrame:
    """The scene that is asked for, else the first by name."""
    return rendered.where(F.col("scene_id") == wanted) if wanted else rendered.orderBy("scene_id").limit(1)


#: Where instructions are looked for if nothing says so.
INSTRUCTIONS = ("pipeline/render/dsl_instructions.render.json", "renderer_instructions.json")


def instructions_path(folder: str = "pipeline/render", candidates: tuple[str, ...] = INSTRUCTIONS, env: str = "RENDERER_INSTRUCTIONS_FILE") -> str:
    """The file the environment names, else the first *.render.json of the folder by name, else the first
    candidate that exists, else the first candidate."""
    if os.environ.get(env):
        return os.environ[env]
    if os.path.isdir(folder) and (own := sorted(x for x in os.listdir(folder) if x.endswith(".render.json"))):
        return os.path.join(folder, own[0])
    return next((c for c in candidates if os.path.isfile(c)), candidates[0])


@dataclass(frozen=True)
class Settings:
    """Thresholds of the document flow, with the defaults that apply where nothing is set."""

    reading_order_stride: int = 100_000
    table_y_tolerance: float = 3.0
    table_x_cluster_tolerance: float = 8.0
    table_row_spacing_variance: float = 2.5
    table_width_ratio: float = 0.75
    table_score_threshold: float = 3.0

    @staticmethod
    def read(path: str) -> Settings:
        """From an INI file's [ingestion] section; a missing file or key leaves the default."""
        ini = configparser.ConfigParser()
        if os.path.isfile(path):
            ini.read(path, encoding="utf-8")
        own = dict(ini["ingestion"]) if ini.has_section("ingestion") else {}
        stride = positive_setting(ini, "ingestion", "reading_order_stride", Settings.reading_order_stride)
        return Settings(reading_order_stride=stride, **{k: float(own[k]) for k in Settings.__dataclass_fields__ if k in own and k.startswith("table_")})


def positive_setting(ini: configparser.ConfigParser, section: str, key: str, fallback: int) -> int:
    """A whole number of at least 1; the fallback where it is missing or none."""
    try:
        return max(1, int(ini.get(section, key, fallback=str(fallback))))
    except ValueError:
        return fallback


#: Seconds of a day whose steps one task numbers.
RANGE_S = 3600
# What the types of events do in a scene.
ACTIONS = {"signup": "spawn", "click": "move", "view": "idle", "purchase": "wait", "error": "close"}


def event_steps(events: DataFrame, marks: bool = False) -> DataFrame:
    """(scene_id, ts, event_id, action, target, duration) of events with a user and a time; one scene a day.

    signup spawns, click moves, view idles, purchase waits value / 100 seconds, error closes.
    With marks, events without a user stay, with a null scene_id.
    """
    days = events.where("ts is not null" if marks else "user_id is not null and ts is not null")
    user = F.col("user_id")
    day = F.when(user.isNotNull(), F.date_format("ts", "yyyy-MM-dd"))
    action = F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), F.col("event_type"))
    rows = days.select(day.alias("scene_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action"), F.concat(F.lit("u"), user.cast("string")).alias("name"), "value")
    return rows.select("scene_id", "ts", "event_id", "action", F.when(F.col("action") != "wait", F.col("name")).alias("target"), F.when(F.col("action") == "wait", F.col("value") / 100).alias("duration"))


def scene_from_events(events: DataFrame, range_s: int = RANGE_S) -> tuple[DataFrame, DataFrame]:
    """(elements, steps) of one scene a day: users are elements, and event types actions in order of time.

    Steps are numbered by (ts, event_id), a task numbering range_s seconds of a day.
    """
    users = events.where("user_id is not null and ts is not null").select(F.date_format("ts", "yyyy-MM-dd").alias("scene_id"), "user_id").distinct()
    u = F.col("user_id")
    move = F.when(
        u % 3 != 0,
        F.struct(
            F.element_at(F.array(F.lit("straight"), F.lit("bent"), F.lit("curve")), (u % 3 + 1).cast("int")).alias("type"),
            F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array((u % 7).cast("double"), (u % 4).cast("double"))).alias("path"),
            (F.lit(0.25) * (u % 4 + 1)).alias("duration"),
            (u % 3).cast("int").alias("repeat"),
            (u % 2 == 0).alias("reverse"),
        ),
    )
    animation = lambda name, d: F.struct(F.lit(name).alias("type"), d.cast("double").alias("duration"))
    elements = users.select(
        "scene_id",
        F.concat(F.lit("u"), u.cast("string")).alias("name"),
        F.lit("arrow").alias("type"),
        animation("unidirectional_dotted_spawn", F.lit(0.5) * (u % 3 + 1)).alias("spawn_animation"),
        F.when(u % 2 == 0, animation("dotted_unidirectional_idle", F.lit(1.0))).alias("idle_animation"),
        animation("unidirectional_dotted_remove", F.lit(0.25) * (u % 2 + 1)).alias("remove_animation"),
        move.alias("movement"),
    )
    steps = two_level(event_steps(events), ["scene_id"], F.floor(F.unix_micros("ts") / (range_s * 1_000_000)), ["ts", "event_id"], {"step_no": F.lit(1).cast("long")})
    name = F.col("target")
    return elements, steps.select("scene_id", "step_no", "action", name, F.when(F.col("action").isin("spawn", "close"), F.array(name)).alias("targets"), "duration")
