"""Small settings files, read on the driver: cameras, environment, detector, tracker, labels."""

from __future__ import annotations

import configparser
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import percent_encoded

CAMERA = "pos int, id string, name string, nvr int, channel int, subtype int"

#: The registered cameras as (id, name, nvr, channel, subtype).
CAMERAS = [
    ("ground_01", "entrance", 225, 7, 1),
    ("ground_02", "ground_02", 225, 16, 1),
    ("ground_03", "ground_03", 225, 10, 1),
    ("ground_04", "ground_04", 225, 18, 1),
    ("ground_05", "ground_05", 225, 20, 1),
    ("ground_06", "ground_06", 225, 11, 1),
]

#: Class labels, the place in the list is the class id.
LABELS = (
    "person,bicycle,car,motorcycle,airplane,bus,train,truck,boat,traffic light,fire hydrant,stop sign,parking meter,bench,bird,cat,dog,horse,sheep,cow,"
    "elephant,bear,zebra,giraffe,backpack,umbrella,handbag,tie,suitcase,frisbee,skis,snowboard,sports ball,kite,baseball bat,baseball glove,skateboard,"
    "surfboard,tennis racket,bottle,wine glass,cup,fork,knife,spoon,bowl,banana,apple,sandwich,orange,broccoli,carrot,hot dog,pizza,donut,cake,chair,couch,"
    "potted plant,bed,dining table,toilet,tv,laptop,mouse,remote,keyboard,cell phone,microwave,oven,toaster,sink,refrigerator,book,clock,vase,scissors,"
    "teddy bear,hair drier,toothbrush"
).split(",")


def parse_yaml_lists(text: str) -> dict[str, object]:
    """The part of YAML that the settings use: sections of ``key: value``, or of lists of them.

    Comments, directives and quotes are stripped; numbers and bracketed lists become values.
    """
    out: dict[str, object] = {}
    section = None
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not body.strip() or body.startswith("%") or body.strip() == "---":
            continue
        indent, item = len(body) - len(body.lstrip()), body.strip()
        if indent == 0 and item.endswith(":"):
            section = item[:-1]
            out[section] = None
            continue
        entry = item.startswith("- ")
        key, _, value = (item[2:] if entry else item).partition(":")
        if section is None or indent == 0 and not entry:
            out[key.strip()] = _scalar(value)
        elif entry:
            out[section] = [*(out[section] or []), {key.strip(): _scalar(value)}]
        elif isinstance(out[section], list):
            out[section][-1][key.strip()] = _scalar(value)
        else:
            out[section] = {**(out[section] or {}), key.strip(): _scalar(value)}
    return out


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def cameras(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The camera registry with its order; ``rows`` default to the fixed ones."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(CAMERAS if rows is None else rows)], CAMERA)


def camera_rows(text: str | None) -> list[tuple]:
    """Registry rows of a YAML text; none if it is missing or has no cameras."""
    found = parse_yaml_lists(text or "").get("cameras") or []
    return [(c["id"], c.get("name"), c.get("nvr"), c.get("channel"), c.get("subtype")) for c in found]


def requested_ids(spark: SparkSession, wanted: str) -> DataFrame:
    """(pos, id) of a comma list: trimmed, blanks dropped, order and repeats kept."""
    return request_rows(spark.range(1).select(F.lit(wanted).alias("wanted")))


def request_rows(lists: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, id): the ids of every comma list in ``wanted``, as ``requested_ids`` reads one."""
    each = lists.select(*keep, F.posexplode(F.split("wanted", ",")).alias("pos", "id"))
    return each.select(*keep, "pos", _stripped("id").alias("id")).where("id <> ''")


def select_cameras(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested cameras in request order; of a repeated registry id the last row counts."""
    last = registry.groupBy("id").agg(F.max_by(F.struct("name", "nvr", "channel", "subtype"), "pos").alias("c"))
    return requested.join(last, "id").select(*[c for c in requested.columns if c not in ("pos", "id")], "pos", "id", "c.*")


def missing_cameras(requested: DataFrame, registry: DataFrame) -> DataFrame:
    return requested.join(registry.select("id"), "id", "left_anti")


def load_cameras(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Like ``select_cameras``, but unknown ids are an error that lists them in order."""
    unknown = [r.id for r in missing_cameras(requested, registry).orderBy("pos").collect()]
    if unknown:
        raise ValueError(f"unknown camera IDs: {','.join(unknown)}")
    return select_cameras(requested, registry)


def override_subtype(selected: DataFrame, subtype: str | None) -> DataFrame:
    """Replace the subtype of all cameras unless the override is blank."""
    text = (subtype or "").strip()
    return selected.withColumn("subtype", F.lit(int(text)).cast("int")) if text else selected


def stream_urls(selected: DataFrame, env: Mapping[str, str]) -> DataFrame:
    """Adds ``url``. Credentials enter the plan: keep the result out of logs and tables."""
    base = F.concat(
        F.lit("rtsp://"), percent_encoded(F.lit(env["CAMERA_USERNAME"])), F.lit(":"), percent_encoded(F.lit(env["CAMERA_PASSWORD"])),
        F.lit(f"@{env['NVR_225_HOST']}:{env['NVR_225_PORT']}/cam/realmonitor?channel="),
    )
    return selected.withColumn("url", F.concat(base, F.col("channel").cast("string"), F.lit("&subtype="), F.col("subtype").cast("string")))


def offline_urls(selected: DataFrame, folder: str, request: str | None = None) -> DataFrame:
    """Adds ``url`` by a camera's place in its request; ``request`` names the column that tells requests apart."""
    place = Window.partitionBy(request or F.lit(0)).orderBy("pos")  # a handful of cameras each
    return selected.withColumn("url", F.format_string("file://%s/cam_%02d.mp4", F.lit(folder.rstrip("/") or "/"), F.row_number().over(place) - 1))


def parse_env(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, value) of ``KEY=value`` lines: blanks and comments skipped, split once, quotes stripped."""
    text = lines.select(_stripped(column).alias("line")).where("line <> '' and not startswith(line, '#') and contains(line, '=')")
    parts = F.split("line", "=", 2)
    value = F.regexp_replace(F.regexp_replace(_stripped(parts[1]), '^"+|"+$', ""), "^'+|'+$", "")
    return text.select(_stripped(parts[0]).alias("key"), value.alias("value"))


def _stripped(text):
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", "")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small settings file, whole; None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """The camera registry of a YAML file; empty if it is missing."""
    return cameras(spark, camera_rows(read_text(spark, path)))


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of an environment file; empty if it is missing."""
    text = read_text(spark, path)
    return parse_env(spark.createDataFrame([(x,) for x in (text or "").splitlines()], "value string"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, label) of a file with a label a line; the line number is the class id."""
    return labels(spark, [x.strip() for x in (read_text(spark, path) or "").splitlines()])


def read_detector(spark: SparkSession, path: str) -> DetectorSettings:
    return DetectorSettings.read(read_text(spark, path) or "")


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    return tracker_parameters(spark, read_text(spark, path) or "")


def overlay_env(file_values: DataFrame, process: DataFrame) -> DataFrame:
    """The process environment overrides keys of the file and adds none."""
    over = process.select("key", F.col("value").alias("_over"))
    return file_values.join(over, "key", "left").select("key", F.coalesce("_over", "value").alias("value"))


def labels(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The label dimension; ``names`` default to the fixed ones."""
    return spark.createDataFrame(list(enumerate(LABELS if names is None else names)), "class_id int, label string")


@dataclass(frozen=True)
class DetectorSettings:
    threshold: float = 0.45
    top_k: int = 300
    excluded: tuple[int, ...] = tuple(range(1, 80))
    batch_size: int = 6

    @classmethod
    def read(cls, text: str) -> DetectorSettings:
        """From the text of a detector settings file."""
        ini = configparser.ConfigParser(strict=False)
        ini.read_string(text)
        main, every = ini["property"], ini["class-attrs-all"]
        gone = tuple(int(x) for x in main.get("filter-out-class-ids", "").split(";") if x.strip())
        return cls(float(every["pre-cluster-threshold"]), int(every["topk"]), gone, int(main["batch-size"]))


def tracker_parameters(spark: SparkSession, text: str) -> DataFrame:
    """(section, parameter, value) of a tracker settings file, values as text."""
    rows = [(s, k, str(v)) for s, body in parse_yaml_lists(text).items() if isinstance(body, dict) for k, v in body.items()]
    return spark.createDataFrame(rows, "section string, parameter string, value string")
