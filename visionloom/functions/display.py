"""Text forms of values, names of jobs and exports, and problems of job settings, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "-"
#: Tasks, splits and export formats that settings may name.
TASKS, EVAL_SPLITS = ["detect", "classify"], ["train", "val", "test"]
EXPORT_FORMATS = ["onnx", "torchscript", "openvino", "engine", "coreml", "tflite", "rknn"]
PREFIX = "prelabel"


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def _finite(x: Column) -> Column:
    v = x.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def format_bytes(n: Column, digits: int = 1) -> Column:
    """Bytes below 1024, then the largest of KB to TB that keeps the number from 1 on; '-' for nothing."""
    v = n.cast("double")
    out = F.concat(n.cast("string"), F.lit(" B"))
    steps = F.when(v < 1024, out)
    for i, unit in enumerate(("KB", "MB", "GB")):
        steps = steps.when(v < 1024.0 ** (i + 2), F.concat(_fixed(v / 1024.0 ** (i + 1), digits), F.lit(f" {unit}")))
    return F.when(~F.coalesce(_finite(n), F.lit(False)), MISSING).otherwise(steps.otherwise(F.concat(_fixed(v / 1024.0**4, digits), F.lit(" TB"))))


def format_duration(seconds: Column) -> Column:
    """Seconds (one digit below ten), minutes and seconds, or hours and minutes."""
    v = seconds.cast("double")
    m, s = F.floor(v / 60), F.floor(v % 60 + 0.5)
    out = F.when(v < 10, F.concat(_fixed(v, 1), F.lit(" s"))).when(v < 60, F.concat(_fixed(v, 0), F.lit(" s"))).when(m < 60, F.concat_ws(" ", m, F.lit("min"), s, F.lit("s")))
    return F.when(~F.coalesce(_finite(seconds), F.lit(False)), MISSING).otherwise(out.otherwise(F.concat_ws(" ", F.floor(m / 60), F.lit("h"), m % 60, F.lit("min"))))


def format_metric(x: Column, digits: int = 4) -> Column:
    """A metric that is not there is '-', never 0."""
    return F.when(~F.coalesce(_finite(x), F.lit(False)), MISSING).otherwise(_fixed(x, digits))


def format_time(x: Column) -> Column:
    """Seconds, or from 10^12 on milliseconds, since 1970 as date and time in the session's zone."""
    s = F.when(x < 1_000_000_000_000, x).otherwise(F.floor(x / 1000))
    return F.coalesce(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss"), F.lit(MISSING))


def name_slug(s: Column, most: int = 48) -> Column:
    return F.regexp_replace(F.left(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^0-9A-Za-z_\-]+", "_"), F.lit(most)), "^_+|_+$", "")


def job_id(prefix: str, at: Column, unique: Column) -> Column:
    """prefix_yyyymmdd_hhmmss_ and six hex digits of what makes it unique; the clock is the caller's."""
    return F.concat_ws("_", F.lit(prefix), F.date_format(at, "yyyyMMdd_HHmmss"), F.left(F.md5(unique.cast("string").cast("binary")), F.lit(6)))


def export_name(stem: Column, at: Column) -> Column:
    return F.concat_ws("_", F.lit(PREFIX), F.coalesce(F.nullif(name_slug(stem), F.lit("")), F.lit("dataset")), F.date_format(at, "yyyyMMdd_HHmmss"))


def ensure_prefix(name: Column) -> Column:
    clean = name_slug(name, 64)
    return F.when(F.lower(clean).startswith(PREFIX), clean).otherwise(F.concat_ws("_", F.lit(PREFIX), F.nullif(clean, F.lit(""))))


def pick_split(test: Column) -> Column:
    """test where a dataset declares one, else val."""
    return F.when(F.trim(F.coalesce(test, F.lit(""))) != "", "test").otherwise("val")


def safe_int(s: Column) -> Column:
    """Whole part of a number given as text, null where it is none."""
    v = F.trim(s).try_cast("double")
    return F.when(_finite(v), F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)))


def _listed(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in rules]), lambda x: x.isNotNull())


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def train_problems(backends: tuple[str, ...] = ("local",)) -> Column:
    """Problems of a training job's settings (data_yaml, name, project, task, epochs, imgsz, batch, lrf, warmup_epochs,
    freeze, cache, backend), in order; an empty list is valid. Whether files exist is for a join with a listing."""
    c = F.col
    return _listed([(_blank("data_yaml"), "data_yaml is empty"), (_blank("name"), "name is empty"), (_blank("project"), "project is empty"), (~c("task").isin(TASKS) | c("task").isNull(), "unknown task"), (c("epochs") <= 0, "epochs must be positive"), (c("imgsz") <= 0, "imgsz must be positive"), (c("batch") <= 0, "batch must be positive"), (c("lrf") < 0, "lrf is negative"), (c("warmup_epochs") < 0, "warmup_epochs is negative"), (c("freeze") < 0, "freeze is negative"), (~c("cache").isin("", "ram", "disk", "true", "false"), "cache must be ram or disk"), (~c("backend").isin(*backends) | c("backend").isNull(), "unknown backend")])


def eval_problems(backends: tuple[str, ...] = ("local",)) -> Column:
    c = F.col
    return _listed([(_blank("weights"), "weights is empty"), (_blank("data_yaml"), "data_yaml is empty"), (_blank("name"), "name is empty"), (_blank("project"), "project is empty"), (~c("split").isin(EVAL_SPLITS) | c("split").isNull(), "unknown split"), (~c("backend").isin(*backends) | c("backend").isNull(), "unknown backend")])


def deploy_problems() -> Column:
    """Problems of an export job's settings (weights, project, name, formats array, imgsz, batch, half, int8)."""
    c = F.col
    listed = _listed([(_blank("weights"), "weights is empty"), (_blank("project"), "project is empty"), (_blank("name"), "name is empty"), (F.coalesce(F.size("formats"), F.lit(0)) <= 0, "no format is chosen")])
    unknown = F.transform(F.filter(F.coalesce("formats", F.array().cast("array<string>")), lambda f: ~f.isin(EXPORT_FORMATS)), lambda f: F.concat(F.lit("unknown format "), f))
    return F.concat(listed, unknown, _listed([(c("imgsz") <= 0, "imgsz must be positive"), (c("batch") <= 0, "batch must be positive"), (c("half") & c("int8"), "half and int8 exclude each other")]))


#: Switches that an export format knows.
FORMAT_SWITCHES = {"onnx": ["opset", "simplify", "dynamic", "half", "nms"], "torchscript": ["half"], "openvino": ["half", "dynamic"], "engine": ["half", "dynamic", "simplify", "int8"], "tflite": ["half", "int8"], "coreml": ["half", "int8"], "rknn": ["half", "int8"]}
ALWAYS = ["imgsz", "batch", "device"]


def export_options(fmt: Column, options: Column) -> Column:
    """Of a map of options those that every format has and those that this one knows, with the format itself."""
    known = F.create_map(*[x for f, names in FORMAT_SWITCHES.items() for x in (F.lit(f), F.array(*map(F.lit, ALWAYS + names)))])
    allowed = F.coalesce(F.try_element_at(known, fmt), F.array(*map(F.lit, ALWAYS)))
    return F.map_concat(F.create_map(F.lit("format"), fmt), F.map_filter(options, lambda k, v: F.array_contains(allowed, k)))


def given_options(options: Column) -> Column:
    """Options that are set: those without a value are left to the trainer."""
    return F.map_filter(options, lambda k, v: v.isNotNull())
