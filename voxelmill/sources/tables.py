"""CSV and text sources: geometry and drift tables, telemetry, key-value text, cached reads, angles, configuration."""

from __future__ import annotations

import dataclasses
import fnmatch
import os
import types
import typing
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.geometry import linspace_angles
from voxelmill.functions.scalars import megabytes_to_gigabytes, reading

# Column names that a geometry table is searched for, in order of preference.
FILENAME_HINTS = ("filename", "file", "tiff", "tif", "image", "projection", "tiff_file", "output_name")
ANGLE_HINTS = ("angle_deg", "theta_deg", "angle", "theta", "rotation", "view_angle")
ANGLE_RAD_HINTS = ("angle_rad", "theta_rad", "radian", "radians", "angle_radian", "theta_radian")
X_SHIFT_HINTS = ("x_shift_px", "shift_x_px", "x_shift", "shift_x", "u_shift_px", "col_shift_px")
Y_SHIFT_HINTS = ("y_shift_px", "shift_y_px", "y_shift", "shift_y", "v_shift_px", "row_shift_px")
PREFERRED_CSV = "projection_geometry.csv"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, folder: str, patterns: Sequence[str], recursive: bool = False) -> list[str]:
    """Paths below a folder whose names match any pattern (whatever their case), each once, sorted."""
    fs, p = hadoop_path(spark, folder)
    if not fs.exists(p):
        return []
    found, todo = set(), [p]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.isDirectory():
                todo += [s.getPath()] if recursive else []
            elif any(fnmatch.fnmatch(s.getPath().getName().lower(), pattern.lower()) for pattern in patterns):
                found.add(s.getPath().toString())
    return sorted(found)


def find_csv(spark: SparkSession, path: str) -> str:
    """The file itself, or of a folder the preferred name, else its first CSV, else the first CSV below it."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        return path
    own = list_files(spark, path, ["*.csv"])
    best = [f for f in own if os.path.basename(f) == PREFERRED_CSV]
    found = best or own or list_files(spark, path, ["*.csv"], recursive=True)
    if not found:
        raise FileNotFoundError(f"no CSV file in {path}")
    return found[0]


def read_csv(spark: SparkSession, path: str, position: str = "row_index") -> DataFrame:
    """All columns as text, with the row's place from 0; an error if there are no rows.

    Geometry tables are small; the place comes from the file's order, so the read is one task.
    """
    df = spark.read.csv(path, header=True, multiLine=True).coalesce(1)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df.withColumn(position, F.monotonically_increasing_id())


def match_column(columns: Sequence[str], hints: Sequence[str]) -> str | None:
    """The first column equal to a hint (by order of the hints), else the first that contains one; case and outer blanks aside."""
    clean = {c: c.strip().lower() for c in columns}
    equal = [c for h in hints for c in columns if clean[c] == h]
    within = [c for h in hints for c in columns if h in clean[c]]
    return next(iter([*equal, *within]), None)


def required_column(columns: Sequence[str], hints: Sequence[str]) -> str:
    """As match_column, but the first column if nothing matches."""
    return match_column(columns, hints) or next(iter(columns), "")


def aliased_column(columns: Sequence[str], aliases: Sequence[str], label: str) -> str:
    found = match_column(columns, aliases)
    if found is None:
        raise ValueError(f"no {label} column; one of {', '.join(aliases)} is needed")
    return found


def bad_rows(df: DataFrame, column: str, position: str = "row_index", most: int = 10) -> list[int]:
    """Places of the first rows whose value is no number."""
    value = F.col(f"`{column}`").cast("string").try_cast("double")
    return [r[0] for r in df.where(value.isNull() | F.isnan(value)).orderBy(position).limit(most).select(position).collect()]


def read_shifts(spark: SparkSession, path: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """(row_index, x_shift_px, y_shift_px): columns by name, or by their aliases; an error if any value is no number."""
    df = read_csv(spark, path)
    columns = [c for c in df.columns if c != "row_index"]
    if any(n is not None and n not in columns for n in (x, y)):
        raise ValueError(f"no columns {x}, {y} in {path}")
    x, y = x or aliased_column(columns, X_SHIFT_HINTS, "x shift"), y or aliased_column(columns, Y_SHIFT_HINTS, "y shift")
    for c in (x, y):
        if rows := bad_rows(df, c):
            raise ValueError(f"{c} is empty or no number in rows {rows} of {path}")
    return df.select("row_index", F.col(f"`{x}`").cast("float").alias("x_shift_px"), F.col(f"`{y}`").cast("float").alias("y_shift_px"))


#: Fields of a telemetry line, in order.
TELEMETRY = ("gpu_id", "name", "utilization_gpu_pct", "utilization_memory_pct", "memory_used_gb", "memory_total_gb", "temperature_c", "power_w")


def parse_telemetry(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with the fields of a device monitor's CSV; lines that are short or without a device number go; megabytes become gigabytes."""
    keep = [F.col(c) for c in lines.columns if c != line]
    parts = lines.select(*keep, F.transform(F.split(line, ","), lambda p: F.trim(p)).alias("__p")).where(F.size("__p") >= len(TELEMETRY))
    fields = parts.select(*keep, F.get("__p", 0).try_cast("int").alias("gpu_id"), F.get("__p", 1).alias("name"), *[(megabytes_to_gigabytes(reading(F.get("__p", k))) if n.startswith("memory_") else reading(F.get("__p", k))).alias(n) for k, n in enumerate(TELEMETRY) if k > 1])
    percent = F.when(F.col("memory_total_gb") > 0, 100.0 * F.col("memory_used_gb") / F.col("memory_total_gb"))
    return fields.where("gpu_id IS NOT NULL").withColumn("memory_percent", percent)


def parse_inventory(lines: DataFrame, line: str = "line") -> DataFrame:
    """(gpu_id, name, total_gb, free_gb) of an inventory's CSV lines (id, name, total MB, free MB)."""
    p = F.transform(F.split(line, ","), lambda x: F.trim(x))
    out = lines.select(F.get(p, 0).try_cast("int").alias("gpu_id"), F.get(p, 1).alias("name"), megabytes_to_gigabytes(reading(F.get(p, 2))).alias("total_gb"), megabytes_to_gigabytes(reading(F.get(p, 3))).alias("free_gb"))
    return out.where("gpu_id IS NOT NULL AND total_gb IS NOT NULL AND free_gb IS NOT NULL")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the lines of a text file that have a colon; of a repeated key the last line counts."""
    text = spark.read.text(path).coalesce(1).withColumn("__k", F.monotonically_increasing_id()).where(F.contains("value", F.lit(":")))
    parts = text.select(F.trim(F.substring_index("value", ":", 1)).alias("key"), F.trim(F.regexp_replace("value", r"^[^:]*:", "")).alias("value"), "__k")
    return parts.groupBy("key").agg(F.max_by("value", "__k").alias("value"))


class CachedCsv:
    """CSV reads kept as long as the file's time and size stay; a missing file is an empty list of columns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, {}

    def stamp(self, path: str) -> tuple:
        fs, p = hadoop_path(self.spark, path)
        if not fs.exists(p):
            return (False, 0, 0)
        s = fs.getFileStatus(p)
        return (True, s.getModificationTime(), s.getLen())

    def read(self, path: str) -> DataFrame | None:
        now = self.stamp(path)
        if path in self.kept and self.kept[path][0] == now:
            return self.kept[path][1]
        if path in self.kept and self.kept[path][1] is not None:
            self.kept[path][1].unpersist()
        df = self.spark.read.csv(path, header=True).cache() if now[0] else None
        self.kept[path] = (now, df)
        return df


def angles(spark: SparkSession, n: int | None = None, start: float = 0.0, end: float = 360.0, endpoint: bool = False, degrees: bool = True, clockwise: bool = False, path: str | None = None) -> DataFrame:
    """(view_idx, angle_rad): evenly spaced, or one per line (or comma-separated field) of a text file."""
    if path is None:
        values = linspace_angles(start, end, int(n), endpoint, degrees, clockwise).tolist()
        return spark.createDataFrame(list(enumerate(values)), "view_idx long, angle_rad double")
    text = spark.read.text(path).coalesce(1).select(F.monotonically_increasing_id().alias("k"), F.posexplode(F.split("value", r"[,\s]+")).alias("j", "v")).where("v <> '' AND NOT v LIKE '#%'")
    value = F.radians(F.col("v").cast("double")) if degrees else F.col("v").cast("double")
    rows = [r[0] for r in text.orderBy("k", "j").select(-value if clockwise else value).collect()]
    if n is not None and len(rows) != n:
        raise ValueError(f"{len(rows)} angles for {n} views")
    return spark.createDataFrame(list(enumerate(rows)), "view_idx long, angle_rad double")


def _plain_yaml(text: str) -> dict:
    """Nested mappings of scalars and inline lists, by indentation: what is left of YAML without its library."""

    def scalar(v: str):
        v = v.strip()
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        known = {"": None, "null": None, "~": None, "none": None, "true": True, "yes": True, "false": False, "no": False}
        if v.lower() in known:
            return known[v.lower()]
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                continue
        return v

    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        key, colon, value = bare.strip().partition(":")
        if not colon:
            continue
        depth = len(bare) - len(bare.lstrip())
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = scalar(value)
        else:
            child = stack[-1][1][key.strip()] = {}
            stack.append((depth, child))
    return root


def load_config(kind: type, text: str):
    """A nested dataclass from YAML text: unknown keys are dropped, missing ones keep their defaults, lists become tuples where typed so."""
    try:
        import yaml

        raw = yaml.safe_load(text) or {}
    except ImportError:
        raw = _plain_yaml(text)
    return _fill(kind, raw)


def _fill(kind: type, raw):
    hints, values = typing.get_type_hints(kind), {}
    for f in dataclasses.fields(kind):
        if not isinstance(raw, dict) or f.name not in raw:
            continue
        t, v = hints[f.name], raw[f.name]
        options = typing.get_args(t) if typing.get_origin(t) in (typing.Union, types.UnionType) else (t,)
        if dataclasses.is_dataclass(t):
            values[f.name] = _fill(t, v or {})
        elif isinstance(v, list) and any(typing.get_origin(o) is tuple for o in options):
            values[f.name] = tuple(v)
        else:
            values[f.name] = v
    return kind(**values)


def dump_config(config) -> str:
    """YAML text that load_config reads back, with or without the library."""

    def lines(value: dict, depth: int) -> list[str]:
        out = []
        for k, v in value.items():
            if isinstance(v, dict):
                out += [f"{'  ' * depth}{k}:", *lines(v, depth + 1)]
            else:
                shown = "[" + ", ".join(show(x) for x in v) + "]" if isinstance(v, list | tuple) else show(v)
                out.append(f"{'  ' * depth}{k}: {shown}")
        return out

    def show(v) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v).replace("e", ".0e") if isinstance(v, float) and "e" in repr(v) and "." not in repr(v) else repr(v)

    return "\n".join(lines(dataclasses.asdict(config), 0)) + "\n"
