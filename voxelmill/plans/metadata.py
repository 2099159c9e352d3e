"""Validation of a geometry table: a views table, a one-row summary and warnings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators import joins, stats
from voxelmill.operators.select import head_and_tail
from voxelmill.sources import tables


@dataclass
class Validation:
    views: DataFrame  # view_idx, filename, path, angle_deg, angle_rad, x_shift_px, y_shift_px, exists; ordered by position
    duplicates: DataFrame
    missing: DataFrame
    summary: dict
    warnings: list[str] = field(default_factory=list)

    def preview(self) -> DataFrame:
        return head_and_tail(self.views, "position")

    def check(self) -> None:
        """What callers refuse to go on with."""
        for name, df in (("duplicate file names", self.duplicates), ("missing files", self.missing)):
            rows = [r["filename"] for r in df.orderBy("filename").limit(10).collect()]
            if rows:
                raise ValueError(f"{name}: {', '.join(rows)}")


def _numbers(df: DataFrame, column: str, label: str) -> None:
    if rows := tables.bad_rows(df, column):
        raise ValueError(f"{label} is empty or no number in rows {rows}")


def _optional(df: DataFrame, column: str | None, label: str, warnings: list[str]) -> tuple[str | None, bool]:
    """The column if it can be used, and whether it was found at all."""
    name = (column or "").strip()
    if not name:
        return None, False
    if name not in df.columns:
        warnings.append(f"{label} column {name} is not there")
        return None, False
    got = df.agg(F.count(F.col(f"`{name}`").try_cast("double"))).first()[0]
    if not got:
        warnings.append(f"{label} column {name} is empty")
        return None, True
    _numbers(df, name, label)
    return name, True


def _totals(views: DataFrame) -> dict:
    """What the summary says of the views themselves: counts, extremes, direction, and whether every view has shifts."""
    deg = views.withColumn("d", F.degrees(F.col("angle_rad").cast("double"))).withColumn("__one", F.lit(1))
    way = stats.direction(deg, "d", ["position"], ["__one"]).first()
    got = views.agg(F.count(F.lit(1)).alias("views"), F.min("angle_deg").alias("angle_min_deg"), F.max("angle_deg").alias("angle_max_deg"), F.min("angle_rad").alias("angle_min_rad"), F.max("angle_rad").alias("angle_max_rad"), F.count("x_shift_px").alias("nx"), F.count("y_shift_px").alias("ny")).first().asDict()
    n = got["views"]
    return got | {"direction": way["direction"] if way else "single angle", "has_x": n > 0 and got["nx"] == n, "has_y": n > 0 and got["ny"] == n}


def validate(spark: SparkSession, frame: DataFrame, folder: str, filename: str = "", angle: str = "", angle_rad: str | None = None, x_shift: str | None = None, y_shift: str | None = None, remove_endpoint: bool = True, reverse: bool = False, tolerance_deg: float = 1e-3) -> Validation:
    """frame: text columns and row_index, as ``tables.read_csv`` gives them.

    Radians, where their column is whole, decide the geometry; degrees are reported from their own column all the same. Repeated names are looked
    for before the endpoint row goes; a reversed table keeps its indexes.
    """
    columns, warnings = [c for c in frame.columns if c != "row_index"], []
    filename = filename or tables.required_column(columns, tables.FILENAME_HINTS)
    if not angle:
        angle = tables.required_column(columns, tables.ANGLE_HINTS)
        if angle.strip().lower() in tables.ANGLE_RAD_HINTS:
            warnings.append(f"column {angle} is taken for degrees, but its name says radians")
    for label, name in (("file name", filename), ("angle", angle)):
        if name not in columns:
            raise ValueError(f"no {label} column {name}")
    fs, p = tables.hadoop_path(spark, folder)
    if not fs.exists(p):
        raise FileNotFoundError(folder)
    named = frame.withColumn("__file", F.trim(F.col(f"`{filename}`")))
    empty = [r[0] for r in named.where("__file IS NULL OR __file = ''").orderBy("row_index").limit(10).select("row_index").collect()]
    if empty:
        raise ValueError(f"no file name in rows {empty}")
    repeated = stats.duplicates(named.select(F.col("__file").alias("filename")), "filename").select("filename")
    _numbers(frame, angle, "the degree column")

    source = f"degrees of {angle}"
    rad = (angle_rad or "").strip()
    usable = None
    if rad and rad not in columns:
        warnings.append(f"radian column {rad} is not there; degrees are used")
    elif rad:
        if frame.agg(F.count(F.col(f"`{rad}`").try_cast("double"))).first()[0]:
            _numbers(frame, rad, "the radian column")
            usable, source = rad, f"radians of {rad}"
        else:
            warnings.append(f"radian column {rad} is empty; degrees are used")
    x, x_found = _optional(frame, x_shift, "x shift", warnings)
    y, y_found = _optional(frame, y_shift, "y shift", warnings)
    number = lambda c: F.col(f"`{c}`").cast("double").cast("float")
    degrees = number(angle)
    radians = number(usable) if usable else F.radians(degrees.cast("double")).cast("float")
    null = F.lit(None).cast("float")
    views = named.select(F.col("row_index").alias("view_idx"), F.col("__file").alias("filename"), degrees.alias("angle_deg"), radians.alias("angle_rad"), (number(x) if x else null).alias("x_shift_px"), (number(y) if y else null).alias("y_shift_px"))

    ends = stats.endpoint_repeats(views.withColumn("deg", F.degrees(F.col("angle_rad").cast("double"))), "deg", "view_idx", [], tolerance_deg).first()
    detected = bool(ends["repeats"])
    if detected:
        warnings.append("the first and the last angle coincide")
        if remove_endpoint:
            last = views.agg(F.max("view_idx")).first()[0]
            views = views.where(F.col("view_idx") != last)
            warnings.append("the last row is dropped as a repeated endpoint")
    files = spark.createDataFrame([(f.split("/")[-1],) for f in tables.list_files(spark, folder, ["*"])], "path string")
    nested = any("/" in r[0] for r in views.where(F.contains("filename", F.lit("/"))).limit(1).select("filename").collect())
    if nested:
        root = p.toUri().getPath().rstrip("/") + "/"
        deep = [f.split(root, 1)[-1] for f in tables.list_files(spark, folder, ["*"], recursive=True)]
        files = spark.createDataFrame([(f,) for f in deep], "path string")
    views = joins.resolve_files(views, files)
    views = views.withColumn("position", -F.col("view_idx") if reverse else F.col("view_idx"))
    if reverse:
        warnings.append("the order of the views is reversed; names and angles keep together")
    views = views.orderBy("position")
    totals = _totals(views)
    summary = totals | {"endpoint_detected": detected, "endpoint_removed": detected and remove_endpoint, "angle_source": source, "x_found": x_found, "y_found": y_found}
    return Validation(views, repeated, views.where("NOT exists").select("filename"), summary, warnings)


def apply_shifts(v: Validation, shifts: DataFrame, reverse: bool = False, source: str = "shift table") -> Validation:
    """Shifts by position instead of those of the geometry table; one row more is dropped if the endpoint was."""
    if v.summary["has_x"] or v.summary["has_y"]:
        v.warnings.append("the geometry table has shifts too; the shift table is used")
    joined = joins.positional(v.views.drop("x_shift_px", "y_shift_px"), shifts, "view_idx", "row_index", v.summary["endpoint_removed"])
    if reverse:
        v.warnings.append("the shift table is in file order, as the indexes of the reversed views are")
    v.warnings.append(f"shifts from {source}")
    return Validation(joined.orderBy("position"), v.duplicates, v.missing, v.summary | {"has_x": True, "has_y": True, "x_found": True, "y_found": True}, v.warnings)


def every_nth(v: Validation, n: int) -> Validation:
    """A stride over the views in their order; indexes stay."""
    if n <= 1:
        return v
    base = v.views.agg(F.min("position")).first()[0]
    if base is None:
        raise ValueError("no view is left")
    kept = v.views.where((F.col("position") - F.lit(base)) % n == 0).orderBy("position")
    return Validation(kept, v.duplicates, v.missing, v.summary | _totals(kept), [*v.warnings, f"every {n}th view"])


def coarser_views(v: Validation, binning: tuple[int, int] = (1, 1), every: int = 1) -> Validation:
    """For a quick run: every nth view, with shifts in the pixels of further binning (rows, cols); the summary is made anew."""
    by, bx = (max(1, int(n)) for n in binning)
    out = every_nth(v, every)
    if (by, bx) == (1, 1):
        return out
    views = out.views.withColumns({"x_shift_px": (F.col("x_shift_px") / bx).cast("float"), "y_shift_px": (F.col("y_shift_px") / by).cast("float")}).orderBy("position")
    return Validation(views, out.duplicates, out.missing, out.summary | _totals(views), [*out.warnings, f"further binning {by} x {bx}"])
