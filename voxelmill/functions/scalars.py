"""Column functions on scalars: angles, numbers in text, labels, times and rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def wrap_angle(angle_rad: Column) -> Column:
    """The angle in [0, 2 pi), by floored modulo."""
    return F.pmod(angle_rad.cast("double"), F.lit(TWO_PI))


def circular_distance(a: Column, b: Column) -> Column:
    """Distance of two angles in radians around the circle."""
    return F.abs(F.pmod(a.cast("double") - b.cast("double") + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi))


def signed_angle(angle_rad: Column, clockwise: bool) -> Column:
    return -angle_rad if clockwise else angle_rad


def to_number(text: Column, default: float | None = None) -> Column:
    """A double from text; default (null, or a number such as NaN) where it is none."""
    got = text.try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(float(default)))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    d = x.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(math.inf))


def replace_non_finite(x: Column, value: float) -> Column:
    return F.when(finite(x), x).otherwise(F.lit(value))


#: What telemetry prints for a missing reading (square brackets around it do not count).
MISSING_READINGS = ("n/a", "na", "not supported", "not applicable", "unknown")


def reading(text: Column) -> Column:
    """A telemetry reading: null for blanks, the missing-value words and what is no number."""
    clean = F.trim(text)
    bare = F.trim(F.lower(clean), F.lit("[]"))
    return F.when((clean != "") & ~bare.isin(*MISSING_READINGS), clean.try_cast("double"))


def megabytes_to_gigabytes(mb: Column) -> Column:
    return mb / 1024.0


def normal_label(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed, lower-cased, and mapped by aliases."""
    clean = F.lower(F.trim(text))
    if not aliases:
        return clean
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, clean), clean)


def safe_key(text: Column) -> Column:
    """Runs of anything but letters and digits become one underscore, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def typed_text(text: Column) -> Column:
    """(kind, value) of a CSV field: empty, bool, int, float or text, with a normal form of the value."""
    clean, number = F.trim(text), F.trim(text).try_cast("double")
    low = F.lower(clean)
    integral = finite(number) & (number == F.floor(number)) & (F.abs(number) < 2.0**53)
    kind = F.when(F.coalesce(clean, F.lit("")) == "", "empty").when(low.isin("true", "false"), "bool").when(integral, "int").when(number.isNotNull(), "float").otherwise("text")
    value = F.when(kind == "bool", low).when(kind == "int", number.cast("long").cast("string")).otherwise(F.coalesce(clean, F.lit("")))
    return F.struct(kind.alias("kind"), value.alias("value"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds; hours may exceed 99, negative counts as 0."""
    s = F.greatest(F.round(seconds).cast("long"), F.lit(0))
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat(F.when(hours > 99, hours.cast("string")).otherwise(part(hours)), F.lit(":"), part(F.floor(s % 3600 / 60)), F.lit(":"), part(s % 60))


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Elapsed time per finished iteration, times the iterations left."""
    return F.try_divide(elapsed.cast("double"), done) * F.greatest(total - done, F.lit(0))


def percent_change(before: Column, after: Column) -> Column:
    """100 * (before - after) / before; null if either is not finite or before is 0."""
    return F.when(finite(before) & finite(after) & (before != 0), (before - after) * 100.0 / before)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of an RGB pixel."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def id_list(text: Column) -> Column:
    """Non-negative integers of a list with commas or semicolons, each once, in first-seen order."""
    parts = F.transform(F.split(F.replace(text, F.lit(";"), F.lit(",")), ","), lambda p: F.trim(p).try_cast("int"))
    return F.array_distinct(F.filter(parts, lambda p: p >= 0))


def detector_pixel_mm(effective_um: Column, source_detector_mm: Column, source_origin_mm: Column) -> Column:
    """Pixel size on the detector from its effective size at the origin."""
    return effective_um * 1e-3 * source_detector_mm / source_origin_mm


def shift_signs(mode: Column) -> Column:
    """(x sign, y sign) of the four shift modes A to D; null for others."""
    # X and y sign by mode.
    table = {"A": (1, 1), "B": (1, -1), "C": (-1, 1), "D": (-1, -1)}
    out = F.lit(None).cast("struct<x:int,y:int>")
    for name, (x, y) in table.items():
        out = F.when(F.upper(F.trim(mode)) == name, F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))).otherwise(out)
    return out


def memory_model_gib(volume_gib: Column, projections_gib: Column, dual_bytes: int = 2) -> Column:
    """Working sets in GiB of the solvers on the CPU, and the least free memory to start with."""
    v, p = volume_gib.cast("double"), projections_gib.cast("double")
    half = 0.5 if dual_bytes == 2 else 1.0
    return F.struct((18 * v + 3 * p).alias("admm"), ((4 + 3 * half) * v + 3 * p).alias("pdhg"), (2.35 * v + 1.25 * p).alias("subset_tv"), (4.85 * v + 1.25 * p).alias("mbir_lite"), F.greatest(F.lit(4.0), 2 * v + p).alias("min_free"))


def batches_per_sweep(views: Column, subsets: Column, batch: Column) -> Column:
    """Batches of a subset."""
    return F.ceil(F.ceil(views / subsets) / batch)


def general_number(x: Column, digits: int = 6) -> Column:
    """A number as C's ``%.<digits>g`` writes it: so many digits at most, no zeros at the end, an exponent below -4 and from digits on.

    What is rounded (half up) is the shortest decimal that reads back as x, where C rounds the binary value itself.
    """
    text = F.format_string(f"%.{digits - 1}e", F.abs(x).cast("double"))
    power = F.element_at(F.split(text, "e"), -1).try_cast("int")
    figures = F.replace(F.element_at(F.split(text, "e"), 1), F.lit("."), F.lit(""))
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    point = lambda at: F.concat(figures.substr(F.lit(1), at), F.lit("."), figures.substr(at + 1, F.lit(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
    exponent = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    long_exponent = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))
    fixed = F.when(power >= 0, bare(point(power + 1))).otherwise(bare(small))
    body = F.when((power < -4) | (power >= digits), F.concat(bare(point(F.lit(1))), F.when(F.abs(power) < 100, exponent).otherwise(long_exponent))).otherwise(fixed)
    sign = F.when(F.startswith(x.cast("double").cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, body))
