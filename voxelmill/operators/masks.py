"""Binary volumes as bit masks: (volume_id, z, ny, nx, bits), 60 voxels of a row of a slice in one long.

A step to face neighbours is a shift of bits along x, the words of the rows beside along y and those of the slices beside along z. Slices
meet in slabs: a slab takes as many slices of its neighbours as there are steps, so a task holds a slab and its halo, never a volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelmill.operators.arrays import _div, _indexes
from voxelmill.operators.ordering import _kept, order_statistics
from voxelmill.operators.volumes import gaussian, voxels

WORD = 60
_ALL = (1 << WORD) - 1


def _width(nx: Column) -> Column:
    return _div(nx + (WORD - 1), WORD)


def pack(df: DataFrame, condition) -> DataFrame:
    """df (volume_id, z, ny, nx, data) with ``bits``: where the condition on a value (a function on columns) holds; null values do not."""
    wide, nx, ny = _width(F.col("nx")), F.col("nx"), F.col("ny")

    def word(d: Column, k: Column) -> Column:
        x0 = k % wide * WORD
        at = lambda b: F.get(d, (_div(k, wide) * nx + x0 + b).cast("int"))
        one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
        return F.aggregate(_indexes(F.least(F.lit(WORD), nx - x0)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(condition(at(b)), one(b)).otherwise(F.lit(0).cast("long"))))

    # bound, as a one-element array: what data is computed from is not worked out again for each bit
    return df.withColumn("bits", F.get(F.transform(F.array(F.col("data")), lambda d: F.transform(_indexes(ny * wide), lambda k: word(d, k))), 0))


def unpack(bits: Column, ny: Column, nx: Column) -> Column:
    """The mask as an array of 0 and 1."""
    wide = _width(nx)
    return F.transform(_indexes(ny * nx), lambda k: F.call_function("shiftright", F.get(bits, (_div(k, nx) * wide + _div(k % nx, WORD)).cast("int")), k % nx % WORD).bitwiseAND(F.lit(1).cast("long")).cast("int"))


def _step(df: DataFrame, grow: bool, slab: list[str]) -> DataFrame:
    """One step of all slices to their six neighbours; what lies outside is empty."""
    by_z = Window.partitionBy(*slab).orderBy("z")
    beside = df.withColumns({"__below": F.lag("bits").over(by_z), "__above": F.lead("bits").over(by_z)})
    wide, zero = _width(F.col("nx")), F.lit(0).cast("long")
    valid = lambda k: F.when(k % wide == wide - 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("nx") - (wide - 1) * WORD) - 1).otherwise(F.lit(_ALL))

    def value(w: Column, k: Column) -> Column:
        left = F.when(k % wide > 0, F.shiftright(F.get("bits", k - 1), WORD - 1)).otherwise(zero)
        right = F.when(k % wide < wide - 1, F.shiftleft(F.get("bits", k + 1).bitwiseAND(F.lit(1).cast("long")), WORD - 1)).otherwise(zero)
        parts = [
            F.shiftleft(w.bitwiseAND(F.lit(_ALL >> 1)), 1).bitwiseOR(left),
            F.shiftright(w, 1).bitwiseOR(right),
            F.coalesce(F.when(k >= wide, F.get("bits", k - wide)), zero),
            F.coalesce(F.get("bits", k + wide), zero),
            F.coalesce(F.get("__below", k), zero),
            F.coalesce(F.get("__above", k), zero),
        ]
        out = w
        for p in parts:
            out = out.bitwiseOR(p) if grow else out.bitwiseAND(p)
        return out.bitwiseAND(valid(k))

    return beside.withColumn("bits", F.transform("bits", value)).drop("__below", "__above")


def morph(df: DataFrame, steps: Sequence[bool], slab: int = 32) -> DataFrame:
    """df with its bits grown (True) or shrunk (False) step by step."""
    if not steps:
        return df
    first, last = F.floor((F.col("z") - len(steps)) / slab), F.floor((F.col("z") + len(steps)) / slab)
    dealt = df.withColumn("__slab", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    for grow in steps:
        dealt = _step(dealt, grow, ["volume_id", "__slab"])
    return dealt.where(F.col("__slab") == F.floor(F.col("z") / slab)).drop("__slab")


def dilate(df: DataFrame, n: int = 1, slab: int = 32) -> DataFrame:
    return morph(df, [True] * n, slab)


def close(df: DataFrame, slab: int = 32) -> DataFrame:
    """Dilation, then erosion."""
    return morph(df, [True, False], slab)


def support(df: DataFrame, depth: int, sigma: float, dilation: int, slab: int = 32) -> DataFrame:
    """(volume_id, z, ny, nx, bits): where the smoothed volume stands out of the fifth percentile of its finite values, closed and dilated.

    NaN and null count as 0 when smoothing. Everywhere, if a volume has no finite value or none stands out.
    """
    ends = order_statistics(voxels(df), "value", [0.05, 0.95], ["volume_id"]).select("volume_id", F.get("q", F.lit(0)).alias("__low"), F.get("q", F.lit(1)).alias("__high"))
    known = df.withColumn("data", F.transform("data", lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))))
    smooth = gaussian(known, depth, sigma).join(ends, "volume_id", "left")
    level = F.col("__low") + 0.02 * F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-6))
    marked = _kept(pack(smooth.withColumn("__level", level), lambda v: v > F.col("__level")).select("volume_id", "z", "ny", "nx", "bits"))  # bits are few, and read twice
    found = marked.groupBy("volume_id").agg(F.max(F.exists("bits", lambda w: w != 0)).alias("__any"))
    done = morph(marked, [True, False, *[True] * dilation], slab).join(found, "volume_id")
    full = pack(done.withColumns({"__bits": F.col("bits"), "data": F.array_repeat(F.lit(1), F.col("ny") * F.col("nx"))}), lambda v: v == 1)
    return full.select("volume_id", "z", "ny", "nx", F.when(F.col("__any"), F.col("__bits")).otherwise(F.col("bits")).alias("bits"))
