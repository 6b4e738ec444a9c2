"""Canny edges of slices: separable gradients and non-maximum suppression by windows along rows and columns, hysteresis by components.

Slices are dense: every pixel of a slice's rectangle has a row.  A window's partition is a row or a column of a slice, so no task holds more than that
before the last step, which groups candidate pixels by slice.  All values are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import raster

#: Fixed value: the tangent of 22.5 degrees in units of 2^-15.
TAN_22 = 13573


def gradients(voxels: DataFrame) -> DataFrame:
    """(z, y, x, gx, gy): Sobel gradients, edge pixels repeated beyond the border."""
    along, down = Window.partitionBy("z", "y").orderBy("x"), Window.partitionBy("z", "x").orderBy("y")
    before = lambda c, w: F.coalesce(F.lag(c).over(w), F.col(c))
    after = lambda c, w: F.coalesce(F.lead(c).over(w), F.col(c))
    g = F.col("gray")
    rows = voxels.select("z", "y", "x", F.col("gray").cast("int").alias("gray"))
    rows = rows.select("z", "y", "x", (after("gray", along) - before("gray", along)).alias("step"), (before("gray", along) + 2 * g + after("gray", along)).alias("mean"))
    return rows.select("z", "y", "x", (before("step", down) + 2 * F.col("step") + after("step", down)).alias("gx"), (after("mean", down) - before("mean", down)).alias("gy"))


def ridges(grads: DataFrame, low: int) -> DataFrame:
    """(z, y, x, m): pixels whose gradient (|gx| + |gy|) is above ``low`` and the greatest across the edge; beyond the border it is 0."""
    along, down = Window.partitionBy("z", "y").orderBy("x"), Window.partitionBy("z", "x").orderBy("y")
    m = grads.withColumn("m", F.abs("gx") + F.abs("gy"))
    m = m.withColumns({"_l": F.coalesce(F.lag("m").over(along), F.lit(0)), "_r": F.coalesce(F.lead("m").over(along), F.lit(0))})
    three = F.struct("_l", "m", "_r")
    m = m.withColumns({"_up": F.lag(three).over(down), "_dn": F.lead(three).over(down)})
    at = lambda row, c: F.coalesce(F.col(f"{row}.{c}"), F.lit(0))
    ax, ay = F.abs("gx").cast("long"), F.shiftleft(F.abs("gy").cast("long"), 15)
    flat, steep = ay < ax * TAN_22, ay > ax * TAN_22 + F.shiftleft(ax, 16)
    falls = (F.col("gx") < 0) != (F.col("gy") < 0)
    here = F.col("m")
    diagonal = F.when(falls, (here > at("_up", "_r")) & (here > at("_dn", "_l"))).otherwise((here > at("_up", "_l")) & (here > at("_dn", "_r")))
    peak = F.when(flat, (here > F.col("_l")) & (here >= F.col("_r"))).when(steep, (here > at("_up", "m")) & (here >= at("_dn", "m"))).otherwise(diagonal)
    return m.where((here > low) & peak).select("z", "y", "x", "m")


def canny(voxels: DataFrame, low: int = 50, high: int = 150) -> DataFrame:
    """(z, y, x): ridges above ``high``, and those above ``low`` that touch them, by sides or corners, through other such."""
    kept = ridges(gradients(voxels), low)
    parts = raster.components(kept.select("z", "y", "x", F.lit(1).alias("label")))
    joined = parts.select("z", "y", "x", "comp").join(kept, ["z", "y", "x"])
    strong = joined.where(F.col("m") > high).select("z", "comp").distinct()
    return joined.join(strong, ["z", "comp"], "left_semi").select("z", "y", "x")


