"""Order, spacing and selection of slices.  These work on slice tables (one row a slice); one window over them holds
rows in the number of slices, not of voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """Sort key: runs of digits compare as numbers, text in lower case.  An array of (text, number) pairs."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike("^[0-9]"), "").otherwise(p).alias("t"), F.when(p.rlike("^[0-9]"), p.cast("decimal(38,0)")).alias("n")))


def number_tuple(key: Column) -> Column:
    """All whole numbers in a key, in order: the export order."""
    return F.transform(F.regexp_extract_all(key, F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("decimal(38,0)"))


def last_number(name: Column) -> Column:
    """The last whole number in a name, or null."""
    found = F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).cast("long")


def stem_key(name: Column) -> Column:
    """The last four characters of a name without its suffix: the key of web uploads and of folders read by stem."""
    return F.right(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(4))


def slice_key(z1: Column) -> Column:
    """Four-digit key of a 1-based place."""
    return F.when(z1 < 10000, F.lpad(z1.cast("string"), 4, "0")).otherwise(z1.cast("string"))


def ordered(files: DataFrame, name: str = "name") -> DataFrame:
    """Accepted files with z (from 0) and key, in natural order; ties by name."""
    z = F.row_number().over(Window.orderBy(natural_key(F.col(name)), F.col(name))) - 1
    return files.withColumn("z", z.cast("int")).withColumn("key", slice_key(F.col("z") + 1))


def mask_keys(files: DataFrame, name: str = "name") -> DataFrame:
    """Mask files with their key: the last number in the name, else the running place."""
    place = F.row_number().over(Window.orderBy(name))
    return files.withColumn("key", slice_key(F.coalesce(last_number(F.col(name)), place)))


def thin(slices: DataFrame, factor: int, order: str = "z") -> DataFrame:
    """Every ``factor``-th slice from the first, renumbered; the slice distance grows by the factor (see ``thinned_spacing``)."""
    if factor <= 1:
        return slices
    place = F.row_number().over(Window.orderBy(order)) - 1
    kept = slices.withColumn("_i", place).where(F.col("_i") % factor == 0)
    return kept.withColumn("new_z", (F.col("_i") / factor).cast("int")).drop("_i")


def thinned_spacing(sz: float, factor: int) -> float:
    return sz * max(1, factor)


def reverse(voxels: DataFrame, depth: int, height: int | None = None) -> DataFrame:
    """Slices in opposite order; with ``height``, rows too (as the descending mesh export has them)."""
    out = voxels.withColumn("z", (F.lit(depth - 1) - F.col("z")).cast("int"))
    return out if height is None else out.withColumn("y", (F.lit(height - 1) - F.col("y")).cast("int"))


def z_spacing(slices: DataFrame, order: str = "idx", ranged: int = 100_000) -> DataFrame:
    """One row (spacing): the last positive spacing tag, else the upper median of distances along the slice normal above 1e-6, else the
    last positive thickness, else null.  slices: (idx, spacing_between, thickness, position, all but idx nullable)."""
    last = lambda c: F.max_by(F.when(F.col(c) > 0, F.col(c)), F.when(F.col(c) > 0, F.col(order)))
    tags = slices.agg(last("spacing_between").alias("a"), last("thickness").alias("c"))
    # Places in order, by ranges of about equal width: neighbours meet within a range, and each range's first with the last before it.
    at = slices.where("position is not null").select("position")
    span = at.agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count("*").alias("n"))
    width = F.greatest((F.col("hi") - F.col("lo")) / F.ceil(F.col("n") / ranged), F.lit(1e-300))
    ranges = at.crossJoin(F.broadcast(span)).select("position", F.floor((F.col("position") - F.col("lo")) / width).alias("range"))  # one row
    within = ranges.select((F.col("position") - F.lag("position").over(Window.partitionBy("range").orderBy("position"))).alias("d"))
    ends = ranges.groupBy("range").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    between = ends.select((F.col("first") - F.lag("last").over(Window.orderBy("range"))).alias("d"))  # a row for each range
    median = within.unionByName(between).where("d > 1e-6").agg(F.expr("percentile_disc(0.5) within group (order by d desc)").alias("b"))
    return tags.crossJoin(median).select(F.coalesce("a", "b", "c").alias("spacing"))  # one row each


def slice_position(position: Column, orientation: Column) -> Column:
    """A slice position (array of 3) projected on the normal of its orientation (array of 6)."""
    o = lambda i: F.get(orientation, F.lit(i))
    nx, ny, nz = o(1) * o(5) - o(2) * o(4), o(2) * o(3) - o(0) * o(5), o(0) * o(4) - o(1) * o(3)
    return F.get(position, F.lit(0)) * nx + F.get(position, F.lit(1)) * ny + F.get(position, F.lit(2)) * nz


def neighbor_overlay(voxels: DataFrame, step: int = -1, alpha: float = 0.5) -> DataFrame:
    """(z, y, x, mixed): each slice mixed with the one ``step`` away; slices without one stay.  A join on the place, right also for sparse rows."""
    other = voxels.select((F.col("z") - step).cast("int").alias("z"), "y", "x", F.col("gray").alias("_g"))
    mixed = F.floor(F.col("gray") * (1 - alpha) + F.col("_g") * alpha).cast("int")
    return voxels.join(other, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce(mixed, F.col("gray").cast("int")).alias("mixed"))


def normalise(voxels: DataFrame, value: str = "gray") -> DataFrame:
    """(z, y, x, norm): each slice stretched to 0..255 and cut to whole numbers.  The ends come from an aggregation (one row a slice) joined
    back, which combines before the shuffle where a window would sort whole slices."""
    ends = voxels.groupBy("z").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    # Single precision throughout, as the readers have it: a quotient of doubles, rounded once, is that of singles.
    share = ((F.col(value) - F.col("_lo")).cast("float") / ((F.col("_hi") - F.col("_lo")).cast("float") + F.lit(1e-8).cast("float"))).cast("float")
    stretched = F.floor(share * F.lit(255).cast("float")).cast("int")
    return voxels.join(ends, "z").select("z", "y", "x", stretched.alias("norm"))


def gray_levels(voxels: DataFrame, palette: DataFrame) -> DataFrame:
    """(z, y, x, level): labels as grey levels, background 0.  The palette is 20 rows: broadcast."""
    p = palette.select("label", F.col("gray").alias("level"))
    return voxels.join(F.broadcast(p), "label", "left").select("z", "y", "x", F.coalesce("level", F.lit(0)).alias("level"))


def overlay(voxels: DataFrame, palette: DataFrame, alpha: float, visible: list[int] | None = None) -> DataFrame:
    """(z, y, x, r, g, b): label colours over grey pixels, cut to whole numbers; only visible labels are laid over."""
    p = palette.select("label", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    p = p if visible is None else p.where(F.col("label").isin(visible))
    gray = F.col("gray").cast("double")
    mixed = lambda c: F.floor(F.least(F.greatest((1 - alpha) * gray + alpha * F.col(f"_{c}"), F.lit(0.0)), F.lit(255.0)))
    over = lambda c: F.when(F.col(f"_{c}").isNull(), F.col("gray")).otherwise(mixed(c)).cast("int")
    return voxels.join(F.broadcast(p), "label", "left").select("z", "y", "x", *[over(c).alias(c) for c in "rgb"])


def renumbered(slices: DataFrame, descending: bool = False) -> DataFrame:
    """Slices with ``export_index`` from 1, in either order of z."""
    z = F.col("z").desc() if descending else F.col("z")
    return slices.withColumn("export_index", F.row_number().over(Window.orderBy(z)))


def previews(voxels: DataFrame, palette: DataFrame) -> DataFrame:
    """(z, y, x, r, g, b): label colours on black."""
    p = palette.select("label", "r", "g", "b")
    return voxels.join(F.broadcast(p), "label", "left").select("z", "y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])
