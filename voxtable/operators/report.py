"""Measurements: counts by label, slice and object, and what follows from them.

Every value is a whole count times a constant, so results do not depend on the order of addition.  Aggregations run over
foreground rows only; reports are completed to all labels and slices from small tables afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS


def labels_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1, LABELS + 1).select(F.col("id").cast("int").alias("label"))


def spacing(volumes: DataFrame) -> DataFrame:
    """Volumes with ``sx, sy, sz, ox, oy, oz`` filled: each spacing from the header, else from the calibration (mm_per_px, z_spacing), else 1; a missing y
    spacing without calibration is x's; origins are 0."""
    sx = F.coalesce("sx", "mm_per_px", F.lit(1.0))
    filled = {"sx": sx, "sy": F.coalesce("sy", "mm_per_px", sx), "sz": F.coalesce("sz", "z_spacing", F.lit(1.0))}
    return volumes.withColumns(filled | {c: F.coalesce(c, F.lit(0.0)) for c in ("ox", "oy", "oz")})


def picked(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """(id, z, y, x, gray, label) under points (id, z, y, x); outside the volume both are null."""
    return points.join(voxels.select("z", "y", "x", "gray", "label"), ["z", "y", "x"], "left").select("id", "z", "y", "x", "gray", "label")


def label_volumes(voxels: DataFrame, area: float, sz: float) -> DataFrame:
    """(label, voxels, mm3, cm3): 20 rows, also for unused labels.  area: square millimetres of a pixel; sz: slice distance."""
    counted = voxels.where(F.col("label").between(1, LABELS)).groupBy("label").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    mm3 = n * (area * sz)
    return labels_table(voxels).join(counted, "label", "left").select("label", n.alias("voxels"), mm3.alias("mm3"), (mm3 / 1000).alias("cm3"))


def slice_table(voxels: DataFrame) -> DataFrame:
    return voxels.select("z").distinct()


def slice_areas(voxels: DataFrame, area: float) -> DataFrame:
    """(z, label, pixels, mm2) for every slice and label."""
    counted = voxels.where(F.col("label").between(1, LABELS)).groupBy("z", "label").agg(F.count("*").alias("n"))
    spine = slice_table(voxels).withColumn("label", F.explode(F.sequence(F.lit(1), F.lit(LABELS))))
    n = F.coalesce("n", F.lit(0))
    return spine.join(counted, ["z", "label"], "left").select("z", "label", n.alias("pixels"), (n * area).alias("mm2"))


def slice_areas_wide(voxels: DataFrame, area: float) -> DataFrame:
    """(z, obj_1 .. obj_20): areas, one row for each slice, one pass."""
    return voxels.groupBy("z").agg(*[(F.count(F.when(F.col("label") == i, 1)) * area).alias(f"obj_{i}") for i in range(1, LABELS + 1)])


def _share(part, whole):
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def threshold_fraction(voxels: DataFrame, target: int, extracted: int, area: float, sz: float) -> DataFrame:
    """One row: voxels of either label, of the extracted one, their volumes, and the share in percent (100 if both are the same label)."""
    found = voxels.where(F.col("label").isin(target, extracted)).agg(F.count("*").alias("target_n"), F.count(F.when(F.col("label") == extracted, 1)).alias("extracted_n"))
    return found.select("target_n", "extracted_n", (F.col("target_n") * (area * sz)).alias("target_mm3"), (F.col("extracted_n") * (area * sz)).alias("extracted_mm3"), _share(F.col("extracted_n"), F.col("target_n")).alias("percent"))


def threshold_fraction_slices(voxels: DataFrame, target: int, extracted: int, area: float) -> DataFrame:
    """(slice, key, target_n, extracted_n, target_mm2, extracted_mm2, percent) for every slice; slices and keys count from 1."""
    n = voxels.groupBy("z").agg(F.count(F.when(F.col("label").isin(target, extracted), 1)).alias("target_n"), F.count(F.when(F.col("label") == extracted, 1)).alias("extracted_n"))
    return n.select((F.col("z") + 1).alias("slice"), F.lpad((F.col("z") + 1).cast("string"), 4, "0").alias("key"), "target_n", "extracted_n", (F.col("target_n") * area).alias("target_mm2"), (F.col("extracted_n") * area).alias("extracted_mm2"), _share(F.col("extracted_n"), F.col("target_n")).alias("percent"))


def threshold_fraction_display(voxels: DataFrame, target: int, extracted: int) -> DataFrame:
    """(z, remaining_n, extracted_n, percent): the counts are added, so one label for both gives 50; null where both are empty."""
    n = voxels.groupBy("z").agg(F.count(F.when(F.col("label") == target, 1)).alias("remaining_n"), F.count(F.when(F.col("label") == extracted, 1)).alias("extracted_n"))
    total = F.col("remaining_n") + F.col("extracted_n")
    return n.withColumn("percent", F.when(total > 0, F.col("extracted_n") / total * 100.0))


def used_labels(voxels: DataFrame) -> DataFrame:
    return voxels.where(F.col("label").between(1, LABELS)).select("label").distinct()


def label_boxes(voxels: DataFrame) -> DataFrame:
    """(label, n, min and max of z, y, x) of the labels in use."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("z", "y", "x") for n, f in (("min", F.min), ("max", F.max))]
    return voxels.where(F.col("label").between(1, LABELS)).groupBy("label").agg(F.count("*").alias("n"), *ends)


def overlap_pairs(memberships: DataFrame, voxel: float) -> DataFrame:
    """(a, b, voxels, mm3) of label pairs that share voxels.  Labels of a voxel are gathered once and paired there (at most 20
    of them), so nothing is joined with itself."""
    sets = memberships.groupBy("z", "y", "x").agg(F.array_sort(F.collect_set("label")).alias("ls")).where(F.size("ls") > 1)
    pairs = sets.select(F.posexplode("ls").alias("i", "a"), "ls").select("a", F.explode(F.expr("slice(ls, i + 2, size(ls))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("voxels")).withColumn("mm3", F.col("voxels") * voxel)


def roi_volumes(members: DataFrame, sx: float, sy: float, sz: float) -> DataFrame:
    """The volume summary: (roi, voxels_count, spacings, voxel_volume_mm3, total_volume_mm3, total_volume_mL)."""
    voxel = sx * sy * sz
    n = members.groupBy("roi").agg(F.count("*").alias("voxels_count"))
    total = F.col("voxels_count") * voxel
    return n.select("roi", "voxels_count", F.lit(sx).alias("spacing_x_mm"), F.lit(sy).alias("spacing_y_mm"), F.lit(sz).alias("spacing_z_mm"), F.lit(voxel).alias("voxel_volume_mm3"), total.alias("total_volume_mm3"), (total / 1000).alias("total_volume_mL"))


def exposed_faces(voxels: DataFrame, area_xy: float = 1.0, area_side: float = 1.0) -> DataFrame:
    """(label, faces, mm2): voxel faces that meet another label, background or the border.  Each voxel offers its six faces, keyed by the
    plane between the two voxels; a face that one label offers twice is inner."""
    fore = voxels.where("label > 0").select("z", "y", "x", "label")
    faces = F.array(*[F.struct(F.lit(a).alias("axis"), (F.col("z") + dz).alias("fz"), (F.col("y") + dy).alias("fy"), (F.col("x") + dx).alias("fx")) for a, (dz, dy, dx) in [(0, (0, 0, 0)), (0, (1, 0, 0)), (1, (0, 0, 0)), (1, (0, 1, 0)), (2, (0, 0, 0)), (2, (0, 0, 1))]])
    once = fore.select("label", F.explode(faces).alias("f")).groupBy("label", "f").agg(F.count("*").alias("n")).where("n = 1")
    by = once.groupBy("label").agg(F.count("*").alias("faces"), F.count(F.when(F.col("f.axis") == 0, 1)).alias("flat"))
    return by.select("label", "faces", (F.col("flat") * area_xy + (F.col("faces") - F.col("flat")) * area_side).alias("mm2"))
