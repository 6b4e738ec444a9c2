"""Types and fixed tables of the volume model.

A volume is rows ``(z, y, x, label, gray)``: label 0 is background, 1 to 20 are objects, and (z, y, x) is unique.  With
several volumes, ``volume_id`` leads.  ``memberships`` may hold a voxel under several labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LABELS = 20

VOXELS = T.StructType([T.StructField("z", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("gray", T.IntegerType()), T.StructField("label", T.IntegerType())])
MEMBERSHIPS = T.StructType([T.StructField("z", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("label", T.IntegerType())])
SLICES = T.StructType([T.StructField("z", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("path", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])
PATHS = "z int, path_id long, seq int, label int, pts array<struct<x:double,y:double>>"

#: The objects' colours, red, green and blue, for labels 1 to 20.
COLORS = [
    (255, 0, 0), (0, 0, 255), (0, 255, 0), (255, 255, 0), (128, 0, 128), (255, 165, 0), (0, 255, 255), (173, 255, 47), (128, 128, 128), (0, 128, 128),
    (255, 192, 203), (255, 20, 147), (0, 128, 0), (128, 0, 0), (0, 255, 230), (255, 215, 0), (255, 69, 0), (0, 0, 128), (220, 20, 60), (128, 128, 0),
]
#: The labels' grey levels in grey exports.
GRAYS = [255, 248, 237, 226, 215, 204, 193, 182, 171, 160, 149, 138, 127, 116, 105, 94, 83, 72, 61, 50]
#: Intensity ranges by name.
PRESETS = {"CT Bone": (180, 255), "CT Soft Tissue": (80, 180), "CT Fat": (30, 80), "CT Air/Background": (0, 30), "MRI High Signal": (150, 255), "MRI Low Signal": (0, 60)}
#: Fixed value: opacity of labels over images.
OVERLAY_ALPHA = 77 / 255
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".dcm", ".nrrd", ".nhdr")


def palette(spark: SparkSession) -> DataFrame:
    """(label, r, g, b, hex, gray), one row for each of the 20 labels."""
    rows = [(i + 1, r, g, b, f"#{r:02x}{g:02x}{b:02x}", GRAYS[i]) for i, (r, g, b) in enumerate(COLORS)]
    return spark.createDataFrame(rows, "label int, r int, g int, b int, hex string, gray int")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, lo, hi) for n, (lo, hi) in PRESETS.items()], "preset string, lo int, hi int")


def volinfo(spark: SparkSession, width: int, height: int, depth: int, sx: float = 1.0, sy: float = 1.0, sz: float = 1.0, ox: float = 0.0, oy: float = 0.0, oz: float = 0.0) -> DataFrame:
    return spark.createDataFrame([(width, height, depth, sx, sy, sz, ox, oy, oz)], "width int, height int, depth int, sx double, sy double, sz double, ox double, oy double, oz double")
