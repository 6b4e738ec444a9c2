"""Readers: files become slice, voxel, path and header tables.

Bytes come through Spark's ``binaryFile`` source, so any store that Spark reads will do; decoding runs in Arrow batches where the
files are.  A file that cannot be decoded becomes a row with ``error`` and no pixels, and takes no place in the order.
"""

from __future__ import annotations

import csv
import io
import json
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import nearest_label, parse_color
from ..operators.geometry import parse_points, parse_subpaths, scale_points
from ..operators.stack import mask_keys, natural_key, slice_key, slice_position, z_spacing
from ..runtime import settle
from ..schema import IMAGE_SUFFIXES
from . import codecs

_DECODED = "path string, part int, height int, width int, data binary, tags string, error string"


_FILES = "path string, content binary"
_DATA_FILE = r"(?im)^data ?file:[ \t]*([^\r\n]+?)[ \t]*\r?$"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files in ZIP archives, one at a time; an archive that cannot be opened, and a member that cannot be unpacked, stay as they are."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                yield pd.DataFrame({"path": [path], "content": [content]})
                continue
            for info in archive.infolist():
                if not info.is_dir():
                    try:
                        data = archive.read(info)
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
                        data = b""
                    yield pd.DataFrame({"path": [f"{path}!/{info.filename}"], "content": [data]})


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of a folder's files of a known suffix or with DICOM content.

    Of ZIP archives the members are files, named ``archive!/member``; each archive is unpacked where it is read.  An NRRD header that names a data
    file gets that file's bytes, by a join on the place that it names; where the file is missing it stays without data, which no decoder takes."""
    read = spark.read.format("binaryFile").load(path).select("path", "content")
    zipped = F.lower("path").endswith(".zip")
    found = read.where(~zipped).unionByName(read.where(zipped).mapInPandas(_members, _FILES))
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    head = F.substring("content", 1, 132)
    sniffed = (F.substring(head, 129, 4) == F.lit(b"DICM")) | F.substring(head, 1, 2).isin(b"\x02\x00", b"\x08\x00", b"\x10\x00")
    known = found.withColumn("name", name).where(suffix.isin(*IMAGE_SUFFIXES, ".zip") | sniffed)
    detached = known.where(F.lower("name").endswith(".nhdr"))
    text = F.decode("content", "ISO-8859-1")
    folder = F.regexp_replace("path", "[^/]*$", "")
    asked = detached.select("path", "name", "content", F.concat(folder, F.regexp_extract(text, _DATA_FILE, 1)).alias("_data"), text.alias("_text"))
    bodies = found.select(F.col("path").alias("_data"), F.col("content").alias("_body"))
    whole = F.concat(F.encode(F.concat(F.regexp_replace(F.regexp_replace("_text", r"(?im)^data ?file:[^\n]*\n?", ""), r"\s+$", ""), F.lit("\n\n")), "ISO-8859-1"), F.col("_body"))
    filled = asked.join(bodies, "_data", "left").select("path", "name", F.when(F.col("_body").isNotNull() & (F.col("_data") != folder), whole).otherwise(F.col("content")).alias("content"))
    return known.where(~F.lower("name").endswith(".nhdr")).select("path", "name", "content").unionByName(filled)


def _decode(name: str, content: bytes) -> list[tuple[np.ndarray, dict]]:
    low = name.lower()
    if low.endswith(".png"):
        return [(codecs.decode_png(content), {})]
    if low.endswith((".nrrd", ".nhdr")):
        values, spacing = codecs.decode_nrrd(content)
        return [(codecs.stretch(s), {"pixel_spacing": list(spacing[:2]), "spacing_between": spacing[2]} if spacing else {}) for s in values]
    if low.endswith(".dcm") or codecs.is_dicom(content):
        pixels, tags = codecs.decode_dicom(content)
        return [(codecs.stretch(pixels), tags)]
    raise ValueError("no decoder for this kind of file; use image_slices")


def slices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(slices, rejects) of PNG, NRRD, DICOM, JPG, TIFF and BMP files in natural order: (z, key, path, part, height, width, data, tags), pixels row by
    row.  Places come from names and part numbers alone, so no task sees the pixels of other files than its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, n, c in zip(pdf["path"], pdf["name"], pdf["content"], strict=True):
                try:
                    for part, (pixels, tags) in enumerate(_decode(n, c)):
                        gray = pixels if pixels.ndim == 2 else to_gray(pixels)
                        out.append((p, part, *gray.shape, np.ascontiguousarray(gray).tobytes(), json.dumps(tags), None))
                except Exception as e:  # reported as a row
                    out.append((p, 0, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DECODED.split(", ")])

    def gray(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, h, w, n, d in zip(pdf["path"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
                pixels = np.frombuffer(d, np.uint8).reshape(h, w, n)
                out.append((p, 0, h, w, (pixels[..., 0] if n == 1 else to_gray(pixels[..., 2::-1])).tobytes(), "{}", None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DECODED.split(", ")])

    found = files(spark, path)
    pictured = F.lower("name").rlike(r"\.(jpe?g|tiff?|bmp)$")
    read = found.where(~pictured).select("path", "name", "content").mapInPandas(run, _DECODED)
    if not (pictures := found.where(pictured).select("path")).isEmpty():
        images = image_slices(spark, path, "*.{" + ",".join(f"{x},{x.upper()}" for x in ("jpg", "jpeg", "tif", "tiff", "bmp")) + "}").mapInPandas(gray, _DECODED)
        alike = F.regexp_replace("path", "^([a-z]+):/+", "$1:/").alias("_path")  # the two sources write local paths differently
        lost = pictures.select("path", alike).join(images.select(alike), "_path", "left_anti")
        read = read.unionByName(images).unionByName(lost.selectExpr("path", "0 as part", "cast(null as int) as height", "cast(null as int) as width", "cast(null as binary) as data", "cast(null as string) as tags", "'not a picture that can be read' as error"))
    read = settle(read)  # decoded once, for places, pixels and rejects
    name = F.element_at(F.split("path", "/"), -1)
    z = F.row_number().over(Window.orderBy(natural_key(name), name, "part")) - 1
    places = read.where("error is null").select("path", "part").withColumn("z", z.cast("int")).withColumn("key", slice_key(F.col("z") + 1))
    good = read.where("error is null").drop("error").join(places, ["path", "part"])
    return good.select("z", "key", "path", "part", "height", "width", "data", "tags"), read.where("error is not null").select("path", "error")


def series(slice_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slices, spacing) of one DICOM series: renumbered by their place along the slice normal where all have one (ties and others as they
    were), and one row with the distance of slices from the tags or those places."""
    t = F.from_json("tags", "position array<double>, orientation array<double>, spacing_between double, thickness double")
    axes = F.coalesce(t["orientation"], F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))))
    index = slice_rows.select(F.col("z").alias("idx"), t["spacing_between"].alias("spacing_between"), t["thickness"].alias("thickness"), slice_position(t["position"], axes).alias("position"))
    at = F.when(F.min(F.col("position").isNotNull()).over(Window.partitionBy()), F.col("position"))  # a row for each slice
    order = index.select(F.col("idx").alias("z"), at.alias("_p")).select("z", (F.row_number().over(Window.orderBy("_p", "z")) - 1).cast("int").alias("_z"))
    sorted_rows = slice_rows.join(order, "z").withColumn("z", F.col("_z")).withColumn("key", slice_key(F.col("z") + 1)).drop("_z")
    return sorted_rows, z_spacing(index)


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of red, green and blue in fixed point, rounded: 0.299, 0.587, 0.114."""
    r, g, b = (pixels[..., i].astype(np.int64) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def image_slices(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """JPG, BMP, TIFF and others through Spark's image source: (path, height, width, channels, data), colour bytes in blue, green, red order."""
    reader = spark.read.format("image").option("dropInvalid", True)
    i = (reader.option("pathGlobFilter", only) if only else reader).load(path)
    return i.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def voxels(slice_rows: DataFrame, value: str = "gray") -> DataFrame:
    """One row for each pixel of (z, height, width, data).  Filter slices before: nothing is pushed through the decoding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for z, w, d in zip(pdf["z"], pdf["width"], pdf["data"], strict=True):
                v = np.frombuffer(d, np.uint8)
                i = np.arange(len(v))
                yield pd.DataFrame({"z": np.int32(z), "y": (i // w).astype(np.int32), "x": (i % w).astype(np.int32), value: v.astype(np.int32)})

    return slice_rows.select("z", "width", "data").mapInPandas(run, f"z int, y int, x int, {value} int")


def label_masks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(masks, rejects): (key, height, width, data) of single-channel PNG masks, keyed by the last number in their name, and (path, error) of the others."""
    schema = "key string, path string, height int, width int, data binary, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, p, c in zip(pdf["key"], pdf["path"], pdf["content"], strict=True):
                try:
                    m = codecs.decode_png(c)
                    if m.ndim != 2:
                        raise ValueError("a label mask must have one channel")
                    out.append((k, p, *m.shape, m.tobytes(), None))
                except Exception as e:  # reported as a row
                    out.append((k, p, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    read = mask_keys(found).select("key", "path", "content").mapInPandas(run, schema)
    return read.where("error is null").select("key", "height", "width", "data"), read.where("error is not null").select("path", "error")


def svg_paths(spark: SparkSession, path: str) -> DataFrame:
    """(key, path_id, z, label, seq, kind, d, width, height) of SVG masks: shapes with a palette colour, in file order; later ones lie on top."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *s) for k, c in zip(pdf["key"], pdf["content"], strict=True) for s in parse_svg(c)]
            yield pd.DataFrame(out, columns=["key", "seq", "label", "kind", "d", "width", "height"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    shapes = mask_keys(found).select("key", "content").mapInPandas(run, "key string, seq int, label int, kind string, d string, width double, height double")
    return shapes.withColumn("z", F.col("key").cast("int") - 1).withColumn("path_id", F.shiftleft(F.col("z").cast("long"), 32) + F.col("seq"))


def mask_paths(shapes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Paths (path_id, z, seq, label, pts), one row a subpath, of SVG shapes in pixels of their images (z, height, width): a view of another size than
    its image is scaled to it, in each direction for itself; without a view's size, units are pixels.  What ``geometry.rasterise`` takes."""
    image = sizes.select("z", F.col("height").alias("_h"), F.col("width").alias("_w"))
    parts = F.when(F.col("kind") == "path", parse_subpaths(F.col("d"))).otherwise(F.array(parse_points(F.col("d"))))
    laid = shapes.join(image, "z").withColumn("pts", F.explode(parts))
    fx, fy = (F.when(F.col(view) > 0, F.col(size) / F.col(view)).otherwise(1.0) for view, size in (("width", "_w"), ("height", "_h")))
    return laid.select("path_id", "z", "seq", "label", scale_points(F.col("pts"), fx, fy).alias("pts"))


def parse_svg(content: bytes) -> list[tuple[int, int, str, str, float | None, float | None]]:
    """(seq, label, kind, points or d, view width, view height) of the shapes that bear a palette colour."""
    root = ET.fromstring(content)
    box = (root.get("viewBox") or "").replace(",", " ").split()
    size = [float(v) for v in box[2:4]] if len(box) == 4 else [float(v.removesuffix("px")) if (v := root.get(k)) else None for k in ("width", "height")]
    out = []
    for seq, e in enumerate(root.iter()):
        kind = e.tag.rpartition("}")[2]
        style = dict(p.split(":", 1) for p in (e.get("style") or "").replace(" ", "").split(";") if ":" in p)
        label = nearest_label(parse_color(style.get("fill") or e.get("fill") or ""))
        if label is None:
            continue
        if kind == "path":
            out.append((seq, label, kind, e.get("d") or "", *size))
        elif kind in ("polygon", "polyline"):
            out.append((seq, label, kind, e.get("points") or "", *size))
        elif kind == "rect":
            x, y, w, h = (float(e.get(k) or 0) for k in ("x", "y", "width", "height"))
            out.append((seq, label, "polygon", f"{x} {y} {x + w} {y} {x + w} {y + h} {x} {y + h}", *size))
    return out


def read_volinfo(spark: SparkSession, path: str, *, spacing_mode: str = "mean") -> DataFrame:
    """The volume header as one row, with ``mm_per_px``: the mean of x and y spacing, or x alone (``spacing_mode="x"``)."""
    text = "\n".join(r["value"] for r in spark.read.text(path).limit(16).collect())  # a header of six lines
    return spark.createDataFrame([parse_volinfo(text, spacing_mode)], "width int, height int, depth int, sx double, sy double, sz double, ox double, oy double, oz double, mm_per_px double")


def parse_volinfo(text: str, spacing_mode: str = "mean") -> tuple:
    rows = list(csv.reader(io.StringIO(text)))
    if len(rows) < 4:
        raise ValueError("a volume header has at least four rows")
    names = [c.strip().lower() for c in rows[2]]
    if not all(any(a in n and "spacing" in n for n in names) for a in "xyz"):
        raise ValueError("the third row must name x, y and z spacing")
    w, h, d = (int(float(v)) for v in rows[1][:3])
    sx, sy, sz = (float(v) for v in rows[3][:3])
    if min(sx, sy, sz) <= 0:
        raise ValueError("spacing must be positive")
    ox, oy, oz = (float(v) for v in rows[5][:3]) if len(rows) > 5 else (0.0, 0.0, 0.0)
    mm = (sx + sy) / 2 if spacing_mode == "mean" and abs(sx - sy) > 1e-9 else sx
    return w, h, d, sx, sy, sz, ox, oy, oz, mm


def nifti_members(spark: SparkSession, path: str) -> DataFrame:
    """(roi, i, j, k) foreground (above a half) of NIfTI masks, the region named by its file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for roi, c in zip(pdf["roi"], pdf["content"], strict=True):
                values, _, _ = codecs.decode_nifti(c)
                i, j, k = np.nonzero(values > 0.5)
                yield pd.DataFrame({"roi": roi, "i": i.astype(np.int32), "j": j.astype(np.int32), "k": k.astype(np.int32)})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii*").load(path)
    roi = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.nii(\.gz)?$", "")
    return found.select(roi.alias("roi"), "content").mapInPandas(run, "roi string, i int, j int, k int")


def web_index(names: DataFrame, name: str = "name") -> DataFrame:
    """One row (starting_index): the least number in the last four characters of the stems."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return names.select(stem.alias("_s")).agg(F.min(F.expr("try_cast(right(_s, 4) as int)")).alias("starting_index"))
