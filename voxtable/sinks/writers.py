"""Writers: label and preview pictures, volumes, meshes and reports.

Pixels of a slice are gathered by slice (bounded by an image), encoded there, and returned as (name, content) rows; ``save`` writes
such rows to any folder that Spark can write, from where they are.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS
from ..sources import codecs

FILES = "name string, content binary"


def _grid(pdf: pd.DataFrame, columns: list[str], height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width, len(columns)), np.uint8)
    out[pdf["y"], pdf["x"]] = pdf[columns].to_numpy()
    return out[..., 0] if len(columns) == 1 else out


def pictures(voxels: DataFrame, height: int, width: int, columns: list[str], pattern: str = "mask{:04}.png", descending: bool = False, kind: str = "png") -> DataFrame:
    """FILES of one picture a slice, numbered from 1 in order of z (or from the last).  columns: one grey or three colour columns."""
    depth = voxels.agg(F.max("z").alias("m")).first()["m"] or 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = int(pdf["z"].iloc[0])
        pixels = _grid(pdf, columns, height, width)
        data = codecs.encode_png(pixels) if kind == "png" else codecs.encode_tiff(pixels)
        return pd.DataFrame({"name": [pattern.format(depth - z + 1 if descending else z + 1)], "content": [data]})

    return voxels.select("z", "y", "x", *columns).groupBy("z").applyInPandas(run, FILES)


def nifti_affine(sx: float, sy: float, sz: float, ox: float, oy: float, oz: float, height: int, depth: int, descending: bool = False) -> np.ndarray:
    """Rows run against y; with ``descending``, slices against z."""
    a = np.diag([sx, -sy, -sz if descending else sz, 1.0])
    a[:3, 3] = ox, oy + (height - 1) * sy, oz + (depth - 1) * sz if descending else oz
    return a


def nifti(voxels: DataFrame, volume: str, height: int, width: int, depth: int, affine: np.ndarray) -> DataFrame:
    """FILES of one label volume.  A NIfTI file is one byte stream: its voxels meet in one task, as bytes by slice (depth rows)."""

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"z": [np.int32(pdf["z"].iloc[0])], "data": [_grid(pdf, ["label"], height, width).tobytes()]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((depth, height, width), np.uint8)
        for z, d in zip(pdf["z"], pdf["data"], strict=True):
            out[z] = np.frombuffer(d, np.uint8).reshape(height, width)
        return pd.DataFrame({"name": [f"{volume}.nii.gz"], "content": [codecs.encode_nifti(out.transpose(2, 1, 0), affine)]})

    slabs = voxels.where("label > 0").select("z", "y", "x", "label").groupBy("z").applyInPandas(strip, "z int, data binary")
    return slabs.withColumn("volume", F.lit(volume)).groupBy("volume").applyInPandas(run, FILES)


def stl(triangles: DataFrame) -> DataFrame:
    """FILES of one mesh a label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.iloc[:, 1:].to_numpy().reshape(-1, 3, 3)
        return pd.DataFrame({"name": [f"object{int(pdf['label'].iloc[0]):02}.stl"], "content": [codecs.encode_stl(t)]})

    return triangles.groupBy("label").applyInPandas(run, FILES)


def split_colors(voxels: DataFrame, height: int, width: int) -> DataFrame:
    """FILES of one black and white picture for each label and slice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = _grid(pdf.assign(v=255), ["v"], height, width)
        return pd.DataFrame({"name": [f"object{int(pdf['label'].iloc[0]):02}/mask{int(pdf['z'].iloc[0]) + 1:04}.png"], "content": [codecs.encode_png(pixels)]})

    return voxels.where("label > 0").select("label", "z", "y", "x").groupBy("label", "z").applyInPandas(run, FILES)


def save(files: DataFrame, folder: str) -> int:
    """Write FILES rows as files, each by the task that has it, and give their number.  A file appears under its name when it is complete,
    so a task that runs again does no harm.  ``folder``: a path or URI that Arrow's file systems know, reachable from all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base}/{name}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(draft) as f:
                    f.write(content)
                fs.move(draft, target)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def volinfo_csv(width: int, height: int, depth: int, sx: float, sy: float, sz: float, ox: float = 0.0, oy: float = 0.0, oz: float = 0.0) -> str:
    """The six-row header; numbers with ten digits."""
    out = io.StringIO()
    n = lambda *v: [format(x, ".10g") for x in v]
    csv.writer(out).writerows([["Width", "Height", "Depth"], [str(width), str(height), str(depth)], ["X Spacing", "Y Spacing", "Z Spacing"], n(sx, sy, sz), ["X Origin", "Y Origin", "Z Origin"], n(ox, oy, oz)])
    return out.getvalue()


def measurement_csv(volumes: DataFrame, areas: DataFrame, fraction: DataFrame, fraction_slices: DataFrame, lines: DataFrame | None, target: int, extracted: int, lo: int, hi: int) -> str:
    """The report of all sections; their titles and columns are fixed values of the format.  Rounding is done here, in Python; the tables have a row for each label or slice."""
    out = io.StringIO()
    w = csv.writer(out)
    two, four = (lambda v: f"{v:.2f}"), (lambda v: f"{v:.4f}")
    w.writerows([["Object Volumes"], ["Label", "Volume (mm^3)", "Volume (cm^3)"]])
    w.writerows([f"Obj {r['label']}", two(r["mm3"]), format(r["cm3"], ".3f")] for r in volumes.orderBy("label").collect())
    w.writerows([[], ["Slice Areas (mm^2)"], ["Slice Index", *[f"Obj {i}" for i in range(1, LABELS + 1)]]])
    w.writerows([r["z"] + 1, *[two(r[f"obj_{i}"]) for i in range(1, LABELS + 1)]] for r in areas.orderBy("z").collect())
    w.writerows([[], ["Threshold Fraction Inside Object"], ["Target Object", f"Obj {target}"], ["Extracted Object", f"Obj {extracted}"], ["Threshold Min", lo], ["Threshold Max", hi]])
    f = fraction.first()
    w.writerows([[], ["Summary"], ["Target Volume (mm^3)", "Target Volume (cm^3)", "Extracted Volume (mm^3)", "Extracted Volume (cm^3)", "Fraction (%)"]])
    w.writerow([four(f["target_mm3"]), four(f["target_mm3"] / 1000), four(f["extracted_mm3"]), four(f["extracted_mm3"] / 1000), four(f["percent"])])
    w.writerows([[], ["Per-slice Threshold Fraction"], ["Slice Index", "Image Key", "Target Pixels", "Extracted Pixels", "Target Area (mm^2)", "Extracted Area (mm^2)", "Fraction (%)"]])
    w.writerows([r["slice"], r["key"], r["target_n"], r["extracted_n"], four(r["target_mm2"]), four(r["extracted_mm2"]), four(r["percent"])] for r in fraction_slices.orderBy("slice").collect())
    found = lines.orderBy("id").collect() if lines is not None else []
    if found:
        w.writerows([[], ["Measurement Results"], ["Label", "Length (px)", "Length (mm)"]])
        w.writerows([f"Measurement {i:02d}", two(r["px"]), "N/A" if r["mm"] is None else two(r["mm"])] for i, r in enumerate(found, 1))
    return out.getvalue()
