"""Files in and out, and the edit stream."""

import gzip
import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable import fixtures as fx
from voxtable.operators import edits, geometry, mesh, report, stack, tracking
from voxtable.plans.queries import AREA, SZ
from voxtable.schema import palette
from voxtable.sinks import writers
from voxtable.sources import codecs, readers
from voxtable.streaming import editlog

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(0)


def dicom(pixels, z, explicit=True):
    def tag(g, e, kind, data):
        data += b"\0" if len(data) % 2 else b""
        if g == 2 or explicit:
            if kind in (b"OW",):
                return struct.pack("<HH2sHI", g, e, kind, 0, len(data)) + data
            return struct.pack("<HH2sH", g, e, kind, len(data)) + data
        return struct.pack("<HHI", g, e, len(data)) + data

    h, w = pixels.shape
    us = lambda v: struct.pack("<H", v)
    body = tag(0x18, 0x50, b"DS", b"2.5") + tag(0x20, 0x32, b"DS", f"0\\0\\{z}".encode()) + tag(0x20, 0x37, b"DS", b"1\\0\\0\\0\\1\\0") + tag(0x28, 0x10, b"US", us(h)) + tag(0x28, 0x11, b"US", us(w)) + tag(0x28, 0x100, b"US", us(16)) + tag(0x28, 0x103, b"US", us(0))
    syntax = b"1.2.840.10008.1.2.1" if explicit else b"1.2.840.10008.1.2"
    return b"\0" * 128 + b"DICM" + tag(2, 0x10, b"UI", syntax) + body + tag(0x7FE0, 0x10, b"OW", pixels.astype("<u2").tobytes())


def test_png_round_trip_and_filters():
    for shape in ((7, 5), (4, 6, 3)):
        a = RNG.integers(0, 256, shape, np.uint8)
        assert np.array_equal(codecs.decode_png(codecs.encode_png(a)), a)
    import zlib

    rows = [b"\x00\x01\x02\x03", b"\x01\x05\x01\x01", b"\x02\x01\x01\x01", b"\x03\x02\x02\x02", b"\x04\x01\x01\x01"]
    part = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")
    assert codecs.decode_png(png).tolist() == [[1, 2, 3], [5, 6, 7], [6, 7, 8], [5, 8, 10], [6, 9, 11]]
    with pytest.raises(ValueError):
        codecs.decode_png(b"no")


def test_mixed_folder(spark, tmp_path):
    gray = RNG.integers(0, 256, (4, 6), np.uint8)
    (tmp_path / "s10.png").write_bytes(codecs.encode_png(gray))
    (tmp_path / "s2.dcm").write_bytes(dicom(np.arange(24).reshape(4, 6) * 100, 3))
    (tmp_path / "plain").write_bytes(dicom(np.arange(24).reshape(4, 6), 4, explicit=False))
    (tmp_path / "s3.png").write_bytes(b"broken")
    (tmp_path / "notes.txt").write_text("not an image")
    good, bad = readers.slices(spark, str(tmp_path))
    rows = good.orderBy("z").collect()
    assert [r["path"].rpartition("/")[2] for r in rows] == ["plain", "s2.dcm", "s10.png"] and [r["key"] for r in rows] == ["0001", "0002", "0003"]
    assert bytes(rows[2]["data"]) == gray.tobytes() and bytes(rows[1]["data"])[-1] in (254, 255)
    assert bad.count() == 1 and bad.first()["path"].endswith("s3.png")
    voxels = readers.voxels(good.where("z = 2"))
    assert voxels.count() == 24 and voxels.agg(F.sum("gray")).first()[0] == int(gray.sum())


def test_pictures_and_arrays_in_one_volume(spark, tmp_path):
    gray = RNG.integers(0, 256, (4, 6), np.uint8)
    (tmp_path / "s1.png").write_bytes(codecs.encode_png(gray))
    (tmp_path / "s2.tiff").write_bytes(codecs.encode_tiff(gray))
    (tmp_path / "s3.JPG").write_bytes(b"broken")
    bmp = b"BM" + struct.pack("<IHHI", 54 + 4 * 20, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 4, 1, 24, 0, 80, 0, 0, 0, 0) + b"".join(bytes(np.repeat(r, 3)) + b"\0\0" for r in gray[::-1])
    (tmp_path / "s10.bmp").write_bytes(bmp)
    good, bad = readers.slices(spark, str(tmp_path))
    rows = good.orderBy("z").collect()
    assert [r["path"].rpartition("/")[2] for r in rows] == ["s1.png", "s2.tiff", "s10.bmp"] and all(bytes(r["data"]) == gray.tobytes() for r in rows)
    assert [r["path"].rpartition("/")[2] for r in bad.collect()] == ["s3.JPG"]


def test_series_by_place_and_spacing(spark, tmp_path):
    for name, z in (("a", 9.0), ("b", 1.0), ("c", 4.0), ("d", 6.5)):
        (tmp_path / f"{name}.dcm").write_bytes(dicom(np.arange(24).reshape(4, 6), z))
    good, _ = readers.slices(spark, str(tmp_path))
    ordered, spacing = readers.series(good)
    assert [r["path"].rpartition("/")[2] for r in ordered.orderBy("z").collect()] == ["b.dcm", "c.dcm", "d.dcm", "a.dcm"]
    assert spacing.first()["spacing"] == 2.5 and [r["z"] for r in ordered.orderBy("z").collect()] == [0, 1, 2, 3]


def test_predictors_see_frames(spark):
    frames = spark.createDataFrame([(z, 2, 3, bytes([z, 0, 0, 0, z, 0])) for z in range(5)], "z int, height int, width int, data binary")
    prompts = spark.createDataFrame([(1, 0, 0, 2, 2, 1, 3, 2)], "obj_id long, x0 int, y0 int, x1 int, y1 int, z_start int, z_end int, z_box int")
    masks = tracking.track(prompts, lambda image, box, z: np.nonzero(image == z), frames)
    assert {tuple(r) for r in masks.select("z", "y", "x").collect()} == {(z, y, x) for z in (1, 2, 3) for y, x in ((0, 0), (1, 1))}


def test_nrrd_and_nifti():
    v = RNG.integers(0, 200, (3, 4, 5)).astype(np.uint8)  # z, y, x
    head = b"NRRD0004\ntype: uchar\ndimension: 3\nsizes: 5 4 3\nencoding: gzip\nendian: little\nspace directions: (-0.5,0,0) (0,0.25,0) (0,0,2)\n\n"
    values, spacing = codecs.decode_nrrd(head + gzip.compress(v.transpose(2, 1, 0).tobytes(order="F")))
    assert np.array_equal(values, v[:, :, ::-1]) and spacing == (0.5, 0.25, 2.0)
    affine = writers.nifti_affine(0.5, 0.5, 2.0, 1, 2, 3, height=4, depth=3)
    back, spacing, a = codecs.decode_nifti(codecs.encode_nifti(v.transpose(2, 1, 0), affine))
    assert np.array_equal(back, v.transpose(2, 1, 0)) and spacing == (0.5, 0.5, 2.0) and np.allclose(a, affine)
    down = writers.nifti_affine(0.5, 0.5, 2.0, 1, 2, 3, 4, 3, descending=True)
    assert down[2, 2] == -2 and down[2, 3] == 3 + 2 * 2 and down[1, 3] == 2 + 3 * 0.5


def test_archives_and_detached_headers(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for i in (2, 10, 1):
            z.writestr(f"series/s{i}.dcm", dicom(np.arange(24).reshape(4, 6) * i, i))
        z.writestr("series/s5.dcm", b"\0" * 128 + b"DICM broken")
        z.writestr("readme.txt", "no picture")
    (tmp_path / "scan.zip").write_bytes(data.getvalue())
    (tmp_path / "torn.zip").write_bytes(data.getvalue()[:200])
    values = RNG.integers(0, 2000, (3, 4, 5)).astype("<i2")
    (tmp_path / "body.raw").write_bytes(values.tobytes())
    for name, body in (("volume", "body.raw"), ("lost", "nothing.raw")):
        (tmp_path / f"{name}.nhdr").write_text(f"NRRD0004\ntype: short\ndimension: 3\nsizes: 5 4 3\nencoding: raw\ndata file: {body}\nendian: little\n")
    slices, rejects = readers.slices(spark, str(tmp_path))
    rows = slices.orderBy("z").collect()
    assert [r["path"].rpartition("/")[2] for r in rows] == ["s1.dcm", "s2.dcm", "s10.dcm", *["volume.nhdr"] * 3] and "scan.zip!/series/s1.dcm" in rows[0]["path"]
    for r, want in zip(rows[3:], values, strict=True):
        assert bytes(r["data"]) == codecs.stretch(want).tobytes()
    assert {r["path"].rpartition("/")[2] for r in rejects.collect()} == {"s5.dcm", "torn.zip", "lost.nhdr"}


def test_volume_header(spark, tmp_path):
    text = writers.volinfo_csv(10, 20, 30, 0.5, 0.25, 2.0)
    (tmp_path / "v.csv").write_text(text)
    row = readers.read_volinfo(spark, str(tmp_path / "v.csv")).first()
    assert (row["width"], row["depth"], row["mm_per_px"], row["sz"]) == (10, 30, 0.375, 2.0)
    assert readers.parse_volinfo(text, "x")[-1] == 0.5
    for broken in ("a\nb", text.replace("X Spacing", "A"), text.replace("0.5,", "0,")):
        with pytest.raises(ValueError):
            readers.parse_volinfo(broken)


def test_masks_and_svg(spark, tmp_path):
    m = RNG.integers(0, 21, (5, 5), np.uint8)
    (tmp_path / "mask0007.png").write_bytes(codecs.encode_png(m))
    (tmp_path / "mask0002.svg").write_text(
        '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 10 10"><rect x="1" y="1" width="3" height="2" fill="#ff0000"/><path style="fill: rgb(0,0,255)" d="M 0 0 L 4 0 L 4 4 Z"/><polygon points="0,0 1,1 2,0" fill="#123456"/></svg>'
    )
    (tmp_path / "mask0009.png").write_bytes(codecs.encode_png(RNG.integers(0, 256, (4, 4, 3), np.uint8)))
    masks, rejects = readers.label_masks(spark, str(tmp_path))
    assert masks.count() == 1 and rejects.first()["path"].endswith("mask0009.png")
    row = masks.first()
    assert row["key"] == "0007" and bytes(row["data"]) == m.tobytes()
    shapes = readers.svg_paths(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["label"], r["kind"], r["z"], r["width"]) for r in shapes] == [(1, "polygon", 1, 10.0), (2, "path", 1, 10.0)]
    # A view of 10 by 10 on an image of 20 rows and 40 columns.
    paths = readers.mask_paths(readers.svg_paths(spark, str(tmp_path)), spark.createDataFrame([(1, 20, 40), (2, 5, 5)], "z int, height int, width int"))
    assert {r["label"]: (r["pts"][1]["x"], r["pts"][2]["y"]) for r in paths.collect()} == {1: (16.0, 6.0), 2: (16.0, 8.0)}
    laid = {(r["y"], r["x"]) for r in geometry.rasterise(paths, 20, 40).where("label = 1").collect()}
    assert laid == {(y, x) for y in range(2, 6) for x in range(4, 16)}


def test_pictures_and_meshes(spark, tmp_path):
    v = fx.phantom(spark, SF)
    shown = stack.gray_levels(v, palette(spark))
    files = {r["name"]: bytes(r["content"]) for r in writers.pictures(shown, fx.HEIGHT, fx.WIDTH, ["level"], descending=True).collect()}
    assert len(files) == fx.DEPTH
    first = codecs.decode_png(files["mask0012.png"])
    assert first.sum() == shown.where("z = 0").agg(F.sum("level")).first()[0]
    tiff = writers.pictures(shown.where("z = 3"), fx.HEIGHT, fx.WIDTH, ["level"], "mask{:04}.tiff", kind="tiff")
    assert writers.save(tiff, f"file://{tmp_path}/tiff") == 1
    assert readers.image_slices(spark, f"{tmp_path}/tiff").first()["height"] == fx.HEIGHT
    t = mesh.triangles(v.where("label = 10"), SZ, 0.5, 0.5)
    data = bytes(writers.stl(t).first()["content"])
    assert len(codecs.decode_stl(data)) == t.count() and len(data) == 84 + 50 * t.count()
    nii = writers.nifti(v, "labels", fx.HEIGHT, fx.WIDTH, fx.DEPTH, np.eye(4)).first()
    (tmp_path / nii["name"]).write_bytes(bytes(nii["content"]))
    members = readers.nifti_members(spark, f"{tmp_path}/labels.nii.gz")
    assert members.count() == v.where("label > 0").count()
    assert writers.split_colors(v, fx.HEIGHT, fx.WIDTH).count() == v.where("label > 0").select("z", "label").distinct().count()


def test_measurement_report(spark):
    v = fx.phantom(spark, SF)
    text = writers.measurement_csv(report.label_volumes(v, AREA, SZ), report.slice_areas_wide(v, AREA), report.threshold_fraction(v, 10, 5, AREA, SZ), report.threshold_fraction_slices(v, 10, 5, AREA), None, 10, 5, 0, 255)
    lines = text.splitlines()
    assert lines[0] == "Object Volumes" and lines[2].startswith("Obj 1,") and "Per-slice Threshold Fraction" in lines and sum(x.startswith("Obj ") for x in lines) == 20


def test_edit_stream(spark, tmp_path):
    saved = {0: fx.phantom(spark, SF).cache()}
    log = [(1, None, "convert", 10, 4), (2, 3, "delete", 4, None), (3, 1, "convert", 4, 6)]
    spark.createDataFrame(log, editlog.EDITS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(editlog.EDITS).parquet(f"{tmp_path}/in")
    q = editlog.autosave(stream, lambda: saved[max(saved)], lambda df, n: saved.__setitem__(n + 1, df.cache()), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    got = {(r["z"], r["label"]): r["count"] for r in saved[max(saved)].groupBy("z", "label").count().collect()}
    want = edits.apply(edits.apply(saved[0], [edits.Convert(10, 4)]), [edits.Delete(4, z=3), edits.Convert(4, 6, z=1)])
    assert got == {(r["z"], r["label"]): r["count"] for r in want.groupBy("z", "label").count().collect()}
    counts = editlog.edit_counts(stream).writeStream.outputMode("update").format("memory").queryName("edit_counts").start()
    counts.processAllAvailable()
    counts.stop()
    assert {tuple(r) for r in spark.table("edit_counts").collect()} == {(3, 1, 2), (1, 1, 3)}


def test_label_maps_survive_a_restart(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = [(1, None, "convert", 10, 4), (2, 3, "delete", 4, None), (3, 1, "convert", 4, 6), (4, 3, "convert", 0, 7), (5, None, "convert", 6, 10), (6, 1, "delete", 10, None), (7, 3, "convert", 7, 2)]
    v = fx.phantom(spark, SF)

    def run(rows):
        spark.createDataFrame(rows, editlog.EDITS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        maps = editlog.label_maps(spark.readStream.schema(editlog.EDITS).parquet(f"{tmp_path}/in"), fx.DEPTH)
        q = maps.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None

    try:
        run(log[:4])
        run([log[3], *log[4:]])  # from the checkpoint, with an edit that comes again
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    counted = lambda df: {(r["z"], r["label"]): r["count"] for r in df.groupBy("z", "label").count().collect()}
    got = counted(editlog.apply_maps(v, spark.read.parquet(f"{tmp_path}/out")))
    assert got == counted(editlog.apply_batch(v, spark.createDataFrame(log, editlog.EDITS))) != counted(v)
