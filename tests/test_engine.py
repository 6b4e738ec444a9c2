"""Queries against SQL, and small hand-made cases for the traps."""

import collections
import itertools
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable import fixtures as fx
from voxtable.operators import edits, geometry, history, mesh, raster, report, roi, stack, tracking
from voxtable.plans import queries as plans
from voxtable.schema import COLORS, palette, presets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    if name not in plans.SQL:
        assert df.count() > 0
        return
    want = duck.sql(plans.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert collections.Counter(plain(tuple(r)) for r in df.select(want.columns).collect()) == collections.Counter(map(plain, want.fetchall()))


def volume(spark, layers, gray=None):
    """Voxels of nested lists [z][y][x]."""
    rows = [(z, y, x, (gray or layers)[z][y][x], v) for z, s in enumerate(layers) for y, r in enumerate(s) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, "z int, y int, x int, gray int, label int")


def labels(df):
    return {(r["z"], r["y"], r["x"]): r["label"] for r in df.collect()}


def square(path_id, x, y, n, z=0, label=1):
    return (z, path_id, path_id, label, [(float(x), float(y)), (float(x + n), float(y)), (float(x + n), float(y + n)), (float(x), float(y + n))])


PATHS = "z int, path_id long, seq int, label int, pts array<struct<x:double,y:double>>"


def test_add_is_or_and_erase_is_xor(spark):
    v = volume(spark, [[[1] * 6] * 6])
    cover = geometry.rasterise(spark.createDataFrame([square(1, 0, 0, 4), square(2, 2, 2, 4)], PATHS), 6, 6)
    added = labels(edits.add_paths(v, cover, 5))
    erased = labels(edits.erase_paths(v, cover, 1))
    moved = labels(edits.transfer_paths(v, cover, 1, 2))
    assert added[0, 3, 3] == 5 and erased[0, 3, 3] == 1 and moved[0, 3, 3] == 1
    assert added[0, 0, 0] == 5 and erased[0, 0, 0] == 0 and moved[0, 0, 0] == 2
    assert sum(x == 5 for x in added.values()) == 28 and sum(x == 0 for x in erased.values()) == 24


def test_fraction_of_one_label_for_both(spark):
    v = volume(spark, [[[1, 1, 2, 0]]])
    assert report.threshold_fraction(v, 1, 1, 1.0, 1.0).first()["percent"] == 100
    assert report.threshold_fraction_display(v, 1, 1).first()["percent"] == 50
    assert report.threshold_fraction_display(v, 7, 8).first()["percent"] is None
    assert report.threshold_fraction(v, 7, 8, 1.0, 1.0).first()["percent"] == 0


def test_small_parts_are_strictly_smaller_and_touch_by_corners(spark):
    v = volume(spark, [[[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 2, 2]]])
    assert sorted(r["area"] for r in report_sizes(v)) == [1, 2, 2, 2]
    left = labels(raster.remove_small_parts(v, 1, 2))
    assert left[0, 3, 0] == 0 and left[0, 0, 0] == 1 and left[0, 0, 3] == 1 and left[0, 3, 2] == 2


def report_sizes(v):
    return raster.component_sizes(v).collect()


def test_components_against_flood_fill():
    rng = np.random.default_rng(0)
    for density in (0.2, 0.45, 0.7):
        mask = rng.random((40, 60)) < density
        y, x = np.nonzero(mask)
        got = raster._label_components(y, x)
        seen, n = {}, 0
        for p in zip(y.tolist(), x.tolist(), strict=True):
            if p in seen:
                continue
            todo = [p]
            while todo:
                q = todo.pop()
                if q in seen or not (0 <= q[0] < 40 and 0 <= q[1] < 60) or not mask[q]:
                    continue
                seen[q] = n
                todo += [(q[0] + a, q[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            n += 1
        want = [seen[p] for p in zip(y.tolist(), x.tolist(), strict=True)]
        assert len(set(zip(got.tolist(), want, strict=True))) == n == len(set(got.tolist()))


def test_upper_median_and_precedence(spark):
    schema = "idx int, spacing_between double, thickness double, position double"
    one = lambda rows: stack.z_spacing(spark.createDataFrame(rows, schema)).first()["spacing"]
    places = [(i, None, 5.0, p) for i, p in enumerate([0.0, 1.0, 3.0, 6.0, 10.0, 10.0])]
    assert one(places) == 3.0  # of 1, 2, 3, 4
    assert one([*places, (9, 2.5, None, None)]) == 2.5
    assert one([(0, 0.0, 5.0, None), (1, -1.0, 7.0, None)]) == 7.0
    assert one([(0, None, None, 1.0)]) is None


def test_normalise_cuts(spark):
    v = volume(spark, [[[10, 20, 15]], [[7, 7, 7]]])
    got = {(r["z"], r["x"]): r["norm"] for r in stack.normalise(v).collect()}
    assert [got[0, i] for i in range(3)] == [0, 255, 127] and got[1, 0] == 0
    rng = np.random.default_rng(6)
    images = [rng.integers(0, top, (3, 7)) for top in (2, 40, 256)]
    many = {(r["z"], r["y"], r["x"]): r["norm"] for r in stack.normalise(volume(spark, [i.tolist() for i in images])).collect()}
    for z, image in enumerate(images):  # in single precision, as images are read
        low, high = np.float32(image.min()), np.float32(image.max())
        want = ((image.astype(np.float32) - low) / (high - low + np.float32(1e-8)) * np.float32(255)).astype(np.uint8)
        assert [[many[z, y, x] for x in range(7)] for y in range(3)] == want.tolist()


def test_edit_rules(spark):
    v = volume(spark, [[[1, 2, 3]]], [[[50, 60, 70]]])
    assert labels(edits.apply(v, [edits.Convert(1, 2), edits.Convert(2, 3)])) == {(0, 0, 0): 3, (0, 0, 1): 3, (0, 0, 2): 3}
    assert labels(edits.apply(v, [edits.Convert(1, 1)])) == labels(v)
    assert labels(edits.apply(v, [edits.ExtractInside(2, 9, 65, 55)]))[0, 0, 1] == 9
    assert v.where(edits.in_threshold(65, 55)).count() == 0
    for bad in (edits.Convert(0, 1), edits.Delete(21)):
        with pytest.raises(ValueError):
            edits.apply(v, [bad])


def test_many_edits_stay_one_projection(spark):
    chain = [e for i in range(30) for e in (edits.Convert(i % 20 + 1, (i + 1) % 20 + 1), edits.ExtractInside(i % 20 + 1, 3, i, 2 * i))]
    plan = edits.apply(fx.phantom(spark, SF), chain)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Join") <= 3


def test_properties(spark):
    v = fx.phantom(spark, SF)
    n = {r["label"]: r["count"] for r in v.groupBy("label").count().collect()}
    assert sum(n.values()) == fx.DEPTH * fx.HEIGHT * fx.WIDTH
    back = stack.reverse(stack.reverse(v, fx.DEPTH, fx.HEIGHT), fx.DEPTH, fx.HEIGHT)
    assert labels(back) == labels(v)
    turned = v
    for _ in range(4):
        turned = raster.rot90(turned, fx.HEIGHT, fx.WIDTH)
    assert labels(turned) == labels(v)
    grown = raster.dilate(v, 1, fx.HEIGHT, fx.WIDTH)
    assert v.where("label > 0").join(grown, ["label", "z", "y", "x"], "left_anti").count() == 0


def test_fixtures_have_the_known_sizes(spark):
    assert fx.phantom(spark, SF).where("label > 0").count() == 1636
    assert fx.scatter(spark, SF).count() == 5719


def test_natural_order(spark):
    names = spark.createDataFrame([("image10.jpg",), ("Image2.jpg",), ("image1.jpg",), ("a.jpg",), ("image99999999999999999999.jpg",)], "name string")
    assert [r["name"] for r in stack.ordered(names).orderBy("z").collect()] == ["a.jpg", "image1.jpg", "Image2.jpg", "image10.jpg", "image99999999999999999999.jpg"]
    assert stack.mask_keys(spark.createDataFrame([("m_007_x12.png",), ("plain.png",)], "name string")).orderBy("name").select("key").collect() == [("0012",), ("0002",)]


def test_history_policy(spark):
    log = spark.createDataFrame([(i, a) for i, a in enumerate(["edit", "edit", "undo", "redo", "undo", "edit", "redo", "undo", "undo", "undo", "redo"])], "seq long, action string")
    assert [r["seq"] for r in history.active(log).orderBy("seq").collect()] == [0]
    paths = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "z int, seq int")
    assert {tuple(r) for r in history.without_latest(paths).collect()} == {(0, 1)}


def test_history_against_lists(spark):
    rng = random.Random(2)
    log = [(i, rng.choice(["edit", "edit", "undo", "redo"])) for i in range(300)]
    done, undone = [], []
    for i, a in log:
        if a == "edit":
            done.append(i)
            undone.clear()
        elif a == "undo" and done:
            undone.append(done.pop())
        elif a == "redo" and undone:
            done.append(undone.pop())
    got = history.active(spark.createDataFrame(log, "seq long, action string"))
    assert [r["seq"] for r in got.orderBy("seq").collect()] == done


def test_tracking_winners(spark):
    prompts = spark.createDataFrame([(1, 0, 0, 2, 2, 0, 4, 2)], "obj_id long, x0 int, y0 int, x1 int, y1 int, z_start int, z_end int, z_box int")

    def predict(image, box, z):
        return (np.array([z]), np.array([0])) if z != 3 else (np.zeros(0, int), np.zeros(0, int))

    masks = tracking.track(prompts, predict)
    assert {r["direction"] for r in masks.collect()} == {"forward", "backward"}
    assert sorted(r["z"] for r in tracking.merge_directions(masks).collect()) == [0, 1, 2, 4]
    assert tracking.track(prompts.limit(0)).count() == 0


def test_roi_rules(spark):
    assert [tuple(r) for r in roi.requested(spark, "b, a\nb\n\n c ").orderBy("place").select("roi").collect()] == [("b",), ("a",), ("c",)]
    files = spark.createDataFrame([("/x/liver_left.nii.gz",), ("/x/liver.nii.gz",), ("/x/Big_Spleen.nii",)], "file string")
    wanted = spark.createDataFrame([("liver",), ("spleen",), ("heart",)], "roi string")
    assert {tuple(r) for r in roi.match_files(wanted, files).collect()} == {("liver", "/x/liver.nii.gz"), ("spleen", "/x/Big_Spleen.nii")}
    assert (roi.resolve_task("Auto", "MR"), roi.resolve_task("\U0001f512 body", "ct")) == ("total_mr", "body")
    assert roi.object_ids(3, 18) == [19, 20, 1]


def test_geometry_parsing(spark):
    row = spark.createDataFrame([("M 0,0 L 4 0 L4,4 Z M1 1L2,1 L 2 2 Z", "1,2 3 4 5")], "d string, p string").select(geometry.parse_subpaths(F.col("d")).alias("d"), geometry.parse_points(F.col("p")).alias("p")).first()
    assert [[tuple(q) for q in s] for s in row["d"]] == [[(0, 0), (4, 0), (4, 4)], [(1, 1), (2, 1), (2, 2)]]
    assert [tuple(q) for q in row["p"]] == [(1, 2), (3, 4)]
    empty = spark.createDataFrame([("",)], "p string").select(geometry.parse_points(F.col("p")).alias("p")).first()
    assert empty["p"] == []


def test_curve_meets_its_points(spark):
    pts = [(0.0, 0.0), (4.0, 2.0), (8.0, 0.0)]
    df = spark.createDataFrame([(pts,)], "pts array<struct<x:double,y:double>>")
    curve = [tuple(q) for q in df.select(geometry.smooth_curve(F.col("pts"), 4).alias("c")).first()["c"]]
    assert len(curve) == 9 and curve[0] == pts[0] and curve[4] == pts[1] and curve[8] == pts[2]
    assert df.select(geometry.to_svg(F.col("pts")).alias("s")).first()["s"] == "M 0.0 0.0 L 4.0 2.0 L 8.0 0.0 Z"


def test_simplified_lines_stay_near(spark):
    rng = random.Random(11)
    lines = [[(float(i), rng.randint(0, 9) * 1.0) for i in range(n)] for n in (0, 1, 2, 3, 40)] + [[(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(lines)], "id int, pts array<struct<x:double,y:double>>")
    got = {r["id"]: r["s"] and [tuple(q) for q in r["s"]] for r in df.select("id", geometry.simplify(F.col("pts"), 3).alias("s")).collect()}
    assert got[7] is None and got[5] == lines[5] and got[6] == [lines[6][0], lines[6][2]] and all(got[i] == (lines[i] or got[i]) for i in (1, 2))
    kept, where = got[4], [lines[4].index(p) for p in got[4]]
    assert 2 < len(kept) < 40 and where == sorted(where) and where[0] == 0 and where[-1] == 39
    for (i, j), (p, q) in zip(itertools.pairwise(where), itertools.pairwise(kept), strict=True):
        far = [abs((q[0] - p[0]) * (m[1] - p[1]) - (q[1] - p[1]) * (m[0] - p[0])) / math.hypot(q[0] - p[0], q[1] - p[1]) for m in lines[4][i:j]]
        assert max(far) <= 3 + 1e-9


def test_measure_without_calibration(spark):
    lines = spark.createDataFrame([(1, 0, 0, 3, 4)], "id int, x1 int, y1 int, x2 int, y2 int")
    assert geometry.measure(lines, None).first()["mm"] is None and geometry.measure(lines, 0.5).first()["mm"] == 2.5


def test_mesh_is_closed_and_fills_its_voxels(spark):
    v = fx.phantom(spark, SF).where("label in (3, 10)")
    whole = {r["label"]: r for r in mesh.mesh_size(mesh.triangles(v, 2.0, 0.5, 0.5, slab=64)).collect()}
    slabs = {r["label"]: r for r in mesh.mesh_size(mesh.triangles(v, 2.0, 0.5, 0.5, slab=3)).collect()}
    assert whole and {k: r["triangles"] for k, r in whole.items()} == {k: r["triangles"] for k, r in slabs.items()}
    for k, r in whole.items():
        n = v.where(F.col("label") == k).count() * 0.5
        assert math.isclose(r["mm3"], slabs[k]["mm3"]) and 0.5 * n < r["mm3"] < n
    t = mesh.surface(np.pad(np.ones((3, 3, 3)), 1), (1, 1, 1)).round(6)
    edge = collections.Counter()
    for a, b, c in t.tolist():
        for p, q in ((a, b), (b, c), (c, a)):
            edge[tuple(p), tuple(q)] += 1
    assert all(edge[q, p] == n for (p, q), n in edge.items() if p != q)


def test_slice_interpolation_keeps_slices():
    mask = np.zeros((4, 5, 5))
    mask[1:3, 1:4, 1:4] = 1
    out, factor = mesh.interpolate_slices(mask, 5)
    assert factor == 3 and out.shape[0] == 12 and out[:, 2, 2].sum() >= 5
    assert mesh.interpolate_slices(mask, 0)[0].shape == mask.shape


def test_fixed_tables(spark):
    assert palette(spark).count() == len(COLORS) == 20 and presets(spark).count() == 6


def test_outlines_of_rings_and_corners():
    ring = [(y, x) for y in range(5) for x in range(5) if not (1 <= y <= 3 and 1 <= x <= 3)]
    loops = geometry.outline(*map(np.array, zip(*ring, strict=True)))
    assert sorted(len(p) for p in loops) == [4, 4]
    corners = geometry.outline(np.array([0, 1]), np.array([0, 1]))
    assert sum(len(p) for p in corners) == 8
    assert geometry.outline(np.zeros(0, int), np.zeros(0, int)) == []


def test_queries_read_every_row(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert parts > 72 and plans.QUERIES["polygon_area"](spark, SF).count() == parts
    assert plans.QUERIES["rasterize_polygons"](spark, SF).select("path_id").distinct().count() == parts
    assert max(r["seq"] for r in plans.QUERIES["undo_redo_replay"](spark, SF).collect()) >= 600
    used = plans.QUERIES["used_labels"](spark, SF).count()
    assert plans.QUERIES["smooth_mesh"](spark, SF).select("label").distinct().count() == used > 2


def test_every_region_finds_its_file(spark):
    wanted = spark.createDataFrame([(f"Region{i:02}",) for i in range(30)] + [("",)], "roi string")
    files = spark.createDataFrame([(f"/x/{'left_' * (i % 2)}region{i:02}.nii.gz",) for i in range(30)], "file string")
    assert {tuple(r) for r in roi.match_files(wanted, files).collect()} == {(f"Region{i:02}", f"/x/{'left_' * (i % 2)}region{i:02}.nii.gz") for i in range(30)}


def test_sessions_are_folded_apart_and_long_ones_in_one_pass(spark):
    log = spark.range(200_000).selectExpr("id % 2 as session", "id as seq", "case when id % 10 = 0 then 'undo' else 'edit' end as action")
    got = history.active(log, "session").groupBy("session").count().collect()
    assert {r["session"]: r["count"] for r in got} == {0: 100_000 - 2 * 20_000 + 1, 1: 100_000}


def test_spacing_does_not_depend_on_ranges(spark):
    rng = random.Random(3)
    rows = [(i, None, None, rng.choice([0.0, 1.0, 2.5]) + rng.randint(0, 400) * 3.0) for i in range(900)]
    df = spark.createDataFrame(rows, "idx int, spacing_between double, thickness double, position double")
    steps = sorted(b - a for a, b in itertools.pairwise(sorted(r[3] for r in rows)) if b - a > 1e-6)
    assert {stack.z_spacing(df, ranged=n).first()["spacing"] for n in (1, 7, 10_000)} == {steps[len(steps) // 2]}
