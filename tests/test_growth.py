"""Work that must not grow with repeated rows, and steps that must not hold them."""

import numpy as np
import pytest

from voxtable import fixtures as fx
from voxtable.operators import edits, geometry, layers, raster, tracking
from voxtable.plans import queries as plans

PROMPT = "obj_id long, x0 int, y0 int, x1 int, y1 int, z_start int, z_end int, z_box int"


def test_equal_prompts_are_followed_once_and_groups_stay_small(spark, tmp_path):
    frames = spark.createDataFrame([(z, 4, 4, bytearray([1] * 16)) for z in range(6)], "z int, height int, width int, data binary")
    boxes = [(x, y, x + 2, y + 1, 0, 5, 2) for x in range(3) for y in range(4)]
    prompts = spark.createDataFrame([(i, *boxes[i % 12]) for i in range(300)], PROMPT)

    def follow(image, before, frame):
        with open(tmp_path / "calls", "a") as f:
            f.write("x")
        return before

    found = tracking.propagate(prompts, frames, follow, span=2, lanes=3)
    got = {(r["obj_id"], r["direction"], r["z"], r["y"], r["x"]) for r in found.collect()}
    want = {(i, d, z, y, x) for i in range(300) for d, zs in (("forward", range(2, 6)), ("backward", range(3))) for z in zs for x0, y, x1, *_ in [boxes[i % 12]] for x in range(x0, x1)}
    assert got == want
    assert (tmp_path / "calls").stat().st_size == 12 * 7  # before: 300 * 7
    rng = np.random.default_rng(3)
    for mask in (*(rng.random((5, 7)) < 0.5 for _ in range(20)), np.ones((3, 2), bool), np.zeros((3, 2), bool)):
        assert np.array_equal(tracking._mask(tracking._runs(mask), mask.shape), mask)


def test_intersections_of_every_pair_of_a_slice(spark):
    """Equal paths, paths of two subpaths, and lists shorter than a class."""
    box = lambda x, y, w, h: [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    shapes = [[box(0, 0, 4, 4)], [box(2, 2, 4, 4)], [box(9, 9, 1, 1)], [box(0, 0, 2, 2), box(5, 5, 2, 2)]]
    pixels = [{(x, y) for b in s for x in range(int(b[0][0]), int(b[2][0])) for y in range(int(b[0][1]), int(b[2][1]))} for s in shapes]
    paths = [(i, i % 2, 1, b) for i in range(60) for b in shapes[i // 2 % 4]]
    found = geometry.intersections(spark.createDataFrame(paths, f"path_id long, z int, label int, pts {geometry.POINTS}"), 12, 12, chunk=3)
    want = {(i % 2, i, j, n) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and (n := len(pixels[i // 2 % 4] & pixels[j // 2 % 4]))}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_files_of_intersections_take_bits_a_pair(spark, tmp_path):
    """Four classes of two thousand on one slice, one of which meets none of the others: runs and repeated stretches, whatever the order of the input."""
    box = lambda x, y: [(float(a), float(b)) for a, b in ((x, y), (x + 3, y), (x + 3, y + 3), (x, y + 3))]
    shapes = [box(0, 0), box(1, 0), box(1, 1), box(8, 8)]
    paths = [(i * 1_000_003 - 7, 0, 1, shapes[i * 7 % 4]) for i in np.random.default_rng(4).permutation(8000).tolist()]
    geometry.intersections(spark.createDataFrame(paths, f"path_id long, z int, label int, pts {geometry.POINTS}"), 12, 12).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs").groupBy("pixels").agg({"*": "count"}).collect()
    same, n = 2000 * 1999 // 2, 2000 * 2000
    assert {tuple(r) for r in got} == {(9, 4 * same), (6, 2 * n), (4, n)}
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.3 * (4 * same + 3 * n)  # before: 0.52 a pair


def test_intersections_of_many_lists(spark):
    """Classes of several lists whose ids interleave, negative and far ids, a repeated row, null ids and slices."""
    box = lambda x: [(float(a), float(b)) for a, b in ((x, 0), (x + 4, 0), (x + 4, 2), (x, 2))]
    ids = [i * 3 - 100 for i in range(90)] + [-(2**62), 2**62]
    paths = [(k, 0, 1, box(i % 2 * 3)) for i, k in enumerate(ids)] + [(5000, 1, 1, box(0)), (None, 0, 1, box(0)), (77_777, None, 1, box(0)), (6000, 0, 1, box(0)), (6000, 0, 1, box(0))]
    got = [tuple(r) for r in geometry.intersections(spark.createDataFrame(paths, f"path_id long, z int, label int, pts {geometry.POINTS}"), 12, 12, chunk=1).collect()]
    want = {(0, *sorted((j, k)), 8 if (m - n) % 2 == 0 else 2) for m, j in enumerate(ids) for n, k in enumerate(ids) if j < k}  # the repeated row covers nothing by the even-odd rule
    assert len(got) == len(want) and set(got) == want


def test_intersections_keep_twelve_slices(spark):
    """Slices are the parts' keys modulo twelve, so that what lies on them grows with the table."""
    found = plans.QUERIES["path_intersections"](spark, "/root/testdata/sf0.001")
    assert all(r["a"] % 12 == r["z"] == r["b"] % 12 for r in found.select("z", "a", "b").distinct().collect()) and found.select("z").distinct().count() == 12
    assert "p_partkey % 12" in plans.SQL["path_intersections"] and "// 40" not in plans.SQL["path_intersections"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapping_looks_up_a_place_once(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(int(z), int(y), int(x)) for z, y, x in zip(rng.integers(0, 3, 90), rng.integers(0, 40, 90), rng.integers(0, 40, 90), strict=True)})
    points = [(i, i % 2, int(y), int(x)) for i, (y, x) in enumerate(zip(rng.integers(0, 40, 120), rng.integers(0, 40, 120), strict=True))]
    points += [(1000 + i, z, y, x) for i, z, y, x in points] + [(5000, None, 3, 3), (5001, 9, 3, 3)]
    found = raster.snap(spark.createDataFrame(points, "id long, z int, y int, x int"), spark.createDataFrame(edges, "z int, y int, x int"))
    assert "SortAggregate" not in plan_of(found)
    for i, z, y, x, sy, sx in found.collect():
        near = [((b - y) ** 2 + (c - x) ** 2, b, c) for a, b, c in edges if a == z and -7 <= b - y < 7 and -7 <= c - x < 7]
        assert (sy, sx) == (min(near)[1:] if near else (y, x)), i
    assert found.count() == len(points)


def test_writers_are_not_sorted_and_ties_go_to_the_greatest_label(spark):
    writes = [(0, 0, i % 5, i % 7, i % 20 + 1) for i in range(300)]
    found = edits.last_writer(spark.createDataFrame(writes, "z int, y int, x int, seq long, label int"), "seq")
    want = {x: max((q, n) for *_, c, q, n in writes if c == x)[1] for x in range(5)}
    assert {r["x"]: r["label"] for r in found.collect()} == want
    assert all("HashAggregate" in line for line in plan_of(found).splitlines() if "max(seq" in line)
    assert any("max(seq" in line for line in plan_of(found).splitlines())


def test_phantoms_are_not_sorted(spark):
    plan = plan_of(fx.phantom(spark, "/root/testdata/sf0.001"))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


#: Queries on the phantom alone whose largest task held what every supplier covers.
ON_PHANTOM = [
    "slice_areas_long", "slice_areas_pivot", "threshold_fraction_volume", "threshold_fraction_slice", "threshold_fraction_display", "used_labels",
    "label_bbox", "extract_inside_object", "convert_label", "convert_label_changes", "delete_label", "edit_chain", "visible_labels", "contour_lengths",
]


@pytest.mark.parametrize("name", ON_PHANTOM)
def test_equal_ellipsoids_are_laid_out_once(spark, tmp_path, monkeypatch, name):
    """Thirty copies of the suppliers whose keys are shifted by 240, a multiple of every period of the ellipsoids, so that the volume stays the same."""
    one, inside, laid = "/root/testdata/sf0.001", fx.inside, []
    copies = fx.table(spark, one, "supplier").selectExpr("explode(sequence(0, 29)) as i", "*").selectExpr("s_suppkey + i * 240 as s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    copies.write.parquet(f"{tmp_path}/supplier.parquet")
    assert (copies.count(), fx.table(spark, str(tmp_path), "supplier").count()) == (300, 300)
    monkeypatch.setattr(fx, "inside", lambda prims, *shape: laid.append(prims.count()) or inside(prims, *shape))
    want, got = (plans.QUERIES[name](spark, folder) for folder in (one, str(tmp_path)))
    assert laid == [10, 10]  # before: 10, 300
    assert "SortAggregate" not in plan_of(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_equal_prompts_are_predicted_once_and_without_groups(spark, tmp_path):
    prompts = spark.createDataFrame([(i, i % 3, 1, i % 3 + 2, 3, 0, 3, 1) for i in range(90)], PROMPT)

    def predict(image, box, z):
        with open(tmp_path / "calls", "a") as f:
            f.write("x")
        return tracking.box_predictor(image, box, z) if z else (np.zeros(0, int), np.zeros(0, int))

    masks = tracking.track(prompts, predict)
    got = [tuple(r) for r in masks.collect()]
    assert sorted(got) == sorted((i, d, z, y, x) for i in range(90) for d, zs in (("forward", (1, 2, 3)), ("backward", (1,))) for z in zs for y in (1, 2) for x in (i % 3, i % 3 + 1))
    assert (tmp_path / "calls").stat().st_size == 3 * 5  # before: 90 * 5
    order = prompts.selectExpr("obj_id", "obj_id as seq", "cast(obj_id % 20 + 1 as int) as label")
    volume = spark.range(64).selectExpr("cast(id div 16 as int) as z", "cast(id div 4 % 4 as int) as y", "cast(id % 4 as int) as x", "0 as label")
    one, two = (sorted(tuple(r) for r in tracking.write_labels(volume, tracking.merge_directions(tracking.track(prompts, predict, packed=p)), order).collect()) for p in (False, True))
    assert one == two and any(r[3] for r in one)


def test_sessions_are_no_groups(spark):
    """Streams of many sessions, null ones and odd rows included, with and without chunks."""
    log = [(None if s == 3 else s, i, ["edit", "undo", "redo", "draw", "edit_all", None][(i * 7 + s) % 6], None if i % 11 == 5 else i % 3) for s in range(40) for i in range(s % 9 + 1)]
    df = spark.createDataFrame(log, "session long, seq long, action string, z int").repartition(3)
    one, two = layers.left(df), layers.left(df, chunk=2)
    assert "Groups" not in plan_of(one) and "mapInArrow" in plan_of(one).replace("MapInArrow", "mapInArrow")
    rows = sorted(map(tuple, one.collect()), key=str)
    assert rows == sorted(map(tuple, two.collect()), key=str) and len({r[0] for r in rows}) == 40
    want = []
    for s in {r[0] for r in log}:
        state = layers.Layers()
        for r in sorted((r for r in log if r[0] == s), key=lambda r: r[1]):
            state.act(*r[1:])
        want += [(s, *r) for r in state.rows()]
    assert rows == sorted(want, key=str)
