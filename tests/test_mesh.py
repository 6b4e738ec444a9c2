"""Indexed surfaces, smoothing and slices between slices, against brute force on small volumes."""

import collections
import itertools
import math

import numpy as np
import pytest

from voxtable import fixtures as fx
from voxtable.operators import cubes, mesh, zspline
from voxtable.sinks import writers
from voxtable.sources import codecs

SF = "/root/testdata/sf0.001"
VOXELS = "z int, y int, x int, label int"


def voxels(spark, mask, label=1):
    return spark.createDataFrame([(*map(int, p), label) for p in np.argwhere(mask)], VOXELS)


def directed(faces):
    n = collections.Counter()
    for a, b, c in faces:
        n.update([(a, b), (b, c), (c, a)])
    return n


def test_cases_cut_every_crossed_edge():
    by = collections.defaultdict(set)
    for code, _, *edges in cubes.cases():
        by[code].update(edges)
    for code in range(256):
        inside = [bool(code >> i & 1) for i in range(8)]
        cut = {i for i, (axis, c) in enumerate(cubes.EDGES) if inside[cubes.CORNERS.index(c)] != inside[cubes.CORNERS.index(tuple(v + (k == axis) for k, v in enumerate(c)))]}
        assert by[code] == cut


@pytest.mark.parametrize("share", [0.15, 0.5, 0.85])
def test_surfaces_are_closed_and_turned_outwards(spark, share):
    mask = np.random.default_rng(7).random((5, 6, 7)) < share
    m = cubes.faces(voxels(spark, mask))
    faces = [(r["a"], r["b"], r["c"]) for r in m.collect()]
    n = directed(faces)
    assert faces and all(n[q, p] == k for (p, q), k in n.items()) and len({r["face"] for r in m.collect()}) == len(faces)
    size = mesh.mesh_size(cubes.surface(voxels(spark, mask), 1, 1, 1)).first()
    assert 0 < size["mm3"] < mask.sum()
    places = {r["v"]: (r["z"], r["y"], r["x"]) for r in cubes.vertices(m).collect()}
    assert set(places) == set(itertools.chain(*faces))
    padded = np.pad(mask, 1)
    for z, y, x in places.values():  # in the middle between a voxel inside and one outside
        ends = [tuple(f((c / cubes.UNIT)) + 1 for c in (z, y, x)) for f in (math.floor, math.ceil)]
        assert padded[ends[0]] != padded[ends[1]]


def test_counts_of_a_ball_and_a_ring(spark):
    grid = np.stack(np.meshgrid(*[np.arange(-6, 7)] * 3, indexing="ij"))
    ball = (grid**2).sum(axis=0) <= 25
    ring = ((grid[1] ** 2 + grid[2] ** 2) <= 30) & ((grid[1] ** 2 + grid[2] ** 2) >= 6) & (abs(grid[0]) < 2)
    two = voxels(spark, ball, 3).unionByName(voxels(spark, ring, 4))
    got = {r["label"]: r for r in cubes.counts(cubes.faces(two)).collect()}
    assert got[3]["euler"] == 2 and got[4]["euler"] == 0 and all(2 * r["sides"] == 3 * r["faces"] for r in got.values())
    assert {r["label"] for r in cubes.counts(cubes.faces(two, labels=[4])).collect()} == {4} and cubes.faces(two, labels=[9]).count() == 0


def test_smoothing_against_a_loop(spark):
    mask = np.random.default_rng(2).random((4, 4, 4)) < 0.4
    m = cubes.faces(voxels(spark, mask))
    place = {r["v"]: [r["z"], r["y"], r["x"]] for r in cubes.vertices(m).collect()}
    near = collections.defaultdict(set)
    for r in m.collect():
        for p, q in itertools.permutations((r["a"], r["b"], r["c"]), 2):
            near[p].add(q)
    for _ in range(15):
        place = {v: [(50 * c * len(near[v]) + 50 * sum(place[u][i] for u in near[v])) // (100 * len(near[v])) for i, c in enumerate(p)] for v, p in place.items()}
    got = {r["v"]: [r["z"], r["y"], r["x"]] for r in cubes.smooth(m, cubes.vertices(m), level=1).collect()}
    assert got == place
    assert cubes.smooth(m, cubes.vertices(m), level=0).count() == len(place)


def test_recursive_filter_equals_the_dense_system():
    rng = np.random.default_rng(4)
    for n in (2, 3, 5, 40, 300):
        values = (rng.random((n, 6)) < 0.5).astype(float)
        for level in (1, 3, 5):
            m = zspline.slices_after(n, level)
            at = np.arange(m) * (n - 1) / (m - 1)
            assert np.allclose(zspline.sampled(zspline.coefficients(values), 0, at, n), mesh.spline_weights(n, m) @ values, atol=1e-10)


def test_slabs_equal_the_whole_stack(spark):
    rng = np.random.default_rng(5)
    mask = np.repeat(rng.random((55, 3, 4)) < 0.5, 3, axis=0)  # 165 slices: more than a slab with both overlaps
    df = voxels(spark, mask)
    for level in (1, 4):
        want, _ = mesh.interpolate_slices(mask, level)
        got = np.zeros(want.shape, bool)
        for r in zspline.interpolated(df, level, len(mask), slab=16, tile=2).collect():
            assert not got[r["z"], r["y"], r["x"]]
            got[r["z"], r["y"], r["x"]] = True
        assert (got == want).all()
    assert zspline.interpolated(df, 0, len(mask)).count() == mask.sum()
    assert zspline.interpolated(df.limit(0), 2, 10).count() == 0


def test_interpolated_surfaces_as_files(spark):
    v = fx.phantom(spark, SF).where("label in (3, 10)")
    plain = mesh.mesh_size(cubes.surface(v, 2.0, 0.5, 0.5, labels=[10])).first()
    between = cubes.surface(v, 2.0, 0.5, 0.5, labels=[10], level=2, depth=fx.DEPTH)
    size = mesh.mesh_size(between).first()
    assert size["label"] == 10 and 0.4 * plain["mm3"] < size["mm3"] < 1.2 * plain["mm3"] and size["triangles"] > plain["triangles"]
    files = writers.stl(between).collect()
    assert [f["name"] for f in files] == ["object10.stl"] and len(codecs.decode_stl(bytes(files[0]["content"]))) == size["triangles"]
