"""Canny edges and turned slices against pixel-by-pixel loops."""

import math

import numpy as np
import pytest

from voxtable.operators import edges, resample

VOXELS = "z int, y int, x int, gray int, label int"


def voxels(spark, images, label=None):
    rows = [(z, y, x, int(g), int(0 if label is None else label[z][y, x])) for z, image in enumerate(images) for (y, x), g in np.ndenumerate(image)]
    return spark.createDataFrame(rows, VOXELS)


def loop_canny(image, low, high):
    g = np.pad(image.astype(int), 1, mode="edge")
    h, w = image.shape
    win = lambda dy, dx: g[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = sum(k * (win(dy, 1) - win(dy, -1)) for dy, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (win(1, dx) - win(-1, dx)) for dx, k in ((-1, 1), (0, 2), (1, 1)))
    m = np.pad(abs(gx) + abs(gy), 1)
    state = {}
    for y in range(h):
        for x in range(w):
            here, n = m[y + 1, x + 1], lambda dy, dx, y=y, x=x: m[y + 1 + dy, x + 1 + dx]
            if here <= low:
                continue
            ax, ay = abs(int(gx[y, x])), abs(int(gy[y, x])) << 15
            if ay < ax * 13573:
                peak = here > n(0, -1) and here >= n(0, 1)
            elif ay > ax * 13573 + (ax << 16):
                peak = here > n(-1, 0) and here >= n(1, 0)
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                peak = here > n(-1, -s) and here > n(1, s)
            if peak:
                state[y, x] = here > high
    todo, out = [p for p, strong in state.items() if strong], set()
    while todo:
        p = todo.pop()
        if p not in out:
            out.add(p)
            todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (p[0] + a, p[1] + b) in state]
    return out


def test_canny_against_a_loop(spark):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:23, 0:31]
    disc = ((y - 11) ** 2 + (x - 14) ** 2 < 60) * 140 + 20
    images = [rng.integers(0, 256, (9, 14)), disc + rng.integers(0, 12, disc.shape), np.full((5, 5), 7), (x * 9 % 200)[:8], np.array([[0, 255]]), np.array([[0], [255]])]
    got = {(r["z"], r["y"], r["x"]) for r in edges.canny(voxels(spark, images)).collect()}
    assert got == {(z, *p) for z, image in enumerate(images) for p in loop_canny(image, 50, 150)} and {z for z, *_ in got} >= {0, 1}
    assert edges.canny(voxels(spark, images).limit(0)).count() == 0


def loop_turned(image, angle, dx, dy, canvas):
    c, s = round(math.cos(math.radians(angle)) * 65536), round(math.sin(math.radians(angle)) * 65536)
    (h, w), out = image.shape, np.full(canvas, 255)
    k = lambda f: [-f + 2 * f * f - f**3, 1 - 2 * f * f + f**3, f + f * f - f**3, -f * f + f**3]
    for y in range(canvas[0]):
        for x in range(canvas[1]):
            v, u = 2 * (y - dy) + 1 - canvas[0], 2 * (x - dx) + 1 - canvas[1]
            sx, sy = (c * u + s * v) / 131072 + w / 2, (c * v - s * u) / 131072 + h / 2
            if 0 <= sx < w and 0 <= sy < h:
                bx, by = math.floor(sx - 0.5), math.floor(sy - 0.5)
                fx, fy = (math.floor((t - 0.5 - b) * 256) / 256 for t, b in ((sx, bx), (sy, by)))
                total = sum(k(fy)[i] * k(fx)[j] * image[min(max(by + i - 1, 0), h - 1), min(max(bx + j - 1, 0), w - 1)] for i in range(4) for j in range(4))
                out[y, x] = min(max(math.floor(total), 0), 255)
    return out


@pytest.mark.parametrize("angle", [0, 33.5, -90, 180, 271])
def test_turning_against_a_loop(spark, angle):
    image = np.random.default_rng(3).integers(0, 256, (7, 12))
    moves = spark.createDataFrame([(1, 1, 0, 2, -1, float(angle)), (2, 4, 4, 0, 0, 10.0)], "seq int, z_start int, z_end int, dx int, dy int, angle_deg double")
    got = resample.rotate(voxels(spark, [image, image, image]), moves, 7, 12).collect()
    canvas = max(r["y"] for r in got) + 1, max(r["x"] for r in got) + 1
    a = math.radians(angle)
    assert canvas[0] >= math.floor(abs(math.cos(a)) * 7 + abs(math.sin(a)) * 12) and canvas[0] % 2 == 1 and canvas[1] % 2 == 0
    out = np.zeros((3, *canvas), int)
    for r in got:
        out[r["z"], r["y"], r["x"]] = r["gray"]
    assert (out[0] == loop_turned(image, angle, 2, -1, canvas)).all() and (out[1] == out[0]).all() and (out[2] == loop_turned(image, 0, 0, 0, canvas)).all()


def test_weights_add_up_and_meet_the_pixels():
    w = resample.cubic(np.arange(256))
    assert (w.sum(axis=0) == 1 << 24).all() and w[:, 0].tolist() == [0, 1 << 24, 0, 0]


def test_canceled_turns_leave_the_version_before(spark):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (6, 6)) for _ in range(3)]
    first = voxels(spark, images, [i % 4 for i in images]).selectExpr("0 as version", "*")
    moves = spark.createDataFrame([(1, 1, 2, 1, 0, 45.0)], "seq int, z_start int, z_end int, dx int, dy int, angle_deg double")
    once = resample.applied(first, moves, 6, 6, 1)
    twice = resample.applied(once, moves, 6, 6, 2)
    rows = lambda df: sorted(map(tuple, df.select("z", "y", "x", "gray", "label").collect()))
    assert rows(resample.current(twice, 0)) == rows(first) and rows(resample.current(twice, 1)) == rows(resample.current(once, 1)) != rows(first)
    assert rows(resample.current(twice, 2).where("z = 0")) == rows(first.where("z = 0")) and resample.current(twice, 2).count() == 108
