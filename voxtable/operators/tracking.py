"""Model-driven segmentation: a predictor is a parameter, and this module runs it and merges what it gives.

Objects are independent, and those that are asked for alike get the same masks.  ``box_predictor`` is the stand-in that fills the box.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import settle
from .edits import last_writer
from .raster import _label_components

#: (image or None, box x0 y0 x1 y1, frame) -> the object's (y, x) pixels, as two arrays; None ends the track.
Predictor = Callable[[object, tuple[int, int, int, int], int], tuple[np.ndarray, np.ndarray] | None]
MASKS = "obj_id long, direction string, z int, y int, x int"


def box_predictor(image: object, box: tuple[int, int, int, int], frame: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-open box."""
    y, x = np.mgrid[box[1] : box[3], box[0] : box[2]]
    return y.ravel(), x.ravel()


def track(prompts: DataFrame, predictor: Predictor = box_predictor, frames: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """MASKS of each prompt (obj_id, x0, y0, x1, y1, z_start, z_end, z_box): forward from the box's frame to the end, backward
    from it to the start.  Empty masks give no rows.  ``packed``: a row a frame, with its pixels as arrays y and x (``laid`` lays them out).

    Prompts with the same box and frames are predicted once; they are no groups, but go through the predictor in batches.  ``frames`` (z, height, width,
    data): the predictor gets each frame's pixels; an object's frames, from its start to its end, meet in its task."""
    asked = prompts.select(*_ASKED).distinct()
    kinds = dict(prompts.dtypes)
    out_type = ", ".join(f"{c} {kinds[c]}" for c in _ASKED) + ", direction string, z int, y array<int>, x array<int>"

    def followed(p, images: dict) -> list[tuple]:
        box, out = (p.x0, p.y0, p.x1, p.y1), []
        for direction, order in (("forward", range(p.z_box, p.z_end + 1)), ("backward", range(p.z_box, p.z_start - 1, -1))):
            for z in order:
                found = predictor(images.get(z), box, z)
                if found is None:
                    break
                y, x = found
                if len(y):
                    out.append((*(getattr(p, c) for c in _ASKED), direction, z, y.astype(np.int32), x.astype(np.int32)))
        return out

    columns = [*_ASKED, "direction", "z", "y", "x"]

    def blind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                yield pd.DataFrame([r for p in pdf[i : i + 256].itertuples() for r in followed(p, {})], columns=columns)

    def seeing(pdf: pd.DataFrame) -> pd.DataFrame:
        images = {r.frame: np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width)) for r in pdf.itertuples() if r.data is not None}
        return pd.DataFrame([r for p in pdf.drop_duplicates(_ASKED).itertuples() for r in followed(p, images)], columns=columns)

    if frames is None:
        masks = asked.mapInPandas(blind, out_type)
    else:
        spread = asked.withColumn("frame", F.explode(F.sequence("z_start", "z_end")))
        masks = spread.join(frames.select(F.col("z").alias("frame"), "height", "width", "data"), "frame", "left").groupBy(*_ASKED).applyInPandas(seeing, out_type)
    # The masks' size is misjudged by that of the prompts, so they may not be broadcast.
    out = prompts.select("obj_id", *_ASKED).join(masks.hint("merge"), _ASKED).select("obj_id", "direction", "z", "y", "x")
    return out if packed else laid(out)


def laid(masks: DataFrame) -> DataFrame:
    """A row a pixel, from masks whose pixels are arrays y and x."""
    if not dict(masks.dtypes)["y"].startswith("array"):
        return masks
    return masks.withColumn("_p", F.explode(F.arrays_zip("y", "x"))).withColumns({"y": F.col("_p.y"), "x": F.col("_p.x")}).drop("_p")


#: (image, the mask of the frame before or the filled box, frame) -> the mask of this frame; None or an empty one ends the track.
Follower = Callable[[np.ndarray, np.ndarray, int], np.ndarray | None]
_FOLLOWED = "track long, direction string, z int, z_end int, go boolean, runs array<int>"
_LAID = "flatten(transform(sequence(0, size(runs) - 2, 2), i -> sequence(runs[i], runs[i + 1] - 1)))"
_ASKED = ["x0", "y0", "x1", "y1", "z_start", "z_end", "z_box"]


def _runs(mask: np.ndarray) -> np.ndarray:
    """Where runs of a mask's pixels start and where they stop, in turns, as places in reading order."""
    steps = np.diff(mask.ravel().astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(steps).astype(np.int32)


def _mask(runs: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    steps = np.zeros(shape[0] * shape[1] + 1, np.int8)
    steps[runs[::2]], steps[runs[1::2]] = 1, -1
    return np.cumsum(steps, dtype=np.int8)[:-1].astype(bool).reshape(shape)


def frames_of(voxels: DataFrame, height: int, width: int) -> DataFrame:
    """Frames (z, height, width, data) of the grey levels of voxels; a pixel without a row is 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width), np.uint8)
        image[pdf["y"], pdf["x"]] = pdf["gray"]
        return pd.DataFrame({"z": [np.int32(pdf["z"].iloc[0])], "height": [height], "width": [width], "data": [image.tobytes()]})

    return voxels.select("z", "y", "x", "gray").groupBy("z").applyInPandas(run, "z int, height int, width int, data binary")


def gray_flood(low: int, high: int) -> Follower:
    """Parts of the frame with grey from ``low`` to ``high`` (joined by sides or corners) that the mask before touches.  The parts of the last frame are
    kept, since objects come frame by frame."""
    last: list = [None, None]

    def follow(image: np.ndarray, before: np.ndarray, frame: int) -> np.ndarray:
        if last[0] is not image:
            y, x = np.nonzero((image >= low) & (image <= high))
            number = np.zeros(image.shape, np.int64)
            number[y, x] = _label_components(y, x) + 1
            last[:] = image, number
        number = last[1]
        touched = np.zeros(number.size + 1, bool)
        touched[number[before]] = True
        touched[0] = False
        return touched[number]

    return follow


def propagate(prompts: DataFrame, frames: DataFrame, follower: Follower, span: int = 16, lanes: int | None = None) -> DataFrame:
    """MASKS of prompts (obj_id, x0, y0, x1, y1, z_start, z_end, z_box) whose mask is carried from frame to frame: the box, filled, is what the first
    frame gets, every further frame gets the mask before it, and a track ends where its mask vanishes or a frame is missing.

    Objects with the same box and frames are followed once and get the same masks.  Frames come in ranges of ``span``; a task holds one range and the
    tracks that enter it, dealt to ``lanes`` (by themselves: some 128 tracks each), so a frame is never copied to each object and a group's size doesn't
    depend on their number.  Masks leave a range in one direction and enter the next in the round after, so there are as many rounds as a track crosses
    ranges; each round's masks are written as a table, as runs of pixels, which are laid out for every object at the end."""
    asked = settle(prompts.groupBy(*_ASKED).agg(F.count("*").alias("n")).withColumn("track", F.monotonically_increasing_id()))
    frames = settle(frames.select("z", "height", "width", "data"))
    tracks, objects = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    lanes = lanes or 1 + tracks // 128
    way = F.explode(F.array(F.struct(F.lit("forward").alias("direction"), F.col("z_end").alias("to")), F.struct(F.lit("backward").alias("direction"), F.col("z_start").alias("to")))).alias("w")
    ways = asked.select("track", "x0", "y0", "x1", "y1", F.col("z_box").cast("int").alias("z"), way)
    live = ways.select("track", "w.direction", "z", F.col("w.to").cast("int").alias("z_end"), F.lit(True).alias("go"), F.array(*[F.col(c).cast("int") for c in ("y0", "x0", "y1", "x1")]).alias("runs"), F.lit(True).alias("box"))
    lane = F.pmod(F.xxhash64("track"), F.lit(lanes)).cast("int")
    dealt = frames.select(F.floor(F.col("z") / span).cast("int").alias("_r"), "z", "height", "width", "data", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane"))

    def entered(o, shape: tuple[int, int]) -> np.ndarray:
        at = np.asarray(o.runs)
        if not o.box:
            return _mask(at, shape)
        before = np.zeros(shape, bool)
        before[max(at[0], 0) : max(at[2], 0), max(at[1], 0) : max(at[3], 0)] = True
        return before

    def run(objects: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        images = {r.z: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in have.itertuples()} if len(objects) else {}
        out = []
        for direction, step in (("forward", 1), ("backward", -1)):
            coming = {z: list(g.itertuples()) for z, g in objects[objects["direction"] == direction].groupby("z")}
            active: list = []
            for z in sorted(images, reverse=step < 0):
                image = images[z]
                active = [(o, before) for o, before, at in active if at == z] + [(o, entered(o, image.shape)) for o in coming.get(z, ()) if (o.z_end - z) * step >= 0]
                kept = []
                for o, before in active:
                    mask = follower(image, before, z)
                    if mask is None or not mask.any():
                        continue
                    runs = _runs(mask)
                    out.append((o.track, direction, z, o.z_end, False, runs))
                    if (o.z_end - z - step) * step >= 0:
                        if (z + step) // span == z // span:
                            kept.append((o, mask, z + step))
                        else:
                            out.append((o.track, direction, z + step, o.z_end, True, runs))
                active = kept
        return pd.DataFrame(out, columns=["track", "direction", "z", "z_end", "go", "runs"])

    done = None
    while True:
        entering = live.where("go").withColumn("_r", F.floor(F.col("z") / span).cast("int")).withColumn("_lane", lane)
        step = settle(entering.groupBy("_r", "_lane").cogroup(dealt.groupBy("_r", "_lane")).applyInPandas(run, _FOLLOWED))
        done = step if done is None else done.unionByName(step)
        if step.where("go").isEmpty():
            break
        live = step.withColumn("box", F.lit(False))
    masks = done.where("not go").join(frames.select("z", "width"), "z").select("track", "direction", "z", "width", "runs")
    # A row of ids with a row of runs stands for all their pixels, so these rows are dealt by number.  Sizes are misjudged here: no join may broadcast.
    part = F.pmod(F.xxhash64("obj_id"), F.ceil(F.col("n") / 256)).alias("part")
    ids = prompts.select("obj_id", *_ASKED).join(asked.hint("merge"), _ASKED).select("track", "obj_id", part).groupBy("track", "part").agg(F.collect_list(F.struct("obj_id")).alias("ids"))
    met = ids.join(masks.hint("merge"), "track").repartition(1 + objects // 1000, "track", "part", "direction", "z")
    laid = met.select(F.explode("ids").alias("o"), "direction", "z", "width", "runs").select("o.obj_id", "direction", "z", "width", F.explode(F.expr(_LAID)).alias("at"))
    return laid.select("obj_id", "direction", "z", F.expr("cast(at div width as int)").alias("y"), (F.col("at") % F.col("width")).alias("x"))


def merge_directions(masks: DataFrame, winner: str = "forward") -> DataFrame:
    """(obj_id, z, y, x): where both directions give a frame, the winner's mask alone (forward on the desktop, backward on the web)."""
    first = F.max(F.col("direction") == winner).over(Window.partitionBy("obj_id", "z"))
    return masks.withColumn("_w", first).where((F.col("direction") == winner) | ~F.col("_w")).select("obj_id", "z", "y", "x")


def write_labels(voxels: DataFrame, masks: DataFrame, order: DataFrame) -> DataFrame:
    """The volume with each object's mask in its label; of several the later in ``seq`` wins.  order: (obj_id, seq, label).  Masks may be packed."""
    last = last_writer(laid(masks.join(order.hint("merge"), "obj_id")), "seq").withColumnRenamed("label", "_w")
    kind = dict(voxels.dtypes)["label"]
    return voxels.join(last, ["z", "y", "x"], "left").withColumn("label", F.coalesce("_w", "label").cast(kind)).drop("_w")
