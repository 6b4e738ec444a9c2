"""Label edits.  A list of edits compiles to projections in one stage (runs of edits that depend on the label alone to a single table of labels), and
path edits to one coverage join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS, PRESETS


def _check(*labels: int) -> None:
    for x in labels:
        if not 1 <= x <= LABELS:
            raise ValueError(f"label {x} is not one of 1 to {LABELS}")


@dataclass(frozen=True)
class Convert:
    """Every ``src`` becomes ``dst``; nothing if they are equal.  ``z``: one slice only."""

    src: int
    dst: int
    z: int | None = None

    def apply(self, label: Column) -> Column:
        _check(self.src, self.dst)
        return F.when((label == self.src) & _on(self.z), self.dst).otherwise(label)


@dataclass(frozen=True)
class Delete:
    label: int
    z: int | None = None

    def apply(self, label: Column) -> Column:
        _check(self.label)
        return F.when((label == self.label) & _on(self.z), 0).otherwise(label)


@dataclass(frozen=True)
class ExtractInside:
    """Where ``src`` and lo <= gray <= hi (given in either order), ``dst``."""

    src: int
    dst: int
    lo: int
    hi: int
    z: int | None = None

    def apply(self, label: Column) -> Column:
        _check(self.src, self.dst)
        lo, hi = sorted((self.lo, self.hi))
        return F.when((label == self.src) & F.col("gray").between(lo, hi) & _on(self.z), self.dst).otherwise(label)


def _on(z: int | None) -> Column:
    return F.lit(True) if z is None else F.col("z") == z


def _composed(edits: list) -> list[int] | None:
    """What each label 0 to 20 becomes, if the edits depend on the label alone."""
    if any(not isinstance(e, (Convert, Delete)) or e.z is not None for e in edits):
        return None
    to = list(range(LABELS + 1))
    for e in edits:
        src, dst = (e.src, e.dst) if isinstance(e, Convert) else (e.label, 0)
        _check(*(x for x in (src, dst) if isinstance(e, Convert) or x == src))
        to = [dst if x == src else x for x in to]
    return to


def apply(voxels: DataFrame, edits: list) -> DataFrame:
    """The voxels after the edits, in their order.  Each edit reads the label twice, so edits are steps, not one nested expression, which would double
    with each; runs of plain conversions and deletions are composed beforehand."""
    kind, out, i = dict(voxels.dtypes)["label"], voxels, 0
    while i < len(edits):
        j = i
        while j < len(edits) and _composed(edits[j : j + 1]):
            j += 1
        if j > i:
            to = F.array(*map(F.lit, _composed(edits[i:j])))
            label = F.coalesce(F.get(to, F.col("label")), F.col("label"))
        else:
            label, j = edits[i].apply(F.col("label")), i + 1
        out, i = out.withColumn("label", label.cast(kind)), j
    return out


def changed(before: DataFrame, edits: list) -> DataFrame:
    """(z, changed): how many voxels of each touched slice the edits change."""
    after = apply(before.withColumn("_was", F.col("label")), edits)
    return after.where("label <> _was").groupBy("z").agg(F.count("*").alias("changed"))


def in_threshold(lo: int, hi: int) -> Column:
    """As given: a reversed range holds nothing."""
    return F.col("gray").between(lo, hi)


def in_preset(name: str) -> Column:
    return in_threshold(*PRESETS[name])


def preset_counts(voxels: DataFrame) -> DataFrame:
    """(preset, n): how many voxels each intensity range holds, in one pass."""
    counted = voxels.agg(*[F.count(F.when(in_preset(name), 1)).alias(name) for name in PRESETS])
    rows = F.array(*[F.struct(F.lit(name).alias("preset"), F.col(f"`{name}`").alias("n")) for name in PRESETS])
    return counted.select(F.explode(rows).alias("r")).select("r.preset", "r.n")


def near_color(r: int, g: int, b: int, tolerance: int = 30) -> Column:
    """Each channel within the tolerance, ends clipped to 0 and 255."""
    clip = lambda c, t: F.col(c).between(max(0, t - tolerance), min(255, t + tolerance))
    return clip("r", r) & clip("g", g) & clip("b", b)


def in_box(x0: int, y0: int, x1: int, y1: int) -> Column:
    """Half-open."""
    return (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)


def set_where(voxels: DataFrame, condition: Column, label: int) -> DataFrame:
    _check(label)
    return voxels.withColumn("label", F.when(condition, label).otherwise(F.col("label")).cast(dict(voxels.dtypes)["label"]))


def _covered(voxels: DataFrame, cover: DataFrame) -> DataFrame:
    """voxels with ``_n``, by how many paths each is covered.  cover: (path_id, z, y, x)."""
    n = cover.groupBy("z", "y", "x").agg(F.count("*").alias("_n"))
    return voxels.join(n, ["z", "y", "x"], "left")


def _relabel(joined: DataFrame, condition: Column, dst: int, kind: str) -> DataFrame:
    return joined.withColumn("label", F.when(F.coalesce(condition, F.lit(False)), dst).otherwise(F.col("label")).cast(kind)).drop("_n")


def add_paths(voxels: DataFrame, cover: DataFrame, label: int) -> DataFrame:
    """Pixels in any path get the label, whatever they had."""
    _check(label)
    return _relabel(_covered(voxels, cover), F.col("_n") > 0, label, dict(voxels.dtypes)["label"])


def erase_paths(voxels: DataFrame, cover: DataFrame, label: int) -> DataFrame:
    """Pixels of the label in an odd number of paths become background: overlaps of two paths stay."""
    _check(label)
    return _relabel(_covered(voxels, cover), (F.col("_n") % 2 == 1) & (F.col("label") == label), 0, dict(voxels.dtypes)["label"])


def transfer_paths(voxels: DataFrame, cover: DataFrame, src: int, dst: int) -> DataFrame:
    """Pixels of ``src`` in an odd number of paths become ``dst``."""
    _check(src, dst)
    return _relabel(_covered(voxels, cover), (F.col("_n") % 2 == 1) & (F.col("label") == src), dst, dict(voxels.dtypes)["label"])


def latest(paths: DataFrame, z: int) -> DataFrame:
    """The path drawn last on a slice: what the automatic edits use."""
    top = paths.where(F.col("z") == z).agg(F.max("seq").alias("_top"))
    return paths.where(F.col("z") == z).join(F.broadcast(top), F.col("seq") == F.col("_top"), "left_semi")


def last_writer(memberships: DataFrame, order: str, label: str = "label") -> DataFrame:
    """(z, y, x, label): of several writes to a voxel, the last in ``order``; of equal ones, the one of the greatest label.  The last write of each label
    comes first, a maximum of one value in a hash table of voxels and labels, so that no task sorts all writes."""
    last = memberships.groupBy("z", "y", "x", F.col(label).alias("_l")).agg(F.max(order).alias("_o"))
    return last.groupBy("z", "y", "x").agg(F.max(F.struct("_o", "_l")).alias("_w")).select("z", "y", "x", F.col("_w._l").alias("label"))
