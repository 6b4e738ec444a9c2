"""Two levels of undo against whole copies of every slice."""

import random

from voxtable.operators import layers
from voxtable.plans import queries as plans

LOG = "session long, seq long, action string, z int"


def loop(acts, slices):
    """Every stack as the description has it, with a full copy of all slices in each entry."""
    now = dict.fromkeys(slices)
    undo, redo, lines, back = ({z: [] for z in slices} for _ in range(4))
    undo_all, redo_all = [], []
    for seq, action, z in acts:
        if action == "edit":
            undo[z].append(now[z])
            redo[z] = []
            now[z] = seq
        elif action == "edit_all":
            undo_all.append(dict(now))
            redo_all = []
            now = dict.fromkeys(slices, seq)
        elif action == "draw":
            lines[z].append(seq)
            back[z] = []
        elif action == "undo":
            if lines[z]:
                back[z].append(lines[z].pop())
            elif undo[z]:
                redo[z].append(now[z])
                now[z] = undo[z].pop()
            elif undo_all:
                redo_all.append(dict(now))
                now = dict(undo_all.pop())
        elif action == "redo":
            if redo_all:
                undo_all.append(dict(now))
                now = dict(redo_all.pop())
            elif redo[z]:
                undo[z].append(now[z])
                now[z] = redo[z].pop()
        elif action == "redo_line" and back[z]:
            lines[z].append(back[z].pop())
        elif action == "clear":
            lines[z] = []
        elif action == "clear_all":
            lines = {z: [] for z in slices}
    return now, {(z, s) for z, own in lines.items() for s in own}


def test_layers_against_full_copies(spark):
    rng = random.Random(8)
    slices = range(5)
    weights = {"edit": 5, "edit_all": 2, "draw": 4, "undo": 9, "redo": 6, "redo_line": 2, "clear": 1, "clear_all": 1, "unknown": 1}
    log = [(s, i, rng.choices(list(weights), weights.values())[0], rng.choice(slices)) for s in range(12) for i in range(rng.randint(1, 120))]
    shuffled = rng.sample(log, len(log))
    df = spark.createDataFrame(shuffled, LOG)
    spine = spark.range(5).selectExpr("cast(id as int) as z")
    for chunk in (1000, 37):
        found = layers.left(df, chunk=chunk)
        got = {(r["session"], r["z"]): r["seq"] for r in layers.contents(found, spine).collect()}
        drawn = {(r["session"], r["z"], r["seq"]) for r in found.where("kind = 'line'").collect()}
        for s in range(12):
            now, lines = loop([r[1:] for r in sorted(log) if r[0] == s], slices)
            assert {z: got[s, z] for z in slices} == now and {(z, q) for t, z, q in drawn if t == s} == lines
    assert layers.left(df.limit(0)).count() == 0


def test_the_registered_log_uses_every_action(spark):
    found = plans.QUERIES["layered_undo"](spark, "/root/testdata/sf0.001")
    kinds = {r["kind"] for r in found.collect()}
    assert kinds == {"label", "line"}
