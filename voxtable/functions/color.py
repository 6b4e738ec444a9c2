"""Colours: text forms, and the label a colour stands for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COLORS


def parse_color(text: str) -> tuple[int, int, int] | None:
    """``#rrggbb`` or ``rgb(r, g, b)``."""
    t = text.strip().lower()
    if m := re.fullmatch(r"#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})", t):
        return tuple(int(v, 16) for v in m.groups())
    if m := re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", t):
        return tuple(int(v) for v in m.groups())
    return None


def nearest_label(color: tuple[int, int, int] | None) -> int | None:
    """The label that bears exactly this colour."""
    return COLORS.index(color) + 1 if color in COLORS else None


def to_hex(text: Column) -> Column:
    """``#rrggbb`` in lower case of either form, else null."""
    t = F.lower(F.trim(text))
    rgb = r"^rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$"
    part = lambda i: F.lpad(F.lower(F.hex(F.regexp_extract(t, rgb, i).cast("int"))), 2, "0")
    return F.when(t.rlike("^#[0-9a-f]{6}$"), t).when(t.rlike(rgb), F.concat(F.lit("#"), part(1), part(2), part(3)))


def fill_of(style: Column, attribute: Column) -> Column:
    """A shape's fill: its style's before its attribute's."""
    s = F.regexp_extract(style, r"(?:^|;)\s*fill\s*:\s*([^;]+)", 1)
    return F.coalesce(to_hex(F.nullif(s, F.lit(""))), to_hex(attribute))
