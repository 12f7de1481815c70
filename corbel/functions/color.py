"""Colours and lengths written as text, and their distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How colours with three channels are written.
_RGB = r"(?i)^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*[\d.]+\s*)?\)$"
_HSL = r"(?i)^hsla?\(\s*([\d.]+)\s*,\s*([\d.]+)%\s*,\s*([\d.]+)%\s*(?:,\s*[\d.]+\s*)?\)$"


def _hex(c: Column, at: int, n: int) -> Column:
    digits = F.substring(c, at, n)
    return F.conv(digits if n == 2 else F.concat(digits, digits), 16, 10).cast("int")


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def _hsl(c: Column) -> Column:
    h, s, l = (F.regexp_extract(c, _HSL, i).try_cast("double") for i in (1, 2, 3))  # noqa: E741
    chroma = (1 - F.abs(2 * l / 100 - 1)) * s / 100
    x = chroma * (1 - F.abs((h / 60) % 2 - 1))
    m = l / 100 - chroma / 2
    zero = F.lit(0.0)
    part = F.least(F.floor(h / 60), F.lit(5))
    pick = lambda order: F.when(part == 0, order[0]).when(part == 1, order[1]).when(part == 2, order[2]).when(part == 3, order[3]).when(part == 4, order[4]).otherwise(order[5])
    scaled = lambda v: F.floor((v + m) * 255 + 0.5).cast("int")
    return _rgb(scaled(pick([chroma, x, zero, zero, x, chroma])), scaled(pick([x, chroma, chroma, x, zero, zero])), scaled(pick([zero, zero, x, chroma, chroma, x])))


def parse_color(text: Column) -> Column:
    """struct<r, g, b> of #rgb, #rrggbb, #rrggbbaa, rgb() or hsl() with commas; else null."""
    c = F.trim(text)
    number = lambda i: F.regexp_extract(c, _RGB, i).try_cast("int")
    return (
        F.when(c.rlike("^#[0-9a-fA-F]{3}$"), _rgb(_hex(c, 2, 1), _hex(c, 3, 1), _hex(c, 4, 1)))
        .when(c.rlike("^#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"), _rgb(_hex(c, 2, 2), _hex(c, 4, 2), _hex(c, 6, 2)))
        .when(c.rlike(_RGB), _rgb(number(1), number(2), number(3)))
        .when(c.rlike(_HSL), _hsl(c))
    )


def color_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in RGB."""
    square = lambda k: F.pow((a[k] - b[k]).cast("double"), F.lit(2.0))
    return F.sqrt(square("r") + square("g") + square("b"))


def parse_px(text: Column) -> Column:
    """Length in px of `12px`, `1.5rem` (16 px each) or a bare number; else null."""
    c = F.trim(text)
    pattern = r"(?i)^(-?\d*\.?\d+)(px|rem|)$"
    number = F.regexp_extract(c, pattern, 1).try_cast("double")
    return F.when(c.rlike(pattern), F.when(F.lower(F.regexp_extract(c, pattern, 2)) == "rem", number * 16).otherwise(number))
