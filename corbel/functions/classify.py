"""Category of a design token, from the parts of its name and its value or type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import path_words, segments

# The rules in their order; a pair means two adjacent parts.
NAME_RULES: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("shadow", "shadow elevation", []),
    ("typography*", "font letter leading tracking weight type typography", []),
    ("typography", "", [("line", "height")]),
    ("border", "", [("border", "width"), ("stroke", "width")]),
    ("radius", "radius rounded", []),
    ("motion", "duration easing ease transition motion animate animation", []),
    ("opacity", "opacity alpha", []),
    ("z-index", "zindex layer", [("z", "index")]),
    ("color", "color bg background fill stroke border text", []),
    ("space", "space spacing gap inset padding margin", []),
    ("size", "size width height breakpoint container", []),
]
# How a value shows that it is a colour.
COLOR_VALUE = r"^(#[0-9a-f]{3,8}$|(rgb|rgba|hsl|hsla|oklch|oklab)\(|(black|white|transparent|currentcolor)$)"
# Categories of token types.
TYPE_RULES = {
    "color": "color", "fontFamily": "typography", "fontWeight": "typography", "fontSize": "typography", "lineHeight": "typography",
    "letterSpacing": "typography", "typography": "typography", "shadow": "shadow", "duration": "motion", "cubicBezier": "motion",
    "transition": "motion", "border": "border", "strokeStyle": "border",
}


def category_by_name(name: Column, value: Column) -> Column:
    """First rule whose word, or adjacent pair of words, is among the parts of the name; else by value; else other.

    The typography rule marked * holds only without a color part.
    """
    parts = segments(F.regexp_replace(name, "^--", ""))
    flat = F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" "))
    out = None
    for category, names, pairs in NAME_RULES:
        hit = F.lit(False)
        if names:
            hit = hit | F.arrays_overlap(parts, F.array(*map(F.lit, names.split())))
        for a, b in pairs:
            hit = hit | flat.contains(f" {a} {b} ")
        if category.endswith("*"):
            hit = hit & ~F.array_contains(parts, "color")
        out = F.when(hit, category.rstrip("*")) if out is None else out.when(hit, category.rstrip("*"))
    return out.when(F.lower(F.trim(value)).rlike(COLOR_VALUE), "color").otherwise("other")


def category_by_type(kind: Column, path: Column) -> Column:
    """Category of a typed token; dimensions and numbers are told apart by words of the path."""
    parts = path_words(path)
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names.split())))
    out = F.when(kind == "dimension", F.when(has("space spacing gap inset padding margin"), "space").when(has("radius rounded"), "radius").otherwise("size"))
    out = out.when(kind == "number", F.when(has("opacity alpha"), "opacity").when(has("z layer elevation"), "z-index").otherwise("other"))
    for name, category in TYPE_RULES.items():
        out = out.when(kind == name, category)
    return out.otherwise("other")
