"""Rectangles as Column expressions: structs of x0, y0, x1, y1 (doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(SIDES, (x0, y0, x1, y1), strict=True)])


def of(prefix: str = "") -> Column:
    """The rectangle of a table's own side columns."""
    return rect(*[F.col(f"{prefix}{s}") for s in SIDES])


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def is_empty(r: Column) -> Column:
    return (r["x1"] <= r["x0"]) | (r["y1"] <= r["y0"])


def area(r: Column) -> Column:
    return F.when(is_empty(r), 0.0).otherwise(width(r) * height(r))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def grown(r: Column, by: float) -> Column:
    return rect(r["x0"] - by, r["y0"] - by, r["x1"] + by, r["y1"] + by)


def clip(r: Column, page: Column, padding: float = 4.0) -> Column:
    return intersection(grown(r, padding), page)


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width over the narrower width; 0 if nothing is shared."""
    shared, base = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(width(a), width(b))
    return F.when((shared > 0) & (base > 0), shared / base).otherwise(0.0)


def vertical_overlap(a: Column, b: Column) -> Column:
    shared, base = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.least(height(a), height(b))
    return F.when((shared > 0) & (base > 0), shared / base).otherwise(0.0)


def horizontal_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x0"] - a["x1"], a["x0"] - b["x1"])


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y0"] - a["y1"], a["y0"] - b["y1"])


def covered(r: Column, by: Column) -> Column:
    """The share of r that another rectangle covers; 1 for an r without area."""
    return F.when(area(r) <= 0, 1.0).otherwise(area(intersection(r, by)) / area(r))


def bbox(r: Column) -> Column:
    """The sides to two places."""
    return rect(*[F.bround(r[s], 2) for s in SIDES])
