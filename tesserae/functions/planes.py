"""Changes of square numeric planes as array expressions: flips, rotation, crop and resize, gain, contrast and blur.

A plane is an array of side * side values, row by row. Each function gives a new plane from a given one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import scalar as S


def _each(side: int, value: Callable[[Column, Column], Column]) -> Column:
    """A plane from a function of x and y."""
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: value((i % side).cast("double"), F.floor(i / side).cast("double")))


def _pixel(plane: Column, side: int, x: Column, y: Column, low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> Column:
    """The value at whole x and y, moved into the given borders."""
    inside = lambda v, low, high: F.least(F.greatest(v, low), high)
    return F.get(plane, (inside(y, low_y, high_y) * side + inside(x, low_x, high_x)).cast("int"))


def _between(plane: Column, side: int, x: Column, y: Column, low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> Column:
    """The value at any x and y from the four around it; borders are repeated."""

    def mix(at: Column) -> Column:
        fx, fy = at["fx"], at["fy"]
        tx, ty = at["x"] - fx, at["y"] - fy
        p = lambda dx, dy: _pixel(plane, side, fx + dx, fy + dy, low_x, high_x, low_y, high_y)
        return (1 - ty) * ((1 - tx) * p(0, 0) + tx * p(1, 0)) + ty * ((1 - tx) * p(0, 1) + tx * p(1, 1))

    return S.let(F.struct(x.alias("x"), y.alias("y"), F.floor(x).cast("double").alias("fx"), F.floor(y).cast("double").alias("fy")), mix)


def flip_sides(plane: Column, side: int) -> Column:
    return _each(side, lambda x, y: F.get(plane, (y * side + (side - 1) - x).cast("int")))


def flip_over(plane: Column, side: int) -> Column:
    return _each(side, lambda x, y: F.get(plane, ((side - 1 - y) * side + x).cast("int")))


def rotate(plane: Column, side: int, degrees: Column, fill: float = 0.0) -> Column:
    """Clockwise around the middle, as y runs down; what comes from outside is `fill`."""
    middle, low, high = (side - 1) / 2, F.lit(0.0), F.lit(side - 1.0)

    def turned(cs: Column) -> Column:
        def value(x: Column, y: Column) -> Column:
            sx = middle + cs["c"] * (x - middle) + cs["s"] * (y - middle)
            sy = middle - cs["s"] * (x - middle) + cs["c"] * (y - middle)
            out = (sx < -0.5) | (sx > side - 0.5) | (sy < -0.5) | (sy > side - 0.5)
            return F.when(out, F.lit(fill)).otherwise(_between(plane, side, sx, sy, low, high, low, high))

        return _each(side, value)

    return S.let(F.struct(F.cos(F.radians(degrees)).alias("c"), F.sin(F.radians(degrees)).alias("s")), turned)


def crop(plane: Column, side: int, width: Column, left: Column, top: Column) -> Column:
    """A square of `width` at left and top, resized to the whole plane."""

    def resized(c: Column) -> Column:
        at = lambda v, first: c[first] + (v + 0.5) * c["w"] / side - 0.5
        return _each(side, lambda x, y: _between(plane, side, at(x, "l"), at(y, "t"), c["l"], c["l"] + c["w"] - 1, c["t"], c["t"] + c["w"] - 1))

    return S.let(F.struct(width.cast("double").alias("w"), left.cast("double").alias("l"), top.cast("double").alias("t")), resized)


def gain(plane: Column, factor: Column) -> Column:
    return F.transform(plane, lambda x: x * factor)


def contrast(plane: Column, factor: Column) -> Column:
    return S.let(S.mean(plane), lambda m: F.transform(plane, lambda x: m + (x - m) * factor))


def blur(plane: Column, side: int, radius: Column) -> Column:
    """A bell of the given radius over three by three values; borders are repeated."""
    low, high = F.lit(0.0), F.lit(side - 1.0)

    def bell(w: Column) -> Column:
        def along(p: Column, dx: int, dy: int) -> Column:
            at = lambda x, y: _pixel(p, side, x, y, low, high, low, high)
            return _each(side, lambda x, y: (w * at(x - dx, y - dy) + at(x, y) + w * at(x + dx, y + dy)) / (1 + 2 * w))

        return S.let(along(plane, 1, 0), lambda rows: along(rows, 0, 1))

    return S.let(F.exp(-1 / (2 * radius * radius)), bell)


def augmented(plane: Column, side: int, chance: Callable[[str], Column], degrees: float = 15.0, crop_min: float = 0.8) -> Column:
    """One mild variant: flips, a rotation, gain and contrast, for some a crop and for some a blur.

    `chance(name)` is a number in [0, 1) for each choice, so a variant depends on its seed alone.
    """
    span = lambda name, low, high: F.lit(low) + chance(name) * (high - low)
    width = F.floor(side * span("crop", crop_min, 1.0)).cast("int")
    place = lambda name: F.floor(chance(name) * (side + 1 - width)).cast("int")
    steps: list[tuple[Column, Callable[[Column], Column]]] = [
        (chance("sides") < 0.5, lambda p: flip_sides(p, side)),
        (chance("over") < 0.3, lambda p: flip_over(p, side)),
        (F.lit(True), lambda p: rotate(p, side, span("turn", -degrees, degrees))),
        (F.lit(True), lambda p: gain(p, span("gain", 0.8, 1.2))),
        (F.lit(True), lambda p: contrast(p, span("contrast", 0.8, 1.2))),
        (chance("cropped") < 0.5, lambda p: crop(p, side, width, place("left"), place("top"))),
        (chance("blurred") < 0.2, lambda p: blur(p, side, span("radius", 0.3, 1.0))),
    ]
    chosen = lambda wanted, step: lambda p: F.when(wanted, step(p)).otherwise(p)
    out = plane
    for wanted, step in steps:
        out = S.let(out, chosen(wanted, step))
    return out
