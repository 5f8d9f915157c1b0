"""Geometry expressions: the axis frame, pixel to parameter to data, distances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frame:
    """Origin, x-axis and y-axis points in pixels and the data limits; numbers, or columns where every image has its own."""

    ox: object
    oy: object
    xx: object
    xy: object
    yx: object
    yy: object
    xmin: object = 0.0
    xmax: object = 1.0
    ymin: object = 0.0
    ymax: object = 1.0

    def __post_init__(self) -> None:
        points = (self.ox, self.oy, self.xx, self.xy, self.yx, self.yy)
        if all(isinstance(p, (int, float)) for p in points):
            for dx, dy in ((self.xx - self.ox, self.xy - self.oy), (self.yx - self.ox, self.yy - self.oy)):
                if dx * dx + dy * dy < 1e-6:
                    raise ValueError("axis points coincide")

    #: The columns of a table of frames, in the order of the fields.
    NAMES = ("ox", "oy", "axx", "axy", "ayx", "ayy", "xmin", "xmax", "ymin", "ymax")

    @staticmethod
    def columns() -> Frame:
        return Frame(*map(F.col, Frame.NAMES))


def _c(v: object) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def params(x: Column, y: Column, frame: Frame) -> tuple[Column, Column]:
    """Shares of the x and y axis vectors, unclipped."""
    dx, dy = x - _c(frame.ox), y - _c(frame.oy)
    out = []
    for px, py in ((frame.xx, frame.xy), (frame.yx, frame.yy)):
        vx, vy = _c(px) - _c(frame.ox), _c(py) - _c(frame.oy)
        out.append((dx * vx + dy * vy) / (vx * vx + vy * vy))
    return out[0], out[1]


def inside(tx: Column, ty: Column) -> Column:
    return tx.between(0.0, 1.0) & ty.between(0.0, 1.0)


def to_data(t: Column, low: object, high: object, log: bool = False) -> Column:
    low, high = _c(low), _c(high)
    if log:
        return F.exp(F.log(low) + t * (F.log(high) - F.log(low)))
    return low + t * (high - low)


def segment_distance(x: Column, y: Column, ax: object, ay: object, bx: object, by: object) -> Column:
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / n))
    t = F.when(n < 1e-12, 0.0).otherwise(t)
    return F.sqrt(F.pow(x - (ax + t * dx), 2) + F.pow(y - (ay + t * dy), 2))


def rectangle_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    zero = F.lit(0)
    return F.sqrt((F.pow(F.greatest(x0 - x, zero, x - x1), 2) + F.pow(F.greatest(y0 - y, zero, y - y1), 2)).cast("double"))


def near_axes(x: Column, y: Column, frame: Frame, margin: float) -> Column:
    a = segment_distance(x, y, frame.ox, frame.oy, frame.xx, frame.xy)
    return (a <= margin) | (segment_distance(x, y, frame.ox, frame.oy, frame.yx, frame.yy) <= margin)


def near_markers(x: Column, y: Column, frame: Frame) -> Column:
    """Within the filled discs of radius 5 that mark the three points of a frame set by hand (29 is the square that the drawn disc reaches)."""
    hit = F.lit(False)
    for px, py in ((frame.ox, frame.oy), (frame.xx, frame.xy), (frame.yx, frame.yy)):
        hit |= F.pow(x - F.rint(_c(px)), 2) + F.pow(y - F.rint(_c(py)), 2) <= 29
    return hit


def canvas_to_image(x: Column, y: Column, scale: Column | float, width: Column | int, height: Column | int) -> tuple[Column, Column]:
    """A place on a scaled canvas as image coordinates, kept inside the image."""
    scale, width, height = map(_c, (scale, width, height))
    return F.least(F.greatest(x / scale, F.lit(0.0)), width - 1), F.least(F.greatest(y / scale, F.lit(0.0)), height - 1)


def rect_meets(x0: Column, y0: Column, w: Column, h: Column, width: Column | int, height: Column | int) -> Column:
    """Whether a rectangle covers any of the image."""
    width, height = map(_c, (width, height))
    return (x0 + w > 0) & (y0 + h > 0) & (x0 < width) & (y0 < height)


def rect_clip(x0: Column, y0: Column, w: Column, h: Column, width: Column | int, height: Column | int) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of a rectangle's part inside the image; all null where nothing of it is."""
    width, height = map(_c, (width, height))
    zero = F.lit(0)
    left, top, right, bottom = F.greatest(zero, x0), F.greatest(zero, y0), F.least(width, x0 + w), F.least(height, y0 + h)
    some = (left < right) & (top < bottom)
    return tuple(F.when(some, c).cast("int") for c in (left, top, right, bottom))


#: The missing corner is the sum of the first two less the third.
PARALLELOGRAM = {"tl": ("bl", "tr", "br"), "tr": ("tl", "br", "bl"), "bl": ("tl", "br", "tr"), "br": ("bl", "tr", "tl")}


def fourth_corner(present: dict) -> dict:
    """The missing one of tl, tr, bl, br by the parallelogram rule; corners are pairs of columns or of numbers."""
    (missing,) = set(PARALLELOGRAM) - set(present)
    a, b, c = PARALLELOGRAM[missing]
    return present | {missing: tuple(present[a][i] + present[b][i] - present[c][i] for i in (0, 1))}


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.abs(b) * 1e-5 + 1e-8
