"""Colour expressions over 8-bit b, g, r columns; all stay in whole-stage code. adjusted_values is the form for kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegrid.config import EngineConfig

# fixed values: the colours that tell a curve (purple) from an axis marker (red); a colour named three times counts three times
PURPLE = ((103, 53, 140), (128, 0, 128), (112, 48, 160), (142, 68, 173), (155, 89, 182), (120, 60, 150), (90, 40, 130), (148, 0, 211), (138, 43, 226))
RED = ((237, 28, 36), (237, 28, 36), (237, 28, 36), (255, 0, 0), (220, 20, 60), (200, 0, 0), (178, 34, 34))


def strict_red(r: Column, g: Column, b: Column, least: int = 240, most: int = 10) -> Column:
    return (r >= least) & (g <= most) & (b <= most)


def without_red(r: Column, g: Column, b: Column, least: int = 240, most: int = 10) -> tuple[Column, Column, Column]:
    """The channels with marker red made black."""
    red = strict_red(r, g, b, least, most)
    return tuple(F.when(red, 0).otherwise(c) for c in (r, g, b))


def near_pure_red(r: Column, g: Column, b: Column, tolerance: int = 4) -> Column:
    """Every channel within the tolerance of (255, 0, 0)."""
    return (r >= 255 - tolerance) & (g <= tolerance) & (b <= tolerance)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit hue (period 180), saturation and value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    sat = F.when(top == 0, 0.0).otherwise(F.rint(span * 255.0 / top))
    angle = F.when(span == 0, 0.0).when(top == r, (g - b) * 60.0 / span).when(top == g, (b - r) * 60.0 / span + 120.0).otherwise((r - g) * 60.0 / span + 240.0)
    half = F.rint(F.when(angle < 0, angle + 360.0).otherwise(angle) / 2.0)
    return F.when(half >= 180, half - 180).otherwise(half).cast("int"), sat.cast("int"), top.cast("int")


def grayscale(r: Column, g: Column, b: Column, config: EngineConfig = EngineConfig()) -> Column:
    _, sat, val = hsv(r, g, b)
    return (F.greatest(r, g, b) - F.least(r, g, b) <= config.gray_spread) | ((sat <= config.gray_sat) & (val >= config.gray_val))


def luminance(r: Column, g: Column, b: Column) -> Column:
    f = "float"
    return F.lit(0.114).cast(f) * b.cast(f) + F.lit(0.587).cast(f) * g.cast(f) + F.lit(0.299).cast(f) * r.cast(f)


def luminance_gate(r: Column, g: Column, b: Column, config: EngineConfig = EngineConfig()) -> Column:
    return luminance(r, g, b).between(config.lum_min, config.lum_max)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) in the 8-bit form, over 255."""

    def linear(c: Column) -> Column:
        u = c / 255.0
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))

    def bent(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = (lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456
    y = lr * 0.212671 + lg * 0.715160 + lb * 0.072169
    z = (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.088754
    light = F.when(y > 0.008856, F.cbrt(y) * 116.0 - 16.0).otherwise(y * 903.3)
    byte = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(v))) / 255.0
    return byte(light * 255.0 / 100.0), byte((bent(x) - bent(y)) * 500.0 + 128.0), byte((bent(y) - bent(z)) * 200.0 + 128.0)


def lab_to_rgb(f0: Column, f1: Column, f2: Column) -> tuple[Column, Column, Column]:
    """The 8-bit r, g, b of Lab features over 255, by way of their nearest 8-bit Lab."""
    byte = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(v * 255.0)))
    light, a, b = byte(f0) * 100.0 / 255.0, byte(f1) - 128.0, byte(f2) - 128.0
    fy = F.when(light > 8.0, (light + 16.0) / 116.0).otherwise(light / 903.3 * 7.787 + 16.0 / 116.0)
    straight = lambda t: F.when(t > 0.206893, F.pow(t, F.lit(3.0))).otherwise((t - 16.0 / 116.0) / 7.787)
    x, y, z = straight(fy + a / 500.0) * 0.950456, straight(fy), straight(fy - b / 200.0) * 1.088754
    linear = (x * 3.240479 - y * 1.537150 - z * 0.498535, y * 1.875992 - x * 0.969256 + z * 0.041556, x * 0.055648 - y * 0.204043 + z * 1.057311)
    curved = lambda c: F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1.0 / 2.4)) * 1.055 - 0.055)
    return tuple(byte(curved(c)).cast("int") for c in linear)


def features(space: str, r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The clustering features of a pixel in [0, 1]: its Lab, or its r, g, b."""
    if space == "lab":
        return lab(r, g, b)
    if space == "rgb":
        return r / 255.0, g / 255.0, b / 255.0
    raise ValueError(f"feature_space must be lab or rgb, not {space!r}")


def to_rgb(space: str, f0: Column, f1: Column, f2: Column) -> tuple[Column, Column, Column]:
    """The 8-bit r, g, b of features."""
    if space == "lab":
        return lab_to_rgb(f0, f1, f2)
    byte = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(v * 255.0)))
    return tuple(byte(c).cast("int") for c in (f0, f1, f2))


def hsv_distance2(h: Column, s: Column, v: Column, ph: Column, ps: Column, pv: Column) -> Column:
    """(2 dH)^2 + dS^2 + dV^2 with a circular hue."""
    d = F.abs(h - ph)
    hue = F.least(d, F.lit(180) - d) * 2.0
    return hue * hue + F.pow((s - ps).cast("double"), 2) + F.pow((v - pv).cast("double"), 2)


def prototypes(colours: tuple) -> list[tuple[int, int, int]]:
    """HSV of literal RGB colours, by the same formulas on the driver."""
    out = []
    for r, g, b in colours:
        top, span = max(r, g, b), max(r, g, b) - min(r, g, b)
        angle = 0.0 if not span else (g - b) * 60.0 / span if top == r else (b - r) * 60.0 / span + 120.0 if top == g else (r - g) * 60.0 / span + 240.0
        half = round((angle + 360.0 if angle < 0 else angle) / 2.0)
        out.append((half - 180 if half >= 180 else half, round(span * 255.0 / top) if top else 0, top))
    return out


def to_colours(h: Column, s: Column, v: Column, colours: tuple, use) -> Column:  # noqa: ANN001
    """use(array of squared distances to the colours); the pixel's hue, saturation and value are computed once."""
    near = F.array(*[F.struct(*[F.lit(c).alias(n) for c, n in zip(p, "hsv", strict=True)]) for p in prototypes(colours)])
    pixel = F.array(F.struct(h.alias("h"), s.alias("s"), v.alias("v")))
    return F.element_at(F.transform(pixel, lambda q: use(F.transform(near, lambda p: hsv_distance2(q["h"], q["s"], q["v"], p["h"], p["s"], p["v"])))), 1)


def knn_distance(h: Column, s: Column, v: Column, colours: tuple, k: int) -> Column:
    """Root of the mean of the k smallest squared distances to the colours; an array expression, so no join and no shuffle."""
    k = min(k, len(colours))
    return to_colours(h, s, v, colours, lambda d: F.sqrt(F.aggregate(F.slice(F.array_sort(d), 1, k), F.lit(0.0), lambda a, x: a + x) / float(k)))


def adjusted(f: tuple[Column, Column, Column], space: str, sat: Column, val: Column, contrast: Column) -> tuple[Column, ...]:
    """Saturation, value and contrast applied to features in [0, 1]."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    if space == "lab":
        light = (f[0] * val - 0.5) * contrast + 0.5
        return clip(light), clip((f[1] - 0.5) * sat + 0.5), clip((f[2] - 0.5) * sat + 0.5)
    mean = (f[0] + f[1] + f[2]) / 3.0
    return tuple(clip(((mean + (c - mean) * sat) * val - 0.5) * contrast + 0.5) for c in f)


def adjusted_values(f: np.ndarray, space: str, sat: float, val: float, contrast: float) -> np.ndarray:
    """adjusted over the rows of an array, in the same order of operations."""
    clip = lambda c: np.minimum(1.0, np.maximum(0.0, c))
    if space == "lab":
        light = (f[:, 0] * val - 0.5) * contrast + 0.5
        return np.stack([clip(light), clip((f[:, 1] - 0.5) * sat + 0.5), clip((f[:, 2] - 0.5) * sat + 0.5)], 1)
    mean = (f[:, 0] + f[:, 1] + f[:, 2]) / 3.0
    return np.stack([clip(((mean + (f[:, i] - mean) * sat) * val - 0.5) * contrast + 0.5) for i in range(3)], 1)
