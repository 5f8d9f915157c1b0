"""Digitising images end to end: a calibration for each image, curves, warnings, failures, and their files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.config import AxisCalibration, DigitizeOptions, EngineConfig, Limits
from tracegrid.functions.geometry import Frame
from tracegrid.operators import curves
from tracegrid.plans import digitize as plans
from tracegrid.session import materialise, ship
from tracegrid.sources.images import pixels, read_images, unreadable

#: A calibration table: the pixels of the three points and the data of each.
POINTS = ("ox", "oy", "axx", "axy", "ayx", "ayy")
DATA = ("origin_x", "origin_y", "x_axis_x", "x_axis_y", "y_axis_x", "y_axis_y")
#: fixed values: the columns of a job and what a job without them has
JOB = {"k": 1000, "num_colors": 5, "auto_colors": True, "exclude_grayscale": True, "keep_outside_axes": False, "monotone_y": False, "monotone_method": "pava", "xscale_log": False, "yscale_log": False}


@dataclass(frozen=True)
class DigitizeResult:
    """curves: image_id, curve_idx (from 1 in each image), pt_idx, x, y. warnings: image_id, warning. failures: image_id, reason, for
    the images that have no curve."""

    curves: DataFrame
    warnings: DataFrame
    failures: DataFrame

    def most_curves(self) -> int:
        """The number of curves of the image that has most; one number comes to the driver."""
        return self.curves.agg(F.coalesce(F.max("curve_idx"), F.lit(1))).first()[0]

    def to_table(self) -> DataFrame:
        """image_id, pt_idx and x, y, or curve<i>_x, curve<i>_y, NaN below the shorter curves."""
        return curves.wide(self.curves, self.most_curves())

    def to_csv(self, path: str) -> None:
        curves.write_csv(self.curves, path, self.most_curves())

    def to_engine_csv(self, path: str) -> None:
        curves.write_engine_csv(self.curves, path, self.most_curves())


def calibration_rows(images: DataFrame, calibration: AxisCalibration) -> DataFrame:
    """The same calibration for each image."""
    points = (calibration.origin, calibration.x_axis, calibration.y_axis)
    pixel = [F.lit(float(v)).alias(n) for n, v in zip(POINTS, [v for p in points for v in p.pixel], strict=True)]
    data = [F.lit(float(v)).alias(n) for n, v in zip(DATA, [v for p in points for v in p.data], strict=True)]
    return images.select("image_id", *pixel, *data)


def calibration_warnings(tolerance: float = 1e-9) -> Column:
    """The warnings of a calibration row: of the axis points only one coordinate is used."""
    off = lambda a, b, text: F.when(F.abs(F.col(a) - F.col(b)) > tolerance, text)
    return F.array_compact(
        F.array(
            off("x_axis_y", "origin_y", "the x axis point has another y than the origin; the origin's is used"),
            off("y_axis_x", "origin_x", "the y axis point has another x than the origin; the origin's is used"),
        )
    )


def frames_of(calibrations: DataFrame) -> DataFrame:
    """image_id and the columns of a Frame, of calibrations whose axis points do not fall together."""
    far = lambda x, y: F.pow(F.col(x) - F.col("ox"), 2) + F.pow(F.col(y) - F.col("oy"), 2) >= 1e-6
    limits = [F.col(a).alias(b) for a, b in (("origin_x", "xmin"), ("x_axis_x", "xmax"), ("origin_y", "ymin"), ("y_axis_y", "ymax"))]
    more = [c for c in ("by_hand",) if c in calibrations.columns]
    return calibrations.filter(far("axx", "axy") & far("ayx", "ayy")).select("image_id", *POINTS, *limits, *more)


def corner_calibrations(table: DataFrame, limits: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Calibrations from exactly three marked corners of each image, the fourth inferred; limits: image_id, xmin, xmax, ymin, ymax."""
    at = plans.marked_corners(table, config)
    pick = lambda n, c, a: F.max(F.when(F.col("corner") == n, F.col(c))).alias(a)
    names = zip(("bl", "bl", "br", "br", "tl", "tl"), "xyxyxy", POINTS, strict=True)
    return with_data(at.groupBy("image_id").agg(*[pick(*n) for n in names]), limits)


def detected_calibrations(table: DataFrame, limits: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Calibrations from the red markers nearest to the corners of each image (image_id, width, height, x, y, b, g, r)."""
    return with_data(plans.calibrate(table, F.col("width"), F.col("height"), config), limits)


def with_data(points: DataFrame, limits: DataFrame) -> DataFrame:
    data = [F.col(c).cast("double").alias(n) for c, n in zip(("xmin", "ymin", "xmax", "ymin", "xmin", "ymax"), DATA, strict=True)]
    return points.join(limits, "image_id").select("image_id", *POINTS, *data)


def limit_rows(images: DataFrame, limits: Limits) -> DataFrame:
    limits = limits.complete()
    return images.select("image_id", *[F.lit(float(v)).alias(k) for k, v in vars(limits).items()])


def chosen_calibrations(table: DataFrame, calibrations: DataFrame | AxisCalibration | None, limits: DataFrame | Limits | None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """image_id, the points, their data and by_hand: an image's own calibration, else what its markers and limits make."""
    names = table.select("image_id").distinct()
    manual = calibration_rows(names, calibrations) if isinstance(calibrations, AxisCalibration) else calibrations
    if manual is not None:
        manual = manual.select("image_id", *POINTS, *DATA).dropna().withColumn("by_hand", F.lit(True))
    if limits is None:
        if manual is None:
            Limits().complete()
        return manual
    bounds = limit_rows(names, limits) if isinstance(limits, Limits) else limits
    detected = detected_calibrations(table, bounds, config).withColumn("by_hand", F.lit(False))
    return detected if manual is None else manual.unionByName(curves.without_result(detected, manual, ("image_id",)))


def digitize_pixels(
    table: DataFrame, calibrations: DataFrame | AxisCalibration | None = None, limits: DataFrame | Limits | None = None, options: DigitizeOptions = DigitizeOptions(), config: EngineConfig = EngineConfig()
) -> tuple[DataFrame, DataFrame]:
    """Curves (image_id, curve_idx, pt_idx, x, y) and warnings (image_id, warning) of a pixel table (image_id, width, height, x, y,
    pix_idx, b, g, r).

    calibrations is a row an image or one for all; images without a row are calibrated by their red markers, for which limits
    (a row an image, or one for all) must be given. Images that cannot be calibrated have no curves. Nulls in a calibration row
    count as no row."""
    found = materialise(chosen_calibrations(table, calibrations, limits, config), "calibrations")
    frames = frames_of(found)
    sized = table.select("image_id", "width", "height", "x", "y", "pix_idx", "b", "g", "r")
    if options.auto_colors:
        out = plans.auto_colours(sized, frames, None, None, options, config)
    else:
        out = plans.single_colour(sized, frames, options, config, marked=True)
    warned = found.filter("by_hand").select("image_id", F.explode(calibration_warnings()).alias("warning"))
    return curves.renumber(out), warned


def digitize_images(
    images: DataFrame, calibrations: DataFrame | AxisCalibration | None = None, limits: DataFrame | Limits | None = None, options: DigitizeOptions = DigitizeOptions(), config: EngineConfig = EngineConfig()
) -> DigitizeResult:
    """The result for images (read_images). Unreadable ones and those without a curve are failures, never silently left out."""
    ship(images.sparkSession)
    found, warned = digitize_pixels(pixels(images), calibrations, limits, options, config)
    found = materialise(found, "curves")
    missing = images.filter("readable").join(found.select("image_id").distinct(), "image_id", "left_anti")
    failed = unreadable(images).select("image_id", F.col("warning").alias("reason"))
    failed = failed.unionByName(missing.select("image_id", F.lit("no curve points; try other colour settings or calibration points").alias("reason")))
    return DigitizeResult(found, warned, failed)


def required(result: DigitizeResult, path: str) -> DigitizeResult:
    """The result, if every image has a curve."""
    failed = result.failures.limit(5).collect()
    if failed or result.curves.isEmpty():
        raise RuntimeError("; ".join(f"{r['image_id']}: {r['reason']}" for r in failed) or f"no image at {path}")
    return result


def digitize(
    spark: SparkSession, path: str, calibration: AxisCalibration | None = None, *, xmin: float | None = None, xmax: float | None = None, ymin: float | None = None, ymax: float | None = None,
    options: DigitizeOptions = DigitizeOptions(), config: EngineConfig = EngineConfig(),
) -> DigitizeResult:
    """The images at a path, calibrated by hand or, without a calibration, by their red markers and the limits. Raises where an image
    cannot be read or yields no curve."""
    limits = None if calibration is not None else Limits(xmin, xmax, ymin, ymax).complete()
    return required(digitize_images(read_images(spark, path), calibration, limits, options, config), path)


def digitize_marked(spark: SparkSession, path: str, *, xmin: float, xmax: float, ymin: float, ymax: float, options: DigitizeOptions = DigitizeOptions(), config: EngineConfig = EngineConfig()) -> DigitizeResult:
    """The images at a path, each with exactly three marked corners. Raises where an image has another number of them."""
    images = read_images(spark, path)
    found = materialise(corner_calibrations(pixels(images), limit_rows(images, Limits(xmin, xmax, ymin, ymax)), config), "corners")
    without = images.filter("readable").join(found, "image_id", "left_anti").limit(5).collect()
    if without:
        raise ValueError(f"exactly three marked corners are needed: {', '.join(r['image_id'] for r in without)}")
    return required(digitize_images(images, found, None, options, config), path)


def job_table(jobs: DataFrame) -> DataFrame:
    """Jobs (image, xmin, xmax, ymin, ymax and any column of JOB) with the missing columns filled and out, the image's name as .csv."""
    filled = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in jobs.columns else F.lit(v).alias(c) for c, v in JOB.items()]
    return jobs.select("image", *("xmin", "xmax", "ymin", "ymax"), *filled, F.regexp_replace("image", r"\.[^./]*$", "").alias("out")).withColumn("out", F.concat("out", F.lit(".csv")))


def run_jobs(images: DataFrame, jobs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """out, image_id, curve_idx, pt_idx, x, y of a batch: jobs join images by file name. Jobs of equal options run as one plan, so the
    number of plans is that of different options, not of jobs; its table of options is small and comes to the driver."""
    ship(images.sparkSession)
    jobs = job_table(jobs)
    named = images.withColumn("image", F.element_at(F.split("image_id", "/"), -1))
    parts = []
    for options in jobs.select(*JOB).distinct().collect():
        same = jobs.filter(F.struct(*JOB).eqNullSafe(F.struct(*[F.lit(options[c]) for c in JOB])))
        held = named.join(same.drop(*JOB), "image")
        found, _ = digitize_pixels(pixels(held), None, held.select("image_id", "xmin", "xmax", "ymin", "ymax"), DigitizeOptions(**options.asDict()), config)
        parts.append(found.join(held.select("image_id", "out"), "image_id").select("out", "image_id", "curve_idx", "pt_idx", "x", "y"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def debug_layers(table: DataFrame, frames: DataFrame | Frame, width: int, height: int, options: DigitizeOptions, config: EngineConfig = EngineConfig()) -> DataFrame:
    """image_id, layer, curve_idx, x, y: what the stages saw, to be kept as a table: the marker pixels (red), the pixels that may be
    curve (candidate), the pixels of each cluster (curve), the thickened union of the clusters (reference), the corners of the legend box
    (legend) and the axis points (axes)."""
    from tracegrid.functions import colour
    from tracegrid.operators import pixels as ops

    layer = lambda df, name, curve=None: df.select("image_id", F.lit(name).alias("layer"), (curve if curve is not None else F.lit(None)).cast("int").alias("curve_idx"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    red = table.filter(colour.strict_red(*ops.rgb(), config.red_min, config.red_other_max))
    features = materialise(plans.clustering_pixels(table, frames, config.axes_margin_cluster, options, config), "features")
    _, _, labels = plans.colour_clusters(features, options, config)
    union = ops.dilate(labels, width, height)
    corners = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    box = ops.legend_box(labels, width, height).select("image_id", corners.alias("p")).select("image_id", "p.x", "p.y")
    placed, frame = ops.framed(table.select("image_id").distinct(), frames)
    value = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    points = F.explode(F.array(*[F.struct(value(a).alias("x"), value(b).alias("y")) for a, b in ((frame.ox, frame.oy), (frame.xx, frame.xy), (frame.yx, frame.yy))]))
    axes = placed.select("image_id", points.alias("p")).select("image_id", "p.x", "p.y")
    parts = [layer(red, "red"), layer(features, "candidate"), layer(labels, "curve", F.col("centre")), layer(union, "reference"), layer(box, "legend"), layer(axes, "axes")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
