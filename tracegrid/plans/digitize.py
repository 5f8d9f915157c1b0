"""The digitising plans: pixel tables to curves, many images at a time."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.config import DigitizeOptions, EngineConfig
from tracegrid.functions import colour, geometry
from tracegrid.functions.geometry import Frame
from tracegrid.operators import cluster, curves, pixels
from tracegrid.session import materialise, spread


def on_axes(points: DataFrame, frames: Frame | DataFrame, options: DigitizeOptions) -> DataFrame:
    """The pixels (x, y) that lie inside the axes, if they must, with x and y in data units."""
    placed, frame = pixels.framed(points, frames)
    tx, ty = geometry.params(F.col("x"), F.col("y"), frame)
    placed = placed.withColumns({"tx": tx, "ty": ty})
    if not options.keep_outside_axes:
        placed = placed.filter(geometry.inside(F.col("tx"), F.col("ty")))
    return placed.withColumns({"x": geometry.to_data(F.col("tx"), frame.xmin, frame.xmax, options.xscale_log), "y": geometry.to_data(F.col("ty"), frame.ymin, frame.ymax, options.yscale_log)})


def finish(points: DataFrame, frames: Frame | DataFrame, options: DigitizeOptions, config: EngineConfig) -> DataFrame:
    """Pixels of curves (image_id, curve_idx, x, y, pix_idx) to sampled, sorted, optionally monotone curves in data units."""
    placed = on_axes(points, frames, options).select("image_id", "curve_idx", F.col("pix_idx").alias("pt_idx"), "x", "y")
    out = curves.sample_farthest(curves.stride_decimate(placed, config.max_points), options.k)
    if options.monotone_y:
        out = curves.monotone_pava(out) if options.monotone_method == "pava" else curves.monotone_clip(out)
    return out


def with_limits(table: DataFrame, frames: Frame | DataFrame) -> tuple[DataFrame, float | str, float | str]:
    """The table and the x limits of its images: numbers, or the names of columns that it now has."""
    if isinstance(frames, Frame):
        return table, float(frames.xmin), float(frames.xmax)
    return table.join(frames.select("image_id", "xmin", "xmax"), "image_id"), "xmin", "xmax"


def closed(found: DataFrame, frames: Frame | DataFrame, options: DigitizeOptions) -> DataFrame:
    """Curves with their synthetic ends."""
    found, low, high = with_limits(found, frames)
    return curves.synthetic_endpoints(found, low, high, options.xscale_log, options.yscale_log)


def single_colour(table: DataFrame, frames: Frame | DataFrame, options: DigitizeOptions = DigitizeOptions(), config: EngineConfig = EngineConfig(), marked: bool = False) -> DataFrame:
    """image_id, curve_idx (1), pt_idx, x, y: the purple curve of each image. With marked, the discs that mark the points of a frame set
    by hand (each frame, or those whose row says by_hand) do not count as curve."""
    near = pixels.knn_colour_classify(table, options.knn_k, options.min_sat, options.min_val, options.knn_thresh)
    purple = near.filter((F.col("class") == "purple") & ~colour.strict_red(*pixels.rgb(), config.red_min, config.red_other_max))
    if marked:
        placed, frame = pixels.framed(purple, frames)
        hit = geometry.near_markers(F.col("x"), F.col("y"), frame)
        purple = placed.filter(~(hit & F.col("by_hand") if "by_hand" in placed.columns else hit))
    out = finish(purple.select("image_id", F.lit(1).alias("curve_idx"), "x", "y", "pix_idx"), frames, options, config)
    return closed(curves.per_curve(out, lambda x, y: curves.prune_spikes(x, y, config)), frames, options)


NAMES = ["f0", "f1", "f2"]


def clustering_pixels(table: DataFrame, frames: Frame | DataFrame, margin: float, options: DigitizeOptions, config: EngineConfig) -> DataFrame:
    """The pixels that can belong to a curve with their features f0, f1, f2; the images' sizes pass through where the table has them."""
    placed, frame = pixels.framed(table, frames)
    valid = pixels.valid_pixels(placed, None if options.keep_outside_axes else frame, margin, config, options.exclude_grayscale)
    sizes = [c for c in ("width", "height") if c in table.columns]
    return valid.select("image_id", "x", "y", "pix_idx", *sizes, *[c.alias(n) for n, c in zip(NAMES, colour.features(config.feature_space, *pixels.rgb()), strict=True)])


def colour_clusters(features: DataFrame, options: DigitizeOptions, config: EngineConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of pixels with features: the normaliser (a row an image), the centres (image_id, centre, c) and the labels (image_id, x, y,
    pix_idx, centre) after the spatial relabelling."""
    norm = materialise(cluster.normaliser(features, NAMES, floor=config.norm_floor), "norm")
    scaled = materialise(cluster.normalise(features, norm, NAMES), "features")
    found = materialise(cluster.discover_labels(scaled, NAMES, num_colours=options.num_colors, k_max=config.k_max, sample=config.sample_limit, config=config), "clusters")
    return norm, cluster.centres_of(found), cluster.labels_of(found)


def centre_colours(centres: DataFrame, norm: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """image_id, centre, r, g, b: the centres as colours to show."""
    raw = cluster.denormalise(centres.select("image_id", "centre", *[F.col("c")[i].alias(n) for i, n in enumerate(NAMES)]), norm, NAMES)
    return raw.select("image_id", "centre", *[c.alias(n) for n, c in zip("rgb", colour.to_rgb(config.feature_space, *map(F.col, NAMES)), strict=True)])


def assign_pixels(features: DataFrame, centres: DataFrame, norm: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """image_id, x, y, label: pixels with features dealt to known centres of their image, the nearest first, then relabelled in space."""
    scaled = cluster.normalise(features, norm, NAMES)
    packed = centres.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("centre", "c"))).alias("centres"))
    tried = F.transform("centres", lambda s: F.struct(cluster.distance2(F.array(*NAMES), s["c"]).alias("d2"), s["centre"].alias("centre")))
    near = scaled.join(packed, "image_id").withColumn("label", F.array_min(tried)["centre"])
    return pixels.icm_exact(near, NAMES, config)


def reference_curves(labels: DataFrame, width: int, height: int, radius: int = 2) -> DataFrame:
    """image_id, label, x, y, sx, sy: each curve's pixels moved to the ridge of the mask that all curves of the image make when it is
    thickened; what the strength of a place is, tells the distance from the background."""
    union = pixels.dilate(labels.select("image_id", "x", "y").distinct(), width, height, radius)
    moved = pixels.snap(labels.select("image_id", "x", "y").distinct(), pixels.chamfer(union, width, height))
    return labels.select("image_id", "label", "x", "y").join(moved, ["image_id", "x", "y"])


def best_curves(placed: DataFrame, known: DataFrame, options: DigitizeOptions, config: EngineConfig) -> DataFrame:
    """image_id, curve_idx, pt_idx, x, y: of each centre of an image (known: its centres, normaliser and span of x) the best accepted
    candidate of the fast grid, else of the full one. A kernel per image tries the grid on its pixels (placed: pix_idx, features,
    px, py in data units) without a row for each candidate's pixels; each pixel can only be of the curve whose centre is nearest."""
    monotone = options.monotone_method if options.monotone_y else None

    def kernel(frame: pd.DataFrame, of_image: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(of_image):
            return pixels.nothing("image_id", "curve_idx", "pt_idx", "x", "y")
        frame, one = frame.sort_values("pix_idx"), of_image.iloc[0]
        curve = np.array([c["centre"] for c in one["centres"]])
        centre = np.array([c["c"] for c in one["centres"]], float)
        f = frame[NAMES].to_numpy(float)
        offset, scale = (np.array([one[f"{n}_{p}"] for n in NAMES], float) for p in ("offset", "scale"))
        best = curves.Best(frame["px"].to_numpy(float), frame["py"].to_numpy(float), float(one["span"]), options.k, config, monotone)
        for axes in (config.fast_grid, config.full_grid):
            asked = [k for k in range(len(curve)) if k not in best.best]
            best.met.clear()
            before = None
            for cand, values in enumerate(product(*axes.values()) if asked else ()):
                now = dict(zip(axes, values, strict=True))
                change = (now["sat"], now["val"], now["contrast"])
                if change != before:
                    before = change
                    unit = (colour.adjusted_values(f, config.feature_space, *change) - offset) / scale
                    d2 = sum((unit[:, i, None] - centre[:, i]) ** 2 for i in range(len(NAMES)))
                    nearest = d2.argmin(1)
                    own = d2[np.arange(len(d2)), nearest]
                    d2[np.arange(len(d2)), nearest] = np.inf
                    rest = d2.min(1)
                    alone, near, far = own < rest, np.sqrt(own), np.sqrt(rest)
                held = np.flatnonzero(alone & (near <= far * now["ratio"]))
                code = nearest[held]
                by = np.argsort(code, kind="stable")
                ends = np.searchsorted(code[by], np.arange(len(curve) + 1))
                for k in asked:
                    best.offer(k, cand, held[by[ends[k] : ends[k + 1]]])
            best.judge()
        parts = [pd.DataFrame({"image_id": one["image_id"], "curve_idx": curve[k], "pt_idx": np.arange(1, len(x) + 1), "x": x, "y": y}) for k, (_, x, y) in sorted(best.best.items())]
        return pd.concat(parts) if parts else pixels.nothing("image_id", "curve_idx", "pt_idx", "x", "y")

    schema = f"image_id {dict(placed.dtypes)['image_id']}, curve_idx int, pt_idx long, x double, y double"
    return spread(placed, "image_id").groupBy("image_id").cogroup(spread(known, "image_id").groupBy("image_id")).applyInPandas(kernel, schema)


def auto_colours(table: DataFrame, frames: Frame | DataFrame, width: int | None, height: int | None, options: DigitizeOptions = DigitizeOptions(auto_colors=True), config: EngineConfig = EngineConfig()) -> DataFrame:
    """image_id, curve_idx, pt_idx, x, y: a curve for each colour cluster. The fast grid is tried for all clusters, the full one for
    those without an accepted candidate. Without a width and height the table's own columns of these names tell them."""
    features = clustering_pixels(table, frames, config.axes_margin_cluster, options, config)
    norm, centres, _ = colour_clusters(features, options, config)
    near = materialise(clustering_pixels(table, frames, config.axes_margin_curve, options, config), "curve-pixels")
    box_of = materialise(pixels.legend_box(near, width, height), "legend")
    near = pixels.legend_erase(near, box_of)
    placed = on_axes(near, frames, options).select("image_id", "pix_idx", *NAMES, F.col("x").alias("px"), F.col("y").alias("py"))
    packed = centres.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("centre", "c"))).alias("centres"))
    known, low, high = with_limits(packed.join(norm, "image_id"), frames)
    known = known.withColumn("span", (F.lit(high) if isinstance(high, float) else F.col(high)) - (F.lit(low) if isinstance(low, float) else F.col(low)))
    both = materialise(best_curves(placed, known, options, config), "picked")
    if options.prune_auto:
        both = curves.per_curve(both, lambda x, y: curves.prune_rolling(*curves.prune_spikes(x, y, config), config))
    return closed(curves.settle_image(both, config), frames, options)


def calibrate(table: DataFrame, width: int | Column, height: int | Column, config: EngineConfig = EngineConfig()) -> DataFrame:
    """image_id, ox, oy, axx, axy, ayx, ayy from the red corner markers, for images that have all three."""
    red = table.filter(colour.strict_red(*pixels.rgb(), config.red_min, config.red_other_max))
    at = pixels.corner_centroids(red, width, height)
    pick = lambda n, c: F.max(F.when(F.col("corner") == n, F.col(c)))
    return at.groupBy("image_id").agg(*[pick(n, c).alias(a) for n, c, a in (("bl", "x", "ox"), ("bl", "y", "oy"), ("br", "x", "axx"), ("br", "y", "axy"), ("tl", "x", "ayx"), ("tl", "y", "ayy"))]).dropna()


def marked_corners(table: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """image_id, corner, x, y, inferred from exactly three red blobs of at least marker_area pixels."""
    red = table.filter(colour.strict_red(*pixels.rgb(), config.red_min, config.red_other_max))
    blobs = pixels.connected_components(red, config.marker_area)
    numbered = blobs.withColumn("p", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "component")))
    return pixels.assign_corners(numbered.select("image_id", "p", F.col("cx").alias("x"), F.col("cy").alias("y")))


def digitize(table: DataFrame, frames: Frame | DataFrame, width: int | None, height: int | None, options: DigitizeOptions = DigitizeOptions(), config: EngineConfig = EngineConfig(), marked: bool = False) -> DataFrame:
    if options.auto_colors:
        return auto_colours(table, frames, width, height, options, config)
    return single_colour(table, frames, options, config, marked)
