"""Pixel-relation operators: classification, masks as sparse relations, morphology, markers, legend."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.config import EngineConfig
from tracegrid.functions import colour, geometry
from tracegrid.functions.geometry import Frame


def nothing(*names: str) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(dtype=object) for n in names})


def rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def with_hsv(pixels: DataFrame) -> DataFrame:
    h, s, v = colour.hsv(*rgb())
    return pixels.withColumns({"h": h, "s": s, "v": v})


def remove_red(pixels: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The pixels with marker red made black."""
    r, g, b = colour.without_red(*rgb(), config.red_min, config.red_other_max)
    return pixels.withColumns({"r": r, "g": g, "b": b})


def framed(table: DataFrame, frames: Frame | DataFrame) -> tuple[DataFrame, Frame]:
    """The table and its frame: one for all images, or a row an image (image_id, ox, oy, axx, axy, ayx, ayy, xmin, xmax, ymin, ymax)
    whose columns are joined, and by_hand if it has that. Images without a row have no result."""
    if isinstance(frames, Frame):
        return table, frames
    more = [c for c in ("by_hand",) if c in frames.columns and c not in table.columns]
    return table.join(frames.select("image_id", *Frame.NAMES, *more), "image_id"), Frame.columns()


def knn_colour_classify(pixels: DataFrame, k: int = 3, min_sat: int = 30, min_val: int = 30, most: float = 35.0) -> DataFrame:
    """Pixels near enough to the purple or red colours, with both distances; ties are red."""
    near = with_hsv(pixels).filter((F.col("s") >= min_sat) & (F.col("v") >= min_val))
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    near = near.withColumns({"d_purple": colour.knn_distance(h, s, v, colour.PURPLE, k), "d_red": colour.knn_distance(h, s, v, colour.RED, k)})
    near = near.filter(F.least("d_purple", "d_red") <= most)
    return near.withColumn("class", F.when(F.col("d_purple") < F.col("d_red"), "purple").otherwise("red"))


def valid_pixels(pixels: DataFrame, frame: Frame | None, margin: float, config: EngineConfig = EngineConfig(), exclude_grayscale: bool = True) -> DataFrame:
    """One conjunction: inside the axes (if a frame is given), off the axes, not gray, within the luminance gate."""
    keep = colour.luminance_gate(*rgb(), config)
    if exclude_grayscale:
        keep &= ~colour.grayscale(*rgb(), config)
    if frame is not None:
        keep &= geometry.inside(*geometry.params(F.col("x"), F.col("y"), frame)) & ~geometry.near_axes(F.col("x"), F.col("y"), frame, margin)
    return pixels.filter(keep)


def corner_centroids(red: DataFrame, width: int | Column, height: int | Column, least: int = 4) -> DataFrame:
    """image_id, corner (tl, bl, br), x, y: the mean of the red pixels in diagonal shells from the corner, up to the first shell with
    which `least` pixels are seen. Shell counts are summed first, so the window runs over shells, not pixels."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    x, y = F.col("x"), F.col("y")
    shells = F.explode(F.array(*[F.struct(F.lit(n).alias("corner"), d.cast("long").alias("d")) for n, d in (("tl", x + y), ("bl", x + h - 1 - y), ("br", w - 1 - x + h - 1 - y))]))
    sums = red.select("image_id", "x", "y", shells.alias("s")).groupBy("image_id", "s.corner", "s.d").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    run = Window.partitionBy("image_id", "corner").orderBy("d")
    seen = sums.withColumns({"before": F.sum("n").over(run) - F.col("n"), "all": F.sum("n").over(Window.partitionBy("image_id", "corner"))})
    used = seen.filter((F.col("before") < least) & (F.col("all") >= least))
    return used.groupBy("image_id", "corner").agg((F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"), F.sum("n").alias("pixels"))


def connected_components(mask: DataFrame, least_area: int = 1) -> DataFrame:
    """image_id, component (its smallest pix_idx), area, cx, cy, box: 8-connected blobs. A kernel per image: its size is the image's."""

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pix_idx")
        xs, ys = frame["x"].to_numpy(), frame["y"].to_numpy()
        place = {(a, b): i for i, (a, b) in enumerate(zip(xs.tolist(), ys.tolist(), strict=True))}
        root = list(range(len(frame)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (a, b), i in place.items():
            for other in ((a - 1, b), (a - 1, b - 1), (a, b - 1), (a + 1, b - 1)):
                if other in place:
                    p, q = top(i), top(place[other])
                    root[max(p, q)] = min(p, q)
        lead = np.array([top(i) for i in range(len(frame))])
        g = pd.DataFrame({"c": frame["pix_idx"].to_numpy()[lead], "x": xs, "y": ys}).groupby("c")
        out = g.agg(area=("x", "size"), cx=("x", "mean"), cy=("y", "mean"), x0=("x", "min"), y0=("y", "min"), x1=("x", "max"), y1=("y", "max")).reset_index().rename(columns={"c": "component"})
        out.insert(0, "image_id", frame["image_id"].iloc[0])
        return out[out["area"] >= least_area]

    kind = dict(mask.dtypes)["image_id"]
    return mask.select("image_id", "x", "y", "pix_idx").groupBy("image_id").applyInPandas(kernel, f"image_id {kind}, component long, area long, cx double, cy double, x0 int, y0 int, x1 int, y1 int")


def assign_corners(points: DataFrame) -> DataFrame:
    """image_id, corner, x, y, inferred: the three points of an image (p, x, y) matched greedily to the corners of their box, nearest
    pair first (then tl, tr, bl, br, then p); the fourth corner by the parallelogram rule. Images without exactly three give none."""

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        names = ("tl", "tr", "bl", "br")
        if len(frame) != 3:
            return nothing("image_id", "corner", "x", "y", "inferred")
        frame = frame.sort_values("p")
        xy = frame[["x", "y"]].to_numpy(float)
        (x0, y0), (x1, y1) = xy.min(0), xy.max(0)
        ideal = {"tl": (x0, y0), "tr": (x1, y0), "bl": (x0, y1), "br": (x1, y1)}
        found: dict[str, np.ndarray] = {}
        used: set[int] = set()
        for _, _, i, name in sorted((float(np.hypot(*(xy[i] - ideal[n]))), k, i, n) for k, n in enumerate(names) for i in range(3)):
            if name not in found and i not in used:
                found[name] = xy[i]
                used.add(i)
        whole = geometry.fourth_corner(found)
        return pd.DataFrame([(frame["image_id"].iloc[0], n, *whole[n], n not in found) for n in names], columns=["image_id", "corner", "x", "y", "inferred"])

    kind = dict(points.dtypes)["image_id"]
    return points.groupBy("image_id").applyInPandas(kernel, f"image_id {kind}, corner string, x double, y double, inferred boolean")


def dilate(mask: DataFrame, width: int, height: int, radius: int = 2) -> DataFrame:
    """The mask grown by an elliptical kernel of the radius (17 cells for 2)."""
    cells = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if abs(dx) <= round(radius * (1 - (dy / radius) ** 2) ** 0.5)]
    offsets = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in cells])
    grown = mask.select("image_id", "x", "y", F.explode(offsets).alias("o")).select("image_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return grown.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()


def neighbour_counts(labels: DataFrame) -> DataFrame:
    """image_id, x, y, label, other, n: how many of the 8 neighbours of a pixel have each label."""
    around = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    offsets = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in around])
    seen = labels.select("image_id", F.col("label").alias("other"), "x", "y", F.explode(offsets).alias("o"))
    seen = seen.select("image_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "other")
    votes = seen.groupBy("image_id", "x", "y", "other").agg(F.count("*").alias("n"))
    return labels.select("image_id", "x", "y", "label").join(votes, ["image_id", "x", "y"])


def icm_jacobi_sweep(labels: DataFrame) -> DataFrame:
    """One scalable relabelling sweep: the commonest label of the 8 neighbours (all see the labels before the sweep), ties to the smallest; a pixel without neighbours keeps its own."""
    votes = neighbour_counts(labels).groupBy("image_id", "x", "y").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("new"))
    return labels.join(votes, ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("new", "label").alias("label"))


def relabel(x: np.ndarray, code: np.ndarray, centres: np.ndarray, px: np.ndarray, py: np.ndarray, config: EngineConfig) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of one image's pixels, given in row-major order, after the sequential relabelling."""
    code, centres = code.copy(), centres.copy()
    if len(centres) < 2:
        return code, centres
    at = list(zip(px.tolist(), py.tolist(), strict=True))
    place = {q: i for i, q in enumerate(at)}
    around = [[place[q] for q in ((a + i, b + j) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j) if q in place] for a, b in at]
    for _ in range(config.icm_sweeps):
        changed = 0
        cost = config.icm_colour * ((x[:, None] - centres) ** 2).sum(2)
        for i, near in enumerate(around):
            votes = np.bincount(code[near], minlength=len(centres)) if near else 0
            best = int((cost[i] - config.icm_neighbour * votes).argmin())
            changed += best != code[i]
            code[i] = best
        for k in range(len(centres)):
            if (code == k).any():
                centres[k] = x[code == k].mean(0)
        if not changed:
            break
    return code, centres


def icm_exact(labels: DataFrame, features: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """The sequential relabelling: pixels in row-major order see the labels already changed; centres are averaged anew each sweep.
    A kernel per image."""

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x"]).reset_index(drop=True)
        x, lab = frame[features].to_numpy(float), frame["label"].to_numpy()
        names = np.unique(lab)
        if len(names) > 1:
            code = np.searchsorted(names, lab)
            centres = np.stack([x[code == k].mean(0) for k in range(len(names))])
            code, _ = relabel(x, code, centres, frame["x"].to_numpy(), frame["y"].to_numpy(), config)
            lab = names[code]
        return frame.assign(label=lab)[["image_id", "x", "y", "label"]]

    kinds = dict(labels.dtypes)
    return labels.groupBy("image_id").applyInPandas(kernel, f"image_id {kinds['image_id']}, x int, y int, label {kinds['label']}")


def snap(mask: DataFrame, strength: DataFrame, radius: int = 3) -> DataFrame:
    """Each mask pixel moves to the strongest pixel (image_id, x, y, dt) within the disk, nearer first, then in row-major order; it stays where none is there."""
    cells = [(a, b) for b in range(-radius, radius + 1) for a in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in cells])
    tried = mask.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(offsets).alias("o")).withColumns({"x": F.col("px") + F.col("o.dx"), "y": F.col("py") + F.col("o.dy")})
    move = F.col("o.dx") * F.col("o.dx") + F.col("o.dy") * F.col("o.dy")
    best = tried.join(strength, ["image_id", "x", "y"]).groupBy("image_id", "px", "py").agg(F.max_by(F.struct("x", "y"), F.struct("dt", -move, -F.col("y"), -F.col("x"))).alias("to"))
    moved = mask.select("image_id", F.col("x").alias("px"), F.col("y").alias("py")).join(best, ["image_id", "px", "py"], "left")
    return moved.select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), F.coalesce("to.x", "px").alias("sx"), F.coalesce("to.y", "py").alias("sy"))


def chamfer(mask: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, x, y, dt: 3 x 3 chamfer distance of each mask pixel to the nearest pixel of the image outside the mask; a two-pass
    kernel per image."""

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        d = np.full((height + 2, width + 2), np.inf)
        d[1:-1, 1:-1] = 0.0
        d[y + 1, x + 1] = 1e9
        # fixed values: the lengths of a straight and a slanted step
        straight, slanted = 0.955, 1.3693
        for rows, cols, back in ((range(1, height + 1), range(1, width + 1), -1), (range(height, 0, -1), range(width, 0, -1), 1)):
            for i in rows:
                for j in cols:
                    if d[i, j]:
                        d[i, j] = min(d[i, j], d[i, j + back] + straight, d[i + back, j] + straight, d[i + back, j - 1] + slanted, d[i + back, j + 1] + slanted)
        return frame.assign(dt=d[y + 1, x + 1])[["image_id", "x", "y", "dt"]]

    return mask.select("image_id", "x", "y").groupBy("image_id").applyInPandas(kernel, f"image_id {dict(mask.dtypes)['image_id']}, x int, y int, dt double")


def legend_box(points: DataFrame, width: int | None, height: int | None, shares: tuple = (0.15, 0.2, 0.25, 0.3, 0.35), least: int = 20, fill: float = 0.002, isolation: float = 0.07) -> DataFrame:
    """image_id, x0, y0, x1, y1: the first box, by size then place, that holds enough points of the image (x, y), is filled enough,
    and keeps every outside point far away; points beyond the image's edge are outside of every box. A kernel per image: all places of
    a size are judged at once over two-dimensional prefix sums. Without a width and height the points' own columns of these names tell
    them."""
    known = (F.lit(width) if width else F.col("width")).cast("int").alias("width"), (F.lit(height) if height else F.col("height")).cast("int").alias("height")

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        width, height = int(frame["width"].iloc[0]), int(frame["height"].iloc[0])
        frame = frame.dropna(subset=["x", "y"])
        px, py = frame["x"].to_numpy(np.int64), frame["y"].to_numpy(np.int64)
        step, far = max(1, round(0.01 * min(width, height))), isolation * max(width, height)
        # points up to pad cells beyond the edge can still be too near to a box
        pad = int(np.ceil(far)) + 1
        seen = (px >= -pad) & (px < width + pad) & (py >= -pad) & (py < height + pad)
        count = np.zeros((height + 2 * pad + 1, width + 2 * pad + 1), np.int64)
        np.add.at(count, (py[seen] + pad + 1, px[seen] + pad + 1), 1)
        prefix = count.cumsum(0).cumsum(1)
        # how far to the sides a point is too near, by its rows above or below the box
        reach = [int((np.hypot(np.arange(pad + 1), up) < far).sum()) - 1 for up in range(pad + 1)]
        rows = [(up, r) for up, r in enumerate(reach) if r >= 0]

        def held(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
            a, c = np.maximum(a, -pad) + pad, np.minimum(c, width + pad) + pad
            b, d = np.maximum(b, -pad) + pad, np.minimum(d, height + pad) + pad
            return prefix[d, c] - prefix[b, c] - prefix[d, a] + prefix[b, a]

        for fx in shares:
            for fy in shares:
                w, h = max(1, round(fx * width)), max(1, round(fy * height))
                y0, x0 = (g.ravel() for g in np.meshgrid(np.arange(-h + 1, height, step), np.arange(-w + 1, width, step), indexing="ij"))
                a, b, c, d = np.maximum(0, x0), np.maximum(0, y0), np.minimum(width, x0 + w), np.minimum(height, y0 + h)
                n = held(a, b, c, d)
                some = np.flatnonzero((n >= least) & (n >= fill * (c - a) * (d - b)) & (n != len(px)))
                a, b, c, d, n = (v[some] for v in (a, b, c, d, n))
                near = -n
                for up, r in rows:
                    # a point at the far edge (x = c, y = d) is outside and no distance away
                    near = near + (held(a - r, b, c + r + 1, d + 1) if not up else held(a - r, b - up, c + r + 1, b - up + 1) + held(a - r, d + up, c + r + 1, d + up + 1))
                alone = np.flatnonzero(near == 0)
                if len(alone):
                    k = alone[0]
                    return pd.DataFrame([(frame["image_id"].iloc[0], a[k], b[k], c[k], d[k])], columns=["image_id", "x0", "y0", "x1", "y1"])
        return nothing("image_id", "x0", "y0", "x1", "y1")

    return points.select("image_id", "x", "y", *known).distinct().groupBy("image_id").applyInPandas(kernel, f"image_id {dict(points.dtypes)['image_id']}, x0 int, y0 int, x1 int, y1 int")


def legend_erase(mask: DataFrame, boxes: DataFrame) -> DataFrame:
    """The mask without the pixels of its image's box; one box an image, so the join adds no rows."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return mask.join(boxes, "image_id", "left").filter(~F.coalesce(inside, F.lit(False))).select(*mask.columns)
