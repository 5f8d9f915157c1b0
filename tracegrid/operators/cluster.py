"""Feature clustering: normalising, nearest centre, one against the rest, k-means, silhouette, choice of k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.config import EngineConfig
from tracegrid.operators.pixels import nothing, relabel
from tracegrid.session import materialise, spread


def distance2(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def normaliser(features: DataFrame, names: list[str], key: str = "image_id", floor: float = 1e-6) -> DataFrame:
    """Offset (minimum) and scale of each feature, one row an image."""
    out = features.groupBy(key).agg(*[F.min(n).alias(f"{n}_offset") for n in names], *[F.greatest(F.max(n) - F.min(n), F.lit(floor)).alias(f"{n}_scale") for n in names])
    return out


def normalise(features: DataFrame, norm: DataFrame, names: list[str], key: str = "image_id") -> DataFrame:
    joined = features.join(norm, key)
    scaled = {n: (F.col(n) - F.col(f"{n}_offset")) / F.col(f"{n}_scale") for n in names}
    return joined.withColumns(scaled).drop(*[f"{n}_{p}" for n in names for p in ("offset", "scale")])


def denormalise(scaled: DataFrame, norm: DataFrame, names: list[str], key: str = "image_id") -> DataFrame:
    """The inverse of normalise."""
    joined = scaled.join(norm, key)
    raw = {n: F.col(n) * F.col(f"{n}_scale") + F.col(f"{n}_offset") for n in names}
    return joined.withColumns(raw).drop(*[f"{n}_{p}" for n in names for p in ("offset", "scale")])


def with_centres(features: DataFrame, centres: DataFrame) -> DataFrame:
    """features with all centres (centre, c) as one sorted array; the centres number at most k and are packed into one row."""
    packed = centres.agg(F.sort_array(F.collect_list(F.struct("centre", "c"))).alias("centres"))
    return features.crossJoin(F.broadcast(packed))  # one row


def nearest_centre(features: DataFrame, centres: DataFrame) -> DataFrame:
    """features with the nearest centre (the first of equals) and its squared distance; an array expression per row."""
    tried = F.transform("centres", lambda s: F.struct(distance2(F.col("f"), s["c"]).alias("d2"), s["centre"].alias("centre")))
    best = F.array_min(tried)
    return with_centres(features, centres).withColumn("best", best).select(*features.columns, F.col("best.centre").alias("centre"), F.col("best.d2").alias("d2"))


def one_vs_rest(features: DataFrame, centres: DataFrame, target: int, ratio: float = 0.85, most: float | None = None) -> DataFrame:
    """Rows nearer to the target centre than to any other, by a certainty ratio of distances, and within an absolute distance if given."""
    own = F.filter("centres", lambda s: s["centre"] == target)
    rest = F.filter("centres", lambda s: s["centre"] != target)
    d = with_centres(features, centres).withColumns({"d_target": distance2(F.col("f"), F.element_at(own, 1)["c"]), "d_other": F.array_min(F.transform(rest, lambda s: distance2(F.col("f"), s["c"])))})
    keep = (F.col("d_target") < F.col("d_other")) & (F.sqrt("d_target") <= F.sqrt("d_other") * ratio)
    if most is not None:
        keep &= F.sqrt("d_target") <= most
    return d.filter(keep).drop("centres")


def k_means_step(features: DataFrame, centres: DataFrame) -> DataFrame:
    """The means of the rows nearest to each centre; a centre without rows stays. Sums are combined before the shuffle."""
    assigned = nearest_centre(features, centres)
    sums = assigned.select("centre", F.posexplode("f").alias("i", "v")).groupBy("centre", "i").agg(F.avg("v").alias("v"))
    means = sums.groupBy("centre").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))
    return centres.join(means, "centre", "left").select("centre", F.coalesce("m", "c").alias("c"))


def k_means(features: DataFrame, centres: DataFrame, rounds: int) -> DataFrame:
    """Lloyd rounds from the given centres; the centre table is written each round, so the plan does not grow."""
    for _ in range(rounds):
        centres = materialise(k_means_step(features, centres), "centres")
    return centres


def silhouette_of(sums: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Silhouette of rows from the sums of their distances to each cluster, their own clusters and the clusters' sizes."""
    line = np.arange(len(own))
    a = sums[line, own] / np.maximum(size[own] - 1, 1)
    mean = sums / size
    mean[line, own] = np.inf
    b = mean.min(1)
    top = np.maximum(a, b)
    return np.where(size[own] == 1, 1.0, np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0))


def silhouette_values(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Silhouette of each row; 1 where a row is alone in its cluster."""
    names, code = np.unique(labels, return_inverse=True)
    size = np.bincount(code)
    out = np.empty(len(x))
    for at in range(0, len(x), 512):
        d = np.sqrt(np.maximum(((x[at : at + 512, None] - x[None]) ** 2).sum(2), 0))
        sums = np.stack([d[:, code == k].sum(1) for k in range(len(names))], 1)
        out[at : at + 512] = silhouette_of(sums, code[at : at + 512], size)
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows; those of which a product of the rows would leave few digits are taken from the differences."""
    scale = (x * x).sum(1)[:, None] + (y * y).sum(1)
    d2 = scale - 2 * (x @ y.T)
    i, j = np.nonzero(d2 < 1e-4 * scale)
    for at in range(0, len(i), 1 << 17):
        m, n = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        d2[m, n] = ((x[m] - y[n]) ** 2).sum(1)
    return np.sqrt(np.maximum(d2, 0))


def silhouette(features: DataFrame, key: str, max_points: int | None = 4000, block: int = 16_384) -> DataFrame:
    """key, points, silhouette: the mean over the rows (id, f, label) of each group, or over max_points of them chosen by a hash of id;
    -1 for one label. The rows of a group are dealt into blocks of at most about `block`; a task has the distances between two blocks,
    summed by label, so the work grows with the square of a group and each row is sent to all of its group's blocks."""
    ids = features.select(key, "id", "f", "label")
    if max_points is not None:
        order = Window.partitionBy(key).orderBy(F.xxhash64("id"), "id")
        ids = ids.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_points).drop("_n")
    # written, so that a row keeps its number
    rows = materialise(ids.select(F.col(key).alias("g"), "f", F.col("label").alias("l"), F.monotonically_increasing_id().alias("r")), "points")
    labels = rows.groupBy("g", "l").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("g")
    labels = labels.select(F.col("g").alias("lg"), F.col("l").alias("ll"), (F.dense_rank().over(whole.orderBy("l")) - 1).alias("code"), F.count("*").over(whole).alias("k"), F.sum("n").over(whole).alias("total"))
    rows = rows.join(labels, F.col("g").eqNullSafe(F.col("lg")) & F.col("l").eqNullSafe(F.col("ll")))
    # a group has at least eight blocks, if it has 1,000 rows for each: small groups are spread over tasks too
    parts = F.greatest(F.ceil(F.col("total") / block), F.least(F.lit(8), F.ceil(F.col("total") / 1000))).cast("int")
    dealt = rows.select("g", "r", "f", "code", "k", parts.alias("p")).withColumn("own", F.pmod(F.xxhash64("r"), F.col("p")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("p") - 1))
    asks = dealt.select("g", F.col("own").alias("i"), every.alias("j"), "r", "f", "code", "k", F.lit(True).alias("asks"))
    met = dealt.select("g", every.alias("i"), F.col("own").alias("j"), "r", "f", "code", "k", F.lit(False).alias("asks"))

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("r")
        a, b = frame[frame["asks"]], frame[~frame["asks"]]
        if not len(a) or not len(b):
            return nothing("g", "i", "codes", "sums", "sizes")
        k = int(frame["k"].iloc[0])
        x, y, code = np.stack(a["f"].to_numpy()).astype(float), np.stack(b["f"].to_numpy()).astype(float), b["code"].to_numpy()
        by = np.argsort(code, kind="stable")
        y, first = y[by], np.flatnonzero(np.diff(code[by], prepend=-1))
        sums = np.zeros((len(x), k))
        step = max(1, (1 << 22) // len(y))
        for at in range(0, len(x), step):
            sums[at : at + step, code[by][first]] = np.add.reduceat(distances(x[at : at + step], y), first, axis=1)
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "i": [frame["i"].iloc[0]], "codes": [a["code"].to_numpy()], "sums": [sums.ravel()], "sizes": [np.bincount(code, minlength=k)]})

    def values(frame: pd.DataFrame) -> pd.DataFrame:
        own, size = frame["codes"].iloc[0], frame["sizes"].sum()
        sums = frame["sums"].sum().reshape(len(own), len(size))
        out = -np.ones(len(own)) if len(size) < 2 else silhouette_of(sums, own, size)
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "n": [len(own)], "s": [out.sum()]})

    kind = dict(features.dtypes)[key]
    cells = materialise(asks.unionByName(met).groupBy("g", "i", "j").applyInPandas(cell, f"g {kind}, i int, codes array<int>, sums array<double>, sizes array<long>"), "cells")
    out = cells.groupBy("g", "i").applyInPandas(values, f"g {kind}, n long, s double")
    return out.groupBy(F.col("g").alias(key)).agg(F.sum("n").alias("points"), (F.sum("s") / F.sum("n")).alias("silhouette"))


def seed_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds: each next one drawn in proportion to the squared distance from those chosen."""
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = near.sum()
        chosen.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].copy()


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    centres = seed_centres(x, k, rng)
    code = np.zeros(len(x), np.int64)
    for turn in range(rounds):
        new = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        if turn and (new == code).all():
            break
        code = new
        moved = np.stack([x[code == j].mean(0) if (code == j).any() else centres[j] for j in range(k)])
        shift = np.abs(moved - centres).max()
        centres = moved
        if shift < tol:
            break
    return centres, code


def clusters_of(frame: pd.DataFrame, names: list[str], num_colours: int, k_max: int, sample: int, seed: int, config: EngineConfig, max_points: int) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Labels (from 0) and centres of one image's pixels, given in row-major order, and the silhouette of each k that was tried."""
    rng = np.random.default_rng(seed)
    x = frame[names].to_numpy(float)
    k, scores = num_colours, {}
    if not k:
        part = x if len(x) <= sample else x[rng.choice(len(x), sample, replace=False)]
        for tried in range(2, min(k_max, len(np.unique(part, axis=0))) + 1):
            _, code = lloyd(part, tried, rng)
            few = np.arange(len(part)) if len(part) <= max_points else rng.choice(len(part), max_points, replace=False)
            if len(np.unique(code[few])) > 1:
                scores[tried] = float(silhouette_values(part[few], code[few]).mean())
        k = max(scores, key=lambda n: (scores[n], -n), default=1)
    centres, code = lloyd(x, min(k, len(x)), rng)
    code, centres = relabel(x, code, centres, frame["x"].to_numpy(), frame["y"].to_numpy(), config)
    return code, centres, scores


def discover_labels(features: DataFrame, names: list[str], key: str = "image_id", num_colours: int = 0, k_max: int = 20, sample: int = 50_000, seed: int = 0, config: EngineConfig = EngineConfig(), max_points: int = 4000) -> DataFrame:
    """The colour clusters of each image, k given or chosen by the silhouette of at most max_points rows of a sample, relabelled in
    space. A row per pixel with its centre (from 1), one per centre with c, and one per tried k with its score; the columns that do not
    apply are null. A kernel per image; centres_of, labels_of and scores_of read the parts."""

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x"])
        code, centres, scores = clusters_of(frame, names, num_colours, k_max, sample, seed, config, max_points)
        parts = [
            frame[["x", "y", "pix_idx"]].assign(centre=code + 1),
            pd.DataFrame({"centre": np.arange(1, len(centres) + 1), "c": list(centres)}),
            pd.DataFrame({"k": list(scores), "score": list(scores.values())}),
        ]
        out = pd.concat([p for p in parts if len(p)], ignore_index=True).reindex(columns=["x", "y", "pix_idx", "centre", "c", "k", "score"])
        for c in ("x", "y", "pix_idx", "centre", "k"):
            out[c] = out[c].astype("Int64")
        out["c"] = [v if isinstance(v, np.ndarray) else None for v in out["c"]]
        out.insert(0, key, frame[key].iloc[0])
        return out

    schema = f"{key} {dict(features.dtypes)[key]}, x int, y int, pix_idx long, centre int, c array<double>, k int, score double"
    return spread(features.select(key, "x", "y", "pix_idx", *names), key).groupBy(key).applyInPandas(kernel, schema)


def centres_of(found: DataFrame, key: str = "image_id") -> DataFrame:
    return found.filter("c IS NOT NULL").select(key, "centre", "c")


def labels_of(found: DataFrame, key: str = "image_id") -> DataFrame:
    return found.filter("pix_idx IS NOT NULL").select(key, "x", "y", "pix_idx", "centre")


def scores_of(found: DataFrame, key: str = "image_id") -> DataFrame:
    return found.filter("k IS NOT NULL").select(key, "k", "score")


def discover(features: DataFrame, names: list[str], **options: object) -> DataFrame:
    """image_id, centre (from 1), c: the centres alone of discover_labels."""
    return centres_of(discover_labels(features, names, **options))
