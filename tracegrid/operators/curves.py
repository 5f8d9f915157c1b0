"""Curve operators over (keys..., pt_idx, x, y): windows where a pass looks at fixed neighbours, Arrow kernels where order of edits matters."""

from __future__ import annotations

from hashlib import blake2b
from itertools import combinations, product
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracegrid.config import EngineConfig
from tracegrid.functions.geometry import close_to

KEYS = ("image_id", "curve_idx")
PAIRS = tuple(combinations(range(5), 2))


def _order(keys: tuple[str, ...] = KEYS, by: str = "pt_idx"):  # noqa: ANN202
    return Window.partitionBy(*keys).orderBy(by)


def per_curve(curves: DataFrame, kernel, extra: str = "", keys: tuple[str, ...] = KEYS) -> DataFrame:  # noqa: ANN001
    """kernel(x, y, frame) -> x, y (or a frame with extra columns) over each curve in point order; points are numbered anew."""
    kinds = dict(curves.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pt_idx")
        x, y = kernel(frame["x"].to_numpy(float), frame["y"].to_numpy(float))
        return pd.DataFrame({k: frame[k].iloc[0] for k in keys} | {"pt_idx": np.arange(1, len(x) + 1), "x": x, "y": y})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pt_idx long, x double, y double"
    return curves.select(*keys, "pt_idx", "x", "y").groupBy(*keys).applyInPandas(run, schema)


def farthest_points(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Indices of k points, each farthest from those before; starts at the smallest x; the first of equals."""
    if len(x) <= k:
        return np.arange(len(x))
    chosen = [int(x.argmin())]
    near = np.full(len(x), np.inf)
    while len(chosen) < k:
        last = chosen[-1]
        near = np.minimum(near, (x - x[last]) ** 2 + (y - y[last]) ** 2)
        chosen.append(int(near.argmax()))
    return np.array(chosen)


def farthest_many(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], k: int) -> np.ndarray:
    """farthest_points of many sets of more than k of the points (ascending indices) at once: the indices chosen, a row a set."""
    size = np.array([len(s) for s in sets])
    held = np.arange(size.max()) < size[:, None]
    at = np.zeros(held.shape, np.int64)
    at[held] = np.concatenate(sets)
    px, py = x[at], y[at]
    near = np.where(held, np.inf, -np.inf)
    line = np.arange(len(sets))
    last = np.where(held, px, np.inf).argmin(1)
    chosen = [last]
    while len(chosen) < k:
        near = np.minimum(near, (px - px[line, last][:, None]) ** 2 + (py - py[line, last][:, None]) ** 2)
        last = near.argmax(1)
        chosen.append(last)
    return at[line[:, None], np.stack(chosen, 1)]


def sample_farthest(points: DataFrame, k: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """At most k points a curve by farthest-point sampling, in the order chosen, then sorted by x."""

    def kernel(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = farthest_points(x, y, k)
        at = at[np.argsort(x[at], kind="stable")]
        return x[at], y[at]

    return per_curve(points, kernel, keys=keys)


def stride_decimate(points: DataFrame, limit: int, keys: tuple[str, ...] = KEYS, by: str = "pt_idx") -> DataFrame:
    """Every ceil(n / limit)-th point of a curve, from the first."""
    step = F.ceil(F.count("*").over(Window.partitionBy(*keys)) / F.lit(limit))
    return points.withColumns({"_n": F.row_number().over(_order(keys, by)) - 1, "_step": step}).filter(F.col("_n") % F.col("_step") == 0).drop("_n", "_step")


def sort_curve(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return points.withColumn("pt_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "pt_idx")).cast("long"))


def monotone_clip(curves: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """y replaced by the smallest y so far."""
    return curves.withColumn("y", F.min("y").over(_order(keys).rowsBetween(Window.unboundedPreceding, 0)))


def falling_fit(y: np.ndarray) -> np.ndarray:
    """The non-increasing least-squares fit: blocks are pooled while a later block's mean is larger."""
    means: list[float] = []
    sizes: list[int] = []
    for v in y:
        means.append(float(v))
        sizes.append(1)
        while len(means) > 1 and means[-1] > means[-2]:
            m, n = means.pop(), sizes.pop()
            means[-1] = (means[-1] * sizes[-1] + m * n) / (sizes[-1] + n)
            sizes[-1] += n
    return np.repeat(means, sizes)


def monotone_pava(curves: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return per_curve(curves, lambda x, y: (x, falling_fit(y)), keys=keys)


# spikes ---------------------------------------------------------------------------------------------------------------


def one_point_spike(config: EngineConfig, order) -> Column:  # noqa: ANN001
    left, right, y = F.lag("y").over(order), F.lead("y").over(order), F.col("y")
    mean, spread = (left + right) / 2.0, F.abs(left - right)
    scale = F.greatest(F.abs(mean), F.abs(left), F.abs(right), F.lit(1.0))
    spike = (spread <= scale * (config.spike_pair * config.spike_floor)) & (F.abs(y - mean) > F.greatest(spread, F.lit(1e-12)) * config.spike_factor)
    return F.coalesce(spike, F.lit(False))


def spike_one_pass(curves: DataFrame, config: EngineConfig = EngineConfig(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One pass of the one-point prune; all points are tested against the curve before the pass."""
    return curves.withColumn("_spike", one_point_spike(config, _order(keys))).filter(~F.col("_spike")).drop("_spike")


def spike_two_pass(curves: DataFrame, config: EngineConfig = EngineConfig(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One pass of the two-point prune: in each window of five points the strongest pair that stands off three alike ones goes."""
    order = _order(keys)
    values = [F.col("y") if k == 0 else F.lead("y", k).over(order) for k in range(5)]
    held = curves.withColumns({f"_y{k}": v for k, v in enumerate(values)})
    tried = []
    for number, pair in enumerate(PAIRS):
        p = [F.col(f"_y{k}") for k in pair]
        b = [F.col(f"_y{k}") for k in range(5) if k not in pair]
        mean_p, mean_b = (p[0] + p[1]) / 2.0, (b[0] + b[1] + b[2]) / 3.0
        spread_p, spread_b = F.abs(p[0] - p[1]), F.greatest(*b) - F.least(*b)
        tight = F.greatest(F.greatest(*[F.abs(c) for c in b]), F.abs(mean_b), F.lit(1.0)) * (config.spike_pair * config.spike_floor)
        room = F.greatest(spread_b, tight)
        off = F.abs(mean_p - mean_b)
        good = (spread_b <= tight) & (spread_p <= room * config.spike_pair) & (off > room * config.spike_factor)
        tried.append(F.when(good, F.struct((off / F.greatest(room * config.spike_factor, F.lit(1e-12))).alias("s"), F.lit(-number).alias("n"))))
    held = held.withColumn("_best", F.when(F.col("_y4").isNotNull(), F.array_max(F.array_compact(F.array(*tried)))))
    pair_of = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in PAIRS])
    held = held.withColumn("_pair", F.when(F.col("_best").isNotNull(), F.element_at(pair_of, 1 - F.coalesce(F.col("_best.n"), F.lit(0)))))
    hit = F.lit(False)
    for back in range(5):
        hit |= F.coalesce(F.array_contains(F.lag("_pair", back).over(order) if back else F.col("_pair"), back), F.lit(False))
    return held.withColumn("_hit", hit).filter(~F.col("_hit")).select(*curves.columns)


def prune_one(y: np.ndarray, config: EngineConfig = EngineConfig()) -> np.ndarray:
    """Mask of what the one-point prune keeps in a pass."""
    keep = np.ones(len(y), bool)
    if len(y) >= 3:
        left, mid, right = y[:-2], y[1:-1], y[2:]
        mean, spread = (left + right) / 2, np.abs(left - right)
        scale = np.maximum.reduce([np.abs(mean), np.abs(left), np.abs(right), np.ones(len(mid))])
        keep[1:-1] = ~((spread <= config.spike_pair * config.spike_floor * scale) & (np.abs(mid - mean) > config.spike_factor * np.maximum(spread, 1e-12)))
    return keep


def prune_two(y: np.ndarray, config: EngineConfig = EngineConfig()) -> np.ndarray:
    """Mask of what the two-point prune keeps in a pass; all windows and pairs at once."""
    keep = np.ones(len(y), bool)
    if len(y) < 5:
        return keep
    w = np.lib.stride_tricks.sliding_window_view(y, 5)
    strength = np.full((len(PAIRS), len(w)), -np.inf)
    for n, pair in enumerate(PAIRS):
        p, b = w[:, pair], np.delete(w, pair, axis=1)
        mean = b.mean(1)
        spread = np.ptp(b, axis=1)
        tight = config.spike_pair * config.spike_floor * np.maximum.reduce([np.abs(b).max(1), np.abs(mean), np.ones(len(b))])
        room = np.maximum(spread, tight)
        off = np.abs(p.mean(1) - mean)
        good = (spread <= tight) & (np.ptp(p, axis=1) <= config.spike_pair * room) & (off > config.spike_factor * room)
        strength[n, good] = (off / np.maximum(config.spike_factor * room, 1e-12))[good]
    best = strength.argmax(0)
    at = np.flatnonzero(strength.max(0) > -np.inf)
    chosen = np.array(PAIRS)[best[at]] + at[:, None]
    keep[chosen.ravel()] = False
    return keep


def rolling_scores(y: np.ndarray, window: int) -> np.ndarray:
    """How many standard deviations of its neighbours (itself left out) each inner point is off; 0 where that is not defined."""
    half, out = (window | 1) // 2, np.zeros(len(y))
    for i in range(1, len(y) - 1):
        near = np.concatenate([y[max(0, i - half) : i], y[i + 1 : i + half + 1]])
        if len(near) >= 5 and (sd := near.std()) > 1e-12:
            out[i] = abs(y[i] - near.mean()) / sd
    return out


def prune_rolling(x: np.ndarray, y: np.ndarray, config: EngineConfig = EngineConfig()) -> tuple[np.ndarray, np.ndarray]:
    budget = floor(config.rolling_fraction * len(y)) if len(y) >= 5 else 0
    for _ in range(config.rolling_passes):
        if budget <= 0 or len(y) < 5:
            break
        score = rolling_scores(y, config.rolling_window)
        worst = np.argsort(-score, kind="stable")
        out = worst[score[worst] > config.rolling_sigma][:budget]
        if not len(out):
            break
        budget -= len(out)
        x, y = np.delete(x, out), np.delete(y, out)
    return x, y


def prune_spikes(x: np.ndarray, y: np.ndarray, config: EngineConfig = EngineConfig()) -> tuple[np.ndarray, np.ndarray]:
    for prune in (prune_one, prune_two):
        for _ in range(config.spike_passes):
            keep = prune(y, config)
            if keep.all():
                break
            x, y = x[keep], y[keep]
    return x, y


def rolling_outlier_pass(curves: DataFrame, config: EngineConfig = EngineConfig(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One unlimited pass of the rolling prune in windows: points more than sigma deviations of their neighbours off go, ends stay."""
    half = config.rolling_window // 2
    order = _order(keys)
    near = F.concat(F.collect_list("y").over(order.rowsBetween(-half, -1)), F.collect_list("y").over(order.rowsBetween(1, half)))
    held = curves.withColumns({"_near": near, "_end": F.lag("y").over(order).isNull() | F.lead("y").over(order).isNull()})
    n = F.size("_near")
    held = held.withColumn("_mean", F.aggregate("_near", F.lit(0.0), lambda a, v: a + v) / n)
    held = held.withColumn("_sd", F.sqrt(F.aggregate("_near", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean"))) / n))
    bad = ~F.col("_end") & (n >= 5) & (F.col("_sd") > 1e-12) & (F.abs(F.col("y") - F.col("_mean")) > F.col("_sd") * config.rolling_sigma)
    return held.filter(~F.coalesce(bad, F.lit(False))).select(*curves.columns)


# quality --------------------------------------------------------------------------------------------------------------


def local_roughness(curves: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """roughness of each point: its distance in y from the chord of its neighbours; 0 at the ends."""
    o = _order(keys)
    x0, y0, x1, y1 = F.lag("x").over(o), F.lag("y").over(o), F.lead("x").over(o), F.lead("y").over(o)
    chord = F.when(F.abs(x1 - x0) <= 1e-12, (y0 + y1) / 2.0).otherwise(y0 + (F.col("x") - x0) / (x1 - x0) * (y1 - y0))
    return curves.withColumn("roughness", F.coalesce(F.abs(F.col("y") - chord), F.lit(0.0)))


def roughness_of(x: np.ndarray, y: np.ndarray, samples: int = 200, method: str = "mean_squared") -> float:
    """Mean squared (or median absolute) second difference of the curve resampled evenly; inf for fewer than five different x."""
    at, first = np.unique(x, return_index=True)
    if len(at) < 5:
        return float("inf")
    m = min(max(samples, 20), max(20, len(at)))
    bend = np.diff(np.interp(np.linspace(at[0], at[-1], m), at, y[first]), 2)
    return float((bend**2).mean() if method == "mean_squared" else np.median(np.abs(bend)))


def curve_scores(curves: DataFrame, xmin: float | str, xmax: float | str, config: EngineConfig = EngineConfig(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, n_points, coverage, roughness, score, accepted for each curve."""
    kinds = dict(curves.dtypes)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pt_idx")
        return pd.DataFrame({k: [frame[k].iloc[0]] for k in keys} | {"roughness": [roughness_of(frame["x"].to_numpy(float), frame["y"].to_numpy(float), config.roughness_samples, config.roughness_method)]})

    rough = curves.select(*keys, "pt_idx", "x", "y").groupBy(*keys).applyInPandas(kernel, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", roughness double")
    low, high = F.lit(xmin) if isinstance(xmin, float) else F.col(xmin), F.lit(xmax) if isinstance(xmax, float) else F.col(xmax)
    sums = curves.groupBy(*keys).agg(F.count("*").alias("n_points"), ((F.max("x") - F.min("x")) / F.max(high - low)).alias("coverage"))
    out = sums.join(rough, list(keys)).withColumn("score", F.col("roughness") - F.col("coverage") * 0.02 - F.least(F.col("n_points"), F.lit(500)) * 0.0005)
    good = (F.col("n_points") >= config.min_points) & (F.col("coverage") >= config.min_coverage) & (F.col("roughness") <= config.max_roughness)
    return out.withColumn("accepted", good)


def pick_best(candidates: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The best candidate of each curve: most points, then least rough, then widest, then first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n_points"), F.asc("roughness"), F.desc("coverage"), F.asc("cand_id"))
    return candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


class Best:
    """The best accepted candidate of each curve of an image, as curve_scores and pick_best judge those that are offered. Of equal sets of
    points the first counts. A set that must have fewer points than the best one so far is not sampled."""

    def __init__(self, x: np.ndarray, y: np.ndarray, span: float, k: int, config: EngineConfig, monotone: str | None = None) -> None:
        self.x, self.y, self.span, self.k, self.config, self.monotone = x, y, span, k, config, monotone
        self.least = max(config.min_points, ceil(config.min_preprune * k))
        self.best: dict[int, tuple[tuple, np.ndarray, np.ndarray]] = {}
        self.met: set[tuple[int, bytes]] = set()
        self.waiting: list[tuple[int, int, np.ndarray]] = []
        self.cells = 0

    def offer(self, curve: int, cand: int, at: np.ndarray) -> None:
        """The points at (ascending indices) as a candidate; candidates of a curve come in the order of their numbers."""
        at = at[:: max(1, ceil(len(at) / self.config.max_points))]
        if len(at) < self.least or curve in self.best and min(len(at), self.k) < -self.best[curve][0][0]:
            return
        mark = (curve, blake2b(at.astype(np.int64).tobytes(), digest_size=16).digest())
        if mark in self.met:
            return
        self.met.add(mark)
        # samples span no more than their set
        if (self.x[at].max() - self.x[at].min()) / self.span >= self.config.min_coverage:
            self.waiting.append((curve, cand, at))
            self.cells += len(at)
            if self.cells > 1 << 20:
                self.judge()

    def judge(self) -> None:
        """Sample and score what waits, most points first."""
        waiting, self.waiting, self.cells = sorted(self.waiting, key=lambda w: -len(w[2])), [], 0
        at = 0
        while at < len(waiting):
            most = len(waiting[at][2])
            part = waiting[at : at + max(1, min(256, (1 << 18) // most))]
            at += len(part)
            part = [w for w in part if w[0] not in self.best or min(len(w[2]), self.k) >= -self.best[w[0]][0][0]]
            long = [w for w in part if len(w[2]) > self.k]
            chosen = dict(zip(map(id, long), farthest_many(self.x, self.y, [w[2] for w in long], self.k), strict=True)) if long else {}
            for w in part:
                self.score(w[0], w[1], chosen.get(id(w), w[2]))

    def score(self, curve: int, cand: int, at: np.ndarray) -> None:
        x, y = self.x[at], self.y[at]
        by = np.argsort(x, kind="stable")
        x, y = x[by], y[by]
        coverage = (x[-1] - x[0]) / self.span
        if coverage < self.config.min_coverage:
            return
        if self.monotone:
            y = falling_fit(y) if self.monotone == "pava" else np.minimum.accumulate(y)
        rough = roughness_of(x, y, self.config.roughness_samples, self.config.roughness_method)
        rank = (-len(x), rough, -coverage, cand)
        if rough <= self.config.max_roughness and (curve not in self.best or rank < self.best[curve][0]):
            self.best[curve] = (rank, x, y)


def without_result(asked: DataFrame, results: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of asked whose keys have no row among results: what the next pass tries."""
    return asked.join(results.select(*keys).distinct(), list(keys), "left_anti")


def grid(curves: DataFrame, axes: dict[str, tuple[float, ...]]) -> DataFrame:
    """Each row of curves with every combination of the grid (cand_id from 0); the grid is a literal array, so no join is needed."""
    cells = [F.struct(F.lit(i).alias("cand_id"), *[F.lit(v).alias(n) for n, v in zip(axes, values, strict=True)]) for i, values in enumerate(product(*axes.values()))]
    return curves.withColumn("_c", F.explode(F.array(*cells))).select(*curves.columns, "_c.*")


# between curves of an image -------------------------------------------------------------------------------------------


def interp_distance(points: DataFrame, curves: DataFrame) -> DataFrame:
    """points (image_id, curve_idx, pt_idx, x, y) with other and gap: the distance in y from every other curve of the image whose
    x range holds the point, by linear interpolation.

    Each point is sent once to each other curve of its image and sorted among that curve's points, which carry their next one; so the
    work grows with points times curves. Of several points of a curve at one x the first ends the segment on the left and the last
    begins the one on the right."""
    line = Window.partitionBy("image_id", "other").orderBy("x")
    known = curves.groupBy("image_id", F.col("curve_idx").alias("other"), "x").agg(F.min_by("y", "pt_idx").alias("end"), F.max_by("y", "pt_idx").alias("begin"))
    spot = F.struct("x", "end", "begin", F.lag("x").over(line).isNull().alias("first"), F.lead("x").over(line).alias("next_x"), F.lead("end").over(line).alias("next_y"))
    known = known.select("image_id", "other", "x", spot.alias("spot"))
    others = curves.select("image_id", F.col("curve_idx").alias("other")).distinct()
    asked = points.join(others, "image_id").filter("curve_idx <> other").select("image_id", "other", "x", F.struct("curve_idx", "pt_idx", "y").alias("asks"))
    both = known.unionByName(asked, allowMissingColumns=True)
    run = Window.partitionBy("image_id", "other").orderBy("x", F.col("asks").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("spot", F.last("spot", ignorenulls=True).over(run)).filter("asks IS NOT NULL AND spot IS NOT NULL")
    y = F.col("asks.y")
    here = F.least(F.when(~F.col("spot.first"), F.abs(y - F.col("spot.end"))), F.when(F.col("spot.next_x").isNotNull(), F.abs(y - F.col("spot.begin"))))
    share = (F.col("x") - F.col("spot.x")) / (F.col("spot.next_x") - F.col("spot.x"))
    between = F.abs(y - (F.col("spot.begin") + share * (F.col("spot.next_y") - F.col("spot.begin"))))
    out = met.withColumn("gap", F.when(F.col("spot.x") == F.col("x"), here).otherwise(between)).filter("gap IS NOT NULL")
    return out.select("image_id", "asks.curve_idx", "asks.pt_idx", "other", "gap")


def tail_overlap(curves: DataFrame, lookback: int = 10, tolerance: float = 2.5) -> DataFrame:
    """image_id, curve_idx, other, overlaps, beyond: whether each of a curve's last points lies within tolerance of some point of the
    other, and how many points of the other lie beyond the curve's end."""
    last = curves.withColumns({"_n": F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("pt_idx"))), "_end": F.max("x").over(Window.partitionBy(*KEYS))}).filter(F.col("_n") <= lookback)
    b = curves.select("image_id", F.col("curve_idx").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = last.join(b, "image_id").filter("curve_idx <> other").groupBy("image_id", "curve_idx", "other", "pt_idx").agg(
        F.min(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2)).alias("d2"), F.sum((F.col("bx") > F.col("_end")).cast("long")).alias("beyond")
    )
    return near.groupBy("image_id", "curve_idx", "other").agg(F.bool_and(F.col("d2") <= tolerance * tolerance).alias("overlaps"), F.max("beyond").alias("beyond"))


def tail_extend_step(curves: DataFrame, lookback: int = 10, tolerance: float = 2.5) -> DataFrame:
    """Every curve extended once by the points of the overlapping curve that has most beyond its end (the first of equals); all see the curves before the step."""
    best = Window.partitionBy(*KEYS).orderBy(F.desc("beyond"), "other")
    partner = tail_overlap(curves, lookback, tolerance).filter("overlaps AND beyond > 0").withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*KEYS, "other")
    end = curves.groupBy(*KEYS).agg(F.max("x").alias("_end"))
    b = curves.select("image_id", F.col("curve_idx").alias("other"), "x", "y", F.col("pt_idx").alias("_from"))
    more = partner.join(end, list(KEYS)).join(b, ["image_id", "other"]).filter("x > _end").select(*KEYS, (F.col("_from") + 1_000_000_000).alias("pt_idx"), "x", "y")
    return sort_curve(curves.select(*KEYS, "pt_idx", "x", "y").unionByName(more))


def reassign_step(curves: DataFrame, fraction: float = 0.05, margin: float = 0.8) -> DataFrame:
    """image_id, curve_idx, pt_idx, other: the roughest inner points of each curve that lie clearly nearer to another curve, and to which."""
    rough = local_roughness(curves)
    n = F.count("*").over(Window.partitionBy(*KEYS))
    inner = rough.withColumns({"_n": n, "_first": F.min("pt_idx").over(Window.partitionBy(*KEYS)), "_last": F.max("pt_idx").over(Window.partitionBy(*KEYS))}).filter("pt_idx > _first AND pt_idx < _last")
    take = F.greatest(F.lit(1), F.ceil((F.col("_n") - 2) * F.lit(fraction)))
    worst = inner.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("roughness"), "pt_idx"))).filter((F.col("_r") <= take) & (F.col("roughness") > 0))
    gaps = interp_distance(worst.select(*KEYS, "pt_idx", "x", "y"), curves)
    best = gaps.groupBy(*KEYS, "pt_idx").agg(F.min(F.struct("gap", "other")).alias("b"))
    return worst.join(best, [*KEYS, "pt_idx"]).filter(F.col("b.gap") < F.col("roughness") * margin).select(*KEYS, "pt_idx", F.col("b.other").alias("other"), F.col("b.gap").alias("gap"), "roughness")


def settle_image(curves: DataFrame, config: EngineConfig = EngineConfig(), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The sequential clean-up of an image's curves: tails are extended, then rough points reassigned, each curve seeing the earlier
    ones' changes. A kernel per image: its curves are few and sampled."""

    def apart(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if len(x) < 2:
            return np.full(len(px), np.inf)
        return np.where((px < x[0]) | (px > x[-1]), np.inf, np.abs(py - np.interp(px, x, y)))

    def ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(x, kind="stable")
        x, y = x[by], y[by]
        same = np.isclose(x[1:], x[:-1]) & np.isclose(y[1:], y[:-1])
        keep = np.concatenate([[True], ~same])[: len(x)]
        return x[keep], y[keep]

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(frame["curve_idx"].unique())
        held = {c: frame[frame["curve_idx"] == c].sort_values("pt_idx")[["x", "y"]].to_numpy(float).T for c in names}
        for a in names:
            xa, ya = held[a]
            best, found = 0, None
            for b in names:
                if b == a or not len(xa) or not len(held[b][0]):
                    continue
                xb, yb = held[b]
                tx, ty = xa[-config.tail_lookback :], ya[-config.tail_lookback :]
                near = np.hypot(tx[:, None] - xb, ty[:, None] - yb).min(1)
                beyond = int((xb > xa[-1]).sum())
                if (near <= config.tail_tolerance).all() and beyond > best:
                    best, found = beyond, (xb[xb > xa[-1]], yb[xb > xa[-1]])
            if found is not None:
                held[a] = np.stack(ordered(np.concatenate([xa, found[0]]), np.concatenate([ya, found[1]])))
        for _ in range(config.reassign_passes):
            moves = 0
            for a in names:
                x, y = held[a]
                if len(x) < 3:
                    continue
                dx = x[2:] - x[:-2]
                share = np.where(np.abs(dx) <= 1e-12, 0.5, (x[1:-1] - x[:-2]) / np.where(np.abs(dx) <= 1e-12, 1, dx))
                own = np.abs(y[1:-1] - (y[:-2] + share * (y[2:] - y[:-2])))
                worst = np.argsort(-own, kind="stable")[: max(1, ceil(config.reassign_fraction * len(own)))] + 1
                others = [b for b in names if b != a]
                if not others:
                    continue
                gap = np.stack([apart(x[worst], y[worst], *held[b]) for b in others])
                to = gap.argmin(0)
                go = (own[worst - 1] > 0) & (gap.min(0) < config.reassign_margin * own[worst - 1])
                for i, t in zip(worst[go], to[go], strict=True):
                    b = others[t]
                    held[b] = np.stack(ordered(np.append(held[b][0], x[i]), np.append(held[b][1], y[i])))
                held[a] = np.delete(held[a], worst[go], axis=1)
                moves += int(go.sum())
            if not moves:
                break
        parts = [pd.DataFrame({"image_id": frame["image_id"].iloc[0], "curve_idx": c, "pt_idx": np.arange(1, len(v[0]) + 1), "x": v[0], "y": v[1]}) for c, v in held.items()]
        return pd.concat(parts)

    kinds = dict(curves.dtypes)
    return curves.select(*KEYS, "pt_idx", "x", "y").groupBy("image_id").applyInPandas(kernel, f"image_id {kinds['image_id']}, curve_idx {kinds['curve_idx']}, pt_idx long, x double, y double")


# ends and output ------------------------------------------------------------------------------------------------------


def near_dup_removal(curves: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Without the points that are close to the point before."""
    o = _order(keys)
    same = close_to(F.col("x"), F.lag("x").over(o)) & close_to(F.col("y"), F.lag("y").over(o))
    return curves.withColumn("_same", F.coalesce(same, F.lit(False))).filter(~F.col("_same")).drop("_same")


def synthetic_endpoints(curves: DataFrame, xmin: float | str, xmax: float | str, xlog: bool = False, ylog: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """With a left point (0 or, on a log axis, xmin) and a right point (xmax) at zero (on a log axis the smallest float), where the
    curve has none close to them; sorted by x, without points close to the one before. The limits are numbers or names of columns."""
    low, high = (F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in (xmin, xmax))
    zero, left = F.lit(1.1754943508222875e-38 if ylog else 0.0), low if xlog else F.lit(0.0)
    at = lambda v: close_to(F.col("x"), v) & close_to(F.col("y"), zero)
    ends = curves.groupBy(*keys).agg(F.max(at(left)).alias("l"), F.max(at(high)).alias("r"), F.max("pt_idx").alias("n"), F.max(left).alias("left"), F.max(high).alias("right"))
    new = lambda v, k: F.struct((F.col("n") + k).alias("pt_idx"), F.col(v).alias("x"), zero.alias("y"))
    added = ends.select(*keys, F.explode(F.array_compact(F.array(F.when(~F.col("l"), new("left", 1)), F.when(~F.col("r"), new("right", 2))))).alias("p")).select(*keys, "p.*")
    return sort_curve(near_dup_removal(sort_curve(curves.select(*keys, "pt_idx", "x", "y").unionByName(added), keys), keys), keys)


def renumber(curves: DataFrame, by: str = "image_id") -> DataFrame:
    """curve_idx from 1 in each image over the curves that are there; a window over an image's sampled points."""
    return curves.withColumn("curve_idx", F.dense_rank().over(Window.partitionBy(by).orderBy("curve_idx")))


def wide(curves: DataFrame, n: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, pt_idx and x, y of one curve, or curve<i>_x, curve<i>_y side by side by point number, NaN below the shorter ones. Curves are
    numbered from 1 (renumber); n is the number of curves of the image that has most, at most one more than the clusters allow."""
    if n == 1:
        return curves.filter("curve_idx = 1").select(*keys, "pt_idx", "x", "y")
    picked = lambda i, c: F.coalesce(F.max(F.when(F.col("curve_idx") == i, F.col(c))), F.lit(float("nan")))
    return curves.groupBy(*keys, "pt_idx").agg(*[picked(i, c).alias(f"curve{i}_{c}") for i in range(1, n + 1) for c in ("x", "y")])


def write_csv(curves: DataFrame, path: str, n: int) -> None:
    """One CSV file with a header for each image, in a folder image_id=..., in point order; an image is one task's file, and images
    are spread over all tasks. Cells are plain doubles."""
    table = wide(curves, n)
    table.repartition("image_id").sortWithinPartitions("image_id", "pt_idx").drop("pt_idx").write.mode("overwrite").partitionBy("image_id").option("header", True).csv(path)


@F.pandas_udf(StringType())
def twelve_digits(value: pd.Series) -> pd.Series:
    """Numbers to 12 significant digits without trailing zeros; no number is an empty cell."""
    return value.map(lambda v: "" if pd.isna(v) else f"{v:.12g}")


def engine_table(curves: DataFrame, n: int) -> DataFrame:
    """image_id, pt_idx and the cells of wide as text to 12 significant digits, blank below the shorter curves; x and y alone for one."""
    table = wide(curves, n)
    return table.select("image_id", "pt_idx", *[twelve_digits(c).alias(c) for c in table.columns if c not in ("image_id", "pt_idx")])


def write_engine_csv(curves: DataFrame, path: str, n: int) -> None:
    """The engine's CSV of each image: as write_csv, with the cells of engine_table."""
    table = engine_table(curves, n)
    table.repartition("image_id").sortWithinPartitions("image_id", "pt_idx").drop("pt_idx").write.mode("overwrite").partitionBy("image_id").option("header", True).option("emptyValue", "").csv(path)
