import struct
import zlib
from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracegrid.config import AxisCalibration, CalibrationPoint, DigitizeOptions, EngineConfig
from tracegrid.functions import colour, geometry, names
from tracegrid.functions.geometry import Frame
from tracegrid.operators import curves, pixels
from tracegrid.plans import digitize
from tracegrid.sources.images import pixels as pixels_of
from tracegrid.sources.images import read_images, unreadable


def png(path, image):
    """Write an H x W x 3 (RGB) or H x W (gray) array."""
    h, w = image.shape[:2]
    kind = 2 if image.ndim == 3 else 0
    raw = b"".join(b"\0" + row.tobytes() for row in image.astype(np.uint8))
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_calibration_and_options():
    c = AxisCalibration(CalibrationPoint((0, 10), (0, 0)), CalibrationPoint((10, 10), (1, 0)), CalibrationPoint((0, 0), (0, 2)))
    assert c.ranges() == (0, 1, 0, 2) and c.warnings() == []
    tilted = AxisCalibration(c.origin, CalibrationPoint((10, 10), (1, 1)), c.y_axis)
    assert len(tilted.warnings()) == 1
    assert DigitizeOptions().k == 100 and DigitizeOptions().knn_k == 3
    with pytest.raises(ValueError):
        DigitizeOptions(monotone_method="other")
    with pytest.raises(ValueError):
        Frame(0, 0, 0, 0, 0, 1)


def test_single_colour_chart(spark, tmp_path):
    image = np.full((60, 80, 3), 255, np.uint8)
    for x, y in ((10, 50), (70, 50), (10, 5)):
        image[y - 1 : y + 2, x - 1 : x + 2] = (255, 0, 0)
    for x in range(13, 68):
        image[50 - round((x - 10) * 45 / 60), x] = (103, 53, 140)
    png(tmp_path / "chart.png", image)
    png(tmp_path / "gray.png", np.full((4, 5), 9, np.uint8))
    (tmp_path / "bad.png").write_bytes(b"no image")
    images = read_images(spark, str(tmp_path))
    assert [r["image_id"].rsplit("/", 1)[1] for r in unreadable(images).collect()] == ["bad.png"]
    table = pixels_of(images).cache()
    assert table.filter("image_id LIKE '%gray.png' AND r = 9 AND g = 9 AND b = 9").count() == 20
    chart = table.filter("image_id LIKE '%chart.png'")
    frame = digitize.calibrate(chart, 80, 60).first()
    assert (round(frame["ox"]), round(frame["oy"]), round(frame["axx"]), round(frame["ayy"])) == (10, 50, 70, 5)
    out = digitize.single_colour(chart, Frame(10, 50, 70, 50, 10, 5, 0.0, 1.0, 0.0, 1.0), DigitizeOptions(k=40)).collect()
    inner = [(r["x"], r["y"]) for r in out if 0 < r["x"] < 1]
    assert len(inner) == 40 and all(abs(x - y) < 0.03 for x, y in inner)
    assert sorted((r["x"], r["y"]) for r in out if not 0 < r["x"] < 1) == [(0.0, 0.0), (1.0, 0.0)]


def test_auto_colours_chart(spark, tmp_path):
    image = np.full((90, 120, 3), 255, np.uint8)
    for x in range(12, 108):
        image[40 - round(15 * np.sin(x / 12)) : 43 - round(15 * np.sin(x / 12)), x] = (200, 30, 200)
        image[70 - round(x / 10) : 73 - round(x / 10), x] = (20, 140, 20)
    png(tmp_path / "two.png", image)
    table = pixels_of(read_images(spark, str(tmp_path)))
    out = digitize.auto_colours(table, Frame(5, 85, 115, 85, 5, 5, 0.0, 110.0, 0.0, 80.0), 120, 90, DigitizeOptions(auto_colors=True, num_colors=2, k=40), replace(EngineConfig(), full_grid=EngineConfig().fast_grid))
    found = {r["curve_idx"]: (r["lo"], r["hi"], r["n"]) for r in out.filter("y > 0").groupBy("curve_idx").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("n")).collect()}
    assert len(found) == 2 and all(n >= 30 for _, _, n in found.values())
    spans = sorted(hi - lo for lo, hi, _ in found.values())
    assert spans[0] < 15 < 25 < spans[1]


def test_auto_query_is_uncut(monkeypatch):
    from tracegrid.plans import queries

    monkeypatch.setattr(queries, "ship", lambda spark: spark)
    monkeypatch.setattr(queries, "pixel_view", lambda spark, d: None)
    monkeypatch.setattr(digitize, "auto_colours", lambda table, frame, width, height, options, config=EngineConfig(): (options.num_colors, config))
    assert queries.QUERIES["auto_colours_pipeline"](None, "") == (0, EngineConfig())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not there")
def test_icm_query_is_settled(spark):
    from tracegrid.plans import queries

    view = queries.pixel_view(spark, "/root/testdata/sf0.001")
    f = [c.alias(n) for n, c in zip(queries.F3, colour.lab(*pixels.rgb()), strict=True)]
    rows = view.select("image_id", "x", "y", F.floor(F.col("r") / 64).cast("int").alias("label"), *f)
    settled = pixels.icm_exact(rows, queries.F3, replace(EngineConfig(), icm_sweeps=10_000)).collect()
    assert sorted(settled) == sorted(queries.QUERIES["icm_exact"](spark, "/root/testdata/sf0.001").collect())


def test_choice_of_k_scores_4000_points(monkeypatch):
    from tracegrid.operators import cluster

    sizes = []
    monkeypatch.setattr(cluster, "silhouette_values", lambda x, labels: sizes.append(len(x)) or np.zeros(len(x)))
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"image_id": 1, "x": np.arange(5000) % 100, "y": np.arange(5000) // 100, **{n: rng.random(5000) for n in ("f0", "f1", "f2")}})
    import inspect

    most = inspect.signature(cluster.discover_labels).parameters["max_points"].default
    _, _, scores = cluster.clusters_of(frame, ["f0", "f1", "f2"], 0, 3, 50_000, 0, replace(EngineConfig(), icm_sweeps=1), most)
    assert sizes == [4000, 4000] and list(scores) == [2, 3]


def test_discover_returns_relabelled_centres(spark):
    from tracegrid.operators import cluster

    rows = [(1, x, y, y * 12 + x, float(x >= 6), 0.0, 0.0) for y in range(12) for x in range(12)]
    rows = [(*r[:4], 1.0 - r[4], 0.0, 0.0) if (r[1], r[2]) in {(2, 3), (8, 8)} else r for r in rows]  # a speck in each half
    df = spark.createDataFrame(rows, "image_id int, x int, y int, pix_idx int, f0 double, f1 double, f2 double")
    got = sorted(r["c"][0] for r in cluster.discover(df, ["f0", "f1", "f2"], num_colours=2).collect())
    assert np.allclose(got, [1 / 72, 71 / 72])


def test_series_kernels():
    assert curves.falling_fit(np.array([3.0, 1, 2, 5, 4])).tolist() == [3.0, 3.0, 3.0, 3.0, 3.0]
    assert curves.prune_one(np.array([0, 0, 9.0, 0, 0])).tolist() == [True, True, False, True, True]
    assert curves.prune_two(np.array([0, 0, 9.0, 9.0, 0, 0])).tolist() == [True, True, False, False, True, True]
    x, y = np.arange(10.0), np.zeros(10)
    at = curves.farthest_points(x, y, 3)
    assert at.tolist() == [0, 9, 4]
    assert curves.farthest_points(x, y, 20).tolist() == list(range(10))
    assert curves.roughness_of(np.arange(3.0), np.arange(3.0)) == float("inf")
    assert curves.roughness_of(np.arange(9.0), np.arange(9.0)) < 1e-20
    rng = np.random.default_rng(1)
    for _ in range(20):
        v = rng.normal(size=rng.integers(1, 30))
        fit = curves.falling_fit(v)
        closed = [min(max(v[i : j + 1].mean() for j in range(k, len(v))) for i in range(k + 1)) for k in range(len(v))]
        assert np.allclose(fit, closed) and np.isclose(fit.mean(), v.mean())


def test_spike_windows_match_kernels(spark):
    rng = np.random.default_rng(3)
    y = np.where(rng.random(60) < 0.2, 9.0, 1.0) + rng.random(60) * 0.1
    df = spark.createDataFrame([(1, 1, i + 1, float(i), float(v)) for i, v in enumerate(y)], "image_id int, curve_idx int, pt_idx long, x double, y double")
    for run, kernel in ((curves.spike_one_pass, curves.prune_one), (curves.spike_two_pass, curves.prune_two)):
        assert sorted(r["pt_idx"] - 1 for r in run(df).collect()) == np.flatnonzero(kernel(y)).tolist()


def test_corners_and_components(spark):
    points = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 10.0, 0.5), ("a", 3, 0.2, 8.0), ("b", 1, 0.0, 0.0)], "image_id string, p int, x double, y double")
    out = {r["corner"]: (r["x"], r["y"], r["inferred"]) for r in pixels.assign_corners(points).collect()}
    assert out["br"] == (10.2, 8.5, True) and out["tl"] == (0.0, 0.0, False) and len(out) == 4
    mask = spark.createDataFrame([("a", x, y, y * 10 + x) for x, y in ((0, 0), (1, 1), (2, 0), (5, 5), (6, 5))], "image_id string, x int, y int, pix_idx long")
    assert sorted((r["component"], r["area"]) for r in pixels.connected_components(mask).collect()) == [(0, 3), (55, 2)]
    assert pixels.connected_components(mask.limit(0)).count() == 0


def test_colour_values(spark):
    df = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255), (0, 0, 0)], "r int, g int, b int")
    h, s, v = colour.hsv(F.col("r"), F.col("g"), F.col("b"))
    assert [tuple(r) for r in df.select(h, s, v).collect()] == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 255), (0, 0, 0)]
    white = df.select(*colour.lab(F.col("r"), F.col("g"), F.col("b"))).collect()[3]
    assert white[0] == 1.0 and abs(white[1] - 128 / 255) < 1e-9


def test_names(spark):
    df = spark.createDataFrame([("  A – b--C ",)], "n string")
    assert df.select(names.norm_name(F.col("n"))).first()[0] == names.norm_text("  A – b--C ") == "a-b-c"
    wanted, files = spark.createDataFrame([("d", "figure 1.png")], "folder string, name string"), spark.createDataFrame([("d", "figure-1.png"), ("d", "zzz.png")], "folder string, file string")
    assert names.resolve(wanted, files).first()["match"] == "figure-1.png"


def test_geometry_fourth_corner(spark):
    lit = F.lit
    four = geometry.fourth_corner({"tl": (lit(0.0), lit(0.0)), "tr": (lit(2.0), lit(0.0)), "bl": (lit(0.0), lit(3.0))})
    assert tuple(spark.range(1).select(*four["br"]).first()) == (2.0, 3.0)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not there")
@pytest.mark.parametrize("name", ["legend_box", "legend_erase"])
def test_legend_with_points_beyond_the_edge(spark, tmp_path, name):
    import duckdb

    from tracegrid.plans import queries

    con = duckdb.connect()
    # items at 105,000 are pixels of row 50 of 50
    con.execute("CREATE TABLE lineitem AS FROM '/root/testdata/sf0.001/lineitem.parquet'")
    con.execute("INSERT INTO lineitem SELECT * REPLACE (105000.0 AS l_extendedprice) FROM lineitem WHERE l_orderkey < 40")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    want = con.sql(queries.ORACLES[name]).fetchall()
    assert want and sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_legend_box_by_every_place(spark):
    rng = np.random.default_rng(4)
    rows = []
    for image in range(6):
        legend = {(int(a), int(b)) for a, b in rng.integers(0, 9, (60, 2)) + rng.integers(0, 30, 2)}
        rows += [(image, a, b) for a, b in legend | {(int(a), int(b)) for a, b in rng.integers(-4, 45, (2 + image, 2))}]
    got = {r["image_id"]: tuple(r)[1:] for r in pixels.legend_box(spark.createDataFrame(rows, "image_id int, x int, y int"), 40, 30).collect()}

    def first(points):
        shares = (0.15, 0.2, 0.25, 0.3, 0.35)
        for w, h in ((round(fx * 40), round(fy * 30)) for fx in shares for fy in shares):
            for y0 in range(-h + 1, 30):
                for x0 in range(-w + 1, 40):
                    a, b, c, d = max(0, x0), max(0, y0), min(40, x0 + w), min(30, y0 + h)
                    out = [(x, y) for x, y in points if not (a <= x < c and b <= y < d)]
                    n = len(points) - len(out)
                    if n >= 20 and n >= 0.002 * (c - a) * (d - b) and out and min(np.hypot(max(a - x, 0, x - c), max(b - y, 0, y - d)) for x, y in out) >= 0.07 * 40:
                        return a, b, c, d
        return None

    want = {i: first([(x, y) for k, x, y in rows if k == i]) for i in range(6)}
    assert got == {i: box for i, box in want.items() if box} and 1 < len(got)


def test_silhouette_query_scores_every_point(spark, tmp_path):
    from tracegrid.operators import cluster
    from tracegrid.plans import queries

    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(4100, 4)).astype(np.float32), rng.integers(0, 3, 4100)
    x[4000:] = x[0] + 1e-3 * x[4000:]  # near one point, so that differences are small
    label[label == 2] = np.where(np.arange((label == 2).sum()) < 1, 2, 0)  # one alone
    pd.DataFrame({"vec_id": np.arange(4100), "embedding": list(x), "label": label.astype(np.int32)}).to_parquet(tmp_path / "embeddings.parquet")
    want = cluster.silhouette_values(x.astype(float), label).mean()
    assert [tuple(r) for r in queries.QUERIES["silhouette"](spark, str(tmp_path)).collect()] == [(0, 4100, round(want, 6))]


def test_best_candidate_by_every_candidate():
    """The grid's kernel against each candidate sampled and scored on its own."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 50, 600).astype(float), rng.normal(size=600)
    config = replace(EngineConfig(), max_roughness=4.0)
    sets = [(int(c), n, np.sort(rng.choice(600, s, replace=False))) for n, (c, s) in enumerate(zip(rng.integers(0, 5, 300), rng.integers(1, 90, 300), strict=True))]
    sets += [(c, n + 300, at) for c, n, at in sets]  # equal points: the first counts
    sets += [(5, 600, np.arange(11)), (6, 601, np.flatnonzero((x > 10) & (x < 20)))]  # too few, too narrow
    best = curves.Best(x, y, 50.0, 40, config)
    want = {}
    for c, n, at in sets:
        best.offer(c, n, at)
        at = at[curves.farthest_points(x[at], y[at], 40)]
        at = at[np.argsort(x[at], kind="stable")]
        coverage, rough = np.ptp(x[at]) / 50, curves.roughness_of(x[at], y[at])
        if len(at) >= 12 and coverage >= 0.4 and rough <= 4.0:
            want[c] = min(want.get(c, ((1,), None)), ((-len(at), rough, -coverage, n), at), key=lambda w: w[0])
    best.judge()
    assert 1 < len(want) and best.best.keys() == want.keys()
    for c, (rank, at) in want.items():
        assert best.best[c][0] == rank and best.best[c][1].tolist() == x[at].tolist() and best.best[c][2].tolist() == y[at].tolist()


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not there")
def test_auto_query_writes_no_rows_for_candidates(spark, monkeypatch):
    from tracegrid.plans import queries

    written = {}
    kept = digitize.materialise
    monkeypatch.setattr(digitize, "materialise", lambda df, name: written.setdefault(name, kept(df, name)))
    queries.QUERIES["auto_colours_pipeline"](spark, "/root/testdata/sf0.001")
    pixels_read = written["curve-pixels"].count()
    assert all(df.count() <= 2 * pixels_read for df in written.values())
