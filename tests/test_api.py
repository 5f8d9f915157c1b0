"""Digitising end to end: calibrations by hand, by markers and by marked corners, failures, files, jobs, the command line and streams."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_digitizer import png

from tracegrid import cli
from tracegrid.config import AxisCalibration, CalibrationPoint, DigitizeOptions, EngineConfig, Limits, exactly_three
from tracegrid.functions import colour, geometry, names
from tracegrid.functions.geometry import Frame
from tracegrid.operators import cluster, curves, pixels
from tracegrid.plans import api, digitize
from tracegrid.sources.images import pixels as pixels_of
from tracegrid.sources.images import read_images
from tracegrid.streaming.ingest import digitize_stream

PURPLE = (103, 53, 140)


def chart(width=80, height=60, markers=True, top=5):
    """A purple diagonal from (10, 50) to (70, top); the red markers at the corners of the axes."""
    image = np.full((height, width, 3), 255, np.uint8)
    if markers:
        for x, y in ((10, 50), (70, 50), (10, top)):
            image[y - 2 : y + 3, x - 2 : x + 3] = (255, 0, 0)
    for x in range(14, 67):
        image[50 - round((x - 10) * (50 - top) / 60), x] = PURPLE
    return image


def hand(origin=(10, 50), x=(70, 50), y=(10, 5), data=((0.0, 0.0), (2.0, 0.0), (0.0, 4.0))):
    return AxisCalibration(*[CalibrationPoint(p, d) for p, d in zip((origin, x, y), data, strict=True)])


def inner(rows, high):
    return [(r["x"], r["y"]) for r in rows if 0 < r["x"] < high]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("charts")
    png(at / "a.png", chart())
    png(at / "b.png", chart(90, 64, top=9))
    return at


def test_images_of_different_sizes_by_their_markers(spark, folder):
    limits = spark.createDataFrame([("a.png", 1.0, 1.0), ("b.png", 10.0, 5.0)], "name string, xmax double, ymax double")
    images = read_images(spark, str(folder))
    bounds = images.withColumn("name", F.element_at(F.split("image_id", "/"), -1)).join(limits, "name").select("image_id", F.lit(0.0).alias("xmin"), "xmax", F.lit(0.0).alias("ymin"), "ymax")
    result = api.digitize_images(images, None, bounds, DigitizeOptions(k=30))
    rows = result.curves.collect()
    for name, xmax, ymax in (("a.png", 1.0, 1.0), ("b.png", 10.0, 5.0)):
        own = [r for r in rows if r["image_id"].endswith(name)]
        assert {r["curve_idx"] for r in own} == {1} and [r["pt_idx"] for r in sorted(own, key=lambda r: r["pt_idx"])] == list(range(1, len(own) + 1))
        points = inner(own, xmax)
        assert len(points) == 30 and all(abs(x / xmax - y / ymax) < 0.05 for x, y in points)
    assert result.failures.count() == 0 and result.warnings.count() == 0


def test_a_calibration_by_hand_comes_before_markers(spark, folder, tmp_path):
    result = api.digitize(spark, f"{folder}/a.png", hand(), options=DigitizeOptions(k=30))
    points = inner(result.curves.collect(), 2.0)
    assert len(points) == 30 and all(abs(2 * x - y) < 0.2 for x, y in points)
    tilted = hand(data=((0.0, 0.0), (2.0, 1.0), (0.5, 4.0)))
    warned = api.digitize(spark, f"{folder}/a.png", tilted, options=DigitizeOptions(k=30))
    assert sorted(r["warning"] for r in warned.warnings.collect()) == sorted(tilted.warnings()) and len(tilted.warnings()) == 2
    # one image by hand, the other by its markers
    images = read_images(spark, str(folder))
    own = api.calibration_rows(images.filter("image_id LIKE '%b.png'"), hand(y=(10, 9)))
    mixed = api.digitize_images(images, own, Limits(0.0, 1.0, 0.0, 1.0), DigitizeOptions(k=30)).curves
    assert {r["image_id"][-5:]: r["m"] for r in mixed.groupBy("image_id").agg(F.max("x").alias("m")).collect()} == {"a.png": 1.0, "b.png": 2.0}


def test_marker_discs_are_no_curve(spark):
    image = chart(markers=False)
    image[46:53, 6:14] = PURPLE
    rows = [(1, 80, 60, x, y, y * 80 + x, int(p[2]), int(p[1]), int(p[0])) for y, line in enumerate(image) for x, p in enumerate(line)]
    table = spark.createDataFrame(rows, "image_id int, width int, height int, x int, y int, pix_idx long, b int, g int, r int")
    frame = Frame(10, 50, 70, 50, 10, 5)
    plain, marked = (digitize.single_colour(table, frame, DigitizeOptions(k=60), marked=m).filter("x < 0.06 AND y > 0").count() for m in (False, True))
    assert plain > marked == 0


def test_marked_corners_and_failures(spark, tmp_path):
    image = chart(markers=False)
    for x, y in ((70, 50), (10, 5), (70, 5)):  # the origin is inferred
        image[y - 2 : y + 3, x - 2 : x + 3] = (255, 0, 0)
    png(tmp_path / "three.png", image)
    out = api.digitize_marked(spark, f"{tmp_path}/three.png", xmin=0.0, xmax=1.0, ymin=0.0, ymax=1.0, options=DigitizeOptions(k=30))
    points = inner(out.curves.collect(), 1.0)
    assert len(points) >= 28 and all(abs(x - y) < 0.05 for x, y in points)
    png(tmp_path / "none.png", chart(markers=False))
    with pytest.raises(ValueError, match="three marked corners"):
        api.digitize_marked(spark, f"{tmp_path}/none.png", xmin=0.0, xmax=1.0, ymin=0.0, ymax=1.0)
    with pytest.raises(ValueError, match="xmax, ymin"):
        api.digitize(spark, f"{tmp_path}/three.png", xmin=0.0, ymax=1.0)
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(RuntimeError, match="unreadable"):
        api.digitize(spark, f"{tmp_path}/bad.png", hand())
    png(tmp_path / "white.png", np.full((60, 80, 3), 255, np.uint8))
    with pytest.raises(RuntimeError, match="no curve"):
        api.digitize(spark, f"{tmp_path}/white.png", hand())


def test_validation():
    with pytest.raises(ValueError, match="must differ"):
        Limits(1.0, 1.0, 0.0, 2.0)
    with pytest.raises(ValueError, match="number"):
        Limits("1", 2.0, 0.0, 2.0)
    with pytest.raises(ValueError, match="two numbers"):
        CalibrationPoint((1.0,), (0.0, 0.0))
    with pytest.raises(ValueError, match="exactly three"):
        exactly_three({"tl": (0, 0), "tr": (1, 0), "bl": None})
    assert set(exactly_three({"tl": (0, 0), "tr": (1, 0), "bl": (0, 1), "br": None})) == {"tl", "tr", "bl"}
    with pytest.raises(ValueError):
        EngineConfig(feature_space="hsv")
    with pytest.raises(SystemExit):
        cli.main(["a.png", "--out", "o", "--origin-px", "1,2"], spark=None)
    assert cli.pair(" 1.5, -2") == (1.5, -2.0)


def test_command_line_and_files(spark, folder, tmp_path, capsys):
    args = ["--origin-px", "10,50", "--origin-data", "0,0", "--x-px", "70,50", "--x-data", "2,0.5", "--y-px", "10,5", "--y-data", "0,4", "--k", "20"]
    cli.main([f"{folder}/a.png", "--out", str(tmp_path / "out"), *args], spark=spark)
    files = list((tmp_path / "out").rglob("*.csv"))
    lines = files[0].read_text().splitlines()
    assert len(files) == 1 and lines[0] == "x,y" and len(lines) == 23 and "warning" in capsys.readouterr().out
    xs = [float(line.split(",")[0]) for line in lines[1:]]
    assert xs == sorted(xs)
    cli.main([f"{folder}/*.png", "--out", str(tmp_path / "engine"), "--xmin", "0", "--xmax", "1", "--ymin", "0", "--ymax", "1", "--k", "20", "--engine-csv"], spark=spark)
    assert len(list((tmp_path / "engine").rglob("*.csv"))) == 2


def test_wide_tables(spark):
    rows = [("i", 3, 1, 1.0, 1 / 3), ("i", 3, 2, 2.0, 1e-7), ("i", 7, 1, 123456789.123456, 5.0), ("j", 2, 1, 0.0, 1.0)]
    held = curves.renumber(spark.createDataFrame(rows, "image_id string, curve_idx int, pt_idx long, x double, y double"))
    assert sorted((r["image_id"], r["curve_idx"], r["pt_idx"]) for r in held.collect()) == [("i", 1, 1), ("i", 1, 2), ("i", 2, 1), ("j", 1, 1)]
    cells = {(r["image_id"], r["pt_idx"]): tuple(r)[2:] for r in curves.engine_table(held, 2).collect()}
    assert cells == {("i", 1): ("1", "0.333333333333", "123456789.123", "5"), ("i", 2): ("2", "1e-07", "", ""), ("j", 1): ("0", "1", "", "")}
    result = api.DigitizeResult(held, None, None)
    assert result.most_curves() == 2 and result.to_table().columns == ["image_id", "pt_idx", "curve1_x", "curve1_y", "curve2_x", "curve2_y"]


def test_jobs(spark, folder):
    jobs = spark.createDataFrame([("a.png", 0.0, 1.0, 0.0, 1.0, 20), ("b.png", 0.0, 4.0, 0.0, 1.0, 25)], "image string, xmin double, xmax double, ymin double, ymax double, k int").withColumn("auto_colors", F.lit(False))
    out = api.run_jobs(read_images(spark, str(folder)), jobs)
    assert {r["out"]: (r["n"], r["m"]) for r in out.groupBy("out").agg(F.count("*").alias("n"), F.max("x").alias("m")).collect()} == {"a.csv": (22, 1.0), "b.csv": (27, 4.0)}


def test_stream_reads_the_new_files(spark, folder, tmp_path):
    got = []
    frame = Frame(10, 50, 70, 50, 10, 5)
    for _ in range(2):
        digitize_stream(spark, str(folder), str(tmp_path / "state"), lambda table: digitize.single_colour(table, frame, DigitizeOptions(k=10)), lambda found, n: got.append({r["image_id"][-5:] for r in found.select("image_id").distinct().collect()}), per_batch=1).awaitTermination(120)
    assert sorted(map(sorted, got)) == [["a.png"], ["b.png"]]


def two_colours(side=24):
    rows = []
    for y in range(side):
        for x in range(side):
            r, g, b = (200, 30, 200) if y in (5, 6) else (20, 140, 20) if y in (15, 16) else (255, 255, 255)
            rows.append((1, side, side, x, y, y * side + x, b, g, r))
    return rows


@pytest.mark.parametrize("space", ["lab", "rgb"])
def test_clusters_labels_colours_and_layers(spark, space):
    table = spark.createDataFrame(two_colours(), "image_id int, width int, height int, x int, y int, pix_idx long, b int, g int, r int")
    config = replace(EngineConfig(), feature_space=space)
    options = DigitizeOptions(auto_colors=True, num_colors=2, keep_outside_axes=True)
    frame = Frame(0, 23, 23, 23, 0, 0)
    features = digitize.clustering_pixels(table, frame, 10.0, options, config)
    norm, centres, labels = digitize.colour_clusters(features, options, config)
    shown = sorted((r["r"], r["g"], r["b"]) for r in digitize.centre_colours(centres, norm, config).collect())
    assert all(abs(a - b) <= 3 for p, q in zip(shown, [(20, 140, 20), (200, 30, 200)], strict=True) for a, b in zip(p, q, strict=True))
    found = {(r["x"], r["y"]): r["centre"] for r in labels.collect()}
    assert len(found) == 96 and len({c for (_, y), c in found.items() if y < 10}) == 1 and len(set(found.values())) == 2
    again = {(r["x"], r["y"]): r["label"] for r in digitize.assign_pixels(features, centres, norm, config).collect()}
    assert again == found
    layers = {r["layer"]: r["n"] for r in api.debug_layers(table, frame, 24, 24, options, config).groupBy("layer").agg(F.count("*").alias("n")).collect()}
    assert layers["candidate"] == layers["curve"] == 96 and layers["reference"] > 96 and layers["axes"] == 3
    moved = digitize.reference_curves(labels.withColumnRenamed("centre", "label"), 24, 24).collect()
    assert len(moved) == 96 and all(abs(r["sx"] - r["x"]) <= 3 and abs(r["sy"] - r["y"]) <= 3 for r in moved)


def test_scores_of_k(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i % 20, i // 20, i, *map(float, np.repeat([0.0, 0.5, 1.0], 3).reshape(3, 3)[i % 3] + rng.normal(size=3) * 0.01)) for i in range(300)]
    df = spark.createDataFrame(rows, "image_id int, x int, y int, pix_idx long, f0 double, f1 double, f2 double")
    found = cluster.discover_labels(df, ["f0", "f1", "f2"], k_max=5, config=replace(EngineConfig(), icm_sweeps=1, icm_neighbour=0.0)).cache()
    scores = {r["k"]: r["score"] for r in cluster.scores_of(found).collect()}
    assert sorted(scores) == [2, 3, 4, 5] and max(scores, key=scores.get) == 3 and cluster.centres_of(found).count() == 3 and cluster.labels_of(found).count() == 300


def test_roughness_methods_and_missing_features():
    x = np.arange(40.0)
    y = np.where(x == 20, 9.0, x / 10)
    assert curves.roughness_of(x, y, method="median_abs") < 1e-9 < curves.roughness_of(x, y)
    assert curves.roughness_of(x[:4], y[:4], method="median_abs") == float("inf")
    with pytest.raises(ValueError):
        colour.features("hsv", None, None, None)


def test_rolling_prune_keeps_its_budget():
    rng = np.random.default_rng(5)
    y = rng.normal(size=100)
    y[20:60:2] += 50
    config = replace(EngineConfig(), rolling_sigma=0.5)
    x, kept = curves.prune_rolling(np.arange(100.0), y, config)
    assert len(kept) == 80 and x[0] == 0 and x[-1] == 99  # a fifth, over several passes
    one = curves.rolling_scores(y, config.rolling_window)
    first = np.argsort(-one, kind="stable")[:20]
    gone = set(range(100)) - set(x.astype(int))
    assert gone == set(first.tolist())


def test_settled_image(spark):
    """A short curve is continued by the one that its end lies on; a point astray goes to the curve it lies on."""
    rows = [(1, 1, i + 1, float(i), 1.0 + i) for i in range(20)] + [(1, 2, i + 1, float(i), 1.5 + i) for i in range(30)]
    out = curves.settle_image(spark.createDataFrame(rows, "image_id int, curve_idx int, pt_idx long, x double, y double")).collect()
    assert max(r["x"] for r in out if r["curve_idx"] == 1) == 29.0
    rows = [(1, 1, i + 1, float(i), 40.0 if i == 10 else 0.0) for i in range(21)] + [(1, 2, i + 1, i + 0.5, 40.0) for i in range(20)]
    out = curves.settle_image(spark.createDataFrame(rows, "image_id int, curve_idx int, pt_idx long, x double, y double")).collect()
    assert {(r["x"], r["y"]) for r in out if r["curve_idx"] == 1} == {(float(i), 0.0) for i in range(21) if i != 10}
    assert (10.0, 40.0) in {(r["x"], r["y"]) for r in out if r["curve_idx"] == 2}


def test_interp_distance_at_equal_x(spark):
    kind = "image_id int, curve_idx int, pt_idx long, x double, y double"
    lines = spark.createDataFrame([(1, 2, 1, 0.0, 0.0), (1, 2, 2, 2.0, 4.0), (1, 2, 3, 2.0, 8.0), (1, 2, 4, 3.0, 8.0), (1, 3, 1, 1.0, 5.0)], kind)
    asks = spark.createDataFrame([(1, 1, i + 1, x, 5.0) for i, x in enumerate([-1.0, 0.0, 1.0, 2.0, 2.5, 3.0, 4.0])], kind)
    got = {(r["pt_idx"], r["other"]): r["gap"] for r in curves.interp_distance(asks, lines).collect()}
    assert got == {(2, 2): 5.0, (3, 2): 3.0, (4, 2): 1.0, (5, 2): 3.0, (6, 2): 3.0}


def test_chamfer_at_the_border(spark):
    mask = spark.createDataFrame([(1, x, y) for y in range(3) for x in range(4)], "image_id int, x int, y int")
    got = {(r["x"], r["y"]): round(r["dt"], 4) for r in pixels.chamfer(mask, 6, 3).collect()}
    assert got[0, 0] == round(4 * 0.955, 4) and got[3, 1] == 0.955  # beyond the image there is no background


def test_pairs_names_and_geometry(spark):
    df = spark.createDataFrame([("1,2",), (" 3 , -4.5 ",), ("1",), ("1,2,3",), ("a,1",), (None,)], "t string")
    got = [r[0] for r in df.select(names.parse_pair(F.col("t"))).collect()]
    assert got == [[1.0, 2.0], [3.0, -4.5], None, None, None, None]
    wide = spark.createDataFrame([("Ｆｉｇ – 1",), ("A -⁃2",), (None,)], "n string")
    assert [r[0] for r in wide.select(names.norm_name(F.col("n"))).collect()] == ["fig-1", "a-2", None]
    at = spark.range(1).select(*geometry.canvas_to_image(F.lit(90.0), F.lit(-3.0), 2.0, 40, 30)).first()
    assert tuple(at) == (39.0, 0.0)
    assert tuple(spark.range(1).select(*geometry.rect_clip(F.lit(-2), F.lit(5), F.lit(4), F.lit(4), 10, 7)).first()) == (0, 5, 2, 7)
    assert tuple(spark.range(1).select(*geometry.rect_clip(F.lit(10), F.lit(5), F.lit(4), F.lit(4), 10, 7)).first()) == (None,) * 4
