"""Deterministic views of the driver's tables as pixels, features, curves and names. The items of 4,000 neighbouring orders are an
image's pixels, eight neighbouring users an image's curves, so images grow in number with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions.geometry import Frame
from tracegrid.session import table

SIDE = 50
#: Calibration of the 50 x 50 views: origin bottom left, y upward.
FRAME = Frame(2.0, 47.0, 47.0, 47.0, 2.0, 2.0, 1.0, 1000.0, 0.5, 200.0)

PIXELS_SQL = """pixels AS (SELECT image_id, x, y, (y * 50 + x)::BIGINT AS pix_idx, ((53 * k + 7) % 256)::INTEGER AS b, ((91 * k + 3) % 256)::INTEGER AS g,
 ((37 * k + 11) % 256)::INTEGER AS r FROM (SELECT (l_orderkey // 4000)::INTEGER AS image_id, l_quantity::INTEGER - 1 AS x, floor(l_extendedprice / 2100)::INTEGER AS y, min(l_orderkey) AS k
 FROM lineitem GROUP BY ALL))"""
CURVES_SQL = """curves AS (SELECT user_id // 8 AS image_id, user_id AS curve_idx, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt_idx,
 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS x, value AS y FROM events)"""


def pixel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4000).cast("int").alias("image_id"), (F.col("l_quantity").cast("int") - 1).alias("x"), F.floor(F.col("l_extendedprice") / 2100).cast("int").alias("y"), "l_orderkey")
    k = F.col("k")
    one = items.groupBy("image_id", "x", "y").agg(F.min("l_orderkey").alias("k"))
    channel = lambda a, c: ((k * a + c) % 256).cast("int")
    return one.select("image_id", "x", "y", (F.col("y") * SIDE + F.col("x")).cast("long").alias("pix_idx"), channel(53, 7).alias("b"), channel(91, 3).alias("g"), channel(37, 11).alias("r"))


def curve_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    x = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / F.lit(1e6)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.floor(F.col("user_id") / 8).alias("image_id"), F.col("user_id").alias("curve_idx"), F.row_number().over(order).cast("long").alias("pt_idx"), x.alias("x"), F.col("value").alias("y"))


def feature_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("f"))


def first_centres(features: DataFrame) -> DataFrame:
    """One centre a label: its first vector."""
    return features.groupBy(F.col("label").alias("centre")).agg(F.min_by("f", "vec_id").alias("c"))
