"""Images as pixel tables: Spark's image source, its rows exploded in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The JVM reads these; webp is not among them.
SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Images at a path or paths: image_id (the origin), width, height, channels, data; unreadable files have readable = false."""
    image = spark.read.format("image").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").option("recursiveFileLookup", "true").load(path)
    return image.select(F.col("image.origin").alias("image_id"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), (F.col("image.height") > 0).alias("readable"))


def pixels(images: DataFrame) -> DataFrame:
    """image_id, width, height, x, y, pix_idx, b, g, r per pixel of the readable images; one channel stands for all three, alpha is dropped."""
    good = images.filter("readable AND width > 0")
    rows = good.select("image_id", "width", "height", "channels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    line = F.col("data").substr(F.col("y") * F.col("width") * F.col("channels") + 1, F.col("width") * F.col("channels"))
    rows = rows.select("image_id", "width", "height", "channels", "y", F.hex(line).alias("line"))
    wide = rows.select("image_id", "width", "height", "channels", "y", "line", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    at = F.col("x") * F.col("channels")
    byte = lambda k: F.conv(F.col("line").substr((at + k) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    one = F.col("channels") == 1
    return wide.select(
        "image_id", "width", "height", "x", "y", (F.col("y").cast("long") * F.col("width") + F.col("x")).alias("pix_idx"),
        byte(0).alias("b"), F.when(one, byte(0)).otherwise(byte(1)).alias("g"), F.when(one, byte(0)).otherwise(byte(2)).alias("r"),
    )


def unreadable(images: DataFrame) -> DataFrame:
    return images.filter("NOT readable").select("image_id", F.lit("unreadable image").alias("warning"))
