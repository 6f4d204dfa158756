"""Images, masks, polygons and boxes made from the test tables, which hold no image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import explode_pixels


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images with background, one per vector: (image, pixels)."""
    level = lambda v: F.floor(F.greatest(v.cast("double"), F.lit(0.0)) * 400).cast("int")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", level).alias("pixels"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_pixels(gray_images(spark, sf_dir), width=8)


def on_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, x, y) of the pixels that a mask of level 40 has."""
    return gray(spark, sf_dir).where("v > 40").select("image", "x", "y")


def mosaic(spark: SparkSession, sf_dir: str, columns: int = 25) -> DataFrame:
    """All images side by side in one: (image, c, x, y, v), rows of ``columns`` images."""
    tile = F.col("image")
    return gray(spark, sf_dir).select(F.lit(0).alias("image"), "c", (F.pmod(tile, F.lit(columns)) * 8 + F.col("x")).alias("x"), (F.floor(tile / columns) * 8 + F.col("y")).alias("y"), "v")


def image_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, object, poly): one polygon per ten events, two an image, inside the 8 x 8 image: (1 + 5 event_id mod 6, 1 + floor(value) mod 6)."""
    ten = F.floor(F.col("event_id") / 10)
    rings = _rings(spark, sf_dir, F.pmod(F.col("event_id") * 5, F.lit(6)) + 1, F.pmod(F.floor("value"), F.lit(6)) + 1, ten)
    return rings.select(F.floor(F.col("object") / 2).alias("image"), F.pmod("object", F.lit(2)).cast("int").alias("object"), "poly")


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers as 4 x 4 images of 4 channels."""
    return explode_pixels(gray_images(spark, sf_dir), width=4, channels=4)


def _rings(spark: SparkSession, sf_dir: str, x: Column, y: Column, of: Column) -> DataFrame:
    """(object, poly): the distinct points of each object, three or more, in angular order."""
    from ..functions.polygons import dedup_points, order_points, settled

    point = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    raw = read(spark, sf_dir, "events").where("value is not null").groupBy(of.alias("object")).agg(F.collect_set(point).alias("points"))
    out = raw.where(F.size("points") > 2)
    return settled(out.select("object", "points"), {"poly": order_points(dedup_points(F.col("points")))}).select("object", "poly")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per user: distinct (event_id mod 24, floor(value))."""
    return _rings(spark, sf_dir, F.pmod("event_id", F.lit(24)), F.floor("value"), F.col("user_id"))


def small_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per ten events, of ten points at most: (7 event_id mod 24, floor(value))."""
    return _rings(spark, sf_dir, F.pmod(F.col("event_id") * 7, F.lit(24)), F.floor("value"), F.floor(F.col("event_id") / 10))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per order: the extents of line number and quantity."""
    n, q = F.col("l_linenumber").cast("double"), F.col("l_quantity")
    one = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("object")).agg(F.min(n).alias("x_min"), F.min(q).alias("y_min"), F.max(n).alias("x_max"), F.max(q).alias("y_max"))
    return one.select("object", F.struct("x_min", "y_min", "x_max", "y_max").alias("bbox"))


#: The same tables in DuckDB SQL, as common table expressions.
GRAY_SQL = """px AS (SELECT image, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, 0 AS c, CAST(floor(greatest(CAST(e AS DOUBLE), 0e0) * 400) AS INTEGER) AS v
  FROM (SELECT vec_id AS image, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings))"""
CLIPPED_SQL = GRAY_SQL.replace("CAST(floor(", "CAST(least(255, floor(").replace("* 400) AS", "* 400)) AS")
MULTI_SQL = """px AS (SELECT image, CAST((i // 4) % 4 AS INTEGER) AS x, CAST(i // 16 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS c, CAST(floor(greatest(CAST(e AS DOUBLE), 0e0) * 400) AS INTEGER) AS v
  FROM (SELECT vec_id AS image, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings))"""
POLYGON_SQL = """pt AS (SELECT DISTINCT user_id AS object, CAST(event_id % 24 AS DOUBLE) AS x, floor(value) AS y FROM events WHERE value IS NOT NULL),
mid AS (SELECT object, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pt GROUP BY object HAVING count(*) > 2),
ring AS (SELECT object, x, y, mx, my, n, row_number() OVER (PARTITION BY object ORDER BY -round(atan2(y - my, x - mx), 9), round(pow(x - mx, 2) + pow(y - my, 2), 9), x, y) AS k FROM pt JOIN mid USING (object)),
edge AS (SELECT a.object, a.k, a.n, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, a.mx, a.my FROM ring a JOIN ring b ON a.object = b.object AND b.k = a.k % a.n + 1)"""
IMAGE_POLYGON_SQL = POLYGON_SQL.replace("user_id AS object, CAST(event_id % 24 AS DOUBLE) AS x, floor(value) AS y", "event_id // 10 AS object, CAST(event_id * 5 % 6 + 1 AS DOUBLE) AS x, CAST(CAST(floor(value) AS BIGINT) % 6 + 1 AS DOUBLE) AS y")
SMALL_SQL = POLYGON_SQL.replace("user_id AS object, CAST(event_id % 24 AS DOUBLE)", "event_id // 10 AS object, CAST(event_id * 7 % 24 AS DOUBLE)")
MOSAIC_SQL = GRAY_SQL.replace("px AS (SELECT image, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y", "px AS (SELECT 0 AS image, image % 25 * 8 + i % 8 AS x, image // 25 * 8 + i // 8 AS y")
BOX_SQL = """box AS (SELECT l_orderkey AS object, CAST(min(l_linenumber) AS DOUBLE) AS x_min, min(l_quantity) AS y_min, CAST(max(l_linenumber) AS DOUBLE) AS x_max, max(l_quantity) AS y_max FROM lineitem GROUP BY 1)"""
