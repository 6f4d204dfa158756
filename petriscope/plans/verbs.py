"""The verbs, each a function from DataFrames to a DataFrame.

Images are (image, im), with mask (a label image), polygons or boxes beside
them once paired.  Every verb is one narrow pass: images are never shuffled by
it, and :func:`spread` deals them evenly where a few hold most objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import pair_key
from ..operators import neural as N
from ..operators import objects as O
from ..schema import profile_columns
from ..sources import readers
from ..sources.catalogs import MODELS

KINDS = {"mask": "mask", "polygons": "polygons", "boxes": "boxes"}


def pair(images: DataFrame, segments: DataFrame, kind: str, substring_images: str | None = None, substring_segments: str | None = None) -> DataFrame:
    """(image, id, im, mask | polygons | boxes) of files with one key; the last image of a key holds, files with errors stay out."""
    value = {"mask": "im"}.get(kind, kind)
    a = images.where(F.col("error").isNull()).select(pair_key(F.col("stem"), substring_images).alias("id"), F.col("stem").alias("image"), "path", "im")
    last = a.groupBy("id").agg(F.max("path").alias("path"))
    a = a.join(last, ["id", "path"], "left_semi").drop("path")
    b = segments.where(F.col("error").isNull()).select(pair_key(F.col("stem"), substring_segments).alias("id"), F.col(value).alias(kind))
    return a.join(b, "id").select("image", "id", "im", kind)


def check_folders(images: str, segments: str, substring_images: str | None = None, substring_segments: str | None = None) -> None:
    """Images and segmentations in one folder must be told apart by their substrings."""
    if images.rstrip("/") == segments.rstrip("/") and substring_images == substring_segments:
        raise ValueError("images and segmentations in one folder need different substrings")


def pair_folders(spark: SparkSession, images: str, segments: str, kind: str = "mask", substring_images: str | None = None, substring_segments: str | None = None) -> DataFrame:
    """The files of two folders, read and paired."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    check_folders(images, segments, substring_images, substring_segments)
    read = {"mask": readers.read_masks, "polygons": readers.read_polygons, "boxes": readers.read_boxes}[kind]
    return pair(readers.read_images(spark, images, substring_images), read(spark, segments, substring_segments), kind, substring_images, substring_segments)


def spread(paired: DataFrame, tasks: int) -> DataFrame:
    """Images dealt evenly over tasks, so that one dense folder doesn't fill one task."""
    return paired.repartition(tasks)


def _check(kind: str, mode: str, min_size: int) -> None:
    profile_columns(mode, kind == "boxes")
    if min_size < 1:
        raise ValueError("min_size must be positive")


def profile(paired: DataFrame, kind: str = "mask", mode: str = "cm", pad: int = 1, min_size: int = 1, compat: bool = False) -> DataFrame:
    """(image, object, descriptors…, error), one row per object; ``mode`` picks the families."""
    _check(kind, mode, min_size)
    rows, schema = O.profile_rows(kind, mode, pad, min_size, compat)
    return O.over_rows(paired.select("image", "im", kind), rows, schema)


def process(paired: DataFrame, kind: str = "mask", mode: str = "c", pad: int = 1, min_size: int = 1, compat: bool = False) -> DataFrame:
    """(image, object, part, im, error): crops, to be written with ``write_images``."""
    _check(kind, mode, min_size)
    rows, schema = O.process_rows(kind, mode, pad, min_size, compat)
    return O.over_rows(paired.select("image", "im", kind), rows, schema)


def measure(images: DataFrame, family: str, compat: bool = False) -> DataFrame:
    """One family of descriptors (intensity, moments, texture, zernike) of whole images."""
    rows, schema = O.measure_rows(family, compat)
    return O.over_rows(images.select("image", "im"), rows, schema)


def measure_form(polygons: DataFrame, compat: bool = False) -> DataFrame:
    """The 23 form descriptors of each polygon of (image, polygons)."""
    rows, schema = O.form_rows(compat)
    return O.over_rows(polygons.select("image", "polygons"), rows, schema)


def embed(images: DataFrame, weights: str, model: str = "dino_vit_small", kind: str | None = None, pad: int = 1, min_size: int = 1, compat: bool = False) -> DataFrame:
    """Embeddings of whole images, or of the objects of paired ones."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    rows, schema = N.embed_rows(model, weights, kind, pad, min_size, compat)
    return O.over_rows(images.select("image", "im", *([kind] if kind else [])), rows, schema)


def mask_to_polygons(masks: DataFrame) -> DataFrame:
    """(image, object, label, poly, bbox, width, height, error) of (image, im) label images."""
    return O.over_rows(masks.select("image", "im"), O.mask_objects, O.OBJECTS)


def mask_to_boxes(masks: DataFrame) -> DataFrame:
    return mask_to_polygons(masks).select("image", "object", "label", "bbox", "error")


def object_counts(objects: DataFrame) -> DataFrame:
    """(image, n)."""
    return objects.where(F.col("error").isNull()).groupBy("image").agg(F.count("*").alias("n"))


def object_errors(objects: DataFrame) -> DataFrame:
    """(image, error)."""
    return objects.where(F.col("error").isNotNull()).select("image", "error")


def write_status(objects: DataFrame, folder: str) -> None:
    """object_counts.tsv and object_errors.tsv in ``folder``, without a header, each only if it has rows.

    Both are folders of part files, as Spark writes them.
    """
    for name, rows in (("object_counts", object_counts(objects)), ("object_errors", object_errors(objects))):
        if not rows.isEmpty():
            rows.write.option("sep", "\t").csv(f"{folder}/{name}.tsv")


def long_form(table: DataFrame, keys: list[str]) -> DataFrame:
    """A descriptor table as (keys, name, value) rows."""
    names = [c for c in table.columns if c not in (*keys, "error")]
    return table.unpivot(keys, names, "name", "value")


def image_of(pixels: Column, width: int, height: int, channels: int = 1) -> Column:
    """The image struct of an array of 8-bit values."""
    data = F.unhex(F.array_join(F.transform(pixels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(channels).alias("channels"), F.lit("u1").alias("dtype"), data.alias("data"))


def register_sql(spark) -> None:
    """``mask_objects(im)`` as a table function for SQL: one row per object of a label image."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="object int, label long, poly array<struct<x:double,y:double>>")
    class MaskObjects:
        def eval(self, im):
            from petriscope.operators import kernels as K
            from petriscope.operators.objects import points
            from petriscope.sources.codecs import unpack_image

            _, labels, polygons = K.label_polygons(unpack_image(im.asDict())[:, :, 0])
            for k, (label, p) in enumerate(zip(labels, polygons, strict=True)):
                yield k, label, points(p)

    spark.udtf.register("mask_objects", MaskObjects)
