"""The pixel relation: (image, c, x, y, v), and images kept as arrays.

Reading an image from an array column needs no shuffle; the exploded form is
for aggregation, where Spark combines the rows of an image before it moves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IMAGE_FORMATS
from .ordering import numbered


def explode_pixels(images: DataFrame, pixels: str = "pixels", width: Column | int = 8, channels: Column | int = 1) -> DataFrame:
    """(other columns, c, x, y, v) of row-major, channel-interleaved arrays."""
    w, k = (F.lit(n) if isinstance(n, int) else n for n in (width, channels))
    rest = [c for c in images.columns if c != pixels]
    out = images.select(*rest, w.alias("__w"), k.alias("__k"), F.posexplode(pixels).alias("__i", "v"))
    at = F.expr("__i div __k").cast("int")
    return out.select(*rest, F.expr("cast(__i % __k as int)").alias("c"), (at % F.col("__w")).alias("x"), F.floor(at / F.col("__w")).cast("int").alias("y"), "v")


def implode_pixels(pixels: DataFrame, by: list[str], width: Column | int, channels: Column | int = 1) -> DataFrame:
    """The inverse of :func:`explode_pixels`."""
    w, k = (F.lit(n) if isinstance(n, int) else n for n in (width, channels))
    place = ((F.col("y") * w + F.col("x")) * k + F.col("c")).alias("i")
    return pixels.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place, "v"))).alias("s")).select(*by, F.col("s.v").alias("pixels"))


def cropped(pixels: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """Pixels of a crop, with coordinates from its corner; what is outside the image isn't there."""
    inside = (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)
    return pixels.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def masked(pixels: DataFrame, mask: Column, background: bool = False) -> DataFrame:
    """Pixels outside (or inside, for ``background``) the mask become 0."""
    keep = (mask == 0) if background else (mask != 0)
    return pixels.withColumn("v", F.when(keep, F.col("v")).otherwise(0))


def cast_or_zero(v: Column, kind: str) -> Column:
    """A pixel in another integer type; what doesn't fit is 0, fractions are cut."""
    limits = {"u1": (0, 255), "u2": (0, 65535), "u4": (0, 4294967295), "i4": (-2147483648, 2147483647)}
    if kind not in limits:
        return v.cast({"f4": "float", "f8": "double"}[kind])
    low, high = limits[kind]
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")
    return F.when((v > low - 1) & (v < high + 1), whole).otherwise(0)


# --- listings ---------------------------------------------------------------


def file_parts(path: Column) -> dict[str, Column]:
    """dir, name, stem and lower-case ext of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return {"dir": F.regexp_replace(path, r"/?[^/]*$", ""), "name": name, "stem": F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), "ext": F.lower(ext)}


def listed(files: DataFrame, formats: tuple[str, ...] = IMAGE_FORMATS, substring: str | None = None, compat: bool = False) -> DataFrame:
    """Files of the given formats whose name holds ``substring``; ``compat`` compares extensions by case (Q20)."""
    parts = file_parts(F.col("path"))
    out = files.select("*", *(c.alias(k) for k, c in parts.items()))
    ext = F.regexp_extract(F.col("name"), r"\.([^.]+)$", 1) if compat else F.col("ext")
    out = out.where(ext.isin(*formats))
    return out.where(F.contains("name", F.lit(substring))) if substring else out


def pair_key(stem: Column, substring: str | None) -> Column:
    return F.replace(stem, F.lit(substring), F.lit("")) if substring else stem


def pair_files(a: DataFrame, b: DataFrame, substring_a: str | None = None, substring_b: str | None = None) -> DataFrame:
    """(key, path_a, path_b) of files whose stems agree once the substrings are taken out.

    Of several files of one key in ``a`` the last path holds; those in ``b``
    all stay.  Spark broadcasts the left side if it is small enough.
    """
    left = a.select(pair_key(F.col("stem"), substring_a).alias("key"), F.col("path").alias("path_a")).groupBy("key").agg(F.max("path_a").alias("path_a"))
    right = b.select(pair_key(F.col("stem"), substring_b).alias("key"), F.col("path").alias("path_b"))
    return left.join(right, "key")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with ``row``, their place (from 0) by key and paths, which is the order results are written in."""
    return numbered(pairs, ["key", "path_a", "path_b"], name="row")


def ordered_objects(objects: DataFrame) -> DataFrame:
    """Object rows with ``row``, their place by image and object; rows without an object (errors) are first of their image."""
    return numbered(objects, ["image", "object"], name="row")


def unpaired_files(a: DataFrame, b: DataFrame, substring_a: str | None = None, substring_b: str | None = None) -> DataFrame:
    """Files of ``a`` without a partner in ``b``."""
    keyed = a.withColumn("key", pair_key(F.col("stem"), substring_a))
    return keyed.join(b.select(pair_key(F.col("stem"), substring_b).alias("key")), "key", "left_anti")
