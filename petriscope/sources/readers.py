"""Directories of files as DataFrames: one row per file, failures as rows with an error.

Only Spark opens files, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import listed
from ..functions.polygons import parse_boxes, parse_polygons
from ..schema import BOX_KEYS, IMAGE, IMAGE_FORMATS, POLYGON_KEYS
from . import codecs

#: Images in one Arrow batch: pixels are large, so few.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20
DDL = "path string, stem string, im struct<width:int,height:int,channels:int,dtype:string,data:binary>, error string"


def list_files(spark: SparkSession, folder: str, formats: tuple[str, ...] = IMAGE_FORMATS, substring: str | None = None) -> DataFrame:
    """(path, dir, name, stem, ext) of the files directly in ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    return listed(files, formats, substring)


def _content(spark: SparkSession, folder: str, formats: tuple[str, ...], substring: str | None) -> DataFrame:
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "content")
    return listed(files, formats, substring).select("path", "stem", "ext", "content")


def _decoder(mask: bool):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, stem, ext, raw in batch.itertuples(index=False, name=None):
                try:
                    a = codecs.decode_mask(bytes(raw), ext)[:, :, None] if mask else codecs.decode(bytes(raw), ext)
                    out.append((path, stem, codecs.pack_image(a), None))
                except Exception as e:  # noqa: BLE001 - any broken file is a row
                    out.append((path, stem, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, dtype=object, columns=["path", "stem", "im", "error"])

    return rows


def read_images(spark: SparkSession, folder: str, substring: str | None = None, formats: tuple[str, ...] = IMAGE_FORMATS) -> DataFrame:
    """(path, stem, im, error); 8-bit jpeg goes through Spark's own image source."""
    return _read(spark, folder, substring, formats, False)


def _jpeg_rows(mask: bool):
    """Rows of Spark's image source; as a mask, one channel is asked for."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.width <= 0:
                    out.append((r.path, r.stem, None, "ValueError: not a JPEG file"))
                elif mask and r.nChannels != 1:
                    out.append((r.path, r.stem, None, f"ValueError: a mask has one channel of unsigned integers, not {r.nChannels} of uint8"))
                else:
                    a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                    a = a[:, :, 2::-1] if r.nChannels > 1 else a
                    out.append((r.path, r.stem, codecs.pack_image(a.astype(np.int64) if mask else a), None))
            yield pd.DataFrame(out, dtype=object, columns=["path", "stem", "im", "error"])

    return rows


def jpegs(df: DataFrame, substring: str | None) -> DataFrame:
    """(path, stem, width, …) of the jpeg files of Spark's image source."""
    return listed(df.withColumnRenamed("origin", "path"), ("jpeg", "jpg"), substring)


def _read(spark: SparkSession, folder: str, substring: str | None, formats: tuple[str, ...], mask: bool) -> DataFrame:
    own = _content(spark, folder, tuple(f for f in formats if f not in ("jpeg", "jpg")), substring).mapInPandas(_decoder(mask), DDL)
    if not {"jpeg", "jpg"} & set(formats):
        return own
    jpeg = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(folder).select("image.*")
    return own.unionByName(jpegs(jpeg, substring).mapInPandas(_jpeg_rows(mask), DDL))


def read_masks(spark: SparkSession, folder: str, substring: str | None = None) -> DataFrame:
    """(path, stem, im, error): label images of one channel; a jpeg of more is an error row."""
    return _read(spark, folder, substring, IMAGE_FORMATS, True)


def _json(spark: SparkSession, folder: str, substring: str | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.col("content").cast("string").alias("text"))
    return listed(files, ("json",), substring)


def read_polygons(spark: SparkSession, folder: str, substring: str | None = None) -> DataFrame:
    """(path, stem, polygons, error): arrays of rings; a file without any accepted key is an error row."""
    out = _json(spark, folder, substring).select("path", "stem", parse_polygons(F.col("text"), POLYGON_KEYS).alias("polygons"))
    return out.withColumn("error", F.when(F.col("polygons").isNull(), F.lit("no polygons")))


def read_boxes(spark: SparkSession, folder: str, substring: str | None = None) -> DataFrame:
    """(path, stem, boxes, error); boxes need max >= min, empty ones are allowed."""
    out = _json(spark, folder, substring).select("path", "stem", parse_boxes(F.col("text"), BOX_KEYS).alias("boxes"))
    wrong = F.exists("boxes", lambda b: (b["x_max"] < b["x_min"]) | (b["y_max"] < b["y_min"]))
    return out.withColumn("error", F.when(F.col("boxes").isNull(), F.lit("no boxes")).when(wrong, F.lit("a box ends before it begins")))


__all__ = ["IMAGE", "list_files", "read_boxes", "read_images", "read_masks", "read_polygons"]
