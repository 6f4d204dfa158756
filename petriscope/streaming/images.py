"""Images as they arrive: every per-image verb is stateless and so runs on a stream unchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.image import ImageSchema
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import listed, pair_key
from ..schema import IMAGE_FORMATS
from ..sources.readers import DDL, _decoder, _jpeg_rows, jpegs

FILES = "path string, modificationTime timestamp, length long, content binary"
JPEG = ("jpeg", "jpg")


def _timed(rows: Callable) -> Callable:
    """A mapper of frames that carries the column ``at`` along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for out in rows(iter([batch.drop(columns="at")])):
                yield out.assign(at=batch["at"].to_numpy())

    return run


def stream_images(spark: SparkSession, folder: str, mask: bool = False, files_per_trigger: int = 64) -> DataFrame:
    """A stream of (path, stem, im, error, at) of the files that appear in ``folder``; ``at`` is when a file was written.

    8-bit jpeg goes through Spark's own image source, as in batch.
    """
    read = lambda kind: spark.readStream.format(kind).option("maxFilesPerTrigger", files_per_trigger)
    files = read("binaryFile").schema(FILES).option("pathGlobFilter", "*.{" + ",".join(_any_case(f) for f in IMAGE_FORMATS if f not in JPEG) + "}").load(folder)
    own = listed(files, IMAGE_FORMATS).select("path", "stem", "ext", "content", F.col("modificationTime").alias("at"))
    shown = read("image").schema(ImageSchema.imageSchema).option("dropInvalid", "false").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(folder)
    jpeg = jpegs(shown.select("image.*", F.col("_metadata.file_modification_time").alias("at")), None)
    schema = f"{DDL}, at timestamp"
    return own.mapInPandas(_timed(_decoder(mask)), schema).unionByName(jpeg.mapInPandas(_timed(_jpeg_rows(mask)), schema))


def _any_case(ext: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)


def pair_streams(images: DataFrame, segments: DataFrame, value: str = "im", kind: str = "mask", substring_images: str | None = None, substring_segments: str | None = None, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of (image, id, im, kind, at): images with the segmentation of their key, of two streams (stem, im, error, at).

    A pair's files were written ``within`` some time of each other.  Each side
    waits in the join's state for the other until the watermark, ``late`` behind
    the newest file, says that no partner can come; files later than that find
    none.  Keys are hashed over tasks, state holds one window of files.  Every
    image file of a key is paired, as no stream can know which is the last.
    """
    a = images.where(F.col("error").isNull()).select(pair_key(F.col("stem"), substring_images).alias("id"), F.col("stem").alias("image"), "im", F.col("at").alias("at")).withWatermark("at", late)
    b = segments.where(F.col("error").isNull()).select(pair_key(F.col("stem"), substring_segments).alias("__id"), F.col(value).alias(kind), F.col("at").alias("__at")).withWatermark("__at", late)
    near = F.expr(f"__at BETWEEN at - INTERVAL {within} AND at + INTERVAL {within}")
    return a.join(b, (F.col("id") == F.col("__id")) & near).select("image", "id", "im", kind, F.greatest("at", "__at").alias("at"))


def object_rate(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Objects and images per window of arrival (at, image, object), for late files up to ``late``."""
    return events.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("objects"), F.approx_count_distinct("image").alias("images"))
