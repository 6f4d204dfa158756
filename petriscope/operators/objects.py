"""Operators over rows of images: segmentation to objects, crops, and descriptor tables.

One input row is an image with its segmentation; one output row is an object.
Images travel once, with all their objects, and a failure is a row with an
error, never an exception that would stop the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import profile_columns
from ..sources.codecs import pack_image, unpack_image
from . import kernels as K

OBJECTS = "image string, object int, label long, poly array<struct<x:double,y:double>>, bbox struct<x_min:double,y_min:double,x_max:double,y_max:double>, width int, height int, error string"


#: Bytes of images that are Python objects at a time, about.
SLICE_BYTES = 8 << 20
BAD_RING = "a polygon needs three points"


def over_rows(df: DataFrame, rows: Callable, ddl: str) -> DataFrame:
    """``rows`` (frames of Python values to frames) over Arrow batches, nested columns as lists and dicts.

    Spark's own conversion to pandas can't hold lists of lists of unequal length.
    A batch is taken in slices of about ``SLICE_BYTES``, whatever the session's batches hold.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows_ = max(1, int(b.num_rows * SLICE_BYTES / max(b.get_total_buffer_size(), 1)))
            yield from (b.slice(k, rows_) for k in range(0, b.num_rows, rows_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (pd.DataFrame(b.to_pylist(), columns=b.schema.names, dtype=object) for b in sliced(batches))
        for frame in rows(frames):
            yield pa.RecordBatch.from_arrays([pa.array(frame[f.name].tolist(), f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def points(p: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


def array_of(poly) -> np.ndarray:
    return np.array([(q["x"], q["y"]) for q in poly], float).reshape(-1, 2)


def mask_objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas: (image, im) masks to OBJECTS, ids in the order of labels."""
    for batch in batches:
        out = []
        for image, im in batch[["image", "im"]].itertuples(index=False, name=None):
            try:
                mask = unpack_image(im)[:, :, 0]
                _, labels, polygons = K.label_polygons(mask)
                for k, (label, p) in enumerate(zip(labels, polygons, strict=True)):
                    box = dict(zip(("x_min", "y_min", "x_max", "y_max"), map(float, K.bounding_box(p)), strict=True))
                    out.append((image, k, label, points(p), box, mask.shape[1], mask.shape[0], None))
            except Exception as e:  # noqa: BLE001
                out.append((image, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, dtype=object, columns=["image", "object", "label", "poly", "bbox", "width", "height", "error"])


def _segments(image: np.ndarray, row, kind: str, mode: str, compat: bool) -> list[tuple[int, tuple, np.ndarray | None, Callable]]:
    """(id, box, polygon, crop to object mask) of an image's objects."""
    if kind == "mask":
        mask = unpack_image(row["mask"])[:, :, 0]
        if mask.shape != image.shape[:2]:
            raise ValueError("image and mask differ in size")
        labels, names, polygons = K.label_polygons(mask)
        return [(k, K.bounding_box(p), p, lambda c, n=name: (K.crop(labels, *c) == n).astype(np.uint8)) for k, (name, p) in enumerate(zip(names, polygons, strict=True))]
    if kind == "polygons":
        out = []
        for k, poly in enumerate(row["polygons"]):
            p = array_of(poly)
            if len(p) < 3:
                out.append((k, None, None, None))  # Q18: a bad ring is an error row, the others stay
                continue
            drawn = K.order_points(K.dedup_points(p)) if compat and "p" in mode else p  # Q8
            draw = (lambda c, q=drawn: K.draw_centered(q, c[2], c[3])) if compat else (lambda c, q=drawn: K.fill_polygon(q - [c[0], c[1]], c[2], c[3]))  # Q9
            out.append((k, K.bounding_box(p), p, draw))
        return out
    return [(k, (b["x_min"], b["y_min"], b["x_max"], b["y_max"]), None, None) for k, b in enumerate(row["boxes"])]


def crops_of(image: np.ndarray, row, kind: str, mode: str, pad: int, min_size: int, compat: bool):
    """(id, box, polygon, complete crop, object mask) of each object that stays; a bad ring has its id only."""
    for k, box, polygon, draw in _segments(image, row, kind, mode, compat):
        if box is None:
            yield k, None, None, None, None
            continue
        c = K.object_crop(box, image.shape[1], image.shape[0], pad, min_size, compat)
        if c is not None:
            yield k, box, polygon, K.crop(image, *c), draw(c) if draw and set(mode) & set("mfb") else None


def _families(a: np.ndarray, compat: bool) -> np.ndarray:
    return np.concatenate([K.intensity(a, compat), K.moments(a, compat), K.texture(a), K.zernike(a, compat)])


def describe(crop: np.ndarray, mask: np.ndarray | None, polygon: np.ndarray | None, box, mode: str, compat: bool = False) -> np.ndarray:
    """One row of descriptors, in the order of :func:`profile_columns`."""
    parts: list[np.ndarray] = []
    if "p" in mode:
        parts.append(K.form(polygon, compat))
    if "c" in mode:
        parts.append(_families(crop, compat))
    if "f" in mode:
        parts.append(_families(K.crop_masked(crop, mask), compat))
    if "b" in mode:
        parts.append(_families(K.crop_masked(crop, mask, background=True), compat))
    if "m" in mode:
        m = mask[:, :, None]
        parts.append(np.concatenate([K.moments(m), K.zernike(m)]))
    if "x" in mode:
        w, h = box[2] - box[0], box[3] - box[1]
        parts.append(np.array([w, h, w * h]))
    return np.concatenate(parts)


def profile_rows(kind: str, mode: str, pad: int, min_size: int, compat: bool):
    """mapInPandas: (image, im, mask | polygons | boxes) to (image, object, descriptors…, error)."""
    names = profile_columns(mode, kind == "boxes")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    image = unpack_image(row["im"])
                    for k, box, polygon, crop, mask in crops_of(image, row, kind, mode, pad, min_size, compat):
                        if crop is None:
                            out.append((row["image"], k, *[None] * len(names), BAD_RING))
                            continue
                        out.append((row["image"], k, *describe(crop, mask, polygon, box, mode, compat), None))
                except Exception as e:  # noqa: BLE001
                    out.append((row["image"], None, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, dtype=object, columns=["image", "object", *names, "error"])

    return rows, "image string, object int, " + ", ".join(f"{c} float" for c in names) + ", error string"


CROPS = "image string, object int, part string, im struct<width:int,height:int,channels:int,dtype:string,data:binary>, error string"


def process_rows(kind: str, mode: str, pad: int, min_size: int, compat: bool):
    """mapInPandas: the crops of each object, one row per part (complete, mask, foreground, background)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    image = unpack_image(row["im"])
                    for k, _, _, crop, mask in crops_of(image, row, kind, mode, pad, min_size, compat):
                        if crop is None:
                            out.append((row["image"], k, None, None, BAD_RING))
                            continue
                        parts = {"c": ("complete", lambda: crop), "m": ("mask", lambda: mask[:, :, None] * np.uint8(255)), "f": ("foreground", lambda: K.crop_masked(crop, mask)), "b": ("background", lambda: K.crop_masked(crop, mask, background=True))}
                        for letter, (name, make) in parts.items():
                            if letter in mode:
                                out.append((row["image"], k, name, pack_image(make()), None))
                except Exception as e:  # noqa: BLE001
                    out.append((row["image"], None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, dtype=object, columns=["image", "object", "part", "im", "error"])

    return rows, CROPS


def measure_rows(family: str, compat: bool):
    """mapInPandas: (image, im) to one family of descriptors of the whole image."""
    from .. import schema

    names = {"intensity": schema.INTENSITY, "moments": schema.MOMENTS, "texture": schema.TEXTURE, "zernike": schema.ZERNIKE}[family]
    f = {"intensity": K.intensity, "moments": K.moments, "texture": lambda a, _: K.texture(a), "zernike": K.zernike}[family]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for image, im in batch[["image", "im"]].itertuples(index=False, name=None):
                try:
                    out.append((image, *f(unpack_image(im), compat), None))
                except Exception as e:  # noqa: BLE001
                    out.append((image, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, dtype=object, columns=["image", *names, "error"])

    return rows, "image string, " + ", ".join(f"{c} float" for c in names) + ", error string"


def form_rows(compat: bool):
    """mapInPandas: (image, polygons) to the 23 form descriptors of each ring."""
    from ..schema import FORM

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for image, rings in batch[["image", "polygons"]].itertuples(index=False, name=None):
                for k, poly in enumerate(rings):
                    p = array_of(poly)
                    out.append((image, k, *K.form(p, compat), None) if len(p) > 2 else (image, k, *[None] * len(FORM), BAD_RING))
            yield pd.DataFrame(out, dtype=object, columns=["image", "object", *FORM, "error"])

    return rows, "image string, object int, " + ", ".join(f"{c} float" for c in FORM) + ", error string"
