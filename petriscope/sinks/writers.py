"""Results to files.

Tables go through Spark's writers.  Files per object or image are written by the
tasks through Arrow's file systems, so a folder is a path that all executors
share or the URI of a store (hdfs, s3, gs, file).
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import codecs
from ..sources.folder import store_of as _store

#: Rows of embeddings that one file may hold: 1024 numbers each make 0.8 GB.
GATHERED = 200_000


def write_table(df: DataFrame, path: str, kind: str | None = None, single: bool = False) -> None:
    """CSV, TSV (also txt) or Parquet (pq), by ``kind`` or the path's ending."""
    kind = (kind or path.rsplit(".", 1)[-1]).lower()
    out = (df.coalesce(1) if single else df).write.mode("errorifexists")
    if kind in ("csv", "tsv", "txt"):
        out.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    elif kind in ("pq", "parquet"):
        out.parquet(path)
    else:
        raise ValueError(f"no table format {kind}")


def new_folder(path: str) -> str:
    """A folder that did not exist: ``path``, else path_0 to path_29."""
    for name in (path, *(f"{path}_{k}" for k in range(30))):
        try:
            os.makedirs(name)
            return name
        except FileExistsError:
            continue
    raise FileExistsError(path)


def _put(store: fs.FileSystem, path: str, raw: bytes) -> None:
    """A whole file or none: local and HDFS files are renamed once written, stores show an object when it is complete."""
    if store.type_name in ("s3", "gcs", "abfs"):
        with store.open_output_stream(path) as f:
            f.write(raw)
        return
    part = f"{path}.{os.getpid()}.part"  # a second attempt of a task has its own
    with store.open_output_stream(part) as f:
        f.write(raw)
    store.move(part, path)


def _files(df: DataFrame, folder: str, name: str, ending: str, content: Callable[[tuple], bytes]) -> DataFrame:
    """One file a row: (name, path, error), ``content`` made of the columns after the first."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for key, *rest in batch.itertuples(index=False, name=None):
                try:
                    _put(store, f"{root}/{key}{ending}", content(*rest))
                    out.append((key, f"{folder.rstrip('/')}/{key}{ending}", None))
                except (ValueError, OSError) as e:
                    out.append((key, None, str(e)))
            yield pd.DataFrame(out, columns=[name, "path", "error"])

    return df.mapInPandas(rows, f"{name} string, path string, error string")


def _object_json(objects: DataFrame, what: str) -> tuple[DataFrame, str]:
    """(image, s) with the objects of an image in order, and the key of their JSON."""
    if what == "polygons":
        value, key = F.transform("poly", lambda q: F.array(q["x"], q["y"])), "polygons"
    else:
        value, key = F.array(*(F.col(f"bbox.{c}") for c in ("x_min", "y_min", "x_max", "y_max"))), "bounding_boxes"
    good = objects.where(F.col("object").isNotNull())  # the others say why an image has none
    return good.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("object", value.alias("v")))).alias("s")), key


def write_json_objects(objects: DataFrame, path: str, what: str = "polygons") -> None:
    """One JSON line per image: {"image": …, "polygons": [[[x, y], …], …]} or {"bounding_boxes": [[x0, y0, x1, y1], …]}."""
    rows, key = _object_json(objects, what)
    rows.select(F.to_json(F.struct("image", F.col("s.v").alias(key))).alias("value")).write.text(path)


def write_json_files(objects: DataFrame, folder: str, what: str = "polygons") -> DataFrame:
    """One file per image, <image>.json, as the readers take them; gives (image, path, error)."""
    rows, key = _object_json(objects, what)
    return _files(rows.select("image", F.to_json(F.struct(F.col("s.v").alias(key))).alias("text")), folder, "image", ".json", str.encode)


def image_bytes(a: np.ndarray, fmt: str) -> bytes:
    """An encoded image; png takes 8 or 16 bits of 1 or 3 channels, npy anything."""
    if fmt == "npy":
        return codecs.encode_npy(a)
    if fmt == "png":
        return codecs.encode_png(a)
    raise codecs.Unsupported(f"writing {fmt}")


def write_images(df: DataFrame, folder: str, fmt: str = "png") -> DataFrame:
    """Writes (name, im) rows as files and gives (name, path, error) of each."""
    return _files(df.select("name", "im"), folder, "name", f".{fmt}", lambda im: image_bytes(codecs.unpack_image(im), fmt))


def write_masks(df: DataFrame, folder: str) -> DataFrame:
    """Writes (name, im) label images as npy files of height by width."""
    return _files(df.select("name", "im"), folder, "name", ".npy", lambda im: codecs.encode_npy(codecs.unpack_image(im)[:, :, 0]))


def write_embeddings(df: DataFrame, path: str) -> None:
    """A .npy of the vectors, or a .npz of image, id, centroid and embedding.

    One file of this kind has one writer, so it is for results of at most
    ``GATHERED`` rows; more are an error: :func:`write_table` as Parquet takes any number.
    """
    table = df.limit(GATHERED + 1).toPandas()
    if len(table) > GATHERED:
        raise ValueError(f"over {GATHERED} rows for one file; write_table takes any number")
    vectors = np.array(table["embedding"].tolist(), np.float32)
    if path.endswith(".npy"):
        np.save(path, vectors)
        return
    parts = {"image": table["image"].to_numpy("<U53"), "embedding": vectors}
    if "object" in table:
        parts["id"] = table["object"].to_numpy(np.uint32)
    if "centroid_x" in table:
        parts["centroid"] = table[["centroid_x", "centroid_y"]].to_numpy(np.float32)
    np.savez(path, **parts)


def write_zarr(df: DataFrame, folder: str, width: int, height: int, channels: int, dtype: str = "f4", level: int = 5) -> DataFrame:
    """(stem, im, error) rows as a Zarr v3 group: /images in chunks of one image, /names of 100 bytes.

    Rows with an error or another channel count are left out; an image that
    can't be resized or cast keeps its row without chunks, which reads as zeros, and is listed in _errors.  Row
    numbers follow the sorted stems; chunks are there once all tasks have ended well.  Gives (stem, row).
    """
    from ..functions.ordering import numbered
    from .images import NAME_BYTES, ZARR_KINDS, save_images

    good = df.where(F.col("error").isNull() & (F.col("im.channels") == channels))
    order = numbered(good.select("stem"), ["stem"], name="row")
    n = order.count()

    def meta(shape: list[int], chunk: list[int], kind: str) -> str:
        codecs_ = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": level}}]
        return json.dumps({"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs_})

    save_images(good.join(order, "stem").select("row", F.col("stem").alias("name"), "im"), folder, "zarr", width=width, height=height, dtype=dtype, level=level)
    store, root = _store(folder)
    for name in ("images", "names"):
        store.create_dir(f"{root}/{name}", recursive=True)
    for path, text in (("zarr.json", json.dumps({"zarr_format": 3, "node_type": "group"})), ("images/zarr.json", meta([n, height, width, channels], [1, height, width, channels], ZARR_KINDS[dtype])), ("names/zarr.json", meta([n, NAME_BYTES], [1, NAME_BYTES], "uint8"))):
        _put(store, f"{root}/{path}", text.encode())
    return order
