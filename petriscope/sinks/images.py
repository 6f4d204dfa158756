"""Images as a Spark sink with commit: ``df.write.format("image_sink")``.

Every task writes into a folder of its own below ``_staging``; its message names
that folder and counts.  Commit moves the files to their places, abort deletes
them, so a failed or repeated task leaves nothing.  An image that can't be
encoded has none of its chunks and is listed in ``_errors``.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources import codecs
from ..sources.folder import store_of

STAGING, ERRORS, DONE = "_staging", "_errors", "_SUCCESS"
#: Bytes of a name in a Zarr group.
NAME_BYTES = 100
ZARR_KINDS = {"u1": "uint8", "u2": "uint16", "f4": "float32", "f8": "float64", "i4": "int32"}


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    written: int
    failed: int


class ImageWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.kind, self.options = options["path"], options.get("kind", "png"), options
        self.job = uuid.uuid4().hex

    def chunks(self, row: Row) -> dict[str, bytes]:
        """The files that an image is, by their paths below the folder."""
        image = codecs.unpack_image(row.im)
        if self.kind == "png":
            return {f"{row.name}.png": codecs.encode_png(image)}
        if self.kind == "npy":
            return {f"{row.name}.npy": codecs.encode_npy(image)}
        if self.kind == "mask":
            return {f"{row.name}.npy": codecs.encode_npy(image[:, :, 0])}
        if self.kind == "zarr":
            from ..operators.kernels import cast, resize

            o = self.options
            a, level = cast(resize(image, int(o["width"]), int(o["height"])), o["dtype"]), int(o["level"])
            name = row.name.encode()[:NAME_BYTES].ljust(NAME_BYTES, b"\0")
            return {f"images/c/{row.row}/0/0/0": gzip.compress(a.tobytes(), level), f"names/c/{row.row}/0": gzip.compress(name, level)}
        raise codecs.Unsupported(f"writing {self.kind}")

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, root = store_of(self.folder)
        own = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        written, errors = 0, []
        for row in iterator:
            begun = []
            try:
                for path, raw in self.chunks(row).items():
                    store.create_dir(f"{own}/{path}".rpartition("/")[0], recursive=True)
                    begun.append(f"{own}/{path}")
                    with store.open_output_stream(begun[-1]) as f:
                        f.write(raw)
                written += 1
            except (ValueError, TypeError, AttributeError) as e:  # the image's fault; what the store refuses fails the task
                for path in begun:
                    store.delete_file(path)
                errors.append(f"{row.name}\t{type(e).__name__}: {e}\n")
        if errors:
            store.create_dir(f"{own}/{ERRORS}")
            with store.open_output_stream(f"{own}/{ERRORS}/{uuid.uuid4().hex}.tsv") as f:
                f.write("".join(errors).encode())
        return Staged(own, written, len(errors))

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.folder)
        good = [m for m in messages if m is not None]
        for m in good:
            made: set[str] = set()
            for info in store.get_file_info(fs.FileSelector(m.folder, recursive=True)):
                if info.type != fs.FileType.File:
                    continue
                to = root + info.path[len(m.folder) :]
                if to.rpartition("/")[0] not in made:
                    made.add(to.rpartition("/")[0])
                    store.create_dir(to.rpartition("/")[0], recursive=True)
                store.move(info.path, to)
        store.delete_dir(f"{root}/{STAGING}/{self.job}") if good else None
        with store.open_output_stream(f"{root}/{DONE}") as f:
            f.write(json.dumps({"written": sum(m.written for m in good), "failed": sum(m.failed for m in good)}).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.folder)
        own = f"{root}/{STAGING}/{self.job}"
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)


class ImageSink(DataSource):
    """Rows (name, im) as png, npy or mask files; rows (row, name, im) as chunks of a Zarr group."""

    @classmethod
    def name(cls) -> str:
        return "image_sink"

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter({k.lower(): v for k, v in self.options.items()})


def save_images(df: DataFrame, folder: str, kind: str = "png", **options) -> None:
    """Writes (name, im) rows as files of ``folder``, all or none; images that can't be encoded are listed in its ``_errors``."""
    df.sparkSession.dataSource.register(ImageSink)
    columns = ["row", "name", "im"] if kind == "zarr" else ["name", "im"]
    out = df.select(*columns).write.format("image_sink").mode("append").option("kind", kind)
    for k, v in options.items():
        out = out.option(k, v)
    out.save(folder)
