"""A folder of files as a Spark data source: ``spark.read.format("image_folder")``.

Files are listed once, dealt to tasks by their bytes, and opened by the tasks
only.  Filters on the extension and the name are pushed into the listing, so
files that they leave out are never opened (``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of files that one task opens, about.
TASK_BYTES = 64 << 20
LISTED = "path string, dir string, name string, stem string, ext string, length long"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(folder)
    return fs.FileSystem.from_uri(folder)


def parts_of(path: str) -> dict[str, str]:
    """dir, name, stem and lower-case ext of a path, as ``functions.pixels.file_parts`` gives them."""
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    return {"dir": folder, "name": name, "stem": stem if dot and stem else name, "ext": ext.lower() if dot else ""}


@dataclass
class Files(InputPartition):
    """The files (path, length) of one task."""

    files: list[tuple[str, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(None)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.content = options["path"], options.get("content", "true").lower() == "true"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, lists and substrings of ext, name and stem, which are never null; gives the others back."""
        kinds = {EqualTo: "is", In: "in", StringContains: "contains", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            column = getattr(f, "attribute", None)
            own = bool(column) and column[0] in ("ext", "name", "stem")
            if own and isinstance(f, IsNotNull):
                continue
            if own and type(f) in kinds:
                self.tests.append((column[0], kinds[type(f)], f.value))
            else:
                yield f

    def keeps(self, path: str) -> bool:
        own = parts_of(path)
        does: dict[str, Callable] = {"is": str.__eq__, "in": lambda a, b: a in b, "contains": lambda a, b: b in a, "starts": str.startswith, "ends": str.endswith}
        return all(does[kind](own[column], value) for column, kind, value in self.tests)

    def partitions(self) -> list[Files]:
        store, root = store_of(self.folder)
        found = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")) and self.keeps(i.path))
        out, size = [Files()], 0
        for path, length in found:
            if out[-1].files and size + length > self.task_bytes:
                out.append(Files())
                size = 0
            out[-1].files.append((path, length))
            size += length
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = store_of(self.folder)
        for path, length in partition.files:
            own = parts_of(path)
            row = (path, own["dir"], own["name"], own["stem"], own["ext"], length)
            if not self.content:
                yield row
                continue
            try:
                with store.open_input_stream(path) as f:
                    yield (*row, f.read(), None)
            except OSError as e:
                yield (*row, None, f"{type(e).__name__}: {e}")


class ImageFolder(DataSource):
    """Options: path; content (false: listing only); taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "image_folder"

    def schema(self) -> str:
        return LISTED + (", content binary, error string" if self.options.get("content", "true").lower() == "true" else "")

    def reader(self, schema) -> FolderReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})


def folder(spark: SparkSession, path: str, content: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, dir, name, stem, ext, length, content, error) of the files directly in a folder; an unreadable file is an error row.

    Turns filter pushdown into Python sources on for the session, where it is not set.
    """
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ImageFolder)
    return spark.read.format("image_folder").option("content", str(content).lower()).option("taskBytes", task_bytes).load(path)
