"""What the operators share: the shared folder, packing of columns, loops over graphs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import squeeze

#: Ids that a broadcast holds at most (about 16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of an Arrow batch, about; Spark has no limit of bytes unless one is set.
BATCH_BYTES = 4 << 20
ID, TEXT, REST = "__id", "__text", "__rest"


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper whose worker, which Spark keeps for later tasks, gives free memory back at the end of each task."""

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim is not None:
            trim(0)

    return run


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes in this session, so that long texts don't fill a worker; a limit that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a temporary folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            return set_already.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="petriscope-checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
        return path
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete what :func:`written` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:  # an empty table has a file too
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def join_ids(df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """``df`` joined (left_semi or left_anti) with one column of distinct ids.

    The ids are counted: up to ``BROADCAST_IDS`` they are broadcast and
    ``df``, with its texts, stays where it is; beyond, both sides are shuffled.
    """
    key = f"__key_{uuid.uuid4().hex}"  # a name that no column of ``df`` has
    ids = written(ids.toDF(key), "ids")
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, F.col(f"`{column}`") == F.col(key), how)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, text, all other columns in one struct), under names that no input column has.

    So any extra column, whatever its name, travels through an operator untouched.
    """
    bounded_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias(ID),
        F.col(f"`{text_col}`").cast("string").alias(TEXT),
        F.struct(*rest).alias(REST),
    )


def unpacked(df: DataFrame, like: DataFrame, text_col: str, text: Column | str = TEXT, extra: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``like`` in their order, ``text_col`` from ``text``; ``extra`` columns replace those of the same name."""
    extra = extra or {}
    text = F.col(text) if isinstance(text, str) else text
    cols = [text.alias(c) if c == text_col else F.col(f"{REST}.`{c}`").alias(c) for c in like.columns if c not in extra]
    return df.select(*cols, *(c.alias(k) for k, c in extra.items()))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 500):  # few texts at a time are Python objects
            batch = whole.slice(k, 500)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (ID, REST, "p", "q")), squeeze(batch.column(TEXT))], [ID, REST, "p", "q", "z"])


def dealt_by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rest, z, copy) of each row, partitioned by the id alone.

    ``z`` is the compressed text; ``copy`` says that a smaller id has the same
    text, by two 64-bit hashes of it.  Joins by id find the texts in place, so
    one exchange of them serves a whole plan.  The hashes are compared in a
    form that is no join key, and a left join without filters keeps Catalyst
    from pushing anything below the exchange that would keep it from reuse.
    """
    rows = packed(docs, id_col, text_col)
    hashes = (F.xxhash64(TEXT).alias("p"), F.xxhash64(F.lit("+"), TEXT).alias("q"))
    narrow = rows.where(F.col(ID).isNotNull()).select(F.col(ID).alias("i"), *hashes)
    first = narrow.groupBy("p", "q").agg(F.min("i").alias("first"))
    known = narrow.distinct().join(first, ["p", "q"]).select("i", F.col("p").alias("kp"), F.col("q").alias("kq"), "first")
    keyed = rows.select(ID, TEXT, REST, *hashes)
    texts = keyed.mapInArrow(lean(_squeezed), keyed.select(ID, REST, "p", "q").schema.add("z", "binary"))
    same = F.col("p").bitwiseXOR(F.col("kp")).bitwiseOR(F.col("q").bitwiseXOR(F.col("kq"))) == 0
    return texts.join(known, (F.col(ID) == F.col("i")) & same, "left").select(ID, REST, "z", (F.col("first") < F.col(ID)).alias("copy"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star contraction; rounds go to the shared
    folder.  What a node's neighbours must learn is one row a node: up to
    ``BROADCAST_IDS`` rows (counted) it is broadcast, and a hub's edges stay where they
    are; beyond, it is written, so that the join has two plain exchanges, of
    which AQE splits a hub's.
    """
    before = None
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    rows = pairs.count()
    for _ in range(most_rounds):
        aside = []

        def told(least: DataFrame) -> DataFrame:
            if 2 * rows <= BROADCAST_IDS:  # noqa: B023
                return F.broadcast(least)
            aside.append(written(least, "least"))  # noqa: B023
            return aside[-1]  # noqa: B023

        # large star: every larger neighbour of u goes to u's smallest neighbour
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(told(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(told(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        sides = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = sides(new)
        done, before, rows = now == before, now, now[0]
        for old in (pairs, *aside):
            drop_written(old)
        pairs = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    flat = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
