"""Extendible hashing of documents into shards of bounded size, in DataFrame operations only.

The directory is indexed by the leading bits of a hash; a bucket splits on one
more bit only while it is over its byte limit.  Since a bucket's bytes only
shrink as its prefix grows, a document's depth is the first prefix length whose
bucket fits, so each round of splitting is one aggregation of the buckets that
are still too large - of their sizes, not of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits of the hash; a bucket that is still too large here holds copies of one key.
BITS = 48
#: Sizes are first summed at this many bits, then only inside buckets over the limit.
STRIDE = 12


def _hash(key: Column) -> Column:
    """The first 48 bits of the key's MD5, as a long; equal in every SQL engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.floor(h / F.pow(F.lit(2.0), F.lit(BITS) - bits)).cast("long")


def extendible_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 64) -> DataFrame:
    """``docs``' (id, n_bytes, depth, prefix, part): the shard of each row is (depth, prefix, part).

    A row counts the bytes of its UTF-8 text and ``overhead`` more (null text:
    0).  Shards hold at most ``limit_bytes`` unless one row alone is larger,
    which then has a shard of its own as far as hash bits and parts allow.
    Rows of one key can't be parted by its hash; a bucket still over the limit
    at the last bit is dealt into numbered parts by a running sum of its
    pre-aggregated sizes (``part``, 0 elsewhere): rows of one size class are
    counted first, so no task orders the rows of a hot key.  Null ids hash as
    the text 'null'.  Empty tables give an empty result; extra columns don't
    matter.  Only ids, sizes and hashes are shuffled, never texts.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    sized = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)) + F.lit(overhead)).cast("long").alias("n_bytes"),
        _hash(key).alias("h"),
    )
    sized = written(sized, "sized")
    # directory: (from, to, depth) of every bucket that fits, found stride by stride
    leaves, open_ = None, None
    for low in range(0, BITS, STRIDE):
        high = low + STRIDE
        source = sized
        if open_ is not None:
            source = sized.withColumn("p", _prefix(F.col("h"), low)).join(open_, "p", "left_semi")
        cells = source.groupBy(_prefix(F.col("h"), high).alias("c")).agg(F.sum("n_bytes").alias("b"))
        depths = F.sequence(F.lit(low + 1 if low else 0), F.lit(high))
        at = cells.select("c", "b", F.explode(depths).alias("depth"))
        at = at.withColumn("prefix", F.floor(F.col("c") / F.pow(F.lit(2.0), F.lit(high) - F.col("depth"))).cast("long"))
        sums = at.groupBy("depth", "prefix").agg(F.sum("b").alias("b"))
        sums = written(sums, "directory")
        fits = sums.where(F.col("b") <= limit_bytes)
        # a leaf fits and its parent does not
        parent = sums.where(F.col("b") > limit_bytes).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        below = fits.withColumn("up", F.floor(F.col("prefix") / 2).cast("long"))
        found = below.join(parent, ["depth", "up"], "left_semi").select("depth", "prefix", "b")
        first_depth = 0 if not low else low + 1
        found = found.unionByName(fits.where(F.col("depth") == first_depth).select("depth", "prefix", "b"))
        leaves = found if leaves is None else leaves.unionByName(found)
        open_ = sums.where((F.col("depth") == high) & (F.col("b") > limit_bytes)).select(F.col("prefix").alias("p"), F.col("b"))
        last = open_
        open_ = open_.select("p")
        if open_.isEmpty():
            break
    leaves = leaves.unionByName(last.select(F.lit(BITS).alias("depth"), F.col("p").alias("prefix"), "b")).distinct()
    leaves = written(leaves.select("depth", "prefix", F.col("b").alias("bucket_bytes")), "leaves")
    used = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # at most BITS + 1 numbers
    # a row tries the depths in use; exactly one of its prefixes is a leaf
    tried = sized.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in sorted(used))))) if used else sized.withColumn("depth", F.lit(0))
    tried = tried.withColumn("prefix", _prefix(F.col("h"), F.col("depth")))
    placed = tried.join(leaves, ["depth", "prefix"])
    # buckets of one key: whole size classes in order, each cut into runs of as many rows as fit
    heavy = placed.where(F.col("bucket_bytes") > limit_bytes)
    if used and BITS in used:
        return _split_copies(placed, heavy, limit_bytes)
    return placed.select("id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", F.lit(0).cast("long").alias("part"))


def _split_copies(placed: DataFrame, heavy: DataFrame, limit: int) -> DataFrame:
    """Parts of buckets that no hash bit can split.

    A part ends where the running sum of bytes passes a multiple of ``limit``
    less the largest row, so none exceeds the limit.  The sum is taken in two
    steps - over chunks of 1024 rows, then inside each - so that no task orders
    the rows of a hot key.  A row's place is (partition, row) of a written
    table, the same again when a task is repeated.
    """
    light = placed.where(F.col("bucket_bytes") <= limit)
    light = light.select("id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", F.lit(0).cast("long").alias("part"))
    seated = written(heavy.select("id", "n_bytes", "depth", "prefix", F.monotonically_increasing_id().alias("seat")), "copies")
    seated = seated.withColumn("chunk", F.shiftright("seat", 10))
    chunks = seated.groupBy("depth", "prefix", "chunk").agg(F.sum("n_bytes").alias("b"))
    before = Window.partitionBy("depth", "prefix").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("before", F.coalesce(F.sum("b").over(before), F.lit(0))).drop("b")
    inside = Window.partitionBy("depth", "prefix", "chunk").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1)
    rows = seated.withColumn("own", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))).join(chunks, ["depth", "prefix", "chunk"])
    largest = seated.groupBy("depth", "prefix").agg(F.max("n_bytes").alias("most"))
    rows = rows.join(largest, ["depth", "prefix"])
    step = F.greatest(F.lit(1), F.lit(limit) - F.col("most"))
    part = F.floor((F.col("before") + F.col("own")) / step).cast("long")
    return light.unionByName(rows.select("id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", part.alias("part")))
