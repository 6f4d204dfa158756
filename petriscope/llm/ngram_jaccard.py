"""Similarity join of documents on their sets of word n-grams, as a blocked sparse product.

The overlap counts of all documents are the product A * A' of the sparse
document by n-gram incidence A.  It is taken in blocks, and bounds that follow
from set sizes alone decide which rows and pairs are multiplied at all:

* ``_screened`` reads A once in cells of a block of rows by a block of columns
  (n-gram hashes).  A column that one document has adds to no overlap; a row is
  left only if enough of its columns are shared to reach the least overlap that
  its size allows.  Rows of a cell are combined before they move, so an n-gram
  of any number of documents is one entry for each block of rows.
* Rows that are left are first multiplied with one row of their group (a star),
  groups being equal pairs of least hashes.  Found links merge documents into
  components.  This only saves work: nothing is ruled out by it.
* Then the screen is repeated with components in the place of documents, and
  rows that could still be linked to another component are placed in clusters:
  columns are split by hash into m blocks, m set by the size class.  Linked rows
  differ in at most d columns, d known from their sizes, so they agree in at
  least m - d column blocks, and so in one of the d + 1 heaviest of each.
* The rows of a cluster are multiplied with each other in cells of ``BLOCK`` by
  ``BLOCK`` rows: exact overlaps, pairs below the size-derived bound discarded,
  and of the rest a spanning forest of components leaves the cell, never its
  pairs.  The rows of a cluster's largest component are only multiplied with the
  others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, join_ids, lean, written
from .textkernel import LOWER, Words, mix, sequence_hashes, squeeze, squeezed_steps, steps, window_hashes

#: Sets below this size use the prefix bound instead of column blocks.
SMALL = 24
#: Each size class ends at this multiple of its start.
CLASS_FACTOR = 1.5
#: Rows of a block in the exact product, and columns multiplied at once.
BLOCK, COLUMNS = 256, 4096
#: Entries and documents of a block of rows in the screen, and entries of a block of columns, about.
ENTRIES, DOCUMENTS, COLUMN_ENTRIES = 1 << 21, 20_000, 1 << 20
#: A column of several documents or components in a block of rows.
SEVERAL = 0xFFFF
#: Keys of pairs of least hashes, and how often stars are tried.
KEYS, STARS = 8, 2


def overlap_bound(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap at which sets of these sizes are linked (as exact integers).

    >>> int(overlap_bound(np.int64(10), np.int64(12), 85))
    11
    """
    return -((-percent * (a + b)) // (100 + percent))


def _differ(size, percent: int):
    """n-grams in which a set of this size differs from any linked one, at most."""
    return size * (100 - percent) // percent


def _classes(percent: int, largest: int) -> list[tuple[int, int]]:
    """(first size, column blocks) of each size class, up to one that holds ``largest``."""
    out, start = [], SMALL
    while True:
        end = math.ceil(start * CLASS_FACTOR)
        d = _differ(end - 1, percent)
        out.append((start, d + 3 + d // 5))
        if end > largest:
            return out
        start = end


def _sets(column: pa.Array, n: int, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, document, hash) of the distinct n-grams of texts or squeezed texts, sorted by both."""
    squeezed = pa.types.is_binary(column.type)
    for a, b, data, offsets in squeezed_steps(column) if squeezed else steps(column):
        data = LOWER[data] if lower else data
        w = Words(data, offsets)
        words = w.hashes(data)
        at = w.windows(n)
        short = np.flatnonzero((w.count > 0) & (w.count < n))
        h = np.r_[window_hashes(words, n)[at], sequence_hashes(words, w.first[short], w.count[short])]
        doc = np.r_[w.doc[at], short]
        order = np.argsort(h)
        order = order[np.argsort(doc[order], kind="stable")]
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield a, b, doc[new], h[new]


def _all_sets(column: pa.Array, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the sets of a few rows."""
    parts = [(doc + a, h) for a, _, doc, h in _sets(column, n, lower)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _ids(batch: pa.RecordBatch, name: str = "id") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _sizes(n: int, lower: bool):
    """mapInArrow: (id, size, two commutative hashes of the set)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, doc, h in _sets(batch.column("text"), n, lower):
                size = np.bincount(doc, minlength=b - a)
                both = []
                for seed in (1, 2):
                    sums = np.r_[np.uint64(0), np.cumsum(mix(h, seed), dtype=np.uint64)]
                    ends = np.r_[0, np.cumsum(size)]
                    both.append(pa.array((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(size.astype(np.int64)), *both], ["id", "size", "s1", "s2"])

    return lean(rows)


def _cells_of(ids: np.ndarray, labels: np.ndarray | None, size: np.ndarray, doc: np.ndarray, h: np.ndarray, columns: int) -> tuple[bytes, list[int], list[bytes]]:
    """A block of rows: what is known of its documents, and its cells (column block, entries).

    An entry is a column (32 bits of its hash) and the slot that is told if the
    column is shared: a document, or past the documents a component of which
    several have it.  ``SEVERAL`` stands for a column that is shared right here.
    """
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    run = np.diff(np.r_[first, len(h)])
    if labels is None:
        known, of = None, np.zeros(len(ids), np.int64)
        mixed = run > 1
    else:
        known, of = np.unique(labels, return_inverse=True)
        own = of[doc]
        mixed = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first) if len(first) else np.zeros(0, bool)
    here = np.bincount(doc[np.repeat(mixed, run)], minlength=len(ids))
    at = doc[first]
    slot = np.where(mixed, SEVERAL, np.where(run > 1, len(ids) + of[at], at)).astype(np.uint16)
    h = h[first]
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    tag = (mix(known.astype(np.int64).view(np.uint64), 9)[of[at]] >> np.uint64(32)).astype(np.uint32) if known is not None else None
    block = ((h >> np.uint64(32)) * np.uint64(columns)) >> np.uint64(32)
    cut = np.searchsorted(block, np.arange(columns + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cut))
    cells = [low[a:b].tobytes() + slot[a:b].tobytes() + (tag[a:b].tobytes() if tag is not None else b"") for a, b in zip(cut[full], cut[full + 1], strict=True)]
    head = ids.tobytes() + size.astype(np.int32).tobytes() + here.astype(np.int32).tobytes() + of.astype(np.int32).tobytes()
    return head, full.tolist(), cells


def _cells(n: int, lower: bool, columns: int, labelled: bool):
    """mapInArrow over (id, text[, label]): (column block, row block, payload); block -1 - row block has the documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flushed, held, docs, entries = TaskContext.get().partitionId() << 24, 0, [], 0, 0

        def block() -> pa.RecordBatch:
            at = part + flushed
            ids, labels, size, doc, h = (np.concatenate(x) for x in zip(*held, strict=True))
            head, columns_of, cells = _cells_of(ids, labels if labelled else None, size, doc, h, columns)
            return pa.RecordBatch.from_arrays([pa.array([-1 - at, *columns_of], pa.int64()), pa.array([at] * (len(cells) + 1), pa.int64()), pa.array([head, *cells], pa.binary())], ["block", "at", "payload"])

        for whole in batches:
            for k in range(0, whole.num_rows, 10_000):
                batch = whole.slice(k, 10_000)
                ids = _ids(batch)
                labels = _ids(batch, "label") if labelled else ids
                for a, b, doc, h in _sets(batch.column("text"), n, lower):
                    held.append((ids[a:b], labels[a:b], np.bincount(doc, minlength=b - a), doc + docs, h))
                    docs, entries = docs + b - a, entries + len(h)
                    if entries >= ENTRIES or docs >= DOCUMENTS:
                        yield block()
                        flushed, held, docs, entries = flushed + 1, [], 0, 0
        if held:
            yield block()

    return lean(rows)


SCREEN = "at long, head boolean, payload binary"


def _shared(labelled: bool):
    """applyInArrow over a block of columns: to each block of rows, (slot, number of its columns that are shared)."""

    def out(at: list[int], head: list[bool], payload: list[bytes]) -> pa.Table:
        return pa.table({"at": pa.array(at, pa.int64()), "head": pa.array(head, pa.bool_()), "payload": pa.array(payload, pa.binary())})

    def tell(table: pa.Table) -> pa.Table:
        at = table.column("at").to_pylist()
        cells = table.column("payload").to_pylist()
        if table.column("block")[0].as_py() < 0:
            return out(at, [True] * len(at), cells)
        count = [len(x) // (10 if labelled else 6) for x in cells]
        low = np.concatenate([np.frombuffer(x, np.uint32, c) for x, c in zip(cells, count, strict=True)])
        slot = np.concatenate([np.frombuffer(x, np.uint16, c, 4 * c) for x, c in zip(cells, count, strict=True)])
        order = np.argsort(low, kind="stable")
        low, slot, row = low[order], slot[order], np.repeat(np.arange(len(at)), count)[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        run = np.diff(np.r_[first, len(low)])
        if labelled:
            tag = np.concatenate([np.frombuffer(x, np.uint32, c, 6 * c) for x, c in zip(cells, count, strict=True)])[order]
            many = np.minimum.reduceat(tag, first) != np.maximum.reduceat(tag, first)
        else:
            many = run > 1
        shared = np.repeat(many | np.logical_or.reduceat(slot == SEVERAL, first), run) & (slot != SEVERAL)
        who, times = np.unique(row[shared] << 16 | slot[shared], return_counts=True)
        cut = np.searchsorted(who >> 16, np.arange(len(at) + 1))
        full = np.flatnonzero(np.diff(cut))
        told = [(who[a:b] & 0xFFFF).astype(np.uint16).tobytes() + times[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[full], cut[full + 1], strict=True)]
        return out([at[k] for k in full], [False] * len(full), told)

    return tell


def _enough(percent: int):
    """applyInArrow over a block of rows: the documents of which enough columns are shared."""

    def rows(table: pa.Table) -> pa.Table:
        head = np.array(table.column("head").to_pylist())
        cells = table.column("payload").to_pylist()
        x = cells[int(np.flatnonzero(head)[0])]
        n = len(x) // 20
        ids, size, here, of = np.frombuffer(x, np.int64, n), *(np.frombuffer(x, np.int32, n, (8 + 4 * k) * n) for k in range(3))
        told = np.zeros(2 * n + 1, np.int64)
        for k in np.flatnonzero(~head):
            m = len(cells[k]) // 6
            told[np.frombuffer(cells[k], np.uint16, m)] += np.frombuffer(cells[k], np.uint32, m, 2 * m)
        # what several documents of a component share counts for all of it: too much at most
        ok = 100 * (here + told[:n] + told[n + of]) >= percent * size.astype(np.int64)
        return pa.table({"id": pa.array(ids[ok])})

    return rows


def _screened(rows: DataFrame, entries: int, n: int, percent: int, lower: bool) -> DataFrame:
    """Ids of rows (id, text[, label]) that could be linked by their size: of ``percent`` of their n-grams another document (label) has each.

    Hashes that collide can only leave more rows.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(256, 4 * partitions, entries // COLUMN_ENTRIES)
    labelled = "label" in rows.columns
    cells = rows.mapInArrow(_cells(n, lower, columns, labelled), "block long, at long, payload binary")
    return cells.groupBy("block").applyInArrow(_shared(labelled), SCREEN).groupBy("at").applyInArrow(_enough(percent), "id long")


def _squeezed_with_keys(n: int, lower: bool):
    """mapInArrow over (id, text): (id, size, keys of least hashes, squeezed text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                for a, b, doc, h in _sets(batch.column("text"), n, lower):
                    least = np.full((b - a) * 2 * KEYS, np.iinfo(np.uint64).max)
                    v = mix(h, 13)
                    np.minimum.at(least, doc * 2 * KEYS + (v & np.uint64(2 * KEYS - 1)).astype(np.int64), v)
                    pairs = least.reshape(-1, KEYS, 2)
                    tag = np.arange(KEYS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
                    keys = mix(mix(pairs[:, :, 0], 1) + pairs[:, :, 1] + tag, 2)
                    full = (pairs != np.iinfo(np.uint64).max).any(2)
                    ends = np.r_[0, np.cumsum(full.sum(1))].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].view(np.int64)))
                    size = pa.array(np.bincount(doc, minlength=b - a).astype(np.int64))
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([part.column("id"), size, lists, squeeze(part.column("text"))], ["id", "size", "keys", "text"])

    return lean(rows)


def _star_links(n: int, lower: bool, percent: int):
    """mapInArrow over pairs (a, b) with both squeezed texts: those at or above the bound."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                centers, at, of = np.unique(_ids(batch, "b"), return_index=True, return_inverse=True)
                ra, ha = _all_sets(batch.column("ta"), n, lower)
                rb, hb = _all_sets(batch.column("tb").take(pa.array(at)), n, lower)
                na, nb = np.bincount(ra, minlength=batch.num_rows), np.bincount(rb, minlength=len(centers))[of]
                tag = mix(np.arange(len(centers), dtype=np.uint64), 5)
                both = np.isin(ha ^ tag[of[ra]], hb ^ tag[rb])
                count = np.bincount(ra[both], minlength=batch.num_rows)
                ok = pa.array((count >= overlap_bound(na, nb, percent)) & (count > 0))
                yield batch.select(["a", "b"]).filter(ok)

    return lean(rows)


def _of_class(c: int, m: int, doc: np.ndarray, h: np.ndarray, chosen: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of the ``most`` + 1 heaviest column blocks of the chosen rows in one class."""
    take = chosen[doc]
    doc, h = doc[take], h[take]
    docs = np.flatnonzero(chosen)
    place = np.cumsum(chosen) - 1
    block = ((mix(h, 20 + c) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    cell = place[doc] * m + block
    total = np.zeros(len(docs) * m, np.uint64)
    np.add.at(total, cell, mix(h, 3))
    count = np.bincount(cell, minlength=len(total))
    tag = (np.arange(len(total)) % m + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    sig = mix(total + tag, 40 + c)
    row = np.arange(len(total)) // m
    # an order of blocks by what they hold, so it is the same in all rows
    order = np.lexsort((sig, -count, row))
    use = order[np.arange(len(total)) % m <= most[docs][row]]
    return sig[use], docs[use // m]


def _all_signatures(doc: np.ndarray, h: np.ndarray, docs: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of rows sorted by document: linked rows share one at least.

    A row is in its own class, and in every lower one that a linked set can be in.
    """
    size = np.bincount(doc, minlength=docs)
    small = (size > 0) & (size <= (SMALL - 1) * 100 // percent)
    rank = np.arange(len(doc)) - np.r_[0, np.cumsum(size)][:-1][doc]
    prefix = size - -(-percent * size // 100) + 1
    take = small[doc] & (rank < prefix[doc])
    out = [(mix(h[take], 11), doc[take])]
    table = _classes(percent, int(size.max(initial=0)))
    firsts = np.array([x[0] for x in table])
    own = np.searchsorted(firsts, size, "right") - 1
    for c, (_, m) in enumerate(table):
        chosen, most = own == c, _differ(size, percent)
        if c + 1 < len(table):
            last = firsts[c + 1] - 1
            lower = (own > c) & (size <= last * 100 // percent)
            chosen, most = chosen | lower, np.where(lower, (size + last) * (100 - percent) // (100 + percent), most)
        if chosen.any():
            out.append(_of_class(c, m, doc, h, chosen, most))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _signatures(n: int, lower: bool, percent: int):
    """mapInArrow over (id, label, squeezed text): (sig, id, label)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                ids, labels = _ids(batch), _ids(batch, "label")
                for a, b, doc, h in _sets(batch.column("text"), n, lower):
                    sig, at = _all_signatures(doc, h, b - a, percent)
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[a:b][at]), pa.array(labels[a:b][at])], ["sig", "id", "label"])

    return lean(rows)


def block_product(doc_a: np.ndarray, col_a: np.ndarray, n_a: int, doc_b: np.ndarray, col_b: np.ndarray, n_b: int) -> np.ndarray:
    """Overlap counts of two blocks of sparse rows, a slice of columns at a time."""
    shared = np.intersect1d(col_a, col_b)
    out = np.zeros((n_a, n_b), np.float32)
    ia, ib = np.searchsorted(shared, col_a), np.searchsorted(shared, col_b)
    ok_a = shared[np.minimum(ia, len(shared) - 1)] == col_a if len(shared) else np.zeros(len(col_a), bool)
    ok_b = shared[np.minimum(ib, len(shared) - 1)] == col_b if len(shared) else np.zeros(len(col_b), bool)
    for k in range(0, len(shared), COLUMNS):
        a, b = np.zeros((n_a, COLUMNS), np.float32), np.zeros((n_b, COLUMNS), np.float32)
        x, y = ok_a & (ia >= k) & (ia < k + COLUMNS), ok_b & (ib >= k) & (ib < k + COLUMNS)
        a[doc_a[x], ia[x] - k] = 1
        b[doc_b[y], ib[y] - k] = 1
        out += a @ b.T
    return out.astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) join two trees, taken in order."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out.append(k)
    return np.array(out, np.int64)


def _cell_links(n: int, lower: bool, percent: int):
    """applyInArrow over a cell of one or two blocks of rows: a spanning forest of the components that its links join."""

    def links(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        parts = []
        for s in (0, 1):
            t = table.filter(pa.array(side == s)).combine_chunks()
            doc, h = _all_sets(t.column("text").combine_chunks(), n, lower) if t.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            parts.append((t.column("id").to_numpy(), t.column("label").to_numpy(), np.bincount(doc, minlength=t.num_rows), doc, h))
        x, y = parts if (side == 1).any() else (parts[0], parts[0])
        count = block_product(x[3], x[4], len(x[0]), y[3], y[4], len(y[0]))
        ok = (count >= overlap_bound(x[2][:, None], y[2][None, :], percent)) & (count > 0) & (x[1][:, None] != y[1][None, :])
        i, j = np.nonzero(ok)
        pairs = np.stack([x[1][i], y[1][j]], 1)
        _, one = np.unique(np.sort(pairs, 1), axis=0, return_index=True)
        keep = one[_forest(pairs[one, 0], pairs[one, 1])]
        return pa.table({"a": pa.array(x[0][i[keep]].astype(np.int64)), "b": pa.array(y[0][j[keep]].astype(np.int64))})

    return links


def _products(rows: DataFrame, n: int, lower: bool, percent: int) -> DataFrame:
    """Links (a, b) between components of rows (cluster, id, label, squeezed text), from products of blocks of rows.

    A hot cluster costs its size times the rows outside its main component.
    """
    by_label = rows.groupBy("cluster", "label").agg(F.count("*").alias("k"))
    main = by_label.groupBy("cluster").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("g"))
    main = main.select("cluster", F.col("m.label").alias("main"), F.ceil(F.col("m.k") / BLOCK).alias("mains"), F.ceil((F.col("g") - F.col("m.k")) / BLOCK).alias("others"))
    m = rows.join(main, "cluster").withColumn("is_main", F.col("label") == F.col("main"))
    m = m.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    block = F.col("block")
    of_main = F.transform(upto(F.col("others")), lambda j: cell("m", block, j, 0))
    of_other = F.concat(
        F.transform(upto(F.col("mains")), lambda i: cell("m", i, block, 1)),
        F.transform(F.filter(upto(F.col("others")), lambda j: j > block), lambda j: cell("o", block, j, 0)),
        F.transform(F.filter(upto(F.col("others")), lambda j: j < block), lambda j: cell("o", j, block, 1)),
        F.array(cell("o", block, block, 0)),
    )
    placed = m.select("cluster", "id", "label", "text", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)).alias("at"))
    return placed.select("cluster", "id", "label", "text", "at.*").groupBy("cluster", "kind", "i", "j").applyInArrow(_cell_links(n, lower, percent), "a long, b long")


def _links(texts: DataFrame, n: int, percent: int, lower: bool) -> DataFrame | None:
    """(node, component) of all links among rows (id, size, keys, squeezed text) of different sets; None without links."""

    def labelled(df: DataFrame, comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return df.withColumn("label", F.col("id"))
        return df.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    def merged(links: DataFrame, comp: DataFrame | None) -> tuple[DataFrame | None, bool]:
        """The components with new links, and whether there were any."""
        links = written(links, "links")
        if links.isEmpty():
            drop_written(links)
            return comp, False
        edges = links if comp is None else links.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b")))
        out = written(components(edges), "components")
        drop_written(links)
        if comp is not None:
            drop_written(comp)
        return out, True

    comp: DataFrame | None = None
    for turn in range(STARS):
        keyed = written(labelled(texts.select("id", "size", F.explode("keys").alias("key")), comp), "keyed")
        order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        of_key = keyed.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "size", "label")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        center = of_key.select("key", F.col("c.id").alias("b"), F.col("c.size").alias("sb"), F.col("c.label").alias("lb"))
        pairs = keyed.join(center, "key").where(f"label <> lb and 100 * least(size, sb) >= {percent} * greatest(size, sb)").select(F.col("id").alias("a"), "b").distinct()
        full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        comp, more = merged(full.select("a", "b", "ta", "tb").mapInArrow(_star_links(n, lower, percent), "a long, b long"), comp)
        drop_written(keyed)
        if not more:
            break

    # written, so that a task that runs again finds its rows in the same blocks
    rows = written(labelled(texts.select("id", "text"), comp), "labelled")
    entries = texts.agg(F.sum("size")).first()[0] or 0
    left = written(_screened(rows.select("id", "text", "label"), entries, n, percent, lower), "left")
    own = written(rows.join(left, "id", "left_semi").select("id", "label", "text").mapInArrow(_signatures(n, lower, percent), "sig long, id long, label long"), "own")
    open_ = own.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("b")).where("lo < hi").select("sig", "b")
    edges = written(own.join(open_, "sig").select(F.col("id").alias("a"), "b").distinct(), "agreeing")
    if not edges.isEmpty():
        clusters = components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
        comp, _ = merged(_products(rows.join(clusters, "id").select("cluster", "id", "label", "text"), n, lower, percent), comp)
    for df in (left, own, edges, rows):
        drop_written(df)
    return comp


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, first_id) for each row of ``docs``.

    Two documents are linked when 100 * overlap >= percent * union of their
    sets of distinct n-word shingles (A-Z lower-cased if ``lower``; words are
    runs of characters other than space and 0x09-0x0D).  A document of fewer
    words has its whole word sequence as its one shingle; without words, or
    with null text, its set is empty and it is linked with nothing.
    ``component_id`` is the smallest id reachable over links, the own one
    included; ``first_id`` the smallest id with the same set.  Rows with a null
    id keep it and are alone.  Repeated rows give repeated rows.  Rows of one id
    with different sets are documents of their own, each with its own links.
    Other columns of ``docs`` are not read.

    Every link counts: no cap on candidates, no sampling.  Documents of equal
    sets are one row of the product.  n-grams are compared by 64-bit hashes,
    whole sets by two of them.
    """
    if not 50 <= percent <= 100 or n < 1:
        raise ValueError("percent must be in 50..100 and n positive")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sizes = written(rows.mapInArrow(_sizes(n, lower), "id long, size long, s1 long, s2 long"), "sizes")
    one_set = F.xxhash64("size", "s1", "s2")
    several = sizes.where("id is not null").groupBy("id").agg(F.min(one_set).alias("lo"), F.max(one_set).alias("hi")).where("lo <> hi")
    if not several.isEmpty():
        drop_written(sizes)
        return _by_row(rows, n, percent, lower, id_col)
    first = written(sizes.where("id is not null and size > 0").groupBy("size", "s1", "s2").agg(F.min("id").alias("rep")), "first")
    entries = first.agg(F.sum("size")).first()[0] or 0
    alone = join_ids(rows, "id", first.select("rep"), "left_semi")
    left = written(_screened(alone, entries, n, percent, lower), "left")
    wanted = join_ids(rows, "id", left, "left_semi")
    texts = written(wanted.mapInArrow(_squeezed_with_keys(n, lower), "id long, size long, keys array<long>, text binary").dropDuplicates(["id"]), "texts")
    drop_written(left)
    comp = _links(texts, n, percent, lower)
    drop_written(texts)

    out = sizes.join(first, ["size", "s1", "s2"], "left")
    if comp is None:
        out = out.withColumn("component", F.lit(None).cast("long"))
    else:
        out = out.join(comp, F.col("rep") == F.col("node"), "left")
    linked = F.col("id").isNotNull() & (F.col("size") > 0)
    return out.select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"),
        F.when(linked, F.col("rep")).otherwise(F.col("id")).alias("first_id"),
    )


def _by_row(rows: DataFrame, n: int, percent: int, lower: bool, id_col: str) -> DataFrame:
    """The join of rows (id, text) whose ids don't tell their sets apart: every row has a number instead."""
    key = F.when(F.col("id").isNotNull(), F.monotonically_increasing_id()).alias("key")
    keyed = written(rows.select(key, "id", "text"), "keyed")
    found = written(ngram_jaccard(keyed.select("key", "text"), n, percent, lower, "key", "text"), "by_row")
    own = found.join(keyed.where("key is not null").select("key", "id"), "key", "left")
    least = lambda c, name: own.where("key is not null").groupBy(c).agg(F.min("id").alias(name))
    out = own.join(least("component_id", "component"), "component_id", "left").join(least("first_id", "first"), "first_id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("first").alias("first_id"))
