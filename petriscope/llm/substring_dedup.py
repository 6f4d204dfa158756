"""Removal of word passages that an earlier document already has, by level-wise doubling.

Level by level, windows that repeat at one length are extended to twice that
length (at most the asked one), and only those: a window of 13 words can occur
again only if the 7-word window chosen inside it does.  The choice is made by
content - the 7-word window of least hash among the 7 in it - so equal
13-word windows choose equal 7-word ones, and neighbouring windows mostly
choose the same, which leaves about a quarter of all positions to shuffle on
the first level and only windows inside repeated passages on the last.  The
ladder ends at the asked length, as longer windows cannot change which words
go; its levels are one plan that shares one exchange of the texts, in which a level after
one without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ID, REST, TEXT, dealt_by_id, lean, unpacked
from .textkernel import Words, mix, sliding_min, squeezed_steps, window_hashes


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def ladder(window: int, base: int = 7) -> list[int]:
    """Lengths from ``base``, each at most twice the one before, up to ``window``.

    >>> ladder(13), ladder(50), ladder(5)
    ([7, 13], [7, 14, 28, 50], [5])
    """
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class _Windows:
    """The candidate windows of one step: for each window of full length, its sub-window at every level."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.words = Words(data, offsets)
        self.data = data
        self.hashes = self.words.hashes(data)
        self.at = self.words.windows(window)
        self.doc = self.words.doc[self.at]
        self.window = window
        self.total = len(self.words.start)

    def level(self, length: int) -> np.ndarray:
        """Least hash of the windows of ``length`` words in each full window."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        return sliding_min(window_hashes(self.hashes, length), self.window - length + 1)[self.at]

    def check(self) -> np.ndarray:
        """A second hash of the full windows, of words hashed anew."""
        return window_hashes(self.words.hashes(self.data, 99), self.window, 99)[self.at]


def _kept(flat: np.ndarray, keys: np.ndarray, doc: np.ndarray, list_doc: np.ndarray) -> np.ndarray:
    """Whether each (doc, key) is among the (list_doc, flat)."""
    if not len(flat):
        return np.zeros(len(keys), bool)
    return np.isin(keys ^ mix(doc.astype(np.uint64), 5), flat ^ mix(list_doc.astype(np.uint64), 5))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list<long> column; null lists are empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.r_[0, np.cumsum(lengths)]


def _level_rows(lengths: list[int], level: int):
    """mapInArrow: (key, id) of windows at a level whose lower levels all repeat."""
    window = lengths[-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            live = pc.and_(pc.is_valid(batch.column(ID)), pc.invert(batch.column("copy").fill_null(False)))
            batch = batch.filter(pc.and_(live, pc.is_valid(batch.column("keys"))) if level else live)
            ids = batch.column(ID).to_numpy(zero_copy_only=False)
            if level:
                values, at = _lists(batch.column("keys"))
            for a, b, data, offsets in squeezed_steps(batch.column("z")):
                w = _Windows(data, offsets, window)
                doc, keys = w.doc, w.level(lengths[level])
                check = w.check() if level == len(lengths) - 1 else None
                if level:
                    of = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                    ok = _kept(values[at[a] : at[b]], w.level(lengths[level - 1]), doc, of)
                    doc, keys = doc[ok], keys[ok]
                    check = check[ok] if check is not None else None
                order = np.lexsort((keys, doc))
                doc, keys = doc[order], keys[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                out = [_signed(keys[new]), pa.array(ids[a:b][doc[new]].astype(np.int64))]
                names = ["key", "id"]
                if level == len(lengths) - 1:
                    out.append(pa.array((check[order][new] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                    names.append("check")
                yield pa.RecordBatch.from_arrays(out, names)

    return lean(rows)


def _cut(window: int):
    """mapInArrow: the kept words of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column("copy").fill_null(False).to_numpy(zero_copy_only=False)
            values, at = _lists(batch.column("keys"))
            for a, b, data, offsets in squeezed_steps(batch.column("z")):
                w = _Windows(data, offsets, window)
                words = w.words
                of = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                gone = _kept(values[at[a] : at[b]], w.level(window), w.doc, of) | copy[a:b][w.doc]
                cover = np.zeros(w.total + 1, np.int64)
                np.add.at(cover, w.at[gone], 1)
                np.subtract.at(cover, w.at[gone] + window, 1)
                keep = np.cumsum(cover)[:-1] == 0
                # bytes of kept words, and one space after each but a document's last
                marks = np.zeros(len(data) + 1, np.int8)
                marks[words.start[keep]] += 1
                marks[words.end[keep]] -= 1
                take = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
                text = data.copy()
                kept = np.flatnonzero(keep)
                follows = kept[np.r_[words.doc[kept][1:] == words.doc[kept][:-1], False]] if len(kept) else kept
                text[words.end[follows]] = 0x20
                take[words.end[follows]] = True
                ends = np.r_[0, np.cumsum(take)][offsets]
                new = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text[take]))
                n = words.count.astype(np.int64)
                left = np.bincount(words.doc[keep], minlength=b - a)
                # maximal runs of removed words, as (first word, end word)
                edge = np.diff(np.r_[False, ~keep, False].astype(np.int8))
                inner = np.flatnonzero((~keep[1:]) & (~keep[:-1]) & (words.doc[1:] != words.doc[:-1])) + 1 if w.total else np.zeros(0, np.int64)
                s0 = np.sort(np.r_[np.flatnonzero(edge == 1), inner])
                s1 = np.sort(np.r_[np.flatnonzero(edge == -1), inner])
                base = words.first[words.doc[s0]] if len(s0) else s0
                counts = np.bincount(words.doc[s0], minlength=b - a) if len(s0) else np.zeros(b - a, np.int64)
                spans = pa.StructArray.from_arrays([pa.array((s0 - base).astype(np.int64)), pa.array((s1 - base).astype(np.int64))], ["first", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([batch.column(REST).slice(a, b - a), new.cast(pa.string()), pa.array(n), pa.array(n - left), spans], [REST, TEXT, "n_words", "n_removed", "removed"])

    return lean(rows)


def substring_dedup(docs: DataFrame, window: int = 13, base: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without the words that an earlier document has.

    A word goes if it lies in a window of ``window`` consecutive words that
    also starts in a document of smaller id; windows are judged on the input.
    Words are runs of characters other than space and 0x09-0x0D.  The text
    becomes the kept words joined by one space; ``n_words``, ``n_removed`` and
    ``removed`` (word spans) replace columns of those names.

    Exact copies are settled first, by a hash of the whole text, and only the
    smallest id of a group of copies goes on.  Null and empty texts have no
    words (the result is empty text, 0 and 0).  A document with a null id
    comes before and after none: nothing of it goes, and it removes nothing.
    Repeated rows of one id don't remove each other's words.  Extra columns
    stay.  Two hashes with seeds of their own, 64 and 32 bits, stand for a window.
    """
    if window < 1 or base < 1:
        raise ValueError("window and base must be positive")
    lengths = ladder(window, base)
    full = dealt_by_id(docs, id_col, text_col)
    # Every branch reads all columns of ``full`` by left joins without filters that
    # Catalyst could push below its exchange, so the texts are dealt out once and reused.
    keys = None
    for level in range(len(lengths)):
        source = full if keys is None else full.join(keys.withColumnRenamed("id", "k"), F.col(ID) == F.col("k"), "left")
        last = level == len(lengths) - 1
        found = source.mapInArrow(_level_rows(lengths, level), "key long, id long" + ", check int" * last)
        by = ["key", "check"] if last else ["key"]
        least = [F.min("id").alias("least")] * last
        again = found.groupBy(*by).agg(F.count("*").alias("n"), *least).where("n > 1").drop("n")
        kept = found.join(again, by).where("id > least" if last else "true")
        keys = kept.groupBy("id").agg(F.collect_set("key").alias("keys"))

    out = full.join(keys.withColumnRenamed("id", "k"), F.col(ID) == F.col("k"), "left")
    schema = out.select(REST, F.lit("").alias(TEXT)).schema.add("n_words", "long").add("n_removed", "long").add("removed", SPANS)
    cut = out.mapInArrow(_cut(window), schema)
    return unpacked(cut, docs, text_col, extra={c: F.col(c) for c in ("n_words", "n_removed", "removed")})
