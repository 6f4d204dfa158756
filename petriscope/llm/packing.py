"""Packing of tokenized documents into sequences, by bounded-space online best-fit.

Each task packs its own share of the pieces.  It holds a fixed number of open
bins in a bitset keyed by free space: bit f of one integer says that some open
bin has f tokens free, so the tightest bin that takes a piece is the lowest set
bit at or above its length.  A piece that fits nowhere opens a bin; if all are
open, the fullest closes first.  Pieces arrive in hashed order, which an online
packer is free to be given, longest first only within chunks of as many pieces
as bins can be open: a bin opened for a long piece still meets the short ones.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .textkernel import mix

#: Open bins of a task.
OPEN_BINS = 1024
#: Pieces that one task packs, about.
TASK_PIECES = 200_000
END_ID = 2


class BestFit:
    """Bounded-space best-fit into bins of ``size``.

    >>> b = BestFit(10, 2)
    >>> [b.place(n) for n in (6, 7, 3, 4, 9, 1)]
    [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 9)]
    """

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = 0  # bit f: an open bin has f free
        self.bins: dict[int, list[int]] = {}  # free space: numbers of open bins
        self.n_open = self.n_bins = 0

    def _pop(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.free &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``size`` tokens."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._pop(free)
        else:
            if self.n_open == self.open_bins:
                self._pop((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, free = self.n_bins, self.size
            self.n_bins += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.n_open += 1
        return number, self.size - free


_encoders: dict[str, object] = {}


class Encoder:
    """Ids of texts by a public byte-level BPE file.

    Where the same vocabulary lies beside it as ranks, texts go through the
    faster of the two libraries; those that hold a special token's string go
    through the slower one, which gives that token's id.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
        if name.startswith("byte_bpe") and os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def _pieces(tokenizer: str, size: int, with_ids: bool):
    """mapInArrow: the pieces of each document; full ones get their sequence here."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        full = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out: list[list] = [[] for _ in range(8)]
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), END_ID], "<u4")
                    first = len(ids) % size or size
                    start = 0
                    for number, end in enumerate(range(first, len(ids) + 1, size)):
                        own = ids[start:end].tobytes()
                        whole = end - start == size
                        for column, value in zip(out, (doc, number, start, end - start, zlib.crc32(own), full if whole else None, 0 if whole else None, own if with_ids else None), strict=True):
                            column.append(value)
                        full += whole
                        start = end
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], SCHEMA.names)

    return rows


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType()))])


def arrival(lengths: np.ndarray, open_bins: int) -> np.ndarray:
    """Places of the pieces in the order they are packed: hashed, longest first within chunks of ``open_bins``."""
    hashed = np.argsort(mix(np.arange(len(lengths), dtype=np.uint64), 23), kind="stable")
    chunk = np.arange(len(lengths)) // open_bins
    return hashed[np.lexsort((-lengths[hashed], chunk))]


def _pack(size: int, open_bins: int):
    """mapInArrow over a whole partition: sequences and offsets of its pieces."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = -1 - (TaskContext.get().partitionId() << 40)
        whole = list(batches)
        table = pa.Table.from_batches(whole) if whole else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("id", "ascending"), ("ids_crc32", "ascending"), ("length", "ascending"), ("piece", "ascending")])
        table = table.take(pa.array(arrival(table.column("length").to_numpy(), open_bins)))
        bins = BestFit(size, open_bins)
        places = [bins.place(n) for n in table.column("length").to_pylist()]
        at = np.array(places, np.int64).reshape(-1, 2)
        table = table.set_column(5, "sequence_id", pa.array(base - at[:, 0])).set_column(6, "offset", pa.array(at[:, 1]))
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return rows


def pack(docs: DataFrame, size: int = 1024, tokenizer: str = "byte_bpe_50k.json", open_bins: int = OPEN_BINS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of at most ``size`` tokens.

    Per piece: id, piece (from 0), start (its document's tokens before it),
    length, ids_crc32 (of the little-endian 32-bit ids), sequence_id, offset
    (gapless from 0), ids (binary; null unless ``with_ids``).  A document is
    its text's ids and then the end id 2; null text is empty text, so one
    token.  Only a document longer than ``size`` is cut: its first piece takes
    what is over a multiple of ``size``, the others are full and are sequences
    by themselves.  Every other piece - one of a document - is dealt by a hash
    to tasks of about ``TASK_PIECES`` and packed there.  Null ids and repeated
    rows are documents like any other; extra columns don't travel.

    ``tokenizer`` names a file of the public tokenizers; each executor reads
    its own installed copy.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    cut = written(source.mapInArrow(_pieces(tokenizer, size, with_ids), SCHEMA), "pieces")
    part = cut.where("sequence_id is null")
    tasks = max(1, -(-part.count() // TASK_PIECES))
    dealt = part.repartition(tasks, F.xxhash64("id", "ids_crc32", "length")) if tasks > 1 else part.repartition(1)
    packed = dealt.mapInArrow(_pack(size, open_bins), SCHEMA)
    return cut.where("sequence_id is not null").unionByName(packed)
