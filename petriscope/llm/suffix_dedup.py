"""Removal of byte strings that occurred earlier, by suffix arrays over shards.

Where.  A string of ``length`` bytes can have occurred before only if the
24-byte gram of least hash inside it has; so each document is a sequence of
runs of window starts that choose the same gram, and only runs whose gram
occurs more than once anywhere are looked at further.  A run with the bytes its
windows cover is a context.  Equal contexts are pre-aggregated to their first
occurrence before any move: in the others every window has occurred.

How.  Distinct contexts go to shards by their gram, so windows that could be
equal meet.  A shard builds the suffix array of its contexts by Larsson and
Sadakane's refinement - groups of equal prefixes are split by the rank of what
follows, twice as far on each round, and settled ones are left alone - then
takes Kasai's common prefixes, and every run of neighbours sharing ``length``
bytes is one string, whose first occurrence stays.  The contexts of a gram with
very many are dealt over several shards; what those keep as first is merged
in ranges of digests, shard after shard, each looked up by binary search among
the sorted digests of those before.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ID, REST, TEXT, dealt_by_id, lean, unpacked, written
from .textkernel import _BYTE_VALUE, mix, sliding_min, squeezed_steps

GRAM = 24
#: Text of one kernel step: its arrays stay in the processor's cache.
STEP = 1 << 18
#: Bytes of contexts in a shard, about, and contexts of one gram in a shard at most, about.
SHARD_BYTES, SHARD_CONTEXTS = 1 << 20, 2048
#: Strings in a range of the merge, about.
RANGE_STRINGS = 4096
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, end of window starts, gram hash) of each run of windows that choose one gram."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none.view(np.uint64)
    one = _BYTE_VALUE[data]
    two = one[:-1] * _M[0] + one[1:]
    four = two[:-2] * _M[1] + two[2:]
    eight = four[:-4] * _M[2] + four[4:]
    gram = (eight[:-8] * _M[3] + eight[8:])[: n - GRAM + 1] * _M[4] + eight[16:]
    gram ^= gram >> np.uint64(32)
    gram *= _M[5]
    gram ^= gram >> np.uint64(29)
    low = np.uint64((1 << max(20, n.bit_length())) - 1)
    least = sliding_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), length - GRAM + 1)
    cross = np.zeros(n + 1, np.int32)  # windows that start less than length before the end of their document
    ends = offsets[1:]
    np.add.at(cross, np.maximum(np.maximum(ends - length + 1, offsets[:-1]), 0), 1)
    np.subtract.at(cross, ends, 1)
    inside = np.cumsum(cross[:-1])[: len(least)] == 0
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(np.r_[(new[1:] | ~inside[1:]), True] & inside) + 1
    return start, stop, gram[(least[start] & low).astype(np.int64)]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each slice, as two columns of longs."""
    view = memoryview(np.ascontiguousarray(data))
    out = b"".join(blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of slices put one after another."""
    size = end - start
    at = np.r_[0, np.cumsum(size)]
    return data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)], at


def suffix_order(text: np.ndarray, end: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Indices into ``start`` that sort those suffixes by their first ``length`` bytes.

    Larsson-Sadakane refinement: ``end`` gives for every place of ``text``
    where its context ends; ranks of equal prefixes are refined by the rank of
    the place as far on as the prefix is long, until ``length``.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    depth = min(8, length)
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key = (key << np.uint64(8)) | padded[k : n + k]
    rank = np.zeros(n, np.int64)
    live = np.flatnonzero(np.arange(n) + depth <= end)

    def settle(places: np.ndarray, keys: np.ndarray, base: np.ndarray | int) -> np.ndarray:
        """Give sorted places the rank at which their group starts; the places of groups over one."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        if isinstance(base, np.ndarray):
            new[1:] |= base[1:] != base[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(keys)])
        if isinstance(base, np.ndarray):  # a group's members number on from their old rank
            top = np.ones(len(keys), bool)
            top[1:] = base[1:] != base[:-1]
            t = np.flatnonzero(top)
            within = first - t[np.searchsorted(t, first, "right") - 1]
            rank[places] = np.repeat(base[first] + within, size)
        else:
            rank[places] = np.repeat(first, size)
        return places[np.repeat(size > 1, size)]

    order = np.argsort(key[live])
    live = settle(live[order], key[live][order], 0)
    while depth < length and len(live):
        step = min(depth, length - depth)
        live = live[live + depth + step <= end[live]]
        if depth + step == length:
            live = live[np.isin(live, start)] if len(start) < n else live
        keys = rank[live] * np.int64(n + 1) + rank[live + step]
        order = np.argsort(keys)
        live, keys = live[order], keys[order]
        live = settle(live, keys, rank[live])
        depth += step
    return np.argsort(rank[start], kind="stable")


def kasai(text: np.ndarray, context: np.ndarray, start: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix, up to ``length``, of each suffix of ``order`` with the one before it.

    Kasai's walk in text order, all contexts in lock step: the prefix of the
    next place is at most one byte shorter, where that place's old neighbour
    moved on too and still stands before it.
    """
    n = len(start)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.r_[False, (context[1:] == context[:-1]) & (start[1:] == start[:-1] + 1)]
    head = np.flatnonzero(~follows)
    extent = np.diff(np.r_[head, n])
    out, padded = np.zeros(n, np.int64), np.r_[text, np.zeros(8, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for k in range(int(extent.max(initial=0))):
        now = head[extent > k] + k
        h = np.zeros(len(now), np.int64)
        if k:
            old = before[now - 1]
            nxt = np.minimum(old + 1, n - 1)
            kept = (old >= 0) & (old + 1 < n) & follows[nxt]
            kept &= place[nxt] < place[now]
            h = np.where(kept, np.maximum(out[now - 1] - 1, 0), 0)
        go = np.flatnonzero(before[now] >= 0)
        while len(go):
            i, j = start[now[go]] + h[go], start[before[now[go]]] + h[go]
            same = words[np.minimum(i, len(words) - 1)] == words[np.minimum(j, len(words) - 1)]
            more = np.where(same.all(1), 8, np.argmin(same, 1))
            h[go] += more
            go = go[(more == 8) & (h[go] < length)]
        out[now] = np.minimum(h, length)
    return out[order]


def _grams(length: int):
    """mapInArrow: (key, id, number of runs), so that a gram repeated in a text is one row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(ID)), pc.invert(batch.column("copy").fill_null(False))))
            ids = batch.column(ID).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in squeezed_steps(batch.column("z"), STEP):
                start, _, key = runs(data, offsets, length)
                doc = np.searchsorted(offsets, start, "right") - 1
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)])
                n = np.diff(np.r_[new, len(key)])
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[a:b][doc[new]].astype(np.int64)), pa.array(n)], ["key", "id", "n"])

    return lean(rows)


CONTEXT = "key long, id long, start long, n long, c1 long, c2 long, again boolean, bytes binary"


def _contexts(length: int):
    """mapInArrow: the runs whose gram occurs more than once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("keys")), pc.invert(batch.column("copy").fill_null(False))))
            ids = batch.column(ID).to_numpy(zero_copy_only=False)
            sizes = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
            flat, at = batch.column("keys").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.r_[0, np.cumsum(sizes)].astype(np.int64)
            for a, b, data, offsets in squeezed_steps(batch.column("z"), STEP):
                start, stop, key = runs(data, offsets, length)
                doc = np.searchsorted(offsets, start, "right") - 1
                of = np.repeat(np.arange(b - a, dtype=np.uint64), sizes[a:b])
                ok = np.isin(key ^ mix(doc.astype(np.uint64), 5), flat[at[a] : at[b]] ^ mix(of, 5))
                start, stop, key, doc = start[ok], stop[ok], key[ok], doc[ok]
                end = stop + length - 1
                c1, c2 = digests(data, start, end).T
                order = np.lexsort((start, c2, c1, doc))
                again = np.zeros(len(start), bool)
                again[order[1:]] = (c1[order[1:]] == c1[order[:-1]]) & (c2[order[1:]] == c2[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
                text, edge = _gather(data, start, np.where(again, start, end))
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(text)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[a:b][doc].astype(np.int64)), pa.array(start - offsets[doc]), pa.array(stop - start), pa.array(c1), pa.array(c2), pa.array(again), text],
                    ["key", "id", "start", "n", "c1", "c2", "again", "bytes"],
                )

    return lean(rows)


def _empty(schema: list[str]) -> pa.Table:
    return pa.table({c: pa.array([], pa.int64()) for c in schema})


SHARD_OUT = ["id", "start", "n", "shard", "f1", "f2"]


def _shard(length: int):
    """applyInArrow over one shard: windows to remove (n of them from start), and in a dealt shard (n = 0) its first occurrences."""

    def array(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("bytes").combine_chunks()
        raw = column.cast(pa.large_binary())
        at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        text = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        ids, first, n = (table.column(c).to_numpy() for c in ("id", "start", "n"))
        end = np.repeat(at[1:], np.diff(at))
        context = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
        start = at[context] + inner
        order = suffix_order(text, end, start, length)
        common = kasai(text, context, start, order, length)
        # windows of one gram only; equal windows choose equal grams
        string = np.empty(len(start), np.int64)
        string[order] = np.cumsum(common < length)
        where_id, where_at = ids[context], first[context] + inner
        by = np.lexsort((where_at, where_id, string))
        is_first = np.ones(len(start), bool)
        is_first[by[1:]] = string[by[1:]] != string[by[:-1]]
        gone = ~is_first
        # runs of removed windows
        edge = gone & ~np.r_[False, gone[:-1] & (context[1:] == context[:-1])]
        tail = gone & ~np.r_[gone[1:] & (context[1:] == context[:-1]), False]
        a, b = np.flatnonzero(edge), np.flatnonzero(tail)
        shard = group[1].as_py()
        out = [where_id[a], where_at[a], b - a + 1, np.full(len(a), shard), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)]
        if shard >= 0:
            k = np.flatnonzero(is_first)
            f1, f2 = digests(text, start[k], start[k] + length).T
            out = [np.r_[x, y] for x, y in zip(out, (where_id[k], where_at[k], np.zeros(len(k), np.int64), np.full(len(k), shard), f1, f2), strict=True)]
        return pa.table({c: pa.array(x.astype(np.int64)) for c, x in zip(SHARD_OUT, out, strict=True)})

    return array


def _merge(table: pa.Table) -> pa.Table:
    """applyInArrow over a range of digests: the strings that another shard has earlier.

    A shard has each string of a gram once.  The shards come in one after
    another, sorted; each string is looked up by binary search among those that
    came in before, where the earlier occurrence stays.
    """
    i, s, shard = (table.column(c).to_numpy() for c in ("id", "start", "shard"))
    digest = np.ascontiguousarray(np.stack([table.column(c).to_numpy() for c in ("f1", "f2")], 1)).view("S16")[:, 0]
    order = np.lexsort((digest, shard))
    gone = np.zeros(len(i), bool)
    leads = np.zeros(0, np.int64)
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        at = np.searchsorted(digest[leads], digest[own])
        met = np.zeros(len(own), bool)
        if len(leads):
            met = digest[leads[np.minimum(at, len(leads) - 1)]] == digest[own]
        mine, rival = own[met], leads[at[met]]
        earlier = (i[mine] < i[rival]) | (i[mine] == i[rival]) & (s[mine] < s[rival])
        gone[np.where(earlier, rival, mine)] = True
        leads[at[met][earlier]] = mine[earlier]
        leads = np.insert(leads, at[~met], own[~met])
    return pa.table({"id": pa.array(i[gone]), "start": pa.array(s[gone]), "n": pa.array(np.ones(gone.sum(), np.int64))})


def _cut(length: int):
    """mapInArrow: what is left of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column("copy").fill_null(False).to_numpy(zero_copy_only=False)
            cuts = batch.column("cuts")
            sizes = cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = cuts.flatten()
            c0, cn = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            at = np.r_[0, np.cumsum(sizes)]
            for a, b, data, offsets in squeezed_steps(batch.column("z")):
                n = np.diff(offsets)
                doc = np.repeat(np.arange(b - a), sizes[a:b])
                marks = np.zeros(len(data) + 1, np.int64)
                lo = offsets[doc] + c0[at[a] : at[b]]
                np.add.at(marks, lo, 1)
                np.subtract.at(marks, lo + cn[at[a] : at[b]] + length - 1, 1)
                whole = np.flatnonzero(copy[a:b] & (n >= length))
                np.add.at(marks, offsets[whole], 1)
                np.subtract.at(marks, offsets[whole + 1], 1)
                gone = np.cumsum(marks[:-1]) > 0
                kept = data[~gone]
                ends = np.r_[0, np.cumsum(~gone)][offsets]
                left = np.diff(ends)
                edge = np.zeros(len(data), bool)  # a document's first byte
                edge[offsets[:-1][n > 0]] = True
                s0 = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]]))
                s1 = np.flatnonzero(gone & np.r_[edge[1:] | ~gone[1:], True]) + 1
                of = np.searchsorted(offsets, s0, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array((s0 - offsets[of]).astype(np.int64)), pa.array((s1 - offsets[of]).astype(np.int64))], ["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=b - a))].astype(np.int32)), spans)
                new = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(REST).slice(a, b - a), new, pa.array(n), pa.array(n - left), spans], [REST, TEXT, "n_bytes", "n_removed", "removed"])

    return lean(rows)


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without the bytes of strings that occurred earlier.

    A byte goes if it lies in a string of ``length`` bytes that also starts
    earlier: in a document of smaller id, or in the same one before.  Strings
    are judged on the input and don't cross documents; overlapping ones count.
    The text column becomes binary (what is left may end inside a character);
    ``n_bytes``, ``n_removed`` and ``removed`` (byte spans) replace columns of
    those names.

    Null text is empty.  Exact copies of a whole text are settled by its hash;
    repeated rows of one id don't remove each other.  Rows with a null id have
    no place in the order: nothing of them goes and they remove nothing.  Extra
    columns stay.  128-bit digests decide whether contexts are equal, and
    strings of different shards.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    full = dealt_by_id(docs, id_col, text_col)
    found = full.mapInArrow(_grams(length), "key long, id long, n long")
    again = found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    keys = found.select("key", "id").join(again, "key").groupBy("id").agg(F.collect_set("key").alias("keys")).withColumnRenamed("id", "k")
    ctx = written(full.join(keys, F.col(ID) == F.col("k"), "left").mapInArrow(_contexts(length), CONTEXT), "contexts")

    live = ctx.where(~F.col("again"))
    firsts = live.groupBy("c1", "c2").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1")
    gone = ctx.where("again").select("id", "start", "n").unionByName(live.select("c1", "c2", "id", "start", "n").join(firsts, ["c1", "c2"]).where("id > first").select("id", "start", "n"))
    distinct = live.groupBy("key", "c1", "c2").agg(F.count("*"))
    many = distinct.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1")
    wanted = live.join(many, "key").groupBy("key", "contexts", "c1", "c2").agg(F.min_by(F.struct("id", "start", "n", "bytes"), "id").alias("x")).select("key", "contexts", "c1", "x.*")
    wanted = written(wanted, "distinct")
    total = wanted.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    salts = F.ceil(F.col("contexts") / SHARD_CONTEXTS)
    hot = F.col("contexts") > SHARD_CONTEXTS
    shards = max(1, -(-total // SHARD_BYTES))
    dealt = wanted.select("key", "id", "start", "n", "bytes", F.when(hot, F.col("key")).otherwise(F.pmod("key", F.lit(shards))).alias("a"), F.when(hot, F.pmod(F.xxhash64("c1"), salts)).otherwise(F.lit(-1)).cast("long").alias("b"))
    out = written(dealt.groupBy("a", "b").applyInArrow(_shard(length), ", ".join(f"{c} long" for c in SHARD_OUT)), "strings")
    firsts_of_shards = out.where("n = 0")
    ranges = max(1, -(-firsts_of_shards.count() // RANGE_STRINGS))
    merged = firsts_of_shards.withColumn("range", F.pmod(F.xxhash64("f1"), F.lit(ranges))).groupBy("range").applyInArrow(_merge, "id long, start long, n long")
    gone = gone.unionByName(out.where("n > 0").select("id", "start", "n")).unionByName(merged)
    cuts = gone.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("cuts")).withColumnRenamed("id", "k")

    left = full.join(cuts, F.col(ID) == F.col("k"), "left").select(REST, "z", "copy", "cuts")
    schema = left.select(REST, F.col("z").alias(TEXT)).schema.add("n_bytes", "long").add("n_removed", "long").add("removed", SPANS)
    cut = left.mapInArrow(_cut(length), schema)
    return unpacked(cut, docs, text_col, extra={c: F.col(c) for c in ("n_bytes", "n_removed", "removed")})
