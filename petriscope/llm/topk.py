"""Exact top-k inner products from an impact-ordered index, read score-at-a-time.

A block of vectors is indexed by impact: every component is split into a level
(the nearest multiple of a step, its impact) and a rest.  The postings of one
dimension and level, the places of the vectors that have it, are a segment;
segments are read in descending order of impact, each adding to the
accumulators of its own vectors only.  While they are, an accumulator differs
from its score by no more than the query's length times the length of what is
unread of the vector, which the index keeps for each level.  Reading stops only
on proof: when few vectors can still reach the k-th best certain score, the
rounding of the accumulators included.  Possible members are rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least impact step, and impact levels of a block at most: large components have a larger step.
STEP, LEVELS = 8, 64
#: Numbers in the queries, and in the vectors, of one task at most; of either 32,768 rows at most; vectors of an index, queries that read it together.
BLOCK_NUMBERS, BLOCK_ROWS, INDEX_BLOCK, READERS = 1 << 22, 32_768, 4096, 256


class ImpactIndex:
    """Posting segments of one block of integer vectors, by descending impact.

    >>> index = ImpactIndex(np.array([[40, 0], [3, 50], [-9, 1]]), np.array([7, 8, 9]))
    >>> index.search(np.array([[1, 0], [0, 1]]), 2, np.array([-1, -1]))
    [(0, 7, 40), (0, 8, 3), (1, 8, 50), (1, 9, 1)]
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors.astype(np.int64), ids
        self.floats = self.vectors.astype(np.float64)
        n, dims = self.vectors.shape
        size = np.abs(self.vectors)
        self.peak = int(size.max(initial=0))
        self.step = max(STEP, self.peak // LEVELS + 1)
        level = size // self.step + (size % self.step > self.step // 2)
        rows, cols = np.nonzero(level)
        level, sign = level[rows, cols], np.sign(self.vectors[rows, cols])
        order = np.argsort((LEVELS + 1 - level) * (2 * dims) + 2 * cols + (sign < 0), kind="stable")
        self.rows, cols, level, sign = rows[order], cols[order], level[order], sign[order]
        cuts = np.flatnonzero((np.diff(level) != 0) | (np.diff(cols) != 0) | (np.diff(sign) != 0)) + 1
        starts = np.concatenate([[0], cuts])[: len(order)]
        ends = np.append(starts[1:], len(order))
        # segments of one level follow each other: (impact, [(dimension, weight, from, to)], length of what is unread of each vector)
        whole = (self.floats**2).sum(1)
        left, self.levels = whole.copy(), []
        for impact in np.unique(level)[::-1]:
            at = np.flatnonzero(level[starts] == impact)
            weight = sign[starts[at]] * impact * self.step
            segments = list(zip(cols[starts[at]].tolist(), weight.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True))
            a, b = segments[0][2], segments[-1][3]
            x = self.floats[self.rows[a:b], cols[a:b]]
            left -= np.bincount(self.rows[a:b], x**2 - (x - sign[a:b] * float(impact * self.step)) ** 2, n)
            self.levels.append((int(impact), segments, np.sqrt(np.maximum(left, 0) + whole * (dims + 2) * 2.0**-50)))

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, id, score) of each query's k best, ties to the smaller id, its own id left out."""
        n = len(self.ids)
        q = queries.astype(np.float32).T.copy()
        exact = queries.astype(np.float64)
        length, reach = np.sqrt((exact**2).sum(1)) * (1 + 2.0**-40), np.abs(exact).sum(1)
        # twice what float32 can be off by: each product and each sum by 2**-24 of no more than reach times 1.5 peaks
        rounding = 1.5 * reach * self.peak * (queries.shape[1] + 3) * 2.0**-23
        top = reach.max(initial=0) * self.peak
        done = np.zeros((n, queries.shape[0]), np.float32)
        mine = self.ids[None, :] == own[:, None]
        keep = min(k, n - 1)
        member, judged = np.ones(mine.shape, bool), np.inf
        for place, (_, segments, unread) in enumerate(self.levels):
            if n <= k + 1:
                break
            for col, weight, a, b in segments:
                done[self.rows[a:b]] += np.float32(weight) * q[col]
            widest = unread.max()
            if widest > judged / 2 and place + 1 < len(self.levels):
                continue  # what is unread has hardly become less since the last try
            judged = widest
            slack = length[:, None] * unread[None, :] + rounding[:, None]
            now = done.T.astype(np.float64)
            worst = np.partition(np.where(mine, -np.inf, now - slack), n - keep, axis=1)[:, n - keep]
            member = now + slack + 1 >= worst[:, None]
            if member.sum() <= 4 * k * len(member):
                break
        out = []
        rows, cols = np.nonzero(member & ~mine)
        ends = np.searchsorted(rows, np.arange(len(queries) + 1))
        for i in range(len(queries)):
            at = cols[ends[i] : ends[i + 1]]
            if top < 2.0**52:  # every product and sum is a whole number that a double holds
                score = (self.floats[at] @ exact[i]).astype(np.int64)
            elif top < 2.0**62:
                score = self.vectors[at] @ queries[i].astype(np.int64)
            else:  # in unbounded integers; a score that is no 64-bit integer is an error
                score = np.array(self.vectors[at].astype(object) @ queries[i].astype(object), np.int64)
            best = np.lexsort((self.ids[at], -score))[:k]
            out += [(i, int(self.ids[at[j]]), int(score[j])) for j in best]
        return out


def _cell_search(k: int):
    """applyInArrow over one cell of the grid: query blocks by vector blocks of one dimension."""

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        dim = key[2].as_py()
        ids = table.column("id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        v = flat.reshape(-1, dim) if dim else np.zeros((table.num_rows, 0), np.int64)
        own, q = ids[is_query], v[is_query]
        ids, v = ids[~is_query], v[~is_query]
        order = np.argsort(own, kind="stable")
        own, q = own[order], q[order]
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        found: list[tuple[int, int, int]] = []
        for a in range(0, len(ids), INDEX_BLOCK):
            index = ImpactIndex(v[a : a + INDEX_BLOCK], ids[a : a + INDEX_BLOCK])
            for b in range(0, len(own), READERS):
                found += [(b + i, x, s) for i, x, s in index.search(q[b : b + READERS], k, own[b : b + READERS])]
        i, x, s = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((x, -s, i))
        i, x, s = i[order], x[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, x, s = i[rank < k], x[rank < k], s[rank < k]
        return pa.table({"query_id": pa.array(own[i]), "vec_id": pa.array(x), "score": pa.array(s)})

    return search


def _component(scale: int):
    """floor(scale * x) as a 64-bit integer; one that doesn't fit is an error."""
    error = F.raise_error(F.lit("a component of a vector is too large")).cast("long")
    return lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale)).otherwise(error)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    Components become floor(scale * x), x as double; components of 2**62 or
    more, and scores that are no 64-bit integers, are errors.  Candidates are all rows
    but those of the query's own id; ties go to the smaller id; fewer than k
    candidates give fewer rows.  Rows whose id or vector is null, or whose
    vector is empty or holds null or non-finite components, take no part.
    Vectors of different length are not compared.  If a query id occurs more
    than once, its least vector is the query; a repeated candidate counts each
    time.  Extra columns don't matter.

    Queries and vectors meet in the cells of a grid, each of about
    ``BLOCK_ROWS`` of either (fewer, if they are long) whatever the size of the input, so a vector is dealt, and its
    index built, once for that many queries; k rows per query leave a cell.
    """
    x = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull()).withColumn("__q", is_query)
    rows = rows.where(fine & (F.size(x) > 0)).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(x, _component(scale)).alias("v"), "__q")
    rows = rows.withColumn("dim", F.size("v"))
    queries = rows.where("__q").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("m")).select("id", "m.v", "m.dim")
    n, longest = rows.agg(F.count("*"), F.max("dim")).first()
    block = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(longest or 1, 1)))
    rs, qs = max(1, -(-n // block)), max(1, -(-queries.count() // block))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = queries.select(F.lit(True).alias("is_query"), "id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(qs)).cast("int").alias("qb")).withColumn("vb", every(rs))
    # rows of one id are parted by their place, so that no id makes a cell larger
    right = rows.select(F.lit(False).alias("is_query"), "id", "v", "dim", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(rs)).cast("int").alias("vb")).withColumn("qb", every(qs))
    cells = left.select("is_query", "id", "v", "dim", "qb", "vb").unionByName(right.select("is_query", "id", "v", "dim", "qb", "vb"))
    found = cells.groupBy("qb", "vb", "dim").applyInArrow(_cell_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
