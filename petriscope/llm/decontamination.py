"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is the hash of the words at the cared-for positions of a mask; the
ignored positions may hold anything.  The masks are chosen by enumeration so
that one of them hits wherever the replaced words of a stretch stand, for as
many as the rule lets be replaced.  Every hit fixes an alignment of document
and item, and the words of each alignment are compared once, one by one: it counts if
some stretch of the item agrees in four fifths of its words.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, join_ids, written

#: Stretches of more words, or of more placements of replaced words, are not enumerated.
MOST_WORDS, MOST_PLACEMENTS = 13, 300
#: Places of items whose seeds one broadcast holds, about; more are taken in turns.
ITEM_WORDS = 200_000


def _words(text: Column) -> Column:
    """Hashes of the lower-cased words of a text, as array<long>; null text has none."""
    trimmed = F.btrim(F.lower(text.cast("string")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    return F.transform(words, lambda w: F.xxhash64(w))


@lru_cache
def covering(n: int, wrong: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which one lies on agreeing words only, whichever ``wrong`` of ``n`` words are replaced.

    The heaviest one or two that enumeration finds; where that is too much, the
    run of words that ``wrong`` replaced ones can't break up.

    >>> covering(13, 2)
    ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
    >>> covering(40, 8)
    ((0, 1, 2, 3),)
    """
    run = -(-(n - wrong) // (wrong + 1))
    if wrong and n <= MOST_WORDS and math.comb(n, wrong) <= MOST_PLACEMENTS:
        placements = [sum(1 << p for p in c) for c in combinations(range(n), wrong)]
        every = (1 << len(placements)) - 1
        for weight in range(n - wrong, run, -1):
            served = []  # (placements that the mask survives at some shift, as bits, mask)
            for rest in combinations(range(1, n), weight - 1):
                mask = sum(1 << p for p in rest) + 1
                shifts = [mask << s for s in range(n - rest[-1])] if rest else [1 << s for s in range(n)]
                served.append((sum(1 << k for k, c in enumerate(placements) if any(not c & m for m in shifts)), (0, *rest)))
            served.sort(key=lambda x: (-x[0].bit_count(), x[1]))
            if served[0][0] == every:
                return (served[0][1],)
            for i, (a, first) in enumerate(served):
                if 2 * a.bit_count() < len(placements):
                    break
                for b, second in served[i + 1 :]:
                    if a.bit_count() + b.bit_count() < len(placements):
                        break
                    if a | b == every:
                        return first, second
    return (tuple(range(run)),)


def _seeds(words: Column, at: Column, masks: list[tuple[int, ...]]) -> Column:
    """Array of the seed hashes at a position, null where a mask doesn't fit."""
    return F.array(*(F.when(at + mask[-1] < F.size(words), F.xxhash64(F.lit(k), *(F.get(words, at + p) for p in mask))) for k, mask in enumerate(masks)))


def contaminated(docs: DataFrame, benchmark: DataFrame, stretch: int = 13, agree: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_hits, n_agree, n_aligned), one row for each document and item that overlap.

    They overlap if, aligned at a seed hit, some ``stretch`` consecutive words
    of the item (all of them, if it has fewer) agree with the document in at
    least ``agree`` of them.  Words are runs other than space and 0x09-0x0D,
    lower-cased.  n_hits counts the alignments that overlap; n_agree and
    n_aligned are those of the best.  Null and empty texts or items overlap with
    nothing; repeated rows add to n_hits; a null document id is reported as
    null.  Extra columns don't matter.  Every overlap has a seed hit: items of
    ``stretch`` words or more have the masks of a stretch, shorter ones those of
    their length.

    The benchmark's seeds are broadcast in turns of at most about ``ITEM_WORDS``
    positions, counted first, so documents are never shuffled.  What leaves a
    scan are distinct alignments (row, item, shift) without any words; only the
    rows among them are read again, and each alignment is compared once.
    """
    if stretch < 1 or agree <= 0:
        raise ValueError("stretch and agree must be positive")
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), _words(F.col(f"`{item_text_col}`")).alias("iw")).where(F.size("iw") > 0)
    items = items.withColumn("key", F.xxhash64("item_id", "iw"))
    total, *_ = items.agg(F.sum(F.size("iw"))).first()
    if not total:
        return docs.limit(0).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *(F.lit(0).cast("long").alias(c) for c in ("item_id", "n_hits", "n_agree", "n_aligned")))
    needed = F.least(F.lit(stretch), F.size("iw"))
    lengths = sorted(r[0] for r in items.select(needed).distinct().collect())  # at most ``stretch`` numbers
    serving = {n: covering(n, max(0, n - math.ceil(agree * n))) for n in lengths}
    masks = sorted({m for own in serving.values() for m in own})
    turns = -(-total // ITEM_WORDS)
    # rows of one key that differ are compared with each other's alignments too, which adds nothing false
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    least = min(m[-1] + 1 for m in masks)
    at = text.select("row", _words(F.col("text")).alias("w")).where(F.size("w") >= least).select("row", "w", F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias("pos"))
    seeded = at.select("row", "pos", F.explode(_seeds(F.col("w"), F.col("pos"), masks)).alias("seed")).where("seed is not null")
    places = items.where(F.size("iw") >= least).select("key", "iw", F.explode(F.sequence(F.lit(0), F.size("iw") - least)).alias("ipos"))
    seeds = places.select("key", "iw", "ipos", F.posexplode(_seeds(F.col("iw"), F.col("ipos"), masks)).alias("k", "seed"))
    # an item has the masks of its own length only
    fits = reduce(or_, ((needed == n) & F.col("k").isin(*(masks.index(m) for m in own)) for n, own in serving.items()))
    seeds = seeds.where("seed is not null").where(fits).select("seed", "ipos", "key").distinct()
    out = None
    for turn in range(turns):
        some = seeds.where(F.pmod(F.xxhash64("key", "ipos"), F.lit(turns)) == turn)
        found = seeded.join(F.broadcast(some), "seed").select("row", "key", (F.col("pos") - F.col("ipos")).alias("shift"))
        out = found if out is None else out.unionByName(found)
    hits = written(out.distinct(), "alignments")

    rows = join_ids(text, "row", hits.select("row").distinct(), "left_semi").select("doc_id", "row", _words(F.col("text")).alias("w"))
    few = hits.count() <= BROADCAST_IDS
    hit = rows.join(F.broadcast(hits) if few else hits, "row")
    texts = items.dropDuplicates(["key"])
    hit = hit.join(F.broadcast(texts) if turns == 1 else texts, "key")
    shift = F.col("shift")
    hit = hit.select("doc_id", "item_id", "iw", F.greatest(F.lit(0), -shift).alias("skip"), F.slice("w", F.greatest(F.lit(0), shift) + 1, F.size("iw")).alias("dw"))
    own = F.slice("iw", F.col("skip") + 1, F.size("dw"))
    hit = hit.select("doc_id", "item_id", needed.alias("need"), F.zip_with(own, F.slice("dw", F.lit(1), F.size("iw") - F.col("skip")), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))).alias("same"))
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, x: a + x)
    starts = F.sequence(F.lit(1), F.size("same") - F.col("need") + 1)
    agrees = F.exists(starts, lambda s: add(F.slice("same", s, F.col("need"))) >= F.ceil(F.lit(agree) * F.col("need")))
    good = hit.where(F.size("same") >= F.col("need")).where(agrees)
    best = good.select("doc_id", "item_id", add("same").cast("long").alias("n_agree"), F.size("same").cast("long").alias("n_aligned"))
    return best.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hits"), F.max("n_agree").alias("n_agree"), F.max("n_aligned").alias("n_aligned"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """``docs`` without the documents that overlap with any item; all columns stay.

    Documents with a null id can't be named and stay.
    """
    bad = contaminated(docs, benchmark, id_col=id_col, **parameters).where("doc_id is not null").select("doc_id").distinct()
    return join_ids(docs, id_col, bad, "left_anti")
