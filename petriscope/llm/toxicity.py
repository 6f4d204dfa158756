"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees the words of the
text and the probabilities of the categories before it.  Those it trains with
are out-of-fold - from models that had not seen the row - so that it learns how
far a predicted probability can be trusted, not how well training rows are
remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ID, REST, TEXT, bounded_batches, lean, packed, unpacked
from .textkernel import LOWER, Words, byte_values, mix, prefix_sums, run_hash, steps

#: Hashed words and word beginnings of 4 and 5 bytes.
BITS = 18
BEGINNINGS = (4, 5)
#: Labelled rows of either sort to learn from, about: the bound of the training sample.
POSITIVE, NEGATIVE = 4000, 8000
FOLDS = 5
#: Standard errors by which a feature's log odds must differ from none, and rows that must have it.
CLEAR, SUPPORT = 3.5, 3

_BREAK = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_SPACE = np.where(_BREAK, 0x20, LOWER).astype(np.uint8)


def feature_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all words and their beginnings; letters and digits make words, A-Z lower-cased."""
    data = _SPACE[data]
    w = Words(data, offsets)
    sums = prefix_sums(byte_values(data))
    docs, ids = [w.doc], [run_hash(sums, w.start, w.end)]
    for n in BEGINNINGS:
        long = w.end - w.start > n
        docs.append(w.doc[long])
        ids.append(run_hash(sums, w.start[long], w.start[long] + n, n))
    return np.concatenate(docs), (mix(np.concatenate(ids)) >> np.uint64(64 - BITS)).astype(np.int64)


class Sparse:
    """0/1 rows as (row, column) places."""

    def __init__(self, row: np.ndarray, col: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.shape = row, col, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.shape[1])

    def rows(self, chosen: np.ndarray) -> Sparse:
        take = chosen[self.row]
        return Sparse((np.cumsum(chosen) - 1)[self.row[take]], self.col[take], (int(chosen.sum()), self.shape[1]))


def logistic(x: Sparse, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2.0, rounds: int = 150) -> np.ndarray:
    """Weights of the sparse columns, then of ``extra`` and the constant; steps scaled by each weight's past slopes."""
    n = x.shape[1] + extra.shape[1] + 1
    w, past = np.zeros(n), np.full(n, 1e-8)
    prior = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4) if len(y) else 0.5
    w[-1] = np.log(prior / (1 - prior))
    for k in range(rounds):
        p = probability(x, extra, w)
        g = weight * (p - y)
        grad = np.concatenate([x.transposed_times(g), g @ extra, [g.sum()]])
        grad[:-1] += penalty * w[:-1]
        past += grad * grad
        w = w - 0.5 * grad / np.sqrt(past)
    return w


def probability(x: Sparse, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    m = x.shape[1]
    return 1 / (1 + np.exp(-np.clip(x.times(w[:m]) + extra @ w[m:-1] + w[-1], -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def one_fit(f: int, x: Sparse, fold: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, probabilities of the rows of fold ``f``) of a model that has not seen that fold; a fold that no row has leaves all rows to learn from."""
    train = fold != f
    if not train.any():
        return np.zeros(0), np.zeros(len(y))
    w = logistic(x.rows(train), earlier[train], y[train], weight[train])
    return w, probability(x.rows(~train), earlier[~train], w)


def fold_tasks(spark: SparkSession):
    """Runs the fits of a category, one of each fold and one of all rows, as tasks; the bounded sample is broadcast."""

    def begin(x: Sparse, fold: np.ndarray) -> Callable:
        sample = spark.sparkContext.broadcast((x, fold))

        def run(*given: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            small = spark.sparkContext.broadcast(given)

            def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for f in batch.column(0).to_pylist():
                        w, out = one_fit(f, *sample.value, *small.value)
                        yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([w]), pa.array([out])], ["f", "w", "out"])

            got = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(lean(rows), "f long, w array<double>, out array<double>").toArrow().to_pylist()
            small.destroy()
            return [(np.array(r["w"]), np.array(r["out"])) for r in sorted(got, key=lambda r: r["f"])]

        return run

    return begin


class Chain:
    """One model per category, in order; ``tasks`` runs a category's fits (:func:`fold_tasks`), or they run one after the other."""

    def __init__(self, names: list[str], doc: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, tasks: Callable | None = None):
        n = len(y)
        keep = np.zeros(1 << BITS, bool)
        for j in range(len(names)):  # features whose log odds are clear in any category
            yes = np.bincount(feature, y[doc, j], 1 << BITS)
            no = np.bincount(feature, 1 - y[doc, j], 1 << BITS)
            a, b = y[:, j].sum(), (1 - y[:, j]).sum()
            odds = np.log((yes + 0.5) / (a - yes + 0.5)) - np.log((no + 0.5) / (b - no + 0.5))
            error = np.sqrt(1 / (yes + 0.5) + 1 / (a - yes + 0.5) + 1 / (no + 0.5) + 1 / (b - no + 0.5))
            keep |= (np.abs(odds) > CLEAR * error) & (yes + no >= SUPPORT)
        self.names = names
        self.place = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
        self.width = int(keep.sum())
        own = keep[feature]
        x = Sparse(doc[own], self.place[feature[own]].astype(np.int64), (n, self.width))
        self.weights, self.cut = [], []
        run = tasks(x, fold) if tasks else lambda *given: [one_fit(f, x, fold, *given) for f in range(FOLDS + 1)]
        earlier = np.zeros((n, 0))
        for j in range(len(names)):
            *folds, (w, _) = run(earlier, y[:, j], weight)
            out = np.zeros(n)
            for f, (_, p) in enumerate(folds):
                out[fold == f] = p
            self.weights.append(w)
            self.cut.append(best_cut(out, y[:, j], weight))
            earlier = np.c_[earlier, _logit(out)]

    def predict(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        at = self.place[feature]
        doc, at = doc[at >= 0], at[at >= 0].astype(np.int64)
        pair = np.unique(doc * np.int64(self.width + 1) + at)
        x = Sparse(pair // (self.width + 1), pair % (self.width + 1), (n, self.width))
        out = np.zeros((n, 0))
        earlier = np.zeros((n, 0))
        for w in self.weights:
            p = probability(x, earlier, w)
            out, earlier = np.c_[out, p], np.c_[earlier, _logit(p)]
        return out


def best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which a row counts as positive: best F1 out of fold, in the middle of its gap.

    Half of what it takes must be right out of fold; where no cut manages that,
    there is nothing to go by and no row is positive.
    """
    if not len(p) or not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * y).sum())
    last = np.r_[p[order][1:] < p[order][:-1], True]
    f1 = np.where(last & (2 * hit >= all_), f1, 0)
    if not f1.any():
        return 1.1
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in steps(batch.column("text")):
            doc, feature = feature_ids(data, offsets)
            pair = np.unique(doc << BITS | feature)
            ends = np.r_[0, np.cumsum(np.bincount(pair >> BITS, minlength=b - a))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((pair & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("id", "y", "positive")), lists], ["id", "y", "positive", "f"])


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """A chain from labelled rows; ``categories`` are conditions on ``labels``, in the order of the chain.

    About ``POSITIVE`` rows that have the second category (the only one, if
    there is one) and ``NEGATIVE`` others are taken by a hash of the id and weighed by how many they stand
    for.  Labels that are null are no label; of repeated labels of an id any
    that has a category gives it.  Other columns of ``labels`` are not read.
    """
    bounded_batches(docs.sparkSession)
    ys = [f"y{k}" for k in range(len(categories))]
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(c.cast("int").alias(y) for y, c in zip(ys, categories.values(), strict=True))).dropna()
    named = named.groupBy("id").agg(*(F.max(y).alias(y) for y in ys))
    named = named.withColumn("positive", F.col(ys[min(1, len(ys) - 1)]) > 0)
    counts = {r["positive"]: r["count"] for r in named.groupBy("positive").count().collect()}
    share = {True: min(1.0, POSITIVE / max(1, counts.get(True, 0))), False: min(1.0, NEGATIVE / max(1, counts.get(False, 0)))}
    part = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) < F.when(F.col("positive"), F.lit(share[True])).otherwise(F.lit(share[False])) * float(1 << 30)
    chosen = named.where(part).select("id", F.array(*ys).alias("y"), "positive")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    table = texts.join(F.broadcast(chosen), F.col("i") == F.col("id")).select("id", "text", "y", "positive").mapInArrow(lean(_sample_rows), "id long, y array<int>, positive boolean, f array<int>").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by("id").combine_chunks()
    f = table.column("f").combine_chunks()
    size = f.value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(table.num_rows), size)
    y = np.array(table.column("y").to_pylist(), float)
    weight = np.where(table.column("positive").to_numpy(zero_copy_only=False), 1 / share[True], 1 / share[False])
    fold = (mix(table.column("id").to_numpy().astype(np.int64).view(np.uint64), 3) % np.uint64(FOLDS)).astype(np.int64)
    return Chain(list(categories), doc, f.flatten().to_numpy().astype(np.int64), y, weight / weight.mean(), fold, fold_tasks(docs.sparkSession))


def _predict(model, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(TEXT)):
                p = chain.predict(*feature_ids(data, offsets), b - a) if chain is not None else np.zeros((b - a, len(names)))
                hit = p >= (np.array(chain.cut) if chain is not None else 1.1)
                has = batch.column(TEXT).slice(a, b - a).is_valid().to_numpy(zero_copy_only=False)
                p, hit = np.where(has[:, None], p, 0), hit & has[:, None]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (ID, TEXT, REST)), *(pa.array(p[:, k]) for k in range(len(names))), *(pa.array(hit[:, k]) for k in range(len(names)))], [ID, TEXT, REST, *(f"p{k}" for k in range(len(names))), *(f"h{k}" for k in range(len(names)))])

    return lean(rows)


def score(docs: DataFrame, chain: Chain | None, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` packed (``__id, __text, __rest``) with a probability p0.. and a decision h0.. per category.

    Null text has probability 0 and is never positive; so has every text if
    there was nothing to learn from.  Text is read whole, however long.
    """
    rows = packed(docs, id_col, text_col)
    schema = T.StructType(list(rows.schema.fields))
    for k in range(len(names)):
        schema = schema.add(f"p{k}", "double")
    for k in range(len(names)):
        schema = schema.add(f"h{k}", "boolean")
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(chain), names), schema)


def categories() -> dict[str, Column]:
    """The chain over the table ``labels`` (quality 0/1, toxic 0/1); its third category is both at once."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low, "toxic": toxic, "toxic_low_quality": low & toxic}


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, p_toxic_low_quality, toxic) of the documents that the chain rejects.

    Null and empty texts are never rejected; repeated rows are rejected alike,
    a rejected row with a null id is reported as null.  Texts are read whole.
    Without labels, or without documents, nothing is rejected.  Other columns
    don't matter.
    """
    names = list(categories())
    scored = score(docs, fit(docs, labels, categories()), names)
    return scored.where("h1").select(F.col(ID).alias("doc_id"), *(F.col(f"p{k}").alias(f"p_{n}") for k, n in enumerate(names)), F.col("h1").alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the chain rejects, all columns as they were.

    Rows are judged one by one, so repeated rows go or stay together, and a row
    with a null id is judged by its text.  Null and empty texts stay.
    """
    return unpacked(score(docs, fit(docs, labels, categories(), id_col, text_col), list(categories()), id_col, text_col).where(~F.col("h1")), docs, text_col)
