"""Language identification in two steps: the family first, then the language inside it.

Linear support vector machines over hashed byte n-grams: one-versus-rest among
the families, one-versus-one among the languages of the chosen family, where
closely related languages need a plane of their own for every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean
from .textkernel import LOWER, mix, steps

#: Hashed n-grams of 1 to 3 bytes.
DIM = 2048
ORDERS = (1, 2, 3)
#: Training rows of a language, about, and of all (8 kB each, so 256 MB); with more languages each has fewer, but not fewer than LEAST.
SAMPLE, ROWS, LEAST = 1000, 32_000, 20

#: Tasks that the planes are dealt to, at most.
TASKS = 256

#: Families of ISO 639-1 codes; any other value is a family by itself.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indo-aryan": "hi bn ur pa mr gu ne si",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "sinitic": "zh",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
}


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower()[:2] in codes.split() and len(lang.split("-")[0]) == 2), lang)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: square roots of n-gram shares, so of length one."""
    data = LOWER[data]
    docs = len(offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    out = np.zeros(docs * DIM, np.float64)
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :] if len(data) >= n else code[:0]
        inside = doc[: len(code)] == doc[n - 1 :] if len(code) else np.zeros(0, bool)
        bucket = (mix(code[inside], n) >> np.uint64(53)).astype(np.int64)
        out += np.bincount(doc[: len(code)][inside] * DIM + bucket, minlength=docs * DIM)
    out = out.reshape(docs, DIM)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, both classes of equal weight), by accelerated gradients."""
    mean = x.mean(0)
    z = x - mean
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (penalty + 2 * (share * (1 + (z * z).sum(1))).sum())
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ v[:-1] + v[-1])) * share * y
        grad = np.append(penalty * v[:-1] - 2 * (slack @ z), -2 * slack.sum())
        new = v - step * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1].astype(np.float32), float(w[-1] - mean @ w[:-1])


def plane_tasks(spark: SparkSession) -> Callable:
    """Fits planes as tasks; the bounded sample is broadcast."""

    def run(x: np.ndarray, label: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, float]]:
        sample = spark.sparkContext.broadcast((x, label, sides))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    w, b = one_plane(sample.value[0], sample.value[1], *sample.value[2][k])
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([w.tobytes()], pa.binary()), pa.array([b])], ["k", "w", "b"])

        tasks = min(len(sides), TASKS)
        got = spark.range(0, len(sides), 1, tasks).mapInArrow(lean(rows), "k long, w binary, b double").toArrow().sort_by("k").to_pylist()
        sample.destroy()
        return [(np.frombuffer(r["w"], np.float32), r["b"]) for r in got]

    return run


def one_plane(x: np.ndarray, label: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, float]:
    """The plane between the languages ``yes`` and ``no``."""
    side = np.where(np.isin(label, yes), 1, np.where(np.isin(label, no), -1, 0)).astype(np.float32)
    return svm(x[side != 0], side[side != 0]) if (side == 0).any() else svm(x, side)


class Model:
    """Planes of the families and of every pair of languages inside one; ``tasks`` fits them (:func:`plane_tasks`), or one follows the other."""

    def __init__(self, langs: list[str], x: np.ndarray, label: np.ndarray, tasks: Callable | None = None):
        self.langs = langs
        self.families = sorted({family(a) for a in langs})
        self.members = [[i for i, a in enumerate(langs) if family(a) == f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        every = np.arange(len(langs))
        sides = [(np.array(m), np.setdiff1d(every, m)) for m in self.members] if len(self.families) > 1 else []
        sides += [(np.array([a]), np.array([b])) for a, b in self.pairs]
        run = tasks if tasks and sides else lambda x, label, sides: [one_plane(x, label, *s) for s in sides]
        planes = run(x, label, sides)
        self.w = np.array([p[0] for p in planes], np.float32).reshape(-1, DIM)
        self.b = np.array([p[1] for p in planes], np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score in 0..1): votes inside the best family, margins break ties."""
        margin = x @ self.w.T + self.b
        sure = 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))
        n = len(self.families) if len(self.families) > 1 else 0
        best = margin[:, :n].argmax(1) if n else np.zeros(len(x), np.int64)
        score = sure[np.arange(len(x)), best] if n else np.ones(len(x))
        votes = np.zeros((len(x), len(self.langs)))
        trust = np.zeros((len(x), len(self.langs)))
        for k, (a, b) in enumerate(self.pairs, n):
            votes[:, a] += margin[:, k] > 0
            votes[:, b] += margin[:, k] <= 0
            trust[:, a] += sure[:, k]
            trust[:, b] += 1 - sure[:, k]
        lang = np.zeros(len(x), np.int64)
        for f, m in enumerate(self.members):
            own = best == f
            rank = votes[np.ix_(own, m)] + trust[np.ix_(own, m)] / (1 + len(m))
            lang[own] = np.array(m)[rank.argmax(1)] if own.any() else lang[own]
            if len(m) > 1:
                score[own] *= trust[own, lang[own]] / (len(m) - 1)
        return lang, score


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in steps(batch.column("text")):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def fit(rows: DataFrame) -> Model | None:
    """A model of all languages in (id, text, lang), from about ``SAMPLE`` rows of each by a hash of the id, or fewer where there are many.

    More languages than ``ROWS`` can hold ``LEAST`` rows of are an error.
    """
    bounded_batches(rows.sparkSession)
    counts = rows.groupBy("lang").count()
    many = counts.count()
    if many * LEAST > ROWS:
        raise ValueError(f"{many} languages are more than {ROWS} training rows can tell apart")
    share = min(SAMPLE, ROWS // max(many, 1))
    # a language of no more rows than its share has all of them
    part = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) * F.col("count") < F.lit(share << 20)
    sample = rows.join(F.broadcast(counts), "lang").where(part).select("text", "lang").mapInArrow(_feature_rows, "lang string, x binary").toArrow()
    lang = np.array(sample.column("lang").to_pylist(), object)
    if not len(lang):
        return None
    langs = sorted(set(lang))
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32).reshape(-1, DIM)
    return Model(langs, x, np.searchsorted(np.array(langs, object), lang), plane_tasks(rows.sparkSession))


def _predict(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in batch.column("text").to_pylist()], bool)
            for a, b, data, offsets in steps(batch.column("text")):
                if m is None:
                    lang, score = ["und"] * (b - a), np.zeros(b - a)
                else:
                    number, score = m.predict(features(data, offsets))
                    lang = [m.langs[k] if ok else "und" for k, ok in zip(number, letters[a:b], strict=True)]
                    score = np.where(letters[a:b], np.clip(score, 0, 1), 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("id", "held_out")), pa.array(lang, pa.string()), pa.array(score.astype(float))], ["id", "held_out", "lang_pred", "score"])

    return lean(rows)


def held_out(id_col: Column) -> Column:
    """A quarter of the documents, by crc32 of the id as text; a null id is not among them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of each row.

    Learned from rows with a language and an id that are not held out;
    predicted from the whole text alone.  Null text, or text without a letter,
    is ``und`` with score 0; so is all text if nothing could be learned.
    Of languages with as many duels won, the more certain one is predicted, then the first by name.
    Repeated rows and very long texts are texts like any other.
    """
    id_, text, lang = (F.col(f"`{c}`") for c in (id_col, text_col, lang_col))
    rows = docs.select(id_.cast("long").alias("id"), text.cast("string").alias("text"), lang.cast("string").alias("lang"), held_out(id_).alias("held_out"))
    model = fit(rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~F.col("held_out") & F.col("text").rlike(r"\p{L}")).select("id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.select("id", "held_out", "text").mapInArrow(_predict(shared), "id long, held_out boolean, lang_pred string, score double")
