"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, in every operator and stage."""

import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

rng = np.random.default_rng(17)
CLASHING = ("__key", "__id", "__text", "__rest", "__z", "z", "copy", "keys", "key", "row", "seed", "sig", "rep", "label", "component_id", "n_words", "n_removed", "removed", "id", "y", "p0", "h1", "given", "words")


def prose(n, of=300):
    return " ".join(f"w{k}" for k in rng.integers(0, of, n))


A, B, ITEM = prose(80), prose(90), prose(30)
ROWS = [
    (1, A), (2, A), (2, A), (3, f"{prose(40)} {B}"), (4, f"{prose(45)} {B} {prose(9)}"), (5, None), (6, ""), (7, " \t "), (8, prose(30_000, 20_000)),
    (9, f"{prose(20)} {ITEM} {prose(20)}"), (10, "one"), (11, "one"), (None, A), (None, None), (12, "ab " * 4000),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, None if k % 4 == 0 else "en", "s", len(t or "")) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit(f"old {c}") for c in CLASHING})
    return df.withColumn("m", F.create_map(F.lit("a"), F.lit("b"))).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    labels = spark.createDataFrame([(k, k % 2, 0, "x") for k in range(1, 12)] + [(1, None, None, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, id string")
    labels.withColumn("m", F.create_map(F.lit("a"), F.lit("b"))).write.parquet(f"{path}/labels.parquet")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").withColumns({c: F.lit("old") for c in CLASHING})
    bench.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def ids(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect())


def same_columns(df, odd):
    assert df.columns == odd.columns
    assert all(r[c] == f"old {c}" for r in df.limit(20).collect() for c in CLASHING)


def all_but(*gone):
    return sorted((i is None, i or 0) for i, _ in ROWS if i not in gone)


def test_stages(spark, odd, folder):
    import corpus_pipeline as P

    kept = {"toxicity": all_but(), "near duplicates": all_but(2, 11), "shared passages": all_but(), "decontamination": all_but(9)}
    none = odd.limit(0)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, folder)
        same_columns(out, odd)
        assert ids(out) == kept[name], name
        texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
        assert texts[5] is None and texts[6] == "" and texts[7] == " \t ", name
        empty = stage(spark, none, folder)
        assert empty.columns == odd.columns and empty.count() == 0, name
    cut = {r.doc_id: r for r in P.shared_passages(spark, odd, folder).collect() if r.doc_id is not None}
    assert cut[4].n_chars == len(cut[4].text) and len(cut[4].text.split()) == 45 + 9 and cut[3].text == dict(ROWS)[3]
    pieces = P.packing(spark, odd, folder)
    assert pieces.where("piece = 0").count() == len(ROWS) and P.packing(spark, none, folder).count() == 0


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op7", "op8"])
def test_operators_on_odd_rows(spark, odd, name):
    from petriscope.llm import language_id, ngram_jaccard, packing, sharding, substring_dedup, suffix_dedup

    run = {
        "op2": substring_dedup.substring_dedup, "op4": suffix_dedup.suffix_dedup, "op5": language_id.identify,
        "op6": lambda d: sharding.extendible_shards(d, 4000), "op7": lambda d: packing.pack(d, size=64).where("piece = 0"), "op8": ngram_jaccard.ngram_jaccard,
    }[name]
    key = "id" if name in ("op5", "op6", "op7") else "doc_id"
    shown = {"op2": ("text", "n_words", "n_removed", "removed"), "op4": ("text", "n_bytes", "n_removed", "removed"), "op5": ("held_out", "lang_pred", "score"), "op6": ("n_bytes", "depth", "prefix", "part"), "op7": ("piece", "start", "length"), "op8": ("n_shingles", "component_id")}[name]
    values = lambda df: sorted(map(str, df.select(key, *shown).collect()))
    out = run(odd)
    assert sorted((r[0] is None, r[0] or 0) for r in out.select(key).collect()) == all_but()
    assert values(out) == values(run(odd.select("doc_id", "text", "lang", "source", "n_chars"))), "columns that clash change nothing"
    assert run(odd.limit(0)).count() == 0


def test_links_of_labels_that_clash(spark, folder):
    from petriscope.llm.toxicity import toxic_documents

    docs = spark.createDataFrame([(k, prose(20) + " vile" * (k % 2)) for k in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2, "x") for k in range(40)] * 2, "doc_id long, quality int, toxic int, id string").withColumn("m", F.create_map(F.lit("a"), F.lit("b")))
    assert {r.doc_id for r in toxic_documents(docs, labels).collect()} <= set(range(1, 40, 2))


def test_chat_of_odd_rows(spark):
    from petriscope.llm.chat import format_trees, read_back, threads

    rows = [(None, 1, "user", "a", 1), (None, 2, "assistant", None, 1), (3, None, None, "b", 1), (3, 1, "user", "b", 1), (3, 1, "user", "b", 1), (4, 7, "assistant", "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    turns, loss = read_back(F.col("formatted"), F.col("loss"))
    out = format_trees(threads(df)).select("tree", turns.alias("t"), loss.alias("l")).collect()
    assert {r.tree: [tuple(x) for x in r.t] for r in out} == {None: [("user", "a"), ("assistant", "")], 3: [("", "b"), ("user", "b"), ("user", "b")], 4: [("assistant", "")]}
    assert {r.tree: r.l for r in out} == {None: [""], 3: [], 4: [""]}


def overlapping(docs, items, stretch=13, agree=0.8):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    found = set()
    for i, t in docs:
        d = split(t)
        for item, u in items:
            w = split(u)
            need = min(stretch, len(w))
            for shift in range(-len(w), len(d) + 1) if w else ():
                same = [int(0 <= k + shift < len(d) and d[k + shift] == w[k]) for k in range(len(w))]
                inside = [0 <= k + shift < len(d) for k in range(len(w))]
                if any(all(inside[s : s + need]) and sum(same[s : s + need]) >= -(-agree * need // 1) for s in range(len(w) - need + 1)):
                    found.add((i, item))
                    break
    return found


def test_decontamination_by_brute_force(spark):
    from petriscope.llm.decontamination import contaminated

    items = [(k, prose(int(n), 12)) for k, n in enumerate((1, 2, 5, 12, 13, 14, 20, 40))] + [(20, "same " * 30), (21, "a b " * 10)]
    docs = []
    for k in range(60):
        w = [*prose(int(rng.integers(0, 30)), 12).split(), *items[k % len(items)][1].split(), *prose(int(rng.integers(0, 9)), 12).split()]
        for p in rng.integers(0, max(len(w), 1), int(rng.integers(0, 8))):
            if w:
                w[p % len(w)] = f"other{rng.integers(5)}"
        docs.append((k, " ".join(w).upper() if k % 3 else "\t".join(w)))
    docs += [(100, "same " * 400), (101, "a b " * 300), (102, None), (103, "")]
    df = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()} == overlapping(docs, items)


def test_near_copies_of_one_text_in_many_blocks(spark, monkeypatch):
    """A hot group, its rows in blocks of a few: the links of brute force, of which few leave each cell."""
    import petriscope.llm.ngram_jaccard as J

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_llm import groups

    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "STARS", 0)  # everything is left to the exact products
    base, rows = prose(100).split(), []
    for k in range(80):
        w = list(base)
        for p in rng.choice(100, 1 + k % 6, replace=False):
            w[p] = f"n{k}_{p}"
        rows.append((k, " ".join(w)))
    rows += [(k, prose(60)) for k in range(80, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_jaccard(df, 4, 85).collect())
    assert got == sorted(groups(rows, 4, 85))


def test_chain_by_hand(spark):
    """Two categories and three words: the fits of the tasks are those of plain loops, and the second model sees the first's out-of-fold answers."""
    from petriscope.llm import toxicity as X

    n = 60
    words = [["vile"] * (k % 3 == 0) + ["calm"] * (k % 2) + ["x"] for k in range(n)]
    y = np.array([[k % 3 == 0, k % 3 == 0 and k % 2 == 0] for k in range(n)], float)
    names = sorted({w for d in words for w in d})
    pairs = [(k, 100 + names.index(w)) for k, d in enumerate(words) for w in d]
    doc, feature = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
    weight, fold = np.ones(n), np.arange(n) % X.FOLDS
    chain = X.Chain(["a", "b"], doc, feature, y, weight, fold, X.fold_tasks(spark))

    kept = [j for j in range(len(names)) if chain.place[100 + j] >= 0]
    dense = np.array([[names[j] in d for j in kept] for d in words], float)

    def fit(x, t):
        w, past = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, 1e-8)
        w[-1] = np.log(t.mean() / (1 - t.mean()))
        for _ in range(150):
            p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
            grad = np.append(x.T @ (p - t) + 2.0 * w[:-1], (p - t).sum())
            past += grad**2
            w = w - 0.5 * grad / np.sqrt(past)
        return w

    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    x = dense
    for j in range(2):
        assert np.allclose(chain.weights[j], fit(x, y[:, j]))
        out = np.zeros(n)
        for f in range(X.FOLDS):
            w = fit(x[fold != f], y[fold != f, j])
            out[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ w[:-1] + w[-1])))
        x = np.c_[x, logit(out)]
    assert chain.cut[0] < 1 and ((chain.predict(doc, feature, n)[:, 0] >= chain.cut[0]) == (y[:, 0] > 0)).all()


def test_votes_by_hand():
    """The family of the largest margin, then the language with most duels won; the duels' certainty breaks ties."""
    from petriscope.llm.language_id import DIM, Model

    m = Model.__new__(Model)
    m.langs, m.families, m.members, m.pairs = ["a", "b", "c", "z"], ["f", "g"], [[0, 1, 2], [3]], [(0, 1), (0, 2), (1, 2)]
    m.w = np.zeros((5, DIM), np.float32)
    m.w[:, :5], m.b = np.eye(5), np.zeros(5)
    x = np.zeros((4, DIM), np.float32)
    x[0, :5] = 2, -1, 1, 1, 1  # a wins both its duels
    x[1, :5] = 2, -1, -1, 1, 3  # b beats a and c
    x[2, :5] = 2, -1, 1, -1, 0.2  # one win each: a over b by 1, c over a by 1, b over c by little
    x[3, :5] = -1, 2, 1, 1, 1
    lang, score = m.predict(x)
    sure = lambda v: 1 / (1 + np.exp(-2 * v))
    trust = [sure(1) + sure(-1), sure(-1) + sure(0.2), sure(1) + sure(-0.2)]
    assert [m.langs[k] for k in lang] == ["a", "b", "abc"[int(np.argmax(trust))], "z"]
    assert np.allclose(score, [sure(2) * (2 * sure(1)) / 2, sure(2) * (sure(1) + sure(3)) / 2, sure(2) * max(trust) / 2, sure(2)])
