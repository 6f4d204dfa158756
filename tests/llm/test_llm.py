"""The operators against brute force on small tables, with nulls, empty and repeated rows, and clashing columns."""

import re
from functools import lru_cache
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from petriscope.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(3)
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


@lru_cache
def corpus():
    shared, near, out = prose(60), prose(120), []
    for k in range(12):
        out.append((k, f"{prose(30)} {shared} {prose(10 + k)}"))
    for k in range(12, 30):  # near copies
        words = near.split()
        for _ in range(k % 4):
            words[rng.integers(len(words))] = "changed"
        out.append((k, " ".join(words)))
    out += [(30, None), (31, ""), (32, " \t\n"), (33, "one two"), (34, "one two"), (35, "ä" * 150 + " " + "ä" * 150), (36, prose(5000)), (None, shared), (37, prose(13)), (38, out[0][1]), (38, out[0][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", k) for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, __z long").repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(t):
    return WORD.findall(t or "")


def test_substring_dedup(spark, docs):
    from petriscope.llm.substring_dedup import substring_dedup

    rows = corpus()
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                s = tuple(w[k : k + 13])
                first[s] = min(first.get(s, i), i)
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup(docs)
    assert got.columns == ["doc_id", "text", "__z", "n_words", "n_removed", "removed"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=key) == sorted(want, key=key)
    assert substring_dedup(empty(spark)).count() == 0


def test_suffix_dedup(spark, docs):
    import petriscope.llm.suffix_dedup as S

    rows = corpus()
    order = sorted({i for i, _ in rows if i is not None})
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    seen, want = set(), {}
    for i in order:
        b = texts[i]
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    for contexts in (2048, 3):  # and with grams dealt over shards
        S.SHARD_CONTEXTS = contexts
        got = S.suffix_dedup(docs.select("doc_id", "text", "n_words"))
        for r in got.collect():
            if r.doc_id is not None:
                assert (r.n_bytes, r.n_removed, len(r.removed), bytes(r.text)) == want[r.doc_id]
                assert sum(s.end - s.start for s in r.removed) == r.n_removed
            else:  # has no place in the order
                assert (r.n_removed, len(r.removed)) == (0, 0)
    S.SHARD_CONTEXTS = 2048
    assert S.suffix_dedup(empty(spark)).count() == 0


def test_suffix_order_and_kasai():
    from petriscope.llm.suffix_dedup import kasai, suffix_order

    for _ in range(20):
        parts = [bytes(rng.integers(97, 99, rng.integers(30, 90)).astype(np.uint8)) for _ in range(4)]
        text, at = b"".join(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        length = 20
        start = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(at[:-1], at[1:], strict=True)])
        context = np.searchsorted(at, start, "right") - 1
        array = np.frombuffer(text, np.uint8)
        order = suffix_order(array, at[1:][np.searchsorted(at, np.arange(len(text)), "right") - 1], start, length)
        strings = [text[start[k] : start[k] + length] for k in order]
        assert strings == sorted(strings)
        common = kasai(array, context, start, order, length)
        for k in range(1, len(order)):
            n = next((x for x in range(length) if strings[k][x] != strings[k - 1][x]), length)
            assert common[k] == n


def test_strings_that_defeat_polynomial_hashes(spark):
    """Thue-Morse words: any polynomial modulo a power of two gives the two the same hash."""
    from petriscope.llm.ngram_jaccard import ngram_jaccard
    from petriscope.llm.substring_dedup import substring_dedup
    from petriscope.llm.suffix_dedup import suffix_dedup

    morse = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    other = morse.translate(str.maketrans("ab", "ba"))
    around = [f"u{k}" for k in range(40)]
    rows = [(k, " ".join([*around[:20], x, *around[20:]])) for k, x in enumerate((morse, other))] + [(2, " ".join([morse] * 20)), (3, " ".join([other] * 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup(df, 13).orderBy("doc_id").collect()] == [0, 40, 0, 0]
    assert [r.component_id for r in ngram_jaccard(df, 4, 85).orderBy("doc_id").collect()] == [0, 1, 2, 3]
    seen, want = set(), []
    for _, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(t[k : k + 100])
        want.append(int(gone.sum()))
    assert [r.n_removed for r in suffix_dedup(df, 100).orderBy("doc_id").collect()] == want


def groups(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if None not in (rows[a][0], rows[b][0]) and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(b)] = root(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i) if i is not None else None
    return [(i, len(s), least[root(k)] if i is not None else None) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_jaccard(spark, docs, n, percent):
    from petriscope.llm.ngram_jaccard import ngram_jaccard

    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(docs, n, percent).collect()), key=key)
    assert got == sorted(groups(corpus(), n, percent), key=key)


def test_jaccard_exhaustive_blocks(spark, monkeypatch):
    import petriscope.llm.ngram_jaccard as J

    monkeypatch.setattr(J, "BLOCK", 4)
    base, rows = prose(150).split(), []
    for k in range(60):
        w = list(base)
        for p in rng.choice(150, 3 + k % 9, replace=False):
            w[p] = f"new{k}_{p}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_jaccard(df, 4, 85).collect())
    assert got == sorted(groups(rows, 4, 85))
    assert J.ngram_jaccard(empty(spark)).count() == 0


@pytest.mark.parametrize("percent", [50, 60, 66])
def test_jaccard_links_over_two_size_classes(spark, percent):
    from petriscope.llm.ngram_jaccard import ngram_jaccard

    rows = []
    for size in (*range(24, 60, 3), 81, 120):  # each with the largest set that it is linked with
        for k in (size, size * 100 // percent):
            rows.append((len(rows), " ".join(f"of{size}_{x}" for x in range(k))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(df, 1, percent).collect())
    assert got == sorted(groups(rows, 1, percent)) and [c for *_, c in got] == [k - k % 2 for k in range(len(rows))]


def test_jaccard_of_ids_with_different_texts(spark):
    from petriscope.llm.ngram_jaccard import ngram_jaccard

    a, b, c, d = (prose(80) for _ in range(4))
    rows = [(3, a), (5, f"{a} more"), (5, b), (5, ""), (7, f"{b} more"), (7, c), (2, f"{c} more"), (9, d), (9, f"{d} more"), (8, f"{d} more"), (5, b), (None, a), (4, None), (4, f"{a} more")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(1)
        key = lambda r: tuple((x is None, x or 0) for x in r)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(df, 4, 85).collect()), key=key)
        assert got == sorted(groups(order, 4, 85), key=key)


def test_block_product():
    from petriscope.llm.ngram_jaccard import block_product

    a, b = rng.random((7, 50)) < 0.3, rng.random((5, 50)) < 0.3
    (da, ca), (db, cb) = np.nonzero(a), np.nonzero(b)
    assert (block_product(da, ca.astype(np.uint64), 7, db, cb.astype(np.uint64), 5) == a.astype(int) @ b.T.astype(int)).all()


def test_top_k(spark):
    from petriscope.llm.topk import ImpactIndex, top_k

    v = rng.integers(-100, 100, (300, 8))
    v[50:150] = v[50]  # many ties
    index = ImpactIndex(v, np.arange(300))
    for q in range(0, 300, 37):
        s = v @ v[q]
        best = sorted((-int(s[k]), k) for k in range(300) if k != q)[:5]
        assert index.search(v[q : q + 1], 5, np.array([q])) == [(0, k, -x) for x, k in best]
    rows = [(k, [float(x) / 256 for x in r], 1) for k, r in enumerate(v)] + [(300, None, 1), (350, [None] * 8, 1), (400, [float("nan")] * 8, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = top_k(df, F.col("vec_id") % 50 == 0).collect()
    for q in (0, 50, 250):
        s = v @ v[q]
        best = sorted((-int(s[k]), k) for k in range(300) if k != q)[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n + 1, k, -x) for n, (x, k) in enumerate(best)]
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_postings_of_the_impact_index():
    from petriscope.llm.topk import ImpactIndex

    v = np.random.default_rng(3).normal(0, 60, (200, 6)).astype(np.int64)
    index = ImpactIndex(v, np.arange(200))
    read = np.zeros(v.shape)
    impacts = [impact for impact, _, _ in index.levels]
    assert impacts == sorted(impacts, reverse=True) and impacts[-1] > 0
    for _, segments, unread in index.levels:
        for col, weight, a, b in segments:
            assert len(set(index.rows[a:b])) == b - a and not read[index.rows[a:b], col].any()
            read[index.rows[a:b], col] += weight
        assert np.allclose(unread, np.linalg.norm(v - read, axis=1), atol=1e-2)
    assert (np.abs(v - read) <= index.step / 2).all()


def test_top_k_of_large_components(spark):
    from petriscope.llm.topk import ImpactIndex, top_k

    draw = np.random.default_rng(11)
    for sd in (160, 3000, 20_000, 20_000, 20_000):
        base = draw.normal(0, sd, 64).astype(np.int64) * 16
        v = np.repeat(base[None, :], 100, 0)
        v[:, :8] += 16 * draw.integers(-sd // 2, sd // 2, (100, 8))  # scores that are closer than float32 can tell
        q = base.copy()
        q[:8] = draw.integers(1, 4, 8)
        s = v @ q
        best = sorted((-int(s[k]), k) for k in range(100))[:5]
        assert ImpactIndex(v, np.arange(100)).search(q[None, :], 5, np.array([-1])) == [(0, k, -x) for x, k in best]
    big = [(0, [9e6, 1.0]), (50, [1e7, -2.0]), (1, [9.5e6, 5.0]), (2, [9.5e6, 4.0])]
    got = top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=2).collect()
    score = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(dict(big)[a], dict(big)[b], strict=True))
    assert sorted(tuple(r) for r in got) == [(q, n + 1, v, score(q, v)) for q, found in ((0, (50, 1)), (50, (2, 1))) for n, v in enumerate(found)]


def test_sharding(spark):
    from petriscope.llm.sharding import extendible_shards

    rows = [(k, "x" * int(n)) for k, n in enumerate(rng.integers(0, 900, 300))] + [(7, "y" * 500)] * 200 + [(None, None), (900, "z" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = extendible_shards(df, 4000).toPandas()
    assert len(out) == len(rows)
    sizes = out.groupby(["depth", "prefix", "part"])["n_bytes"].agg(["sum", "count"])
    assert ((sizes["sum"] <= 4000) | (sizes["count"] == 1)).all()
    assert extendible_shards(df.limit(0), 4000).count() == 0


def test_packing(spark, docs):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from petriscope.llm.packing import pack

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(99, "a <|endoftext|> b"), (98, "🙂 don't\n\n  stop…")], "doc_id long, text string")
    df = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(extra)
    out = pack(df, size=64).toPandas()
    for i, t in ((r.doc_id, r.text) for r in df.collect()):
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        own = out[out["id"] == i].sort_values("piece")
        assert own["start"].tolist() == np.r_[0, np.cumsum(own["length"])][:-1].tolist()
        assert b"".join(own["ids"]) == np.array(ids, "<u4").tobytes()
        assert (own["length"].iloc[1:] == 64).all()
        assert all(zlib.crc32(x) == c for x, c in zip(own["ids"], own["ids_crc32"], strict=True))
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.r_[0, np.cumsum(s["length"])][:-1].tolist() and s["length"].sum() <= 64
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 64) + 4
    assert pack(df.limit(0)).count() == 0


def test_bounded_bins_close_the_fullest():
    from petriscope.llm.packing import BestFit

    b = BestFit(10, 2)
    assert [b.place(n)[0] for n in (6, 7, 9, 3)] == [0, 1, 2, 0]


def test_packing_fill_does_not_fall_with_the_number_of_pieces(spark):
    from petriscope.llm.packing import SCHEMA, _pack

    draw = np.random.default_rng(5)
    for top in (128, 100):
        lengths = np.where(draw.random(6400) < 0.4, draw.integers(64, top, 6400), draw.integers(1, 64, 6400))
        rows = [(k % 500 if k % 3 else None, 0, 0, int(n), k % 7, None, None, None) for k, n in enumerate(lengths)]
        out = spark.createDataFrame(rows, SCHEMA).repartition(1).mapInArrow(_pack(128, 64), SCHEMA).toPandas()
        assert sorted(out["length"]) == sorted(lengths)
        for _, s in out.sort_values("offset").groupby("sequence_id"):
            assert s["offset"].tolist() == np.r_[0, np.cumsum(s["length"])][:-1].tolist() and s["length"].sum() <= 128
        assert out["sequence_id"].nunique() <= 1.01 * lengths.sum() / 128 + 64


def test_decontamination(spark):
    from petriscope.llm.decontamination import contaminated, decontaminate

    item = prose(40).split()
    swapped = [w if k % 9 else "other" for k, w in enumerate(item)]
    rows = [(1, f"{prose(50)} {' '.join(item)} {prose(9)}"), (2, f"{prose(5)} {' '.join(swapped).upper()}"), (3, prose(300)), (4, None), (5, ""), (6, "tiny item here"), (None, " ".join(item))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "tiny item here"), (12, None), (13, "")], "item_id long, text string")
    got = contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 10), (2, 10), (6, 11), (None, 10)}
    assert {r.doc_id for r in decontaminate(df, bench).collect()} == {3, 4, 5, None}
    assert contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_catches_every_placement(spark):
    from petriscope.llm.decontamination import contaminated

    items = {n: [f"item{n}_{k}" for k in range(n)] for n in range(1, 17)}
    docs, want = [], set()
    for n, item in items.items():
        need = min(13, n)
        for count in range(min(n, 4 if n < 16 else 3) + 1):
            for gone in combinations(range(n), count):
                text = [f"new{k}" if k in gone else w for k, w in enumerate(item)]
                if max(sum(k not in gone for k in range(s, s + need)) for s in range(n - need + 1)) >= 0.8 * need:
                    want.add((len(docs), n))
                docs.append((len(docs), " ".join(["before", *text, "after"] if len(docs) % 2 else text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()} == want


def test_masks_by_enumeration():
    from petriscope.llm.decontamination import covering

    for n, wrong in [*((n, w) for n in range(1, 14) for w in range(min(n, 4))), (16, 3), (20, 4)]:
        masks = covering(n, wrong)
        assert all(m[-1] < n for m in masks)
        for gone in combinations(range(n), wrong):
            assert any(not {p + s for p in m} & set(gone) for m in masks for s in range(n - m[-1])), (n, wrong, gone)


def test_chat(spark):
    from petriscope.llm.chat import CONTROL, format_trees, paths, read_back

    ugly = "".join(CONTROL) + r"\;" + "\\" + CONTROL[0][:-1] + r"\\;<|turn|"
    rows = [(1, 1, None, "user", ugly, 0.0), (1, 2, 1, "assistant", ugly[::-1], 1.0), (1, 3, 1, "assistant", None, 5.0), (1, 4, 3, None, "end", None), (2, 1, 2, "user", "cycle", 0.0), (2, 2, 1, "user", "cycle", 0.0), (3, 5, 77, "assistant", "orphan", 0.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    assert {(r.tree, r.leaf, r.node) for r in paths(df).collect()} == {(1, 2, 1), (1, 2, 2), (1, 4, 1), (1, 4, 3), (1, 4, 4), (3, 5, 5)}
    turns, loss = read_back(F.col("formatted"), F.col("loss"))
    got = {(r.tree, r.rank): r for r in format_trees(df, branches=2).select("tree", "rank", turns.alias("t"), loss.alias("l")).collect()}
    assert [(x.role, x.text) for x in got[1, 1].t] == [("user", ugly), ("assistant", ""), ("", "end")]
    assert got[1, 2].l == [ugly[::-1]] and got[1, 1].l == [""]
    assert set(got) == {(1, 1), (1, 2), (3, 1)}
    assert format_trees(df.limit(0)).count() == 0


def test_language_id(spark, sf):
    from petriscope.llm.language_id import identify

    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = identify(d).join(d.select(F.col("doc_id").alias("id"), "lang"), "id").where("held_out and lang is not null").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 34 !", None), (3, "", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(odd).collect()} == {"und"}


def test_language_id_learns_rare_languages(spark, monkeypatch):
    import petriscope.llm.language_id as L

    monkeypatch.setattr(L, "svm", lambda x, y: (x[y > 0].mean(0) - x[y < 0].mean(0), 0.0))  # as good for this, and fast
    rows = [(k, " ".join(f"{chr(0x4E00 + 20 * k + x)}{chr(0x4E00 + 20 * k + x + 1)}" for x in range(15)), f"lang{k:03}") for k in range(400)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    assert L.fit(df).langs == sorted(r[2] for r in rows)
    monkeypatch.setattr(L, "ROWS", 300)
    with pytest.raises(ValueError, match="400 languages"):
        L.fit(df)


def test_toxicity(spark):
    from petriscope.llm.toxicity import toxic_documents, without_toxic

    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        rows.append((k, prose(30) + (" awful nasty" if bad else ""), "e"))
        labels.append((k, int(k % 3 == 0), int(bad)))
    df = spark.createDataFrame([*rows, (1000, None, "e"), (1001, "", "e"), (None, "nasty awful", "e")], "doc_id long, text string, p0 string")
    lab = spark.createDataFrame([*labels, (1000, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxic_documents(df, lab).where("doc_id is not null").collect()} == set(range(0, 600, 5))
    left = without_toxic(df, lab)
    assert left.columns == df.columns and left.where("doc_id in (1000, 1001)").count() == 2
    assert toxic_documents(df, lab.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda values, columns: sorted(tuple(str(r[k]) for k in sorted(range(len(columns)), key=lambda k: columns[k])) for r in values)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_pipeline(spark, tmp_path):
    """Planted documents: toxic ones, near copies, a shared passage and a benchmark leak go or are cut, all others are packed whole."""
    import corpus_pipeline
    from petriscope.llm.packing import pack

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "shared passages", "decontamination", "packing"]
    word = lambda n, of: " ".join(f"{of}{k}" for k in rng.integers(0, 5000, n))
    docs = {k: word(60, "w") for k in range(400)}
    toxic = set(range(0, 400, 4))
    for k in toxic:
        docs[k] += " vile filth vermin"
    passage, leak, copied = word(30, "p"), word(30, "b"), word(80, "c")
    docs[1001], docs[1002] = f"{word(20, 'x')} {passage}", f"{passage} {word(20, 'y')}"
    docs[1003], docs[1004], docs[1005] = copied, copied + " end", copied
    docs[1006], docs[1007], docs[1008] = f"{word(9, 'q')} {leak}", "", None
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = {k: t for k, t in docs.items() if k not in toxic | {1004, 1005, 1006}}
    kept[1002] = docs[1002][len(passage) + 1 :]
    assert set(out["doc_id"]) == set(kept)
    alone = pack(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), size=1024, with_ids=False).toPandas()
    pieces = lambda df, key: sorted(zip(df[key], df["piece"], df["start"], df["length"], df["ids_crc32"], strict=True))
    assert pieces(out, "doc_id") == pieces(alone, "id")
    for _, one in out.sort_values("offset").groupby("sequence_id"):
        assert one["length"].sum() <= 1024 and (one["offset"].to_numpy() == np.r_[0, one["length"].cumsum()[:-1]]).all()
