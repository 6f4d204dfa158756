"""License scans, whitening and manifests against brute force, with odd rows in all of them."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

rng = np.random.default_rng(29)
CLASHING = ("id", "tree", "index", "size", "digest", "now", "run", "members", "at", "words", "hits", "found", "n_words", "places", "labels", "score", "v", "whitened", "deviation", "component", "cell", "root", "leaf", "__place", "__part", "__size")


def clashing(df):
    return df.withColumns({c: F.lit(f"old {c}") for c in CLASHING}).withColumn("m", F.create_map(F.lit("a"), F.lit("b")))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- licenses ---------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def scanned(text, sought):
    words = WORD.findall((text or "").translate(UPPER))
    starts = {p: [i for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p] for t in sought for _, p in t.phrases}
    places = sorted((s, t.label, " ".join(p)) for t in sought for _, p in t.phrases for s in starts[p])
    return len(words), places, starts


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, the software to deal in the software without restriction"


def license_rows():
    from petriscope.llm.licenses import NOTICES

    mit = NOTICES["mit-text"].replace("[", "").replace("]", "")
    filler = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 50, n))
    return [
        (1, f"{filler(9)} Released UNDER the MIT-License. {filler(5)} under the mit license"), (2, "Apache License, Version 2.0"), (3, "CC BY-NC 4.0"), (4, None), (5, ""), (6, "..."),
        (7, mit), (8, f"{mit[:300]} {filler(5)} {mit[300:]}"), (9, f"{MIT} {filler(400)} the software is provided as is without warranty of any kind"), (10, "under the mit licensee, cc byKnc"),
        (11, "under the mit license " * 3000), (12, filler(20_000) + " cc by nc"), (1, "cc by nc"), (1, "cc by nc"), (None, "cc/by/nc"), (13, "cc by nc cc by nc by nc"), (14, "LİCENSE under the mit lİcense é under_the_mit_license"),
    ]


def test_licenses_by_brute_force(spark):
    from petriscope.llm.licenses import BASE, NOTICES, license_scan, templates

    sought = templates(BASE | NOTICES)
    rows = license_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    out = license_scan(df).collect()
    assert len(out) == len(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(p) for p in r.places]) for r in out)
    assert got == sorted((i is None, i or 0, *scanned(t, sought)[:2]) for i, t in rows)
    by_id = {r.doc_id: r for r in out}
    assert "mit-text" in by_id[7].labels and "mit-text" in by_id[8].labels
    assert by_id[9].labels == [] and by_id[9].score == 1, "phrases too far apart are no notice"
    assert by_id[10].labels == [] and by_id[10].score < 1
    assert by_id[2].labels == ["apache-2"] and by_id[3].labels == ["cc-by-nc", "cc-by-nc-4"] and by_id[3].score == 1
    for i in (4, 5, 6):
        assert (by_id[i].n_words, by_id[i].places, by_id[i].labels, by_id[i].score) == (0, [], [], 0.0)
    assert license_scan(df.limit(0)).count() == 0


def test_rare_words_come_from_all_documents(spark):
    from petriscope.llm.licenses import document_frequencies

    df = spark.createDataFrame([(1, "The MIT the"), (2, "mit"), (3, None)], "doc_id long, text string")
    assert document_frequencies(df, "text", ["mit", "the", "by"]) == (3, {"mit": 2, "the": 1})


# --- whitening --------------------------------------------------------------


def vectors(n, d, odd=True):
    x = rng.standard_normal((n, d)) * np.linspace(2, 0.2, d)
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    bad = [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] + [0.0] * (d - 1)), (904, [1.0] * (d + 1)), (905, [])]
    return rows + (bad + [rows[3], rows[3], (None, rows[5][1])] if odd else [])


def by_hand(rows, d, k):
    x = np.array([v for _, v in rows if v is not None and len(v) == d and None not in v and np.isfinite(v).all()])
    x = np.floor(64 * x).astype(int) + 1_000_000
    n, sums = len(x), x.sum(0)
    away = n * x - sums
    e, u = np.linalg.eigh((away / n).T @ (away / n) / n)
    e, u = e[::-1], u[:, ::-1]
    return n, sorted((away**2).sum(1).tolist()), (away / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize(("d", "k", "block"), [(6, 32, None), (40, 5, 8), (40, 5, None)])
def test_whitening_by_hand(spark, d, k, block):
    from petriscope.llm.whitening import whiten

    rows = vectors(300, d)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(3)
    out = whiten(df, k=k, block=block).collect()
    n, deviations, white, explained = by_hand(rows, d, min(k, d))
    assert len(out) == n * min(k, d) and {r.n for r in out} == {n}
    assert sorted(int(r.deviation) for r in out if r.component == 1) == deviations
    for c in range(min(k, d)):
        one = [r for r in out if r.component == c + 1]
        got, want = np.sort([abs(r.whitened) for r in one]), np.sort(np.abs(white[:, c]))
        assert np.abs(got - want).max() < 1e-6 and abs(one[0].explained / explained[c] - 1) < 1e-9
    assert {r.identity_error for r in out}.pop() < 1e-9
    same = {(r.component, r.whitened) for r in out if r.id == 3}
    assert len(same) == min(k, d)  # repeated rows are alike


def test_whitening_of_few_vectors(spark):
    from petriscope.llm.whitening import whiten

    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whiten(make([])).count() == 0
    assert whiten(make([(1, None)])).count() == 0
    assert whiten(make([(1, [1.0, 2.0])])).count() == 0
    assert whiten(make([(1, [1.0, 2.0])] * 4)).count() == 0
    line = whiten(make([(k, [float(k), 0.5]) for k in range(5)])).collect()  # one direction has variance
    assert len(line) == 5 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_large_entries(spark):
    from petriscope.llm.whitening import whiten

    rows = [(k, [float(v) for v in rng.integers(-(2**33), 2**33, 2)]) for k in range(50)]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1).collect()
    x = [[64 * int(v) + 1_000_000 for v in row] for _, row in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert sorted(int(r.deviation) for r in out) == sorted(sum((50 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)


# --- manifest ---------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(row, text):
    values = [*row[:4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(top, the runs' siblings of each node from its level up, as (left, right))."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
    top, above = climb([sha("".join(r)) for r in runs])
    return top, [[("".join(r[:j]), "".join(r[j + 1 :])), *above[i]] for i, r in enumerate(runs) for j in range(len(r))]


def manifest_by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, upper in zip(names, tops, strict=True):
        for (_, _, own, row), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            path = path + upper
            proof = sha("".join(a + b for a, b in path))
            fold = leaf(row, row[4].translate(UPPER)) if tampered and row[4] is not None else own
            for a, b in path:
                fold = sha(a + fold + b)
            out.append((row[0] is None, row[0] or 0, own, trees[s][0], root, proof, fold, fold == root))
    return sorted(out)


def test_manifest_by_hand(spark):
    from petriscope.llm.manifest import digest, manifest

    rows = [(int(k), "hot", "en", 3, f"Text {k}") for k in rng.permutation(600)]
    rows += [(k, f"s{k % 20}", None, None, None if k % 7 == 0 else "") for k in range(1000, 1080)]
    rows += [(1, None, "en", 1, "A"), (None, "hot", "en", 1, "B"), (None, None, None, None, None), (5, "hot", "en", 3, "Text 5"), (5, "hot", "en", 3, "text 5"), (7, "", "é", 9, "Ü" * 50_000), (8, "one", "en", 1, "É X"), (9, "é", "x", 1, "y"), (10, "\U0001f600", "x", 1, "y"), (11, "￮", "x", 1, "y")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).repartition(5)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = lambda df: manifest(df, list(FIELDS), found={"text": F.translate("text", upper, upper.lower())}, altered=F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0)
    out = run(df).withColumn("proof", digest(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in out) == manifest_by_hand(rows)
    assert any(not r.verified for r in out) and run(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_manifest_of_one_group(spark, n):
    from petriscope.llm.manifest import manifest

    rows = [(k, "s", "en", 1, "t") for k in range(n)]
    out = manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), list(FIELDS)).collect()
    assert {r.root for r in out} == {manifest_by_hand(rows)[0][4]} and all(r.verified and r.subroot == r.root for r in out)
