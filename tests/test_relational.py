"""The relational forms against the array kernels: regions, forms, resizing, order, whole verbs, sources, sinks and streams."""

import contextlib
import io
import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from petriscope.functions import descriptors as D
from petriscope.functions import polygons as G
from petriscope.functions import regions as R
from petriscope.functions import resizing as Z
from petriscope.functions.graphs import least_reachable
from petriscope.functions.ordering import numbered
from petriscope.operators import kernels as K
from petriscope.plans import relational as V
from petriscope.plans import verbs
from petriscope.schema import FORM
from petriscope.sources import codecs, readers

rng = np.random.default_rng(5)
IMAGE = "struct<width:int,height:int,channels:int,dtype:string,data:binary>"


def relation(spark, images, column="v"):
    rows = [(k, int(x), int(y), int(m[y, x])) for k, m in images.items() for y, x in zip(*np.nonzero(np.ones_like(m)), strict=True)]
    return spark.createDataFrame(rows, f"image int, x int, y int, {column} int").repartition(4)


def test_components_and_contours(spark):
    masks = {k: rng.random((int(rng.integers(1, 14)), int(rng.integers(1, 200 if k % 5 == 0 else 20)))) < p for k, p in enumerate(np.linspace(0.1, 0.8, 15))}
    masks |= {100: np.ones((6, 7), bool), 101: np.zeros((3, 3), bool), 102: np.array([[1]], bool), 103: np.array([[1, 0, 1], [0, 1, 0], [1, 0, 1]], bool)}
    on = relation(spark, masks).where("v <> 0").select("image", "x", "y")
    found = R.kept(R.components(on, ["image"]), "found")
    labels = {(r.image, r.x, r.y): r.label for r in R.pixels_of(R.numbered_components(found, ["image"])).collect()}
    assert labels == {(k, x, y): n for k, m in masks.items() for (y, x), n in np.ndenumerate(K.connected_components(m)) if n}
    got = {}
    for r in R.rings(R.contours(found, ["image"]), ["image", "root"]).orderBy("image", "root").collect():
        got.setdefault(r.image, []).append([(q.x, q.y) for q in r.poly])
    assert got == {k: [[tuple(map(float, p)) for p in b] for b in K.find_contours(m)] for k, m in masks.items() if m.any()}


def test_filled_polygons(spark):
    polygons = [(k, [tuple(map(float, q)) for q in rng.uniform(-3, 25, (int(rng.integers(3, 9)), 2))], int(rng.integers(1, 25)), int(rng.integers(1, 25))) for k in range(80)]
    df = spark.createDataFrame(polygons, "object int, poly array<struct<x:double,y:double>>, w int, h int")
    got = {(r.object, r.x, r.y) for r in R.filled(df, ["object"], F.col("w"), F.col("h")).collect()}
    assert got == {(k, x, y) for k, p, w, h in polygons for (y, x), on in np.ndenumerate(K.fill_polygon(np.array(p), w, h)) if on}


def test_drawn_polygons(spark):
    polygons = [(k, [tuple(map(float, q)) for q in rng.uniform(-9, 60, (int(rng.integers(3, 9)), 2))]) for k in range(40)]
    df = spark.createDataFrame(polygons, "object int, poly array<struct<x:double,y:double>>")
    own = {(r.object, r.x, r.y) for r in R.drawn(df, ["object"], pad=1).collect()}
    fit = {(r.object, r.x, r.y) for r in R.drawn_centered(df, ["object"], 20, 31, pad=2).collect()}
    on = lambda draw: {(k, x, y) for k, p in polygons for (y, x), v in np.ndenumerate(draw(np.array(p))) if v}
    assert own == on(lambda p: K.draw_points(p, 1)) and fit == on(lambda p: K.draw_centered(p, 20, 31, 2))


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_filling_neither_shuffles_nor_sorts(spark):
    """Pixels stay where their polygon is; clipped, flat, long and degenerate rings as the kernels fill them."""
    rings = [[(-40, 3), (70, 4), (70, 9), (-40, 8)], [(5, 5), (5, 5), (5, 5)], [(-9, 2), (30, 2), (11, 2)], [(4, -50), (6, 90), (5, 20)], [(60, 60), (70, 60), (70, 70)], [(0, 0), (19, 7), (19, 8)]]
    polygons = [(k, [tuple(map(float, q)) for q in p]) for k, p in enumerate(rings)]
    df = spark.createDataFrame(polygons, "object int, poly array<struct<x:double,y:double>>")
    fill, own = R.filled(df, ["object"], F.lit(20), F.lit(25)), R.drawn(df, ["object"], pad=1)
    for out in (fill, own):
        assert not any(step in plan(out) for step in ("Exchange", "Sort ", "Join"))
    on = lambda draw: {(k, x, y) for k, p in polygons for (y, x), v in np.ndenumerate(draw(np.array(p))) if v}
    got = [(r.object, r.x, r.y) for r in fill.collect()]
    assert len(got) == len(set(got)) and set(got) == on(lambda p: K.fill_polygon(p, 20, 25))
    assert {(r.object, r.x, r.y) for r in own.collect()} == on(lambda p: K.draw_points(p, 1))


def test_no_broadcast_of_growing_tables(spark, monkeypatch):
    """Crops, parts and runs are merged; so is what nodes learn, beyond a few thousand rows."""
    px = spark.range(64).select(F.lit(1).alias("image"), F.lit(0).alias("c"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"), "id").withColumnRenamed("id", "v")
    px, own = R.kept(px, "pixels"), R.kept(px.where("v = 19").select("image", F.lit(0).alias("object"), "x", "y"), "own")
    crops = R.kept(px.limit(1).select("image", F.lit(0).alias("object"), F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("w"), F.lit(4).alias("h")).alias("crop")), "crops")
    parts = V.parts(px, crops, own, "cfb")
    assert "Broadcast" not in plan(parts) and "SortMergeJoin" in plan(parts)
    assert sorted((r.part, r.v) for r in parts.where("v = 19").collect()) == [("complete", 19), ("foreground", 19)] and parts.count() == 36

    def refused(_):
        raise AssertionError("a broadcast")

    edges = spark.range(60_000).select(F.lit(1).alias("image"), (F.col("id") * 3).alias("u"), (F.col("id") * 3 + 1).alias("v"))
    monkeypatch.setattr(F, "broadcast", refused)
    found = least_reachable(edges, ["image"]).agg(F.count("*"), F.sum(F.col("node") - F.col("root")), F.sum("root")).first()
    assert tuple(found) == (120_000, 60_000, 6 * sum(range(60_000)))


def test_no_broadcast_in_small_rounds(spark, monkeypatch):
    """Rounds of few rows are merged as well: a path of nine nodes and a star of four, in two groups."""

    def refused(_):
        raise AssertionError("a broadcast")

    monkeypatch.setattr(F, "broadcast", refused)
    edges = spark.createDataFrame([(1, k + 1, k) for k in range(8)] + [(2, 9, k) for k in (5, 6, 7)], "image int, u long, v long")
    assert sorted(map(tuple, least_reachable(edges, ["image"]).collect())) == [(1, k, 0) for k in range(9)] + [(2, k, 5) for k in (5, 6, 7, 9)]


def test_objects_and_profiles_broadcast_nothing(spark, monkeypatch):
    """No table that is written on the way to objects of masks and profiles of polygons, nor the result, has a broadcast in its plan."""
    from petriscope.functions import graphs

    def watched(df, label, write=R.kept):
        assert "Broadcast" not in plan(df), label
        return write(df, label)

    for module in (R, V, graphs):
        monkeypatch.setattr(module, "kept", watched)
    px = spark.range(64).select(F.lit(1).alias("image"), F.lit(0).alias("c"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"), F.col("id").alias("v"))
    masks = px.select("image", "x", "y", ((F.col("x") < 3) & (F.col("y") < 2) | (F.col("x") > 4) & (F.col("y") > 5)).cast("long").alias("label"))
    objects = V.mask_objects(masks)
    assert "Broadcast" not in plan(objects)
    assert sorted((r.object, r.label, tuple(r.bbox)) for r in objects.collect()) == [(0, 1, (0, 0, 2, 1)), (1, 2, (5, 6, 7, 7))]
    ring = spark.createDataFrame([(1, 0, [(1.0, 1.0), (5.0, 1.0), (3.0, 5.0)])], "image int, object int, poly array<struct<x:double,y:double>>")
    sizes = spark.createDataFrame([(1, 8, 8)], "image int, width int, height int")
    assert "Broadcast" not in plan(V.profile_polygons(px, ring, sizes, "cf"))


def test_texture_is_dealt_by_its_rows(spark, monkeypatch):
    """Twice the pixels are twice the tasks of as many pixels."""
    monkeypatch.setattr(D, "SHARE", 64, raising=False)
    px = lambda n: spark.range(64 * n).select(F.floor(F.col("id") / 64).alias("image"), F.lit(0).alias("c"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") % 64 / 8).alias("y"), (F.col("id") * 7 % 50).alias("v"))
    for n in (10, 20):
        out = D.texture(px(n), ["image"])
        assert re.search(rf"hashpartitioning\(image#.*, {n}\), REPARTITION_BY_NUM", plan(out)) and out.count() == n


def test_forms(spark):
    rings = [rng.integers(0, 24, (int(n), 2)).astype(float) for n in rng.integers(3, 60, 60)] + [rng.normal(0, 30, (90, 2)), np.array([[0.0, 0], [1, 1], [2, 2], [5, 5]])]
    rings = [p for p in (K.order_points(K.dedup_points(p)) for p in rings) if len(p) > 2]
    df = spark.createDataFrame([(k, [tuple(map(float, q)) for q in p]) for k, p in enumerate(rings)], "object int, poly array<struct<x:double,y:double>>").repartition(4)
    for r in G.form(df).collect():
        if r.object == len(rings) - 1:  # points on a line: no ellipse, no solidity
            assert r.form_area == r.form_area_convex == 0 and r.form_major_axis is None and r.form_solidity is None
            continue
        for name, want in zip(FORM, K.form(rings[r.object], ordered=False), strict=True):
            assert (r[name] is None and np.isnan(want)) or abs(r[name] - want) < 1e-8 * max(1, abs(want)), name
    for r in df.select("object", G.convex_hull(F.col("poly")).alias("h"), G.resample(F.col("poly"), 7).alias("r")).collect():
        assert np.array_equal(np.array([(q.x, q.y) for q in r.h]), K.convex_hull(rings[r.object]))
        assert np.allclose([(q.x, q.y) for q in r.r], K.resample_points(rings[r.object], 7))
    same = spark.createDataFrame([([(1.0, 1.0)] * 3,)], "poly array<struct<x:double,y:double>>").select(G.resample(F.col("poly"), 4).alias("r")).first()
    assert [tuple(q) for q in same.r] == [(1.0, 1.0)] * 4


@pytest.mark.parametrize("method", ["triangle", "corner"])
def test_resize(spark, method):
    images = {k: rng.integers(0, 256, s).astype(np.uint8) for k, s in enumerate(((3, 3), (2, 9), (1, 1), (12, 5)))}
    px = relation(spark, images).withColumn("c", F.lit(0))
    sizes = spark.createDataFrame([(k, m.shape[1], m.shape[0]) for k, m in images.items()], "image int, width int, height int")
    exact = {(r.image, r.y, r.x): r.v for r in Z.resized(px.join(sizes, "image"), ["image"], 7, 4, method).collect()}
    whole = {(r.image, r.y, r.x): r.v for r in Z.resized(px.join(sizes, "image"), ["image"], 7, 4, method, (0, 255)).collect()}
    for k, m in images.items():
        want = K.resize(m[:, :, None].astype(float), 7, 4, method)[:, :, 0]
        assert all(abs(exact[k, y, x] - v) < 1e-9 for (y, x), v in np.ndenumerate(want)), k
    assert whole == {k: min(max(np.floor(v + 0.5 + Z.TIE), 0), 255) for k, v in exact.items()}


def test_numbers_in_order(spark):
    rows = [(int(k) if k else None, int(v)) for k, v in zip(rng.integers(0, 4, 3000), rng.permutation(3000), strict=True)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(7)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    want, seen = {}, {}
    for k, r in enumerate(sorted(rows, key=key)):
        seen[r[0]] = seen.get(r[0], -1) + 1
        want[r] = (k, seen[r[0]])
    whole = {(r.g, r.v): r.number for r in numbered(df, ["g", "v"]).collect()}
    within = numbered(df, ["v"], ["g"], "n", size="size").collect()
    assert {r: (whole[r], n) for r, n in (((r.g, r.v), r.n) for r in within)} == want
    assert {r.g: r.size for r in within} == {g: n + 1 for g, n in seen.items()}
    assert numbered(df.limit(0), ["v"], ["g"]).count() == 0


def test_intensity_of_many_distinct_values(spark):
    """A float image of 10^6 values: no list holds them."""
    px = spark.range(1_000_000).select(F.lit(1).alias("image"), F.lit(0).alias("c"), ((F.col("id") * 7919) % 1_000_003 / 1_000_003.0).alias("v"))
    v = (np.arange(1_000_000) * 7919) % 1_000_003 / 1_000_003.0
    r = D.intensity(px, ["image"]).first()
    assert np.allclose([r[f"intensity_{c}"] for c in ("min", "max", "sum", "mean", "std", "median", "mad")], K.intensity(v.reshape(1000, 1000, 1)))


# --- whole verbs ------------------------------------------------------------


def test_profile_of_labels_equals_kernels(spark):
    """A mask of several labels, one of them in two pieces, and a mask of one value; two channels."""
    labels = np.zeros((20, 24), np.int64)
    labels[3:7, 3:8], labels[9:12, 4:6], labels[3:6, 12:16], labels[12:18, 12:20], labels[15:17, 4:5] = 1, 1, 2, 3, 7
    image = rng.integers(0, 255, (20, 24, 2)).astype(np.uint8)
    masks = {0: labels, 1: (labels > 0).astype(np.int64)}
    want = {}
    for k, m in masks.items():
        df = spark.createDataFrame([(str(k), codecs.pack_image(image), codecs.pack_image(m[:, :, None]))], f"image string, im {IMAGE}, mask {IMAGE}")
        want |= {(k, r.object): r for r in verbs.profile(df, "mask", "pcfbm").collect()}
    pixels = spark.createDataFrame([(k, x, y, c, int(image[y, x, c])) for k in masks for y in range(20) for x in range(24) for c in range(2)], "image int, x int, y int, c int, v int")
    sizes = spark.createDataFrame([(k, 24, 20) for k in masks], "image int, width int, height int")
    got = {(r.image, r.object): r for r in V.profile_masks(pixels, relation(spark, masks, "label"), sizes, "pcfbm").collect()}
    assert set(got) == set(want) and len(got) > 4
    for key, r in want.items():
        for c in [c for c in r.asDict() if c not in ("image", "object", "error")]:
            a, b = got[key][c], r[c]
            a, b = (np.nan if v is None else v for v in (a, b))
            assert np.isclose(a, b, rtol=1e-4, atol=1e-3, equal_nan=True), (key, c, a, b)


def test_bad_rings_are_error_rows(spark):
    im = codecs.pack_image(rng.integers(0, 255, (20, 20, 1)).astype(np.uint8))
    rings = [[{"x": 1.0, "y": 1.0}], [{"x": float(x), "y": float(y)} for x, y in ((5, 5), (15, 5), (15, 15))]]
    df = spark.createDataFrame([("a", im, rings)], f"image string, im {IMAGE}, polygons array<array<struct<x:double,y:double>>>")
    for out in (verbs.profile(df, "polygons", "c"), verbs.process(df, "polygons", "c")):
        assert [(r.object, r.error is None) for r in out.orderBy("object").collect()] == [(0, False), (1, True)]


# --- quirks that only the compatible form has --------------------------------


def paired(spark, image, kind, value, ddl):
    return spark.createDataFrame([("a", codecs.pack_image(image), value)], f"image string, im {IMAGE}, {kind} {ddl}")


def test_q8_masks_follow_the_given_order(spark):
    """A concave ring is filled as given; the old masks of mode p follow the angular order."""
    ring = [(5.0, 5.0), (20.0, 5.0), (20.0, 20.0), (5.0, 20.0), (5.0, 14.0), (16.0, 14.0), (16.0, 10.0), (5.0, 10.0)]  # a C
    points = [{"x": x, "y": y} for x, y in ring]
    df = paired(spark, np.full((30, 30, 1), 9, np.uint8), "polygons", [points], "array<array<struct<x:double,y:double>>>")
    area = lambda compat: verbs.profile(df, "polygons", "pm", compat=compat).first().mask_moments_m00
    own = K.fill_polygon(np.array(ring), 30, 30).sum()
    assert area(False) == own and area(True) > own


def test_q10_neighbours_are_background(spark):
    """The foreground of an object has its own label only, though its crop has another."""
    labels = np.zeros((12, 12), np.int64)
    labels[3:6, 3:6], labels[3:6, 6:9] = 1, 2
    df = paired(spark, np.full((12, 12, 1), 7, np.uint8), "mask", codecs.pack_image(labels[:, :, None]), IMAGE)
    for r in verbs.process(df, "mask", "fb").collect():
        a = codecs.unpack_image(r.im)
        assert (a > 0).sum() == (9 if r.part == "foreground" else a.size - 9)


def test_q11_centroids(spark, tmp_path):
    from petriscope.operators import neural as N

    np.savez(tmp_path / "w.npz", **N.random_weights("dino_vit_small", depth=1))
    df = paired(spark, np.zeros((30, 40, 1), np.uint8), "boxes", [{"x_min": 10.0, "y_min": 4.0, "x_max": 20.0, "y_max": 8.0}], "array<struct<x_min:double,y_min:double,x_max:double,y_max:double>>")
    place = lambda compat: [(r.centroid_x, r.centroid_y) for r in verbs.embed(df, str(tmp_path / "w.npz"), kind="boxes", compat=compat).collect()]
    assert place(False) == [(15, 6)] and place(True) == [(15, 15)]


def test_q16_mode_x_of_masks(spark):
    labels = np.zeros((12, 12), np.int64)
    labels[3:6, 2:9] = 1
    df = paired(spark, np.ones((12, 12, 1), np.uint8), "mask", codecs.pack_image(labels[:, :, None]), IMAGE)
    r = verbs.profile(df, "mask", "x").first()
    assert (r.bbox_width, r.bbox_height, r.bbox_area) == (6, 2, 12)
    px = relation(spark, {0: labels}, "label")
    sizes = spark.createDataFrame([(0, 12, 12)], "image int, width int, height int")
    r = V.profile_masks(px.select("image", F.lit(0).alias("c"), "x", "y", F.lit(1).alias("v")), px, sizes, "x").first()
    assert (r.bbox_width, r.bbox_height, r.bbox_area) == (6, 2, 12)


def test_q20_extensions_in_any_case(spark):
    from petriscope.functions.pixels import listed

    files = spark.createDataFrame([("a/b.TIF",), ("a/c.png",), ("a/d.txt",)], "path string")
    assert [sorted(r.name for r in listed(files, compat=c).collect()) for c in (False, True)] == [["b.TIF", "c.png"], ["c.png"]]


def test_q24_contours_at_the_last_columns():
    """Components at the right and lower border have whole contours."""
    mask = np.zeros((4, 5), np.uint8)
    mask[1:, 3:] = 1
    assert K.find_contours(mask)[0].tolist() == [[3, 1], [3, 2], [3, 3], [4, 3], [4, 2], [4, 1]]


def test_q25_npy_of_another_type_is_an_error_row(spark, tmp_path):
    np.save(tmp_path / "c_image.npy", np.zeros((3, 3), np.complex64))
    np.save(tmp_path / "g_image.npy", np.zeros((3, 3), np.uint8))
    assert {r.stem: r.error is None for r in readers.read_images(spark, str(tmp_path), formats=("npy",)).collect()} == {"c_image": False, "g_image": True}


# --- sources, sinks, streams ------------------------------------------------


def arrays(n=6):
    return {f"im{k}_image": rng.integers(0, 255, (4 + k, 5, 1)).astype(np.uint8) for k in range(n)}


def rows_of(spark, images):
    return spark.createDataFrame([(n, codecs.pack_image(a)) for n, a in images.items()], f"name string, im {IMAGE}").repartition(3)


def test_folder_source(spark, tmp_path):
    from petriscope.sources.folder import folder

    images = arrays()
    for n, a in images.items():
        (tmp_path / f"{n}.npy").write_bytes(codecs.encode_npy(a))
    (tmp_path / "im1_image.PNG").write_bytes(codecs.encode_png(images["im1_image"]))
    (tmp_path / "im2_other.npy").write_bytes(b"")
    (tmp_path / "notes_image.txt").write_text("x")
    df = folder(spark, str(tmp_path), task_bytes=300)
    some = df.where(F.col("ext").isin("npy", "png") & F.col("name").contains("image"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "") and "image_folder" in plan, "both filters are the source's work"
    want = readers.list_files(spark, str(tmp_path), ("npy", "png"), "image").select("stem", "ext").collect()
    assert sorted((r.stem, r.ext) for r in some.collect()) == sorted((r.stem, r.ext) for r in want) and len(want) == 7
    assert df.rdd.getNumPartitions() > 1
    assert {r.stem: codecs.decode(bytes(r.content), r.ext).tolist() for r in some.where("ext = 'npy'").collect()} == {n: a.tolist() for n, a in images.items()}


def test_sink_commits_all_or_nothing(spark, tmp_path):
    from petriscope.sinks.images import ImageSink, ImageWriter, save_images

    images = arrays()
    broken = spark.createDataFrame([("bad", {"width": 3, "height": 3, "channels": 1, "dtype": "u1", "data": b"12"})], f"name string, im {IMAGE}")
    save_images(rows_of(spark, images).unionByName(broken), str(tmp_path / "a"), "npy")
    assert {p.name: codecs.decode(p.read_bytes(), "npy").tolist() for p in (tmp_path / "a").glob("*.npy")} == {f"{n}.npy": a.tolist() for n, a in images.items()}
    assert json.loads((tmp_path / "a/_SUCCESS").read_text()) == {"written": 6, "failed": 1}
    assert ["bad\tValueError" in p.read_text() for p in (tmp_path / "a/_errors").iterdir()] == [True]
    assert not list((tmp_path / "a").glob("_staging/*/*"))

    class Fails(ImageWriter):
        def chunks(self, row):
            if row.name == "im3_image":
                raise OSError("no space")
            return super().chunks(row)

    class FailingSink(ImageSink):
        @classmethod
        def name(cls):
            return "failing_sink"

        def writer(self, schema, overwrite):
            return Fails({k.lower(): v for k, v in self.options.items()})

    spark.dataSource.register(FailingSink)
    with pytest.raises(Exception, match="no space"):
        rows_of(spark, images).write.format("failing_sink").mode("append").option("kind", "npy").save(str(tmp_path / "b"))
    assert not [f for _, _, files in os.walk(tmp_path / "b") for f in files], "a failed job leaves no file"


def test_zarr_leaves_out_chunks_of_failed_images(spark, tmp_path):
    from petriscope.sinks import writers

    good = rows_of(spark, arrays(3)).withColumnRenamed("name", "stem")
    bad = spark.createDataFrame([("im1_z", {"width": 3, "height": 3, "channels": 1, "dtype": "u1", "data": b"12"})], f"stem string, im {IMAGE}")
    rows = writers.write_zarr(good.unionByName(bad).withColumn("error", F.lit(None).cast("string")), str(tmp_path / "z"), width=8, height=6, channels=1).orderBy("row").collect()
    assert [(r.stem, r.row) for r in rows] == [("im0_image", 0), ("im1_image", 1), ("im1_z", 2), ("im2_image", 3)]
    assert json.loads((tmp_path / "z/images/zarr.json").read_text())["shape"] == [4, 6, 8, 1]
    assert sorted(p.name for p in (tmp_path / "z/images/c").iterdir()) == ["0", "1", "3"] == sorted(p.name for p in (tmp_path / "z/names/c").iterdir())


def test_streams_are_paired(spark, tmp_path):
    """Equal to the batch pairs; a mask that comes after the watermark finds no image."""
    from petriscope.streaming.images import object_rate, pair_streams, stream_images

    (tmp_path / "images").mkdir(), (tmp_path / "masks").mkdir()

    def put(kind, name, at):
        path = tmp_path / kind / name
        path.write_bytes(codecs.encode_npy(np.ones((3, 3, 1), np.uint8)))
        os.utime(path, (at, at))

    start = 1_700_000_000
    for k in range(4):
        put("images", f"a{k}_image.npy", start + k)
        put("masks", f"a{k}_mask.npy", start + 60 + k) if k < 3 else None
    pairs = pair_streams(stream_images(spark, str(tmp_path / "images")), stream_images(spark, str(tmp_path / "masks"), mask=True), substring_images="_image", substring_segments="_mask", within="10 minutes", late="1 minutes")
    q = pairs.select("id", "image", "at").writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        batch = verbs.pair(readers.read_images(spark, f"{tmp_path}/images"), readers.read_masks(spark, f"{tmp_path}/masks"), "mask", "_image", "_mask")
        assert sorted(r.id for r in spark.table("pairs").collect()) == sorted(r.id for r in batch.collect()) == ["a0", "a1", "a2"]
        put("images", "b_image.npy", start + 90_000), put("masks", "b_mask.npy", start + 90_000)  # time goes on
        q.processAllAvailable()
        q.processAllAvailable()
        put("masks", "a3_mask.npy", start + 70)  # a day late
        q.processAllAvailable()
        assert sorted(r.id for r in spark.table("pairs").collect()) == ["a0", "a1", "a2", "b"]
    finally:
        q.stop()
    rate = object_rate(spark.table("pairs").withColumn("object", F.lit(0))).collect()
    assert sorted(r.objects for r in rate) == [1, 3]


def test_jpeg_masks_are_read(spark, tmp_path):
    image_io = spark._jvm.javax.imageio.ImageIO
    kinds = spark._jvm.java.awt.image.BufferedImage
    for name, kind in (("gray", 10), ("colour", 5)):
        image_io.write(kinds(8, 8, kind), "jpg", spark._jvm.java.io.File(f"{tmp_path}/{name}.jpg"))
    rows = {r.stem: r for r in readers.read_masks(spark, str(tmp_path)).collect()}
    assert rows["gray"].error is None and rows["gray"].im.dtype == "i8" and "one channel" in rows["colour"].error
