import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from petriscope.functions import descriptors as D
from petriscope.functions import polygons as G
from petriscope.functions.pixels import explode_pixels
from petriscope.operators import kernels as K
from petriscope.operators import neural as N
from petriscope.plans import tables, verbs
from petriscope.schema import TEXTURE, ZERNIKE, profile_columns
from petriscope.sinks import writers
from petriscope.sources import codecs, readers

SF = "/root/testdata/sf0.001"


def scene(h=30, w=40):
    y, x = np.mgrid[:h, :w]
    image = (x * 5 + y).astype(np.uint8)[:, :, None]
    mask = (((x - 10) ** 2 + (y - 15) ** 2 < 25) * 1 + ((abs(x - 28) < 5) & (abs(y - 14) < 4)) * 2).astype(np.uint8)
    return image, mask


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    image, mask = scene()
    for kind in ("images", "masks", "polygons", "boxes"):
        (root / kind).mkdir()
    (root / "images/a_image.png").write_bytes(codecs.encode_png(image))
    (root / "images/b_image.NPY").write_bytes(codecs.encode_npy(image.astype(np.float32)))
    (root / "images/broken_image.png").write_bytes(b"not an image")
    (root / "images/notes.txt").write_text("x")
    for n in "ab":
        (root / f"masks/{n}_mask.png").write_bytes(codecs.encode_png(mask))
    (root / "polygons/a.json").write_text(json.dumps({"shapes": [[[5, 5], [15, 5], [15, 15], [5, 15]]]}))
    (root / "polygons/bad.json").write_text("{}")
    (root / "boxes/a.json").write_text(json.dumps({"xyxy": [[2, 2, 9, 9], [0, 0, 1, 1]]}))
    return str(root)


def test_codecs_round_trip():
    rng = np.random.default_rng(0)
    for dtype, c in (("u1", 1), ("u2", 1), ("u1", 3), ("u2", 3)):
        a = rng.integers(0, np.iinfo(dtype).max, (7, 9, c)).astype(dtype)
        assert (codecs.decode(codecs.encode_png(a), "png") == a).all()
        assert (codecs.decode(codecs.encode_npy(a), "npy") == a).all()
    a = rng.integers(0, 255, (3, 4, 3)).astype("u1")
    assert (codecs.decode(b"P6\n# c\n4 3\n255\n" + a.tobytes(), "ppm") == a).all()
    assert codecs.decode(b"P1\n2 1\n1 0\n", "pbm").ravel().tolist() == [0, 255]
    with pytest.raises(codecs.Unsupported):
        codecs.decode(b"", "exr")


def test_readers_and_profile(spark, folders):
    images = readers.read_images(spark, f"{folders}/images", "image", formats=("png", "npy"))
    rows = {r.stem: r for r in images.collect()}
    assert set(rows) == {"a_image", "b_image", "broken_image"}
    assert rows["broken_image"].error and rows["b_image"].im.dtype == "f4"
    masks = readers.read_masks(spark, f"{folders}/masks")
    paired = verbs.pair(images, masks, "mask", "_image", "_mask")
    out = verbs.profile(paired, "mask", "pcfbm").toPandas()
    assert len(out) == 4 and list(out.columns[2:-1]) == profile_columns("pcfbm") and len(profile_columns("pcfbm")) == 299
    assert out["error"].isna().all() and (out["form_area"] > 0).all()
    crops = verbs.process(paired, "mask", "cm").collect()
    assert {r.part for r in crops} == {"complete", "mask"}
    counts = verbs.object_counts(verbs.mask_to_polygons(masks.select(F.col("stem").alias("image"), "im"))).collect()
    assert {r.n for r in counts} == {2}


def test_polygons_and_boxes(spark, folders):
    p = {r.stem: r for r in readers.read_polygons(spark, f"{folders}/polygons").collect()}
    assert len(p["a"].polygons[0]) == 4 and p["bad"].error
    b = readers.read_boxes(spark, f"{folders}/boxes").collect()[0]
    assert [x.x_max for x in b.boxes] == [9, 1]
    form = verbs.measure_form(readers.read_polygons(spark, f"{folders}/polygons").where("error is null").withColumnRenamed("stem", "image")).collect()[0]
    assert form.form_area == 100 and form.form_centroid_x == 10


def test_q10_q15_q18(spark):
    image, _ = scene()
    im = codecs.pack_image(image)
    rings = [[{"x": 1.0, "y": 1.0}], [{"x": float(x), "y": float(y)} for x, y in ((5, 5), (15, 5), (15, 15))]]
    df = spark.createDataFrame([("a", im, rings)], "image string, im struct<width:int,height:int,channels:int,dtype:string,data:binary>, polygons array<array<struct<x:double,y:double>>>")
    assert [(r.object, r.error is None) for r in verbs.profile(df, "polygons", "c").collect()] == [(0, False), (1, True)]
    assert verbs.profile(df.limit(0), "polygons", "c").count() == 0
    with pytest.raises(ValueError):
        verbs.profile(df, "polygons", "z")


def test_relational_equals_kernels(spark):
    images = tables.gray_images(spark, SF).orderBy("image").limit(8)
    arrays = {r.image: np.array(r.pixels).reshape(8, 8, 1) for r in images.collect()}
    px = explode_pixels(spark.createDataFrame([(k, a.ravel().tolist()) for k, a in arrays.items()], "image long, pixels array<int>"))
    for r in D.intensity(px, ["image"]).collect():
        assert np.allclose([r[f"intensity_{c}"] for c in ("min", "max", "sum", "mean", "std", "median", "mad")], K.intensity(arrays[r.image]))
    for r in D.texture(px, ["image"]).collect():
        assert np.allclose([r[c] for c in TEXTURE], K.texture(arrays[r.image]), atol=1e-6)
    for r in D.zernike(px, ["image"], 8, 8).collect():
        assert np.allclose([r[c] for c in ZERNIKE], K.zernike(arrays[r.image]), atol=1e-6)
    for r in D.moments(px, ["image"]).collect():
        assert np.allclose([r[c] for c in r.asDict() if c != "image"], K.moments(arrays[r.image]), rtol=1e-6)


def test_degenerate_images_equal_kernels(spark):
    """One level, one row, one column, one pixel and no positive value (Q5)."""
    arrays = {k: np.array(a).reshape(h, w, 1) for k, (a, h, w) in enumerate((([7] * 9, 3, 3), ([1, 5, 5, 9], 1, 4), ([1, 5, 5, 9], 4, 1), ([3], 1, 1), ([0] * 4, 2, 2), ([2, 2, 2, 9, 9, 4], 2, 3)))}
    rows = [(k, 0, x, y, int(a[y, x, 0])) for k, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    px = spark.createDataFrame(rows, "image long, c int, x int, y int, v int")
    texture = D.texture(px, ["image"]).collect()
    assert len(texture) == len(arrays)
    for r in texture:
        assert np.allclose([r[c] for c in TEXTURE], K.texture(arrays[r.image]), atol=1e-6, equal_nan=True), r
    for r in D.intensity(px, ["image"]).collect():
        assert np.allclose([r[f"intensity_{c}"] for c in ("min", "max", "sum", "mean", "std", "median", "mad")], K.intensity(arrays[r.image])), r


def test_texture_deals_pixels_once(spark):
    plan = D.texture(tables.gray(spark, SF), ["image"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_polygon_functions_equal_kernels(spark):
    rows = tables.polygons(spark, SF)
    out = G.form_simple(rows).limit(10).collect()
    for r in out:
        p = np.array([(q.x, q.y) for q in r.poly])
        area = abs(K.signed_area(p))
        assert r.form_area == pytest.approx(area)
        assert r.form_perimeter == pytest.approx(np.hypot(*(np.roll(p, -1, 0) - p).T).sum())


def test_sinks(spark, tmp_path, folders):
    df = spark.range(3).withColumn("x", F.col("id") * 2)
    for kind in ("csv", "tsv", "parquet"):
        writers.write_table(df, str(tmp_path / f"t.{kind}"), single=True)
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t.tsv")).count() == 3
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path / "t.xyz"))
    assert writers.new_folder(str(tmp_path / "n")) != writers.new_folder(str(tmp_path / "n"))
    images = readers.read_images(spark, f"{folders}/images", "image", formats=("png", "npy"))
    done = writers.write_images(images.where("error is null").select(F.col("stem").alias("name"), "im"), str(tmp_path / "out"), "npy").collect()
    assert len(done) == 2 and all(r.error is None for r in done)
    rows = writers.write_zarr(images, str(tmp_path / "z"), width=8, height=6, channels=1).collect()
    assert len(rows) == 2
    assert json.loads((tmp_path / "z/images/zarr.json").read_text())["shape"] == [2, 6, 8, 1]  # Q12
    objects = verbs.mask_to_polygons(readers.read_masks(spark, f"{folders}/masks").select(F.col("stem").alias("image"), "im"))
    writers.write_json_objects(objects, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).columns == ["image", "polygons"]


def test_png_filters():
    """Rows of every filter, written here pixel by pixel from the definition, come back."""
    rng = np.random.default_rng(3)
    for c, dtype in ((1, "u1"), (3, "u1"), (1, "u2"), (3, "u2")):
        a = rng.integers(0, np.iinfo(dtype).max, (11, 9, c)).astype(dtype)
        flat = np.ascontiguousarray(a.astype(">u2") if dtype == "u2" else a).view(np.uint8).reshape(11, -1).astype(int)
        step, lines = c * a.itemsize, []
        for y, row in enumerate(flat):
            kind, line = y % 5, []
            for i, v in enumerate(row):
                left, up = row[i - step] if i >= step else 0, flat[y - 1][i] if y else 0
                corner = flat[y - 1][i - step] if y and i >= step else 0
                guesses = sorted(((abs(left + up - corner - g), k, g) for k, g in enumerate((left, up, corner))))
                line.append((v - (0, left, up, (left + up) // 2, guesses[0][2])[kind]) % 256)
            lines.append([kind, *line])
        raw = np.array(lines, np.uint8).ravel()
        assert (codecs._unfilter(raw, 11, flat.shape[1], step) == flat).all()


def test_json_files_come_back(spark, tmp_path, folders):
    masks = readers.read_masks(spark, f"{folders}/masks").select(F.regexp_replace("stem", "_mask", "").alias("image"), "im")
    objects = verbs.mask_to_polygons(masks).cache()
    for what, read in (("polygons", readers.read_polygons), ("bounding_boxes", readers.read_boxes)):
        done = writers.write_json_files(objects, str(tmp_path / what), what).collect()
        assert {r.image for r in done} == {"a", "b"} and all(r.error is None for r in done)
        back = {r.stem: r for r in read(spark, str(tmp_path / what)).collect()}
        for r in objects.collect():
            if what == "polygons":
                assert back[r.image].error is None and back[r.image].polygons[r.object] == r.poly
            else:
                assert back[r.image].error is None and back[r.image].boxes[r.object] == r.bbox
    assert {p.name for p in (tmp_path / "polygons").iterdir()} == {"a.json", "b.json"}


def test_masks_saved_flat_and_by_uri(spark, tmp_path, folders):
    masks = readers.read_masks(spark, f"{folders}/masks").select(F.col("stem").alias("name"), "im")
    done = writers.write_masks(masks, f"file://{tmp_path}/m").collect()
    assert len(done) == 2 and all(r.error is None for r in done)
    assert np.load(tmp_path / "m/a_mask.npy").shape == (30, 40)


def test_folders_guard_and_status(spark, tmp_path, folders):
    with pytest.raises(ValueError):
        verbs.pair_folders(spark, f"{folders}/images", f"{folders}/images/", "mask", "x", "x")
    with pytest.raises(ValueError):
        verbs.pair_folders(spark, folders, folders, "lines", "x", "y")
    paired = verbs.pair_folders(spark, f"{folders}/images", f"{folders}/masks", "mask", "_image", "_mask")
    out = verbs.profile(paired, "mask", "c")
    assert out.count() == 4
    verbs.write_status(out, str(tmp_path))
    assert (tmp_path / "object_counts.tsv").exists() and not (tmp_path / "object_errors.tsv").exists()
    assert {tuple(r) for r in spark.read.option("sep", "\t").csv(str(tmp_path / "object_counts.tsv")).collect()} == {("a_image", "2"), ("b_image", "2")}


def test_embeddings_file_has_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "GATHERED", 2)
    with pytest.raises(ValueError):
        writers.write_embeddings(spark.range(3).select(F.array(F.lit(1.0)).alias("embedding")), str(tmp_path / "e.npy"))


def test_neural(spark, tmp_path, folders):
    w = N.random_weights("dino_vit_small", depth=1)
    np.savez(tmp_path / "w.npz", **w)
    images = readers.read_images(spark, f"{folders}/images", "image", formats=("png", "npy"))
    paired = verbs.pair(images, readers.read_masks(spark, f"{folders}/masks"), "mask", "_image", "_mask")
    out = verbs.embed(paired, str(tmp_path / "w.npz"), kind="mask").toPandas()
    assert len(out) == 4 and all(len(v) == 384 for v in out["embedding"])
    writers.write_embeddings(spark.createDataFrame(out.drop(columns="error")), str(tmp_path / "e.npz"))
    with np.load(tmp_path / "e.npz") as f:
        assert f["embedding"].shape == (4, 384) and f["centroid"].shape == (4, 2)
    assert N.to_tensor(np.zeros((2, 2, 5))).shape == N.to_tensor(np.zeros((2, 2, 1))).shape == (3, 2, 2)
    assert N.preprocess(np.full((2, 2, 1), 65535, np.uint16), "dino_vit_small").max() < 3 < N.preprocess(np.full((2, 2, 1), 65535, np.uint16), "dino_vit_small", compat=True).max()  # Q22


def test_sql_table_function(spark):
    verbs.register_sql(spark)
    _, mask = scene()
    spark.createDataFrame([("a", codecs.pack_image(mask[:, :, None]))], "image string, im struct<width:int,height:int,channels:int,dtype:string,data:binary>").createOrReplaceTempView("masks")
    assert spark.sql("SELECT image, o.object FROM masks, LATERAL mask_objects(im) o").count() == 2


def test_stream_equals_batch(spark, folders, tmp_path):
    from petriscope.streaming.images import stream_images

    q = stream_images(spark, f"{folders}/masks", mask=True).select("stem", "error").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").count() == 2


def test_catalogs(spark):
    from petriscope.sources import catalogs

    rows = catalogs.collections(spark).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in rows} == {"segmentation": 12, "benchmark": 13}
    assert catalogs.models(spark).count() == len(catalogs.MODELS)
    assert catalogs.weights_path("dino_vit_small", "/c") == "/c/dino_vit_small.npz"
    with pytest.raises(ValueError):
        catalogs.weights_path("no_such_model")
