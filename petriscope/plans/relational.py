"""The profile and process verbs on the pixel relation: joins, aggregations and expressions only.

Images are pixels (image, c, x, y, v) with their sizes (image, width, height);
masks are (image, x, y, label) of the pixels that are not 0.  An image is as
many rows as it has pixels, so it may be larger than a task.  A verb first finds
the objects, (image, object, crop) and which pixels of a crop are the object's,
then describes all parts of all objects in one pass for each family.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import descriptors as D
from ..functions import polygons as G
from ..functions import regions as R
from ..functions.joining import merged
from ..schema import BOX, FORM, MOMENTS, PIXEL_FAMILIES, ZERNIKE, profile_columns
from ..sinks.shared import kept

PARTS = {"c": "complete", "f": "foreground", "b": "background", "m": "mask"}
KEY = ["image", "object"]


def mask_objects(masks: DataFrame) -> DataFrame:
    """(image, object, label, poly, bbox): the objects of label images, numbered from 0 by label.

    A mask of one value is split into its components; any other is labelled
    already, and a label's polygon is its longest contour (of equal ones the
    later).  Contours of one or two points are no objects.
    """
    on = kept(masks.where("label <> 0").select("image", "label", "x", "y"), "masks")
    found = kept(R.components(on, ["image", "label"]), "components")
    values = on.groupBy("image").agg(F.countDistinct("label").alias("values"))
    points = R.contours(found, ["image", "label"])
    ring = merged(R.rings(points, ["image", "label", "root"]), values, "image")
    number = F.row_number().over(Window.partitionBy("image").orderBy("root")).cast("long")  # of a mask of one value
    named = ring.withColumn("name", F.when(F.col("values") == 1, number).otherwise(F.col("label")))
    longest = named.groupBy("image", "name").agg(F.max_by(F.struct("poly", "label", "root"), F.struct(F.size("poly"), "root")).alias("o"))
    good = longest.where(F.size("o.poly") > 2).select("image", F.col("name").alias("label"), "o.poly", F.col("o.label").alias("value"), "o.root")
    number = (F.row_number().over(Window.partitionBy("image").orderBy("label")) - 1).alias("object")
    return merged(good, values, "image").select("image", number, "label", "poly", G.bounding_box(F.col("poly")).alias("bbox"), "value", F.when(F.col("values") == 1, F.col("root")).alias("root"))


def object_pixels(masks: DataFrame, objects: DataFrame) -> DataFrame:
    """(image, object, x, y) of the pixels of :func:`mask_objects`: of its component where the mask has one value, else of its label."""
    on = masks.where("label <> 0").select("image", "label", "x", "y")
    found = R.pixels_of(R.components(on, ["image", "label"])).withColumnRenamed("label", "value")
    own = objects.select(*KEY, "value", F.col("root").alias("only"))
    return merged(found, own, ["image", "value"]).where("only is null OR only = root").select(*KEY, "x", "y")


def _cropped(objects: DataFrame, sizes: DataFrame, pad: int, min_size: int, compat: bool) -> DataFrame:
    return G.object_crops(merged(objects, sizes, "image"), pad, min_size, compat)


def parts(pixels: DataFrame, crops: DataFrame, own: DataFrame | None, mode: str) -> DataFrame:
    """(image, object, part, c, x, y, v, w, h): the pixels of each part that ``mode`` asks for, from the crop's corner.

    ``own`` are the objects' pixels (image, object, x, y); a mask has one
    channel of 0 and 1.
    """
    at = R.crops(pixels, crops.select(*KEY, "crop"), ["image"], KEY)
    if own is None:
        return at.withColumn("part", F.lit("complete"))
    corner = crops.select(*KEY, F.col("crop.x").alias("cx"), F.col("crop.y").alias("cy"))
    mine = merged(own, corner, KEY).select(*KEY, (F.col("x") - F.col("cx")).cast("long").alias("x"), (F.col("y") - F.col("cy")).cast("long").alias("y"), F.lit(1).alias("own"))
    at = merged(at, mine, [*KEY, "x", "y"], "left").withColumn("own", F.col("own").isNotNull())
    v, none = F.col("v").cast("double"), F.lit(0.0)
    values = {"c": v, "f": F.when(F.col("own"), v).otherwise(none), "b": F.when(F.col("own"), none).otherwise(v), "m": F.when(F.col("c") == 0, F.col("own").cast("double"))}
    each = F.inline(F.array(*(F.struct(F.lit(PARTS[m]).alias("part"), values[m].alias("v")) for m in PARTS if m in mode)))
    return at.select(*KEY, "c", "x", "y", "w", "h", each).where("v is not null")


def described_parts(of_parts: DataFrame, mode: str) -> DataFrame:
    """(image, object, part, descriptors): all families, a row a part; a mask has no intensity or texture."""
    by = [*KEY, "part"]
    of_parts = kept(of_parts, "parts")
    images = of_parts.where("part <> 'mask'")
    out = merged(D.moments(of_parts, by), D.zernike(of_parts, by, F.col("w"), F.col("h")), by)
    if set(mode) & set("cfb"):
        out = merged(merged(out, D.intensity(images, by), by, "left"), D.texture(images, by), by, "left")
    return out


def described(of_parts: DataFrame, mode: str) -> DataFrame:
    """(image, object, descriptors): a row an object, in the order of the mode's columns."""
    names = {p: MOMENTS + ZERNIKE if p == "mask" else PIXEL_FAMILIES for m, p in PARTS.items() if m in mode}
    wide = [F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p, columns in names.items() for c in columns]
    return described_parts(of_parts, mode).groupBy(*KEY).agg(*wide)


def _profile(pixels: DataFrame, objects: DataFrame, own: DataFrame | None, sizes: DataFrame, mode: str, pad: int, min_size: int, compat: bool) -> DataFrame:
    crops = kept(_cropped(objects, sizes, pad, min_size, compat), "crops")
    out = crops.select(*KEY)
    if set(mode) & set("cfbm"):
        out = merged(out, described(parts(pixels, crops, own, mode), mode), KEY)
    if "p" in mode:
        ordered = G.settled(crops.select(*KEY, "poly"), {"ring": G.order_points(G.dedup_points(F.col("poly")))})
        out = merged(out, G.form(ordered, "ring", compat).select(*KEY, *FORM), KEY)
    if "x" in mode:
        out = merged(out, crops.select(*KEY, *(c.alias(n) for n, c in G.box_descriptors(F.col("bbox")).items())), KEY)
    return out.select(*KEY, *profile_columns(mode, boxes="x" in mode and set(mode) <= set("cx")))


def profile_masks(pixels: DataFrame, masks: DataFrame, sizes: DataFrame, mode: str = "cm", pad: int = 1, min_size: int = 1) -> DataFrame:
    """(image, object, descriptors) of the objects of label images; ``mode`` picks form and parts."""
    profile_columns(mode)
    objects = kept(mask_objects(masks), "objects")
    own = object_pixels(masks, objects) if set(mode) & set("fbm") else None
    return _profile(pixels, objects, own, sizes, mode, pad, min_size, False)


def profile_polygons(pixels: DataFrame, polygons: DataFrame, sizes: DataFrame, mode: str = "pc", pad: int = 1, min_size: int = 1) -> DataFrame:
    """The same of polygons (image, object, poly) of three points or more; an object's pixels are those inside or on its outline."""
    profile_columns(mode)
    objects = polygons.select(*KEY, "poly", G.bounding_box(F.col("poly")).alias("bbox")).where(F.size("poly") > 2)
    own = R.filled(merged(objects, sizes, "image"), KEY, F.col("width"), F.col("height")) if set(mode) & set("fbm") else None
    return _profile(pixels, objects, own, sizes, mode, pad, min_size, False)


def profile_boxes(pixels: DataFrame, boxes: DataFrame, sizes: DataFrame, mode: str = "cx", pad: int = 1, min_size: int = 1) -> DataFrame:
    """The same of boxes (image, object, bbox): the whole crop and the box's own measures."""
    profile_columns(mode, boxes=True)
    return _profile(pixels, boxes.select(*KEY, "bbox"), None, sizes, mode, pad, min_size, False)


def measure(pixels: DataFrame, family: str, sizes: DataFrame | None = None) -> DataFrame:
    """(image, descriptors) of whole images; Zernike's need the ``sizes``."""
    if family == "zernike":
        sized = merged(pixels, sizes.withColumnsRenamed({"width": "w", "height": "h"}), "image")
        return D.zernike(sized, ["image"], F.col("w"), F.col("h"))
    return {"intensity": D.intensity, "moments": D.moments, "texture": D.texture}[family](pixels, ["image"])


def process(pixels: DataFrame, objects: DataFrame, own: DataFrame | None, sizes: DataFrame, mode: str = "c", pad: int = 1, min_size: int = 1) -> DataFrame:
    """(image, object, part, width, height, pixels): crops of the parts as row-major, channel-interleaved arrays; a mask has 0 and 255."""
    of_parts = parts(pixels, _cropped(objects, sizes, pad, min_size, False), own, mode)
    channels = F.when(F.col("part") == "mask", F.lit(0)).otherwise(F.max("c").over(Window.partitionBy(*KEY, "part")))
    v = F.when(F.col("part") == "mask", F.col("v") * 255).otherwise(F.col("v"))
    at = F.struct(((F.col("y") * F.col("w") + F.col("x")) * (F.col("k") + 1) + F.col("c")).alias("i"), v.alias("v"))
    one = of_parts.withColumn("k", channels).groupBy(*KEY, "part").agg(F.max("w").alias("width"), F.max("h").alias("height"), F.array_sort(F.collect_list(at)).alias("s"))
    return one.select(*KEY, "part", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("s.v").alias("pixels"))


__all__ = ["BOX", "described", "described_parts", "mask_objects", "measure", "object_pixels", "parts", "process", "profile_boxes", "profile_masks", "profile_polygons"]
