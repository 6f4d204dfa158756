"""Schemas and fixed names.

The lists of columns, keys and formats are fixed values: files written by other
tools and the tables made here must carry exactly these names.
"""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE_FORMATS = ("avif", "bmp", "dds", "hdr", "ico", "jpeg", "jpg", "exr", "png", "pbm", "pgm", "ppm", "qoi", "tga", "tif", "tiff", "webp", "npy")
POLYGON_KEYS = ("polygons", "contours", "outlines", "shapes", "points")
BOX_KEYS = ("bounding_boxes", "bboxes", "bbox", "bounding_box", "boxes", "box", "xyxy")

FORM = tuple(
    f"form_{c}"
    for c in (
        "centroid_x", "centroid_y", "center_x", "center_y", "area", "area_bbox", "area_convex", "perimeter",
        "elongation", "thread_length", "thread_width", "solidity", "extent", "form_factor", "equivalent_diameter",
        "eccentricity", "major_axis", "minor_axis", "minimum_radius", "maximum_radius", "mean_radius", "min_feret", "max_feret",
    )
)
INTENSITY = tuple(f"intensity_{c}" for c in ("min", "max", "sum", "mean", "std", "median", "mad"))
RAW_MOMENTS = ("m00", "m10", "m01", "m11", "m20", "m02", "m21", "m12", "m30", "m03")
CENTRAL_MOMENTS = ("u11", "u20", "u02", "u21", "u12", "u30", "u03")
HU_MOMENTS = ("i1", "i2", "i3", "i4", "i5", "i6", "i7")
MOMENTS = tuple(f"moments_{c}" for c in RAW_MOMENTS + CENTRAL_MOMENTS + HU_MOMENTS)
TEXTURE = tuple(
    f"texture_{c}"
    for c in (
        "energy", "contrast", "correlation", "sum_of_squares", "inverse_difference_moment", "sum_average", "sum_variance",
        "sum_entropy", "entropy", "difference_variance", "difference_entropy", "infocorr1", "infocorr2",
    )
)
ZERNIKE_ORDERS = tuple((n, m) for n in range(10) for m in range(n % 2, n + 1, 2))
ZERNIKE = tuple(f"zernike_{n}{m}" for n, m in ZERNIKE_ORDERS)
PIXEL_FAMILIES = INTENSITY + MOMENTS + TEXTURE + ZERNIKE
BOX = ("bbox_width", "bbox_height", "bbox_area")

IMAGE = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYGON = T.ArrayType(POINT)
BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x_min", "y_min", "x_max", "y_max")])


def profile_columns(mode: str, boxes: bool = False) -> list[str]:
    """Descriptor columns of a mode, always in the order p, c, f, b, m, x.

    >>> len(profile_columns("mbfcp")), profile_columns("x", boxes=True)
    (299, ['bbox_width', 'bbox_height', 'bbox_area'])
    """
    allowed = "cx" if boxes else "cmbfpx"
    if not mode or set(mode) - set(allowed):
        raise ValueError(f"mode must be made of the letters {allowed}")
    out: list[str] = []
    if "p" in mode:
        out += FORM
    for letter, prefix, names in (("c", "complete", PIXEL_FAMILIES), ("f", "foreground", PIXEL_FAMILIES), ("b", "background", PIXEL_FAMILIES), ("m", "mask", MOMENTS + ZERNIKE)):
        if letter in mode:
            out += [f"{prefix}_{c}" for c in names]
    if "x" in mode:
        out += BOX
    return out
