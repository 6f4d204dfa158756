"""Registered queries over the test tables, and the same results as DuckDB SQL."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import descriptors as D
from ..functions import pixels as P
from ..functions import polygons as G
from ..functions import regions as R
from ..functions import resizing as Z
from ..functions.joining import merged
from ..sinks.shared import new_place
from ..schema import BOX_KEYS, FORM, IMAGE_FORMATS, INTENSITY, MOMENTS, PIXEL_FAMILIES, POLYGON_KEYS, RAW_MOMENTS, TEXTURE, ZERNIKE, ZERNIKE_ORDERS
from . import relational as V
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EPS = "1.1920928955078125e-07"
_P = f"WITH {T.POLYGON_SQL}"


def rounded(df: DataFrame, keys: list[str], decimals: int = 6) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(c).cast("double"), decimals).alias(c) for c in df.columns if c not in keys))


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _r(expression: str, name: str, decimals: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {decimals}) AS {name}"


# --- intensity --------------------------------------------------------------


def _intensity_sql(pixels: str, compat: bool = False) -> str:
    one = lambda c: f"max_by(coalesce({c}, 0), c) / count(*)" if compat else f"avg(coalesce({c}, 0))"
    return f"""WITH {pixels},
ch AS (SELECT image, c, min(v) FILTER (v > 0) AS lo, max(v) FILTER (v > 0) AS hi, CAST(sum(v) FILTER (v > 0) AS DOUBLE) AS total, avg(v) FILTER (v > 0) AS mean, stddev_pop(v) FILTER (v > 0) AS std FROM px GROUP BY image, c),
st AS (SELECT image, {one("lo")} AS lo, {one("hi")} AS hi, {one("total")} AS total, {one("mean")} AS mean, {one("mean" if compat else "std")} AS std FROM ch GROUP BY image),
md AS (SELECT image, median(v) FILTER (v > 0) AS med, mad(v) FILTER (v > 0) AS mad FROM px GROUP BY image)
SELECT image, {_r("lo", "intensity_min")}, {_r("hi", "intensity_max")}, {_r("total", "intensity_sum")}, {_r("mean", "intensity_mean")}, {_r("std", "intensity_std")},
  {_r("coalesce(med, 0)", "intensity_median")}, {_r("coalesce(mad, 0)", "intensity_mad")} FROM st JOIN md USING (image)"""


@query("intensity_gray", _intensity_sql(T.GRAY_SQL))
def intensity_gray(spark, sf):
    return rounded(D.intensity(T.gray(spark, sf), ["image"]), ["image"])


@query("intensity_multichannel", _intensity_sql(T.MULTI_SQL))
def intensity_multichannel(spark, sf):
    return rounded(D.intensity(T.multi(spark, sf), ["image"]), ["image"])


@query("intensity_sum_signed", f"WITH {T.MULTI_SQL} SELECT image, c, {_r('sum(v - 40)', 'sum')} FROM px GROUP BY image, c")
def intensity_sum_signed(spark, sf):
    """Sums of all values of a signed image, channel by channel."""
    return rounded(D.intensity_sum(T.multi(spark, sf).withColumn("v", F.col("v") - 40), ["image"]), ["image", "c"])


@query("intensity_compat_lastchannel", _intensity_sql(T.MULTI_SQL, compat=True))
def intensity_compat(spark, sf):
    return rounded(D.intensity(T.multi(spark, sf), ["image"], compat=True), ["image"])


_MASKED = "px AS (SELECT image, x, y, c, CASE WHEN v > 40 THEN {a} ELSE {b} END AS v FROM raw)"


@query("intensity_foreground", _intensity_sql(T.GRAY_SQL.replace("px AS", "raw AS") + ", " + _MASKED.format(a="v", b="0")))
def intensity_foreground(spark, sf):
    return rounded(D.intensity(P.masked(T.gray(spark, sf), (F.col("v") > 40).cast("int")), ["image"]), ["image"])


@query("intensity_background", _intensity_sql(T.GRAY_SQL.replace("px AS", "raw AS") + ", " + _MASKED.format(a="0", b="v")))
def intensity_background(spark, sf):
    return rounded(D.intensity(P.masked(T.gray(spark, sf), (F.col("v") > 40).cast("int"), background=True), ["image"]), ["image"])


@query("intensity_crop", _intensity_sql(T.GRAY_SQL.replace("px AS", "raw AS") + ", px AS (SELECT image, x - 2 AS x, y - 1 AS y, c, v FROM raw WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4)"))
def intensity_crop(spark, sf):
    return rounded(D.intensity(P.cropped(T.gray(spark, sf), F.lit(2), F.lit(1), F.lit(5), F.lit(4)), ["image"]), ["image"])


@query(
    "pixels_round_trip",
    f"WITH {T.GRAY_SQL} SELECT image, CAST(count(*) AS INTEGER) AS n, CAST(sum(v * (1 + 8 * y + x)) AS BIGINT) AS s FROM px GROUP BY image",
)
def pixels_round_trip(spark, sf):
    back = P.implode_pixels(T.gray(spark, sf), ["image"], width=8)
    return back.select("image", F.size("pixels").alias("n"), F.aggregate(F.transform("pixels", lambda v, i: (v * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


@query(
    "pixel_casts",
    f"""WITH {T.GRAY_SQL} SELECT image, x, y, CASE WHEN v * 3 - 100 BETWEEN 0 AND 255 THEN v * 3 - 100 ELSE 0 END::BIGINT AS u1,
  CASE WHEN v * 900 - 100 BETWEEN 0 AND 65535 THEN v * 900 - 100 ELSE 0 END::BIGINT AS u2 FROM px""",
)
def pixel_casts(spark, sf):
    v = F.col("v")
    return T.gray(spark, sf).select("image", "x", "y", P.cast_or_zero(v * 3 - 100, "u1").cast("long").alias("u1"), P.cast_or_zero(v * 900 - 100, "u2").cast("long").alias("u2"))


# --- moments ----------------------------------------------------------------

_RAW = ", ".join(f"CAST(sum(CAST(v AS DOUBLE) * pow(x, {m[1]}) * pow(y, {m[2]})) AS DOUBLE) AS {m}" for m in RAW_MOMENTS)
_CENTRAL = """u AS (SELECT *, m10 / m00 AS ax, m01 / m00 AS ay FROM m),
cm AS (SELECT *, m11 - ax * m01 AS u11, m20 - ax * m10 AS u20, m02 - ay * m01 AS u02,
  m21 - 2e0 * ax * m11 - ay * m20 + 2e0 * ax * ax * m01 AS u21, m12 - 2e0 * ay * m11 - ax * m02 + 2e0 * ay * ay * m10 AS u12,
  m30 - 3e0 * ax * m20 + 2e0 * ax * ax * m10 AS u30, m03 - 3e0 * ay * m02 + 2e0 * ay * ay * m01 AS u03 FROM u)"""
_HU = """nm AS (SELECT *, u11 / pow(m00, 2) AS n11, u20 / pow(m00, 2) AS n20, u02 / pow(m00, 2) AS n02, u21 / pow(m00, 2.5) AS n21, u12 / pow(m00, 2.5) AS n12, u30 / pow(m00, 2.5) AS n30, u03 / pow(m00, 2.5) AS n03 FROM cm),
hh AS (SELECT *, n20 - n02 AS p, n30 - 3 * n12 AS q, n30 + n12 AS r, n21 + n03 AS z, 3 * n21 - n03 AS w FROM nm),
hu AS (SELECT *, n20 + n02 AS i1, p * p + 4 * n11 * n11 AS i2, q * q + w * w AS i3, r * r + z * z AS i4, q * r * (r * r - 3 * z * z) + w * z * (3 * r * r - z * z) AS i5,
  p * (r * r - z * z) + 4 * n11 * r * z AS i6, w * r * (r * r - 3 * z * z) - q * z * (3 * r * r - z * z) AS i7 FROM hh)"""
_M = f"WITH {T.GRAY_SQL}, m AS (SELECT image, {_RAW} FROM px WHERE v > 0 GROUP BY image)"
_US = ("u11", "u20", "u02", "u21", "u12", "u30", "u03")
_IS = ("i1", "i2", "i3", "i4", "i5", "i6", "i7")


@query("moments_raw", f"{_M} SELECT image, {', '.join(_r(c, c) for c in RAW_MOMENTS)} FROM m")
def moments_raw(spark, sf):
    return rounded(D.raw_moments(T.gray(spark, sf), ["image"]).drop("c"), ["image"])


@query("moments_central", f"{_M}, {_CENTRAL} SELECT image, {', '.join(_r(c, c, 4) for c in _US)} FROM cm")
def moments_central(spark, sf):
    return rounded(D.central_moments(D.raw_moments(T.gray(spark, sf), ["image"])).select("image", *_US), ["image"], 4)


@query("moments_hu", f"{_M}, {_CENTRAL}, {_HU} SELECT image, {', '.join(_r(c, c, 9) for c in _IS)} FROM hu")
def moments_hu(spark, sf):
    return rounded(D.hu_moments(D.central_moments(D.raw_moments(T.gray(spark, sf), ["image"]))).select("image", *_IS), ["image"], 9)


@query("moments_mask", f"WITH {T.GRAY_SQL.replace('px AS', 'raw AS')}, px AS (SELECT image, x, y, c, CAST(v > 40 AS INTEGER) AS v FROM raw), m AS (SELECT image, {_RAW} FROM px WHERE v > 0 GROUP BY image), {_CENTRAL} SELECT image, {', '.join(_r(c, c, 4) for c in (*RAW_MOMENTS, *_US))} FROM cm")
def moments_mask(spark, sf):
    mask = T.gray(spark, sf).withColumn("v", (F.col("v") > 40).cast("int"))
    return rounded(D.central_moments(D.raw_moments(mask, ["image"])).drop("c"), ["image"], 4)


@query("moments_multichannel", f"""WITH {T.MULTI_SQL}, m AS (SELECT image, c, {_RAW} FROM px WHERE v > 0 GROUP BY image, c), {_CENTRAL}, {_HU},
k AS (SELECT DISTINCT image, c FROM px)
SELECT image, {', '.join(_r(f"avg(coalesce({c}, 0e0))", f"moments_{c}", 4) for c in (*RAW_MOMENTS, *_US, *_IS))} FROM k LEFT JOIN hu USING (image, c) GROUP BY image""")  # fmt: skip
def moments_multichannel(spark, sf):
    return rounded(D.moments(T.multi(spark, sf), ["image"]), ["image"], 4)


# --- texture ----------------------------------------------------------------

_GLCM = """lim AS (SELECT image, c, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM px GROUP BY image, c),
lv AS (SELECT image, c, x, y, CAST(coalesce(floor((v - lo) / nullif(hi - lo, 0e0) * 63 + 0.5e0), 0) AS INTEGER) AS g FROM px JOIN lim USING (image, c)),
o AS (SELECT * FROM (VALUES (0, 1, 0), (45, 1, 1), (90, 0, 1), (135, -1, 1)) t(angle, dx, dy)),
pr AS (SELECT a.image, a.c, o.angle, a.g AS i, b.g AS j FROM lv a, o, lv b WHERE b.image = a.image AND b.c = a.c AND b.x = a.x + o.dx AND b.y = a.y + o.dy),
both_ AS (SELECT * FROM pr UNION ALL SELECT image, c, angle, j, i FROM pr),
cn AS (SELECT image, c, angle, i, j, count(*) AS n FROM both_ GROUP BY ALL),
cell AS (SELECT *, n / CAST(t AS DOUBLE) AS p FROM (SELECT *, sum(n) OVER (PARTITION BY image, c, angle) AS t FROM cn))"""
#: Polynomials over whole counts, so nothing depends on the order of a sum.
_SPREAD = "CAST(sum((i + 1) * (i + 1) * n) * max(t) - sum((i + 1) * n) * sum((i + 1) * n) AS DOUBLE)"
_HARALICK = f"""mg AS (SELECT image, c, angle, i, sum(p) AS px FROM cell GROUP BY ALL),
sx AS (SELECT image, c, angle, -sum(px * log2(px + {EPS})) AS hx FROM mg GROUP BY ALL),
mn AS (SELECT image, c, angle, sum(p * p) AS energy, CAST(sum((i - j) * (i - j) * n) AS DOUBLE) / max(t) AS contrast, CAST(sum((i + 1) * (j + 1) * n) * max(t) - sum((i + 1) * n) * sum((i + 1) * n) AS DOUBLE) / nullif({_SPREAD}, 0e0) AS correlation,
  {_SPREAD} / CAST(max(t) * max(t) AS DOUBLE) AS sum_of_squares, sum(p / (1 + (i - j) * (i - j))) AS inverse_difference_moment, -sum(p * log2(p + {EPS})) AS entropy, max(hx) AS hx FROM cell JOIN sx USING (image, c, angle) GROUP BY ALL),
pl AS (SELECT image, c, angle, i + j AS k, sum(p) AS q, sum(n) AS m, max(t) AS t FROM cell GROUP BY ALL),
sp AS (SELECT image, c, angle, CAST(sum(k * m) AS DOUBLE) / max(t) AS sum_average, CAST(sum(k * k * m) * max(t) - sum(k * m) * sum(k * m) AS DOUBLE) / CAST(max(t) * max(t) AS DOUBLE) AS sum_variance, -sum(q * log2(q + CASE WHEN q <= {EPS} THEN 1e0 ELSE 0e0 END)) AS sum_entropy FROM pl GROUP BY ALL),
mi AS (SELECT image, c, angle, abs(i - j) AS k, sum(p) AS q FROM cell GROUP BY ALL),
sd AS (SELECT image, c, angle, (sum(q * q) - sum(q) * sum(q) / 64) / 64 AS difference_variance, -sum(q * log2(q + {EPS})) AS difference_entropy FROM mi GROUP BY ALL),
xx AS (SELECT image, c, angle, sum(a.px * b.px * log2(a.px * b.px + {EPS})) AS hxy2 FROM mg a JOIN mg b USING (image, c, angle) GROUP BY ALL),
hk AS (SELECT *, (hxy2 + entropy) / nullif(hx, 0e0) AS infocorr1, sqrt(greatest(0e0, 1 - exp(-2 * (-entropy - hxy2)))) AS infocorr2 FROM mn JOIN sp USING (image, c, angle) JOIN sd USING (image, c, angle) JOIN xx USING (image, c, angle))"""
for _angle in (0, 45, 90, 135):
    query(f"glcm_{_angle}", f"WITH {T.GRAY_SQL}, {_GLCM} SELECT image, i, j, {_r('p', 'p')} FROM cell WHERE angle = {_angle}")(
        lambda spark, sf, a=_angle: rounded(D.glcm(T.gray(spark, sf), ["image"], (a,)).select("image", "i", "j", "p"), ["image", "i", "j"])
    )


@query("texture_all", f"WITH {T.GRAY_SQL}, {_GLCM}, {_HARALICK} SELECT image, {', '.join(_r(f'avg({t[8:]})', t, 5) for t in TEXTURE)} FROM hk GROUP BY image")
def texture_all(spark, sf):
    return rounded(D.texture(T.gray(spark, sf), ["image"]), ["image"], 5)


@query("texture_multichannel", f"WITH {T.MULTI_SQL}, {_GLCM}, {_HARALICK} SELECT image, {', '.join(_r(f'avg({t[8:]}) + 1e-9', t, 5) for t in TEXTURE)} FROM hk GROUP BY image")
def texture_multichannel(spark, sf):
    # many values are dyadic fractions: the addend keeps ties of the rounding from falling either way
    t = D.texture(T.multi(spark, sf), ["image"], defined_only=True)
    return rounded(t.select("image", *((F.col(c) + 1e-9).alias(c) for c in TEXTURE)), ["image"], 5)


@query("texture_multichannel_nan", f"WITH {T.MULTI_SQL}, {_GLCM}, {_HARALICK} SELECT image, {', '.join(_r(f"avg(coalesce({t[8:]}, 'NaN'::DOUBLE)) + 1e-9", t, 5) for t in TEXTURE)} FROM hk GROUP BY image")
def texture_multichannel_nan(spark, sf):
    """As the kernels: a channel of one level has no correlation, and so has its image (Q5)."""
    t = D.texture(T.multi(spark, sf), ["image"])
    return rounded(t.select("image", *((F.col(c) + 1e-9).alias(c) for c in TEXTURE)), ["image"], 5)


for _t in TEXTURE:
    query(_t, f"WITH {T.GRAY_SQL}, {_GLCM}, {_HARALICK} SELECT image, angle, {_r(_t[8:], 'value', 5)} FROM hk")(
        lambda spark, sf, t=_t[8:]: rounded(D.haralick(D.glcm(T.gray(spark, sf), ["image"]), ["image", "c", "angle"]).select("image", "angle", F.col(t).alias("value")), ["image", "angle"], 5)
    )


# --- Zernike ----------------------------------------------------------------


def _zernike_sql(pixels: str, width: int | str, height: int | str) -> str:
    def radial(n: int, m: int) -> str:
        return " + ".join(f"({float(c)!r}) * pow(r, {k})" for c, k in D.radial_terms(n, m))

    sums = ", ".join(f"sum(CASE WHEN r <= 1 THEN v * ({radial(n, m)}) * {f}({m} * t) ELSE 0e0 END) AS {name}{n}{m}" for n, m in ZERNIKE_ORDERS for name, f in (("re", "cos"), ("im", "sin")))
    out = ", ".join(_r(f"avg(coalesce({n + 1} / {math.pi!r} * sqrt(pow(re{n}{m}, 2) + pow(im{n}{m}, 2)) / nullif(abs(mass), 0e0), 0e0))", f"zernike_{n}{m}", 5) for n, m in ZERNIKE_ORDERS)
    half = lambda n: f"({n} / 2e0)" if isinstance(n, str) else f"{n / 2}"
    return f"""WITH {pixels}, xy AS (SELECT image, c, CAST(v AS DOUBLE) AS v, (x - {half(width)}) / {half(width)} AS px, (y - {half(height)}) / {half(height)} AS py FROM px),
pl AS (SELECT image, c, v, sqrt(px * px + py * py) AS r, atan2(py, px) AS t FROM xy),
z AS (SELECT image, c, sum(CASE WHEN r <= 1 THEN v ELSE 0e0 END) AS mass, {sums} FROM pl GROUP BY image, c)
SELECT image, {out} FROM z GROUP BY image"""


@query("zernike_30", _zernike_sql(T.GRAY_SQL, 8, 8))
def zernike_30(spark, sf):
    return rounded(D.zernike(T.gray(spark, sf), ["image"], 8, 8), ["image"], 5)


@query("zernike_multichannel", _zernike_sql(T.MULTI_SQL, 4, 4))
def zernike_multichannel(spark, sf):
    return rounded(D.zernike(T.multi(spark, sf), ["image"], 4, 4), ["image"], 5)


# --- polygons ---------------------------------------------------------------

_SIGNED = "sum(x0 * y1 - x1 * y0) / 2"


def _poly(columns: Callable[[Column], dict[str, Column]]):
    return lambda spark, sf: rounded(T.polygons(spark, sf).select("object", *(c.alias(k) for k, c in columns(F.col("poly")).items())), ["object"])


@query("polygon_order", f"{_P} SELECT object, CAST(k AS INTEGER) AS k, x, y FROM ring")
def polygon_order(spark, sf):
    at = T.polygons(spark, sf).select("object", F.posexplode("poly").alias("k", "q"))
    return at.select("object", (F.col("k") + 1).alias("k"), "q.x", "q.y")


@query("polygon_dedup", "SELECT user_id AS object, CAST(count(DISTINCT (event_id % 24, floor(value))) AS INTEGER) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def polygon_dedup(spark, sf):
    point = F.struct(F.pmod("event_id", F.lit(24)).alias("x"), F.floor("value").alias("y"))
    raw = T.read(spark, sf, "events").where("value is not null").groupBy(F.col("user_id").alias("object")).agg(F.collect_list(point).alias("p"))
    return raw.select("object", F.size(G.dedup_points(F.col("p"))).alias("n"))


query("polygon_bbox", f"{_P} SELECT object, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM ring GROUP BY object")(_poly(lambda p: {c: G.bounding_box(p)[c] for c in ("x_min", "y_min", "x_max", "y_max")}))
query("form_area", f"{_P} SELECT object, {_r(f'abs({_SIGNED})', 'form_area')} FROM edge GROUP BY object")(_poly(lambda p: {"form_area": G.area(p)}))
query("form_perimeter", f"{_P} SELECT object, {_r('sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)))', 'form_perimeter')} FROM edge GROUP BY object")(_poly(lambda p: {"form_perimeter": G.perimeter(p)}))
for _name, _divisor in (("form_centroid", _SIGNED), ("form_centroid_compat", f"abs({_SIGNED})")):
    query(_name, f"""{_P} SELECT object, {', '.join(_r(f'sum(({a}0 + {a}1) * (x0 * y1 - x1 * y0)) / (6 * nullif({_divisor}, 0e0))', f'form_centroid_{a}') for a in 'xy')} FROM edge GROUP BY object""")(
        _poly(lambda p, compat=_name.endswith("compat"): dict(zip(("form_centroid_x", "form_centroid_y"), G.centroid(p, compat), strict=True)))
    )
query("form_center", f"{_P} SELECT object, {_r('avg(x)', 'form_center_x')}, {_r('avg(y)', 'form_center_y')} FROM ring GROUP BY object")(_poly(lambda p: dict(zip(("form_center_x", "form_center_y"), G.mean_point(p), strict=True))))
query("form_max_feret", f"{_P} SELECT a.object, {_r('sqrt(max(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)))', 'form_max_feret')} FROM ring a JOIN ring b USING (object) GROUP BY a.object")(_poly(lambda p: {"form_max_feret": G.max_feret(p)}))
query("form_min_feret", f"""{_P}, wd AS (SELECT e.object, e.k, max(abs((x1 - x0) * (p.y - y0) - (y1 - y0) * (p.x - x0))) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS w FROM edge e JOIN ring p ON p.object = e.object GROUP BY e.object, e.k, x0, y0, x1, y1)
SELECT object, {_r(f'coalesce(min(w) FILTER (w > {EPS}), 0e0)', 'form_min_feret')} FROM wd GROUP BY object""")(_poly(lambda p: {"form_min_feret": G.min_feret(p)}))  # fmt: skip

_SIMPLE = {
    "form_area_bbox": "w * h",
    "form_elongation": "least(w, h) / nullif(greatest(w, h), 0e0)",
    "form_thread_length": "(l + sqrt(greatest(l * l - 16 * a, 0e0))) / 4",
    "form_thread_width": "a / nullif((l + sqrt(greatest(l * l - 16 * a, 0e0))) / 4, 0e0)",
    "form_extent": "a / nullif(w * h, 0e0)",
    "form_form_factor": f"4 * {math.pi!r} * a / nullif(l * l, 0e0)",
    "form_equivalent_diameter": f"2 * sqrt(a / {math.pi!r})",
}
_BASE = f"{_P}, b AS (SELECT object, abs({_SIGNED}) AS a, sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) AS l, max(x0) - min(x0) AS w, max(y0) - min(y0) AS h FROM edge GROUP BY object)"
for _name, _sql in _SIMPLE.items():
    query(_name, f"{_BASE} SELECT object, {_r(_sql, _name)} FROM b")(lambda spark, sf, n=_name: rounded(G.form_simple(T.polygons(spark, sf)).select("object", n), ["object"]))


@query("form_radii", f"""{_P}, ct AS (SELECT object, sum((x0 + x1) * (x0 * y1 - x1 * y0)) / (6 * nullif({_SIGNED}, 0e0)) AS cx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / (6 * nullif({_SIGNED}, 0e0)) AS cy FROM edge GROUP BY object),
dd AS (SELECT e.object, sqrt(pow(x0 - cx, 2) + pow(y0 - cy, 2)) AS far, cx, cy, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM edge e JOIN ct USING (object)),
tt AS (SELECT *, least(1e0, greatest(0e0, ((cx - x0) * dx + (cy - y0) * dy) / (dx * dx + dy * dy))) AS t FROM dd)
SELECT object, {_r('min(sqrt(pow(cx - x0 - t * dx, 2) + pow(cy - y0 - t * dy, 2)))', 'form_minimum_radius', 5)}, {_r('max(far)', 'form_maximum_radius', 5)}, {_r('avg(far)', 'form_mean_radius', 5)} FROM tt WHERE cx IS NOT NULL GROUP BY object""")  # fmt: skip
def form_radii(spark, sf):
    out = G.form_simple(T.polygons(spark, sf)).where("form_centroid_x is not null")
    return rounded(out.select("object", "form_minimum_radius", "form_maximum_radius", "form_mean_radius"), ["object"], 5)


#: Hull edges: all points on one side, and those on their line between the two ends.
_HULL = """hedge AS MATERIALIZED (SELECT a.object, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM ring a JOIN ring b ON a.object = b.object AND (a.x, a.y) <> (b.x, b.y) JOIN ring c ON c.object = a.object
  GROUP BY ALL HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0))),
hull AS MATERIALIZED (SELECT object, abs(sum(x0 * y1 - x1 * y0)) / 2 AS convex FROM hedge GROUP BY object)"""


def _ellipse_sql() -> str:
    """Tables conic (object, unit, a, b, c, d, e) and ell (object, major, minor, ecc) of the rings."""
    powers = ((2, 0), (1, 1), (0, 2), (1, 0), (0, 1))
    monomial = lambda i, j: " * ".join(["1e0", *["x"] * i, *["y"] * j])
    start = ", ".join(f"sum({monomial(a[0] + b[0], a[1] + b[1])}) AS m{i}{j}" for i, a in enumerate(powers) for j, b in enumerate((*powers, (0, 0))))
    steps = []
    for k in range(5):
        cell = lambda i, j: f"m{k}{j} / m{k}{k}" if i == k else f"m{i}{j} - m{i}{k} * m{k}{j} / m{k}{k}"  # noqa: B023, E731
        steps.append(f"g{k + 1} AS (SELECT object, unit, {', '.join(f'{cell(i, j)} AS m{i}{j}' for i in range(5) for j in range(6))} FROM (SELECT * REPLACE (CASE WHEN m{k}{k} > {G.SINGULAR} THEN m{k}{k} END AS m{k}{k}) FROM g{k}))")
    return f"""seg AS MATERIALIZED (SELECT *, sum(d) OVER (PARTITION BY object ORDER BY k) AS hi FROM (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS d FROM edge)),
spans AS (SELECT object, max(hi) AS total, max(n) AS n FROM seg GROUP BY object),
laid AS (SELECT s.object, i, i * total / 31 AS pos, arg_min(k, k) AS k FROM spans s, range(32) t(i), seg g WHERE g.object = s.object AND s.n < 31 AND (i * total / 31 <= hi OR k = s.n) GROUP BY ALL),
pts AS MATERIALIZED (SELECT l.object, i, x0 + greatest(0, least(1e0, coalesce((pos - hi + d) / nullif(d, 0e0), 0e0))) * (x1 - x0) AS x, y0 + greatest(0, least(1e0, coalesce((pos - hi + d) / nullif(d, 0e0), 0e0))) * (y1 - y0) AS y FROM laid l JOIN seg g USING (object, k)
  UNION ALL SELECT object, k - 1, x0, y0 FROM edge WHERE n >= 31 UNION ALL SELECT object, n, x1, y1 FROM edge WHERE n >= 31 AND k = n),
mean_ AS (SELECT object, avg(x) AS mx, avg(y) AS my FROM pts WHERE i > 0 GROUP BY object),
far AS (SELECT object, max(greatest(abs(x - mx), abs(y - my))) AS unit FROM pts JOIN mean_ USING (object) GROUP BY object),
g0 AS (SELECT object, max(unit) AS unit, {start} FROM (SELECT object, unit, (x - mx) / unit AS x, (y - my) / unit AS y FROM pts JOIN mean_ USING (object) JOIN far USING (object)) GROUP BY object),
{', '.join(steps)},
conic AS (SELECT object, unit, m05 AS a, m15 AS b, m25 AS c, m35 AS d, m45 AS e, nullif(4 * m05 * m25 - m15 * m15, 0e0) AS det FROM g5),
lev AS (SELECT *, 1 + a * x * x + b * x * y + c * y * y + d * x + e * y AS level, sqrt((a - c) * (a - c) + b * b) AS f FROM (SELECT *, (b * e - 2 * c * d) / det AS x, (b * d - 2 * a * e) / det AS y FROM conic)),
ax AS (SELECT object, unit, greatest(p, q) AS big, least(p, q) AS small FROM (SELECT *, (level - d * x - e * y) / nullif((a + c - f) / 2, 0e0) AS p, (level - d * x - e * y) / nullif((a + c + f) / 2, 0e0) AS q FROM lev)),
ell AS MATERIALIZED (SELECT object, 2 * unit * sqrt(big) AS major, 2 * unit * sqrt(small) AS minor, sqrt(1 - small / big) AS ecc FROM ax WHERE small > 0)"""


_ELLIPSE = _ellipse_sql()


@query("convex_hull", f"{_P}, {_HULL} SELECT object, x0 AS x, y0 AS y FROM hedge")
def convex_hull(spark, sf):
    return T.polygons(spark, sf).select("object", F.inline(G.convex_hull(F.col("poly"))))


@query("form_hull", f"{_BASE}, {_HULL} SELECT object, {_r('coalesce(convex, 0e0)', 'form_area_convex')}, {_r('a / nullif(convex, 0e0)', 'form_solidity')} FROM b LEFT JOIN hull USING (object)")
def form_hull(spark, sf):
    return rounded(G.form(T.polygons(spark, sf)).select("object", "form_area_convex", "form_solidity"), ["object"])


@query("ring_resampled", f"WITH {T.SMALL_SQL}, {_ELLIPSE} SELECT object, CAST(i AS INTEGER) AS i, {_r('x', 'x')}, {_r('y', 'y')} FROM pts JOIN spans USING (object) WHERE n < 31")
def ring_resampled(spark, sf):
    few = T.small_polygons(spark, sf).where(F.size("poly") < 31).select("object", F.posexplode(G.resample(F.col("poly"), 32)).alias("i", "q"))
    return rounded(few.select("object", "i", "q.x", "q.y"), ["object", "i"])


@query("form_ellipse", f"{_P}, {_ELLIPSE} SELECT object, {_r('major', 'form_major_axis', 4)}, {_r('minor', 'form_minor_axis', 4)}, {_r('ecc', 'form_eccentricity', 4)} FROM spans LEFT JOIN ell USING (object)")
def form_ellipse(spark, sf):
    e = G.ellipse(F.col("poly"))
    out = G.settled(T.polygons(spark, sf), {"e": e}).select("object", F.col("e.major").alias("form_major_axis"), F.col("e.minor").alias("form_minor_axis"), F.col("e.eccentricity").alias("form_eccentricity"))
    return rounded(out, ["object"], 4)


@query("form_ellipse_resampled", f"WITH {T.SMALL_SQL}, {_ELLIPSE} SELECT object, {_r('major', 'form_major_axis', 3)}, {_r('minor', 'form_minor_axis', 3)}, {_r('ecc', 'form_eccentricity', 3)} FROM spans LEFT JOIN ell USING (object)")
def form_ellipse_resampled(spark, sf):
    """Rings of few points: the conic is fitted to 32 points along them."""
    e = G.ellipse(F.col("poly"))
    out = G.settled(T.small_polygons(spark, sf), {"e": e}).select("object", F.col("e.major").alias("form_major_axis"), F.col("e.minor").alias("form_minor_axis"), F.col("e.eccentricity").alias("form_eccentricity"))
    return rounded(out, ["object"], 3)


_RADII = ORACLE_SQL["form_radii"].split("ct AS", 1)[1].split("SELECT object, round", 1)[0]
_FORM_TABLES = f"""{_HULL}, {_ELLIPSE}, ct AS{_RADII},
rd AS (SELECT object, any_value(cx) AS cx, any_value(cy) AS cy, min(sqrt(pow(cx - x0 - t * dx, 2) + pow(cy - y0 - t * dy, 2))) AS r0, max(far) AS r1, avg(far) AS r2 FROM tt GROUP BY object),
mp AS (SELECT object, avg(x) AS px, avg(y) AS py FROM ring GROUP BY object),
f1 AS (SELECT a.object, sqrt(max(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS most FROM ring a JOIN ring b USING (object) GROUP BY a.object),
wd AS (SELECT e.object, e.k, max(abs((x1 - x0) * (p.y - y0) - (y1 - y0) * (p.x - x0))) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS w FROM edge e JOIN ring p ON p.object = e.object GROUP BY e.object, e.k, x0, y0, x1, y1),
f0 AS (SELECT object, coalesce(min(w) FILTER (w > {EPS}), 0e0) AS least_ FROM wd GROUP BY object)"""
_FORM_COLUMNS = {
    "form_centroid_x": "cx", "form_centroid_y": "cy", "form_center_x": "px", "form_center_y": "py", "form_area": "a", "form_area_convex": "coalesce(convex, 0e0)", "form_perimeter": "l", "form_solidity": "a / nullif(convex, 0e0)",
    "form_eccentricity": "ecc", "form_major_axis": "major", "form_minor_axis": "minor", "form_minimum_radius": "r0", "form_maximum_radius": "r1", "form_mean_radius": "r2", "form_min_feret": "least_", "form_max_feret": "most", **_SIMPLE,
}
_FORM_FROM = "b JOIN mp USING (object) JOIN rd USING (object) JOIN f0 USING (object) JOIN f1 USING (object) LEFT JOIN hull USING (object) LEFT JOIN ell USING (object)"


@query("form_descriptors", f"{_BASE}, {_FORM_TABLES} SELECT object, {', '.join(_r(e, c, 4) for c, e in _FORM_COLUMNS.items())} FROM {_FORM_FROM}")
def form_descriptors(spark, sf):
    """All 23 of every polygon, hull and ellipse included, as expressions."""
    return rounded(G.form(T.polygons(spark, sf)).select("object", *FORM), ["object"], 4)


# --- boxes, listings, JSON --------------------------------------------------


@query("boxes_xywh", f"WITH {T.BOX_SQL} SELECT object, x_min AS x, y_min AS y, x_max - x_min AS w, y_max - y_min AS h FROM box")
def boxes_xywh(spark, sf):
    return T.boxes(spark, sf).select("object", G.xywh(F.col("bbox")).alias("b")).select("object", "b.*")


@query("box_descriptors", f"WITH {T.BOX_SQL} SELECT object, x_max - x_min AS bbox_width, y_max - y_min AS bbox_height, (x_max - x_min) * (y_max - y_min) AS bbox_area FROM box")
def box_descriptors(spark, sf):
    return T.boxes(spark, sf).select("object", *(c.alias(k) for k, c in G.box_descriptors(F.col("bbox")).items()))


for _compat in (False, True):
    _last = 0 if _compat else 1
    _edge = "x_min - 1 <= 0 OR y_min - 1 <= 0 OR x_max + 1 >= 8 OR y_max + 1 >= 52" if _compat else "x_min <= 0 OR y_min <= 0 OR x_max >= 7 OR y_max >= 51"
    query(
        "box_filter_pad_border" + "_compat" * _compat,
        f"""WITH {T.BOX_SQL}, cr AS (SELECT object, CAST(greatest(x_min - 1, 0) AS INTEGER) AS x, CAST(greatest(y_min - 1, 0) AS INTEGER) AS y, CAST(least(x_max + {1 + _last}, 8) AS INTEGER) AS bx, CAST(least(y_max + {1 + _last}, 52) AS INTEGER) AS by_ FROM box WHERE NOT ({_edge}))
SELECT object, x, y, bx - x AS w, by_ - y AS h FROM cr WHERE bx - x >= 3 AND by_ - y >= 3""",
    )(lambda spark, sf, c=_compat: G.object_crops(T.boxes(spark, sf).select("object", "bbox", F.lit(8).alias("width"), F.lit(52).alias("height")), pad=1, min_size=3, compat=c).select("object", "crop.*"))

_LIST = "f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'in/img_' || doc_id || '_image.png' WHEN 1 THEN 'in/img_' || doc_id || '_image.TIF' WHEN 2 THEN 'in/notes_' || doc_id || '.txt' ELSE 'in/img_' || doc_id || '.npy' END AS path FROM documents)"


def _files(spark, sf):
    d = F.col("doc_id")
    path = F.when(d % 4 == 0, F.concat(F.lit("in/img_"), d, F.lit("_image.png"))).when(d % 4 == 1, F.concat(F.lit("in/img_"), d, F.lit("_image.TIF"))).when(d % 4 == 2, F.concat(F.lit("in/notes_"), d, F.lit(".txt"))).otherwise(F.concat(F.lit("in/img_"), d, F.lit(".npy")))
    return T.read(spark, sf, "documents").select(path.alias("path"))


@query("list_files_filter", f"WITH {_LIST} SELECT path, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS ext FROM f WHERE lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ({', '.join(f"'{x}'" for x in IMAGE_FORMATS)}) AND path LIKE '%image%'")
def list_files_filter(spark, sf):
    return P.listed(_files(spark, sf), substring="image").select("path", "stem", "ext")


_MASKS = "g AS (SELECT 'masks/img_' || doc_id || '_mask.png' AS path FROM documents)"
_KEYED = f"""WITH {_LIST}, {_MASKS}, a AS (SELECT replace(regexp_extract(path, '([^/]*)\\.[^.]*$', 1), '_image', '') AS key, max(path) AS path_a FROM f WHERE path NOT LIKE '%.txt' GROUP BY 1),
b AS (SELECT replace(regexp_extract(path, '([^/]*)\\.[^.]*$', 1), '_mask', '') AS key, path AS path_b FROM g)"""


def _masks(spark, sf):
    d = T.read(spark, sf, "documents")
    return P.listed(d.select(F.concat(F.lit("masks/img_"), "doc_id", F.lit("_mask.png")).alias("path")))


@query("pair_files", f"{_KEYED} SELECT key, path_a, path_b FROM a JOIN b USING (key)")
def pair_files(spark, sf):
    return P.pair_files(P.listed(_files(spark, sf)), _masks(spark, sf), "_image", "_mask")


@query("unpaired_files", f"{_KEYED} SELECT key, path_b AS path FROM b ANTI JOIN a USING (key)")
def unpaired_files(spark, sf):
    return P.unpaired_files(_masks(spark, sf), P.listed(_files(spark, sf)), "_mask", "_image").select("key", "path")


@query("pairs_ordered", f"{_KEYED} SELECT key, path_a, path_b, row_number() OVER (ORDER BY key, path_a, path_b) - 1 AS row FROM a JOIN b USING (key)")
def pairs_ordered(spark, sf):
    """Pairs in one total order, without a window over one partition."""
    return P.ordered_pairs(pair_files(spark, sf))


@query("objects_ordered", f"WITH {T.GRAY_SQL}, o AS (SELECT image, CAST(v // 40 AS BIGINT) AS object, count(*) AS n FROM px WHERE v // 40 > 0 GROUP BY ALL) SELECT image, object, n, row_number() OVER (ORDER BY image, object) - 1 AS row FROM o")
def objects_ordered(spark, sf):
    at = T.gray(spark, sf).withColumn("object", F.floor(F.col("v") / 40)).where("object > 0")
    return P.ordered_objects(at.groupBy("image", "object").agg(F.count("*").alias("n")))


@query("json_polygons_parse", "SELECT user_id AS object, count(*) AS n, sum(event_id % 24) AS sx, CAST(sum(floor(value)) AS BIGINT) AS sy FROM events WHERE value IS NOT NULL GROUP BY 1")
def json_polygons_parse(spark, sf):
    point = F.array(F.pmod("event_id", F.lit(24)).cast("double"), F.floor("value").cast("double"))
    key = F.element_at(F.array(*map(F.lit, POLYGON_KEYS)), (F.pmod("user_id", F.lit(len(POLYGON_KEYS))) + 1).cast("int"))
    text = T.read(spark, sf, "events").where("value is not null").groupBy("user_id").agg(F.collect_list(point).alias("p"))
    text = text.select(F.col("user_id").alias("object"), F.to_json(F.create_map(key, F.array("p"))).alias("text"))
    out = text.select("object", F.explode(G.parse_polygons(F.col("text"), POLYGON_KEYS)).alias("p")).select("object", F.explode("p").alias("q"))
    return out.groupBy("object").agg(F.count("*").alias("n"), F.sum(F.col("q.x").cast("long")).alias("sx"), F.sum(F.col("q.y").cast("long")).alias("sy"))


@query("json_boxes_parse", f"WITH {T.BOX_SQL} SELECT object, x_min, y_min, x_max, y_max FROM box")
def json_boxes_parse(spark, sf):
    key = F.element_at(F.array(*map(F.lit, BOX_KEYS)), (F.pmod("object", F.lit(len(BOX_KEYS))) + 1).cast("int"))
    b = F.col("bbox")
    text = T.boxes(spark, sf).select("object", F.to_json(F.create_map(key, F.array(F.array(b["x_min"], b["y_min"], b["x_max"], b["y_max"])))).alias("text"))
    return text.select("object", F.explode(G.parse_boxes(F.col("text"), BOX_KEYS)).alias("b")).select("object", "b.*")


@query("object_counts", f"WITH {T.GRAY_SQL} SELECT image, count(DISTINCT CASE WHEN v // 40 > 0 THEN v // 40 END) AS n FROM px GROUP BY image")
def object_counts(spark, sf):
    label = F.floor(F.col("v") / 40)
    return T.gray(spark, sf).groupBy("image").agg(F.countDistinct(F.when(label > 0, label)).alias("n"))


@query("mask_to_boxes", f"WITH {T.GRAY_SQL} SELECT image, CAST(v // 40 AS BIGINT) AS label, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM px WHERE v // 40 > 0 GROUP BY ALL")
def mask_to_boxes(spark, sf):
    at = T.gray(spark, sf).withColumn("label", F.floor(F.col("v") / 40)).where("label > 0")
    return at.groupBy("image", "label").agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))


@query("unpivot_measure", f"WITH {T.GRAY_SQL}, s AS (SELECT image, min(v) AS lo, max(v) AS hi FROM px GROUP BY image) SELECT image, name, CAST(value AS INTEGER) AS value FROM (UNPIVOT s ON lo, hi INTO NAME name VALUE value)")
def unpivot_measure(spark, sf):
    s = T.gray(spark, sf).groupBy("image").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return s.unpivot(["image"], ["lo", "hi"], "name", "value")


# --- array kernels ----------------------------------------------------------


def _mask_images(spark, sf, threshold: int = 40) -> DataFrame:
    from .verbs import image_of

    on = lambda v: (v > threshold).cast("int")
    return T.gray_images(spark, sf).select(F.col("image").cast("string").alias("image"), image_of(F.transform("pixels", on), 8, 8).alias("im"))


def _gray_structs(spark, sf) -> DataFrame:
    from .verbs import image_of

    return T.gray_images(spark, sf).select(F.col("image").cast("string").alias("image"), image_of(F.transform("pixels", lambda v: F.least(v, F.lit(255))), 8, 8).alias("im"))


@query("mask_relabel_cc", f"""WITH RECURSIVE {T.GRAY_SQL}, on_ AS MATERIALIZED (SELECT image, x, y, y * 8 + x AS k FROM px WHERE v > 40),
nb AS MATERIALIZED (SELECT a.image, a.k, b.k AS l FROM on_ a JOIN on_ b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT image, k, l FROM nb UNION SELECT r.image, r.k, n.l FROM reach r JOIN nb n ON n.image = r.image AND n.k = r.l)
SELECT CAST(image AS VARCHAR) AS image, k, min(l) AS component FROM reach GROUP BY image, k""")  # fmt: skip
def mask_relabel_cc(spark, sf):
    out = mask_components(spark, sf)
    return out.withColumn("image", F.col("image").cast("string"))


# --- regions ----------------------------------------------------------------

_ON = """on_ AS MATERIALIZED (SELECT image, x, y, {k} AS k FROM px WHERE v > 40),
nb AS MATERIALIZED (SELECT a.image, a.k, b.k AS l FROM on_ a JOIN on_ b ON a.image = b.image AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y IN (a.y - 1, a.y, a.y + 1)),
reach AS (SELECT image, k, l FROM nb UNION SELECT r.image, r.k, n.l FROM reach r JOIN nb n ON n.image = r.image AND n.k = r.l),
root AS MATERIALIZED (SELECT image, k, min(l) AS root FROM reach GROUP BY image, k)"""


@query("mask_components", f"WITH RECURSIVE {T.GRAY_SQL}, {_ON.format(k='y * 8 + x')} SELECT image, k, root AS component FROM root")
def mask_components(spark, sf):
    """Components by runs and interval joins, all images at once."""
    found = R.pixels_of(R.components(T.on_pixels(spark, sf), ["image"]))
    return found.select("image", (F.col("y") * 8 + F.col("x")).cast("int").alias("k"), R.from_place("root", 8).cast("int").alias("component"))


@query("mosaic_components", f"WITH RECURSIVE {T.MOSAIC_SQL}, {_ON.format(k='y * 200 + x')} SELECT k, root AS component, dense_rank() OVER (ORDER BY root) AS label FROM root")
def mosaic_components(spark, sf):
    """Components of one image of all: its runs are dealt by row and tile, no task holds it."""
    on = T.mosaic(spark, sf).where("v > 40").select("image", "x", "y")
    found = R.pixels_of(R.numbered_components(R.components(on, ["image"]), ["image"]))
    return found.select((F.col("y") * 200 + F.col("x")).alias("k"), R.from_place("root", 200).alias("component"), "label")


_AROUND = ", ".join(f"({d}, {dx}, {dy})" for d, (dx, dy) in enumerate(R.AROUND))


@query("mask_contours", f"""WITH RECURSIVE {T.GRAY_SQL}, {_ON.format(k='y * 8 + x')},
dir AS (SELECT * FROM (VALUES {_AROUND}) t(d, dx, dy)),
to_ AS MATERIALIZED (SELECT a.image, a.k, d, b.k AS l FROM on_ a, dir, on_ b WHERE b.image = a.image AND b.x = a.x + dx AND b.y = a.y + dy),
succ AS MATERIALIZED (SELECT a.image, a.k, a.d AS back, arg_min(b.l, (a.d - b.d + 7) % 8) AS nk, (arg_min(b.d, (a.d - b.d + 7) % 8) + 4) % 8 AS nd FROM to_ a JOIN to_ b ON a.image = b.image AND a.k = b.k GROUP BY a.image, a.k, a.d),
start AS MATERIALIZED (SELECT r.image, r.root, min(d) AS d FROM (SELECT DISTINCT image, root FROM root) r LEFT JOIN to_ ON to_.image = r.image AND to_.k = r.root GROUP BY r.image, r.root),
walk AS (SELECT image, root, 0 AS step, root AS k, d FROM start
  UNION ALL SELECT w.image, w.root, step + 1, s.nk, s.nd FROM walk w JOIN succ s ON s.image = w.image AND s.k = w.k AND s.back = w.d JOIN start a ON a.image = w.image AND a.root = w.root WHERE NOT (s.nk = a.root AND s.nd = a.d))
SELECT image, root, step, CAST(k % 8 AS INTEGER) AS x, CAST(k // 8 AS INTEGER) AS y FROM walk""")  # fmt: skip
def mask_contours(spark, sf):
    """Outer contours of all components, points in order, by list ranking."""
    points = R.contours(R.kept(R.components(T.on_pixels(spark, sf), ["image"]), "components"), ["image"])
    return points.select("image", R.from_place("root", 8).cast("int").alias("root"), F.col("k").cast("int").alias("step"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


#: Pixels (object, x, y) of rings ``edge`` cut to whole numbers, on a canvas of w by h.
_FILLED = """ed AS MATERIALIZED (SELECT object, CAST(trunc(x0) AS BIGINT) AS x0, CAST(trunc(y0) AS BIGINT) AS y0, CAST(trunc(x1) AS BIGINT) AS x1, CAST(trunc(y1) AS BIGINT) AS y1 FROM edge),
cross_ AS (SELECT object, y, ceil(x0 + (y - y0) / CAST(y1 - y0 AS DOUBLE) * (x1 - x0)) AS x FROM (SELECT *, unnest(range(least(y0, y1), greatest(y0, y1))) AS y FROM ed)),
span_ AS (SELECT object, y, CAST(x AS BIGINT) AS a, CAST(lead(x) OVER l AS BIGINT) AS b, row_number() OVER l AS n FROM cross_ WINDOW l AS (PARTITION BY object, y ORDER BY x)),
line_ AS (SELECT object, floor(x0 + t / CAST(s AS DOUBLE) * (x1 - x0) + 0.5) AS x, floor(y0 + t / CAST(s AS DOUBLE) * (y1 - y0) + 0.5) AS y FROM (SELECT *, unnest(range(s + 1)) AS t FROM (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0), 1) AS s FROM ed))),
fill_ AS MATERIALIZED (SELECT object, x, y FROM (SELECT object, unnest(range(a, b)) AS x, y FROM span_ WHERE n % 2 = 1 UNION SELECT object, CAST(x AS BIGINT), CAST(y AS BIGINT) FROM line_) WHERE x >= 0 AND y >= 0 AND x < {w} AND y < {h})"""


@query("polygon_fill", f"{_P}, {_FILLED.format(w=20, h=60)} SELECT object, x, y FROM fill_")
def polygon_fill(spark, sf):
    """The pixels of every polygon on a canvas that cuts some of them."""
    return R.filled(T.polygons(spark, sf), ["object"], F.lit(20), F.lit(60))


_WHOLE = T.POLYGON_SQL.replace("edge AS (", "whole_edge AS (")


@query("polygon_drawn", f"""WITH {_WHOLE}, lo AS (SELECT object, min(trunc(x0)) AS lx, min(trunc(y0)) AS ly, max(trunc(x0)) AS hx, max(trunc(y0)) AS hy FROM whole_edge GROUP BY object),
edge AS (SELECT e.object, trunc(x0) - lx + 2 AS x0, trunc(y0) - ly + 2 AS y0, trunc(x1) - lx + 2 AS x1, trunc(y1) - ly + 2 AS y1 FROM whole_edge e JOIN lo USING (object)), {_FILLED.format(w=1000000, h=1000000)}
SELECT object, f.x, f.y, CAST(hx - lx + 5 AS BIGINT) AS width, CAST(hy - ly + 5 AS BIGINT) AS height FROM fill_ f JOIN lo USING (object)""")
def polygon_drawn(spark, sf):
    """Polygons on canvases of their own size."""
    return R.drawn(T.polygons(spark, sf), ["object"], pad=2)


@query("polygon_drawn_centered", f"""WITH {_WHOLE}, lo AS (SELECT object, min(x0) AS lx, min(y0) AS ly, max(x0) - min(x0) AS fx, max(y0) - min(y0) AS fy FROM whole_edge GROUP BY object),
sc AS (SELECT *, least(27 / greatest(fx, 1e0), 37 / greatest(fy, 1e0)) AS s FROM lo),
edge AS (SELECT e.object, (x0 - lx) * s + (29 - fx * s) / 2 AS x0, (y0 - ly) * s + (39 - fy * s) / 2 AS y0, (x1 - lx) * s + (29 - fx * s) / 2 AS x1, (y1 - ly) * s + (39 - fy * s) / 2 AS y1 FROM whole_edge e JOIN sc USING (object)), {_FILLED.format(w=30, h=40)}
SELECT object, x, y FROM fill_""")
def polygon_drawn_centered(spark, sf):
    """Polygons scaled to one canvas."""
    return R.drawn_centered(T.polygons(spark, sf), ["object"], 30, 40, pad=1)


@query("profile_mask")
def profile_mask(spark, sf):
    from .verbs import profile

    return profile(_gray_structs(spark, sf).join(_mask_images(spark, sf).withColumnRenamed("im", "mask"), "image"), "mask", "pcfbm")


@query("process_mask")
def process_mask(spark, sf):
    from .verbs import process

    out = process(_gray_structs(spark, sf).join(_mask_images(spark, sf).withColumnRenamed("im", "mask"), "image"), "mask", "cmfb")
    return out.select("image", "object", "part", "im.width", "im.height", F.crc32("im.data").alias("crc"))


def _precise(sql: str) -> str:
    """An oracle above without its own rounding."""
    return re.sub(r"round\((CAST\((?:[^()]|\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\))* AS DOUBLE\)), \d\)", r"\1", sql)




def _clipped(spark, sf) -> DataFrame:
    return T.gray(spark, sf).withColumn("v", F.least("v", F.lit(255)))


def _sizes(spark, sf) -> DataFrame:
    return T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"))


#: Added before rounding: many values are dyadic fractions, whose ties would fall either way.
_TIE = 1e-7


def _tied(c: str, decimals: int = 4) -> Column:
    return F.round(F.col(c).cast("double") + _TIE, decimals).alias(c)


def _measure(family: str, columns: tuple[str, ...], inner: str) -> None:
    """All columns of a family, of whole images."""
    sql = f"SELECT CAST(image AS VARCHAR) AS image, {', '.join(f'round(CAST({c} AS DOUBLE) + {_TIE}, 4) AS {c}' for c in columns)} FROM ({inner})"
    query(f"measure_{family}", sql)(lambda spark, sf: V.measure(_clipped(spark, sf), family, _sizes(spark, sf)).select(F.col("image").cast("string").alias("image"), *map(_tied, columns)))


def _all_moments_sql(pixels: str) -> str:
    return f"""WITH {pixels}, m AS (SELECT image, c, {_RAW} FROM px WHERE v > 0 GROUP BY image, c), {_CENTRAL}, {_HU}, k AS (SELECT DISTINCT image, c FROM px)
SELECT image, {', '.join(f"avg(coalesce({c}, 0e0)) AS moments_{c}" for c in (*RAW_MOMENTS, *_US, *_IS))} FROM k LEFT JOIN hu USING (image, c) GROUP BY image"""


def _texture_nan_sql(pixels: str) -> str:
    return f"WITH {pixels}, {_GLCM}, {_HARALICK} SELECT image, {', '.join(f"avg(coalesce({t[8:]}, 'NaN'::DOUBLE)) AS {t}" for t in TEXTURE)} FROM hk GROUP BY image"


_measure("intensity", INTENSITY, _precise(_intensity_sql(T.CLIPPED_SQL)))
_measure("moments", MOMENTS, _all_moments_sql(T.CLIPPED_SQL))
_measure("texture", TEXTURE, _texture_nan_sql(T.CLIPPED_SQL))
_measure("zernike", ZERNIKE, _precise(_zernike_sql(T.CLIPPED_SQL, 8, 8)))


@query("measure_form", f"{_BASE}, {_FORM_TABLES} SELECT CAST(object AS VARCHAR) AS image, {', '.join(f'round(CAST({e} AS DOUBLE) + {_TIE}, 3) AS {c}' for c, e in _FORM_COLUMNS.items())} FROM {_FORM_FROM}")
def measure_form(spark, sf):
    """The verb's 23 columns of every polygon."""
    return G.form(T.polygons(spark, sf)).select(F.col("object").cast("string").alias("image"), *(_tied(c, 3) for c in FORM))


_CROP = T.CLIPPED_SQL.replace("px AS", "raw AS") + ", px AS (SELECT image, x - 1 AS x, y - 1 AS y, c, v FROM raw WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 5)"
def _corner_sql(axis: str, old: int, new: int) -> str:
    """Weights (o, axis, w) of the general resize along one axis."""
    at = f"(o - 0.5e0) * ({old}e0 / {new}e0)"
    low, high = f"greatest(floor({at}), 0e0)", f"least(greatest(ceil({at}), 0e0), {old - 1}e0)"
    return f"(SELECT o, CAST(p AS INTEGER) AS {axis}, sum(w) AS w FROM (SELECT o, {low} AS p, 1 - ({at} - {low}) AS w FROM range({new}) t(o) UNION ALL SELECT o, {high}, {at} - {low} FROM range({new}) t(o)) GROUP BY ALL)"


@query("resize_general", f"""WITH {T.CLIPPED_SQL}, wx AS {_corner_sql('x', 8, 12)}, wy AS {_corner_sql('y', 8, 10)},
big AS (SELECT image, wx.o AS ox, wy.o AS oy, sum(v * wx.w * wy.w) AS v FROM px JOIN wx USING (x) JOIN wy USING (y) GROUP BY ALL)
SELECT CAST(image AS VARCHAR) AS image, string_agg(CAST(CAST(least(greatest(floor(v + 0.5e0), 0e0), 255e0) AS INTEGER) AS VARCHAR), ',' ORDER BY oy, ox) AS pixels FROM big GROUP BY image""")  # fmt: skip
def resize_general(spark, sf):
    at = resize_corner(spark, sf)
    one = at.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    return one.select(F.col("image").cast("string").alias("image"), F.array_join(F.transform("s", lambda q: q["v"].cast("string")), ",").alias("pixels"))


def _triangle_sql(axis: str, old: int, new: int) -> str:
    """Weights (o, axis, w) of the default resize along one axis."""
    reach = max(old / new, 1.0)
    return f"(SELECT o, {axis}, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, {axis}, greatest(0e0, 1 - abs({axis} - ((o + 0.5e0) * {old}e0 / {new}e0 - 0.5e0)) / {reach!r}e0) AS w FROM range({new}) t(o), range({old}) u({axis})))"


for _bits, _top, _times, _new in ((8, 255, 1, (12, 10)), (16, 65535, 300, (5, 3))):
    query(
        f"resize_triangle_{_bits}",
        f"""WITH {T.GRAY_SQL}, wx AS {_triangle_sql("x", 8, _new[0])}, wy AS {_triangle_sql("y", 8, _new[1])}
SELECT image, c, wx.o AS x, wy.o AS y, CAST(least(greatest(floor(sum(least(v * {_times}, {_top}) * wx.w * wy.w) + 0.5e0 + 1e-9), 0e0), {_top}e0) AS BIGINT) AS v FROM px JOIN wx USING (x) JOIN wy USING (y) GROUP BY ALL""",
    )(
        lambda spark, sf, top=_top, times=_times, new=_new: Z.resized(T.gray(spark, sf).select("image", "c", "x", "y", F.least(F.col("v") * times, F.lit(top)).alias("v"), F.lit(8).alias("width"), F.lit(8).alias("height")), ["image"], *new, limits=(0, top))
        .select("image", "c", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("long").alias("v"))
    )


@query("resize_corner", f"""WITH {T.CLIPPED_SQL}, wx AS {_corner_sql('x', 8, 12)}, wy AS {_corner_sql('y', 8, 10)}
SELECT image, wx.o AS x, wy.o AS y, CAST(least(greatest(floor(sum(v * wx.w * wy.w) + 0.5e0 + 1e-9), 0e0), 255e0) AS BIGINT) AS v FROM px JOIN wx USING (x) JOIN wy USING (y) GROUP BY ALL""")  # fmt: skip
def resize_corner(spark, sf):
    at = T.gray(spark, sf).select("image", "c", "x", "y", F.least("v", F.lit(255)).alias("v"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return Z.resized(at, ["image"], 12, 10, "corner", (0, 255)).select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("long").alias("v"))


# --- verbs on masks, polygons and pairs -------------------------------------

#: Components of more than two pixels, in raster order, as (image, object, label, box): what the verbs call objects.
_OBJECTS = f"""RECURSIVE {T.CLIPPED_SQL}, on_ AS MATERIALIZED (SELECT image, x, y, y * 8 + x AS k FROM px WHERE v > 40),
nb AS MATERIALIZED (SELECT a.image, a.k, b.k AS l FROM on_ a JOIN on_ b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT image, k, l FROM nb UNION SELECT r.image, r.k, n.l FROM reach r JOIN nb n ON n.image = r.image AND n.k = r.l),
root AS (SELECT image, k, min(l) AS first_ FROM reach GROUP BY image, k),
lab AS MATERIALIZED (SELECT image, k, dense_rank() OVER (PARTITION BY image ORDER BY first_) AS label FROM root),
big AS (SELECT image, label, min(k % 8) AS x0, min(k // 8) AS y0, max(k % 8) AS x1, max(k // 8) AS y1 FROM lab GROUP BY ALL HAVING count(*) > 2),
obj AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image ORDER BY label) - 1 AS object FROM big)"""
#: Pixels of the padded crops of objects that don't touch the border, with whether they are the object's.
_CELLS = f"""{_OBJECTS}, cell AS MATERIALIZED (SELECT o.image, o.object, p.x - o.x0 + 1 AS x, p.y - o.y0 + 1 AS y, o.x1 - o.x0 + 3 AS w, o.y1 - o.y0 + 3 AS h, 0 AS c, p.v, coalesce(l.label = o.label, false) AS mine
  FROM obj o JOIN px p ON p.image = o.image AND p.x BETWEEN o.x0 - 1 AND o.x1 + 1 AND p.y BETWEEN o.y0 - 1 AND o.y1 + 1 LEFT JOIN lab l ON l.image = p.image AND l.k = p.y * 8 + p.x
  WHERE o.x0 > 0 AND o.y0 > 0 AND o.x1 < 7 AND o.y1 < 7)"""
_PARTS = {"complete": "v", "mask": "CASE WHEN mine THEN 255 ELSE 0 END", "foreground": "CASE WHEN mine THEN v ELSE 0 END", "background": "CASE WHEN mine THEN 0 ELSE v END"}


def _parted(names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT image, object, '{n}' AS part, x, y, w, h, c, {_PARTS[n]} AS v FROM cell" for n in names)


@query("pair_images", f"""WITH {T.CLIPPED_SQL}, g AS (SELECT image, max(v) AS most, string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY y, x) AS pixels, string_agg(CASE WHEN v > 40 THEN '01' ELSE '00' END, '' ORDER BY y, x) AS mask FROM px GROUP BY image)
SELECT 'img_' || image || '_image' AS image, 'img_' || image AS id, pixels, mask FROM g WHERE most > 40""")  # fmt: skip
def pair_images(spark, sf):
    """The verb on two image files a key, of which the last path holds, and on masks of which the empty ones are error rows."""
    from .verbs import image_of, pair

    stem = F.concat(F.lit("img_"), "image", F.lit("_image"))
    pixels = {"npy": F.transform("pixels", lambda v: v * 0), "png": F.transform("pixels", lambda v: F.least(v, F.lit(255)))}
    versions = F.inline(F.array(*(F.struct(F.concat(F.lit("in/"), stem, F.lit(f".{ext}")).alias("path"), image_of(v, 8, 8).alias("im")) for ext, v in pixels.items())))
    images = T.gray_images(spark, sf).select(stem.alias("stem"), F.lit(None).cast("string").alias("error"), versions)
    on = F.transform("pixels", lambda v: (v > 40).cast("int"))
    masks = T.gray_images(spark, sf).select(F.concat(F.lit("img_"), "image", F.lit("_mask")).alias("stem"), image_of(on, 8, 8).alias("im"), F.when(F.array_max(on) == 0, F.lit("no objects")).alias("error"))
    return pair(images, masks, "mask", "_image", "_mask").select("image", "id", F.hex("im.data").alias("pixels"), F.hex("mask.data").alias("mask"))


# --- whole verbs on the pixel relation ---------------------------------------


def _object_rows(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("image").cast("string").alias("image"), F.col("object").cast("int").alias("object"), *columns)


def _profiled(df: DataFrame) -> DataFrame:
    return _object_rows(df, *(_tied(c) for c in df.columns if c not in ("image", "object")))


#: All pixel descriptors of the images of base_px, as table fam.
_SHOWN = "px AS (SELECT * FROM base_px)"
_FAMILIES = f"""fam AS MATERIALIZED (SELECT * FROM ({_all_moments_sql(_SHOWN)}) f1 JOIN ({_precise(_zernike_sql(_SHOWN, "w", "h"))}) f2 USING (image) JOIN ({_precise(_intensity_sql(_SHOWN))}) f3 USING (image) JOIN ({_texture_nan_sql(_SHOWN)}) f4 USING (image))"""


def _part_pixels(names) -> str:
    value = lambda n: "CASE WHEN mine THEN 1 ELSE 0 END" if n == "mask" else _PARTS[n]
    return " UNION ALL ".join(f"SELECT image || ':' || object || ':{n}' AS image, x, y, w, h, c, CAST({value(n)} AS BIGINT) AS v FROM cell" for n in names)


def _profile_sql(cells: str, names: tuple[str, ...], form: str = "", extra: tuple[str, ...] = ()) -> str:
    """All columns of a profile: ``cells`` are tables with cell, the pixels of the crops, and keys (image, object, key, ring).

    ``form`` are tables of the rings' descriptors; the ring of a key is keys.ring.
    """
    columns, joins = [], ""
    for n in names:
        joins += f" JOIN fam {n}_ ON {n}_.image = k.key || ':{n}'"
        columns += [f"round(CAST({n}_.{c} AS DOUBLE) + {_TIE}, 4) AS {n}_{c}" for c in (MOMENTS + ZERNIKE if n == "mask" else PIXEL_FAMILIES)]
    forms = [f"round(CAST({e} AS DOUBLE) + {_TIE}, 4) AS {c}" for c, e in _FORM_COLUMNS.items()] if form else []
    rings = f" JOIN (SELECT * FROM {_FORM_FROM}) fm ON CAST(fm.object AS VARCHAR) = k.ring" if form else ""
    return f"""WITH {cells}, base_px AS MATERIALIZED ({_part_pixels(names)}), {_FAMILIES}{", " + form if form else ""}
SELECT k.image, k.object, {', '.join([*forms, *columns, *extra])} FROM keys k{joins}{rings}"""


# objects of masks

_OBJECT_CELLS_SQL = _CELLS.replace("min(l) AS first_", "min(l) AS root, min(l) AS first_") + ", keys AS (SELECT DISTINCT CAST(image AS VARCHAR) AS image, CAST(object AS INTEGER) AS object, image || ':' || object AS key, image || ':' || object AS ring FROM cell)"
_ONE_SIDE = ORACLE_SQL["mask_contours"].split("dir AS", 1)[1].split("SELECT image, root, step, CAST", 1)[0]
_RING_OF = "mid AS (SELECT object, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pt GROUP BY object HAVING count(*) > 2)" + T.POLYGON_SQL.split("HAVING count(*) > 2)", 1)[1]
_B_OF = _BASE.split("b AS", 1)[1]
_WALKED = f"""dir AS{_ONE_SIDE}, pt AS (SELECT DISTINCT o.image || ':' || o.object AS object, CAST(w.k % 8 AS DOUBLE) AS x, CAST(w.k // 8 AS DOUBLE) AS y FROM walk w JOIN lab l ON l.image = w.image AND l.k = w.root JOIN obj o ON o.image = l.image AND o.label = l.label),
{_RING_OF}, b AS{_B_OF}, {_FORM_TABLES}"""


def _mask_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pixels, masks, sizes) of the images and their masks of level 40."""
    pixels = _clipped(spark, sf)
    return pixels, pixels.select("image", "x", "y", (F.col("v") > 40).cast("long").alias("label")), _sizes(spark, sf)


@query("profile_objects", _profile_sql(_OBJECT_CELLS_SQL, tuple(_PARTS), _WALKED))
def profile_objects(spark, sf):
    """All 299 columns of the objects of masks, from pixels over contours to descriptors in joins and aggregations."""
    return _profiled(V.profile_masks(*_mask_tables(spark, sf), "pcfbm"))


@query("profile_mask_parts", f"""WITH {_OBJECT_CELLS_SQL}, base_px AS MATERIALIZED ({_part_pixels(("complete", "foreground", "background"))}), {_FAMILIES}
SELECT fam.image AS key, {', '.join(f"round(CAST({c} AS DOUBLE) + {_TIE}, 4) AS {c}" for c in PIXEL_FAMILIES)} FROM fam""")
def profile_mask_parts(spark, sf):
    """All 74 pixel descriptors of each part of each object, a row a part."""
    pixels, masks, sizes = _mask_tables(spark, sf)
    objects = R.kept(V.mask_objects(masks), "objects")
    crops = R.kept(G.object_crops(merged(objects, sizes, "image")), "crops")
    out = V.described_parts(V.parts(pixels, crops, V.object_pixels(masks, objects), "cfb"), "cfb")
    return out.select(F.concat_ws(":", "image", "object", "part").alias("key"), *map(_tied, PIXEL_FAMILIES))


@query("mask_object_boxes", f"WITH {_OBJECTS} SELECT CAST(image AS VARCHAR) AS image, CAST(object AS INTEGER) AS object, CAST(label AS BIGINT) AS label, CAST(x0 AS DOUBLE) AS x_min, CAST(y0 AS DOUBLE) AS y_min, CAST(x1 AS DOUBLE) AS x_max, CAST(y1 AS DOUBLE) AS y_max FROM obj")
def mask_object_boxes(spark, sf):
    return _object_rows(V.mask_objects(_mask_tables(spark, sf)[1]), "label", "bbox.*")


@query("mask_to_polygons", f"""WITH {_OBJECT_CELLS_SQL}, dir AS{_ONE_SIDE}
SELECT CAST(o.image AS VARCHAR) AS image, CAST(o.object AS INTEGER) AS object, CAST(o.label AS BIGINT) AS label, string_agg((w.k % 8) || ' ' || (w.k // 8), ',' ORDER BY w.step) AS points FROM walk w JOIN lab l ON l.image = w.image AND l.k = w.root JOIN obj o ON o.image = l.image AND o.label = l.label GROUP BY ALL""")
def mask_to_polygons(spark, sf):
    """The contours of all objects, points in order, as text."""
    point = F.concat(F.col("p.x").cast("long"), F.lit(" "), F.col("p.y").cast("long"))
    text = F.array_join(F.transform("poly", lambda q: F.concat(q["x"].cast("long").cast("string"), F.lit(" "), q["y"].cast("long").cast("string"))), ",")
    return _object_rows(V.mask_objects(_mask_tables(spark, sf)[1]), "label", text.alias("points"))


def _hexed(df: DataFrame) -> DataFrame:
    two = F.array_join(F.transform("pixels", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    return _object_rows(df, "part", "width", "height", two.alias("pixels"))


_PIXELS_SQL = "string_agg(lpad(to_hex(CAST(v AS BIGINT)), 2, '0'), '' ORDER BY y, x) AS pixels"


@query("process_mask_pixels", f"""WITH {_CELLS}, pt AS ({_parted(tuple(_PARTS))})
SELECT CAST(image AS VARCHAR) AS image, CAST(object AS INTEGER) AS object, part, CAST(max(w) AS INTEGER) AS width, CAST(max(h) AS INTEGER) AS height, {_PIXELS_SQL} FROM pt GROUP BY image, object, part""")
def process_mask_pixels(spark, sf):
    pixels, masks, sizes = _mask_tables(spark, sf)
    objects = R.kept(V.mask_objects(masks), "objects")
    return _hexed(V.process(pixels, objects, V.object_pixels(masks, objects), sizes, "cmfb"))


# polygons and boxes of the images

_POLYGON_CELLS = f"""{T.CLIPPED_SQL.replace("px AS", "whole AS")}, {T.IMAGE_POLYGON_SQL}, {_FILLED.format(w=8, h=8)},
bb AS (SELECT object AS ring, object // 2 AS image, object % 2 AS object, CAST(min(x) AS BIGINT) AS x0, CAST(min(y) AS BIGINT) AS y0, CAST(max(x) AS BIGINT) AS x1, CAST(max(y) AS BIGINT) AS y1 FROM ring GROUP BY object),
cell AS MATERIALIZED (SELECT b.ring, b.image, b.object, p.x - b.x0 + 1 AS x, p.y - b.y0 + 1 AS y, b.x1 - b.x0 + 3 AS w, b.y1 - b.y0 + 3 AS h, 0 AS c, p.v, f.x IS NOT NULL AS mine
  FROM bb b JOIN whole p ON p.image = b.image AND p.x BETWEEN b.x0 - 1 AND b.x1 + 1 AND p.y BETWEEN b.y0 - 1 AND b.y1 + 1 LEFT JOIN fill_ f ON f.object = b.ring AND f.x = p.x AND f.y = p.y),
keys AS (SELECT DISTINCT CAST(image AS VARCHAR) AS image, CAST(object AS INTEGER) AS object, image || ':' || object AS key, CAST(ring AS VARCHAR) AS ring FROM cell)"""


@query("profile_polygons", _profile_sql(_POLYGON_CELLS, tuple(_PARTS), f"b AS{_B_OF}, {_FORM_TABLES}"))
def profile_polygons(spark, sf):
    """All 299 columns of polygons, their masks filled by scan lines."""
    return _profiled(V.profile_polygons(_clipped(spark, sf), T.image_polygons(spark, sf), _sizes(spark, sf), "pcfbm"))


@query("process_polygons", f"""WITH {_POLYGON_CELLS}, pt_ AS ({_parted(tuple(_PARTS))})
SELECT CAST(image AS VARCHAR) AS image, CAST(object AS INTEGER) AS object, part, CAST(max(w) AS INTEGER) AS width, CAST(max(h) AS INTEGER) AS height, {_PIXELS_SQL} FROM pt_ GROUP BY image, object, part""")
def process_polygons(spark, sf):
    sizes = _sizes(spark, sf)
    objects = R.kept(T.image_polygons(spark, sf).withColumn("bbox", G.bounding_box(F.col("poly"))), "objects")
    own = R.filled(merged(objects, sizes, "image"), ["image", "object"], F.col("width"), F.col("height"))
    return _hexed(V.process(_clipped(spark, sf), objects, own, sizes, "cmfb"))


def _image_boxes(spark, sf) -> DataFrame:
    return T.image_polygons(spark, sf).select("image", "object", G.bounding_box(F.col("poly")).alias("bbox"))


@query("profile_boxes", _profile_sql(_POLYGON_CELLS, ("complete",), extra=("CAST(bw AS DOUBLE) AS bbox_width", "CAST(bh AS DOUBLE) AS bbox_height", "CAST(bw * bh AS DOUBLE) AS bbox_area")).replace("FROM keys k", "FROM (SELECT keys.*, x1 - x0 AS bw, y1 - y0 AS bh FROM keys JOIN bb ON CAST(bb.ring AS VARCHAR) = keys.ring) k"))
def profile_boxes(spark, sf):
    """All 77 columns of boxes."""
    out = V.profile_boxes(_clipped(spark, sf), _image_boxes(spark, sf), _sizes(spark, sf), "cx")
    return _object_rows(out, *(_tied(c) for c in out.columns if c.startswith("complete_")), "bbox_width", "bbox_height", "bbox_area")


@query("process_boxes", f"WITH {_POLYGON_CELLS} SELECT CAST(image AS VARCHAR) AS image, CAST(object AS INTEGER) AS object, 'complete' AS part, CAST(max(w) AS INTEGER) AS width, CAST(max(h) AS INTEGER) AS height, {_PIXELS_SQL} FROM cell GROUP BY image, object")
def process_boxes(spark, sf):
    return _hexed(V.process(_clipped(spark, sf), _image_boxes(spark, sf), None, _sizes(spark, sf), "c"))


#: The older name of the verb's columns; all 23 as well.
query("measure_form_columns", ORACLE_SQL["measure_form"])(measure_form)


# --- sources and sinks --------------------------------------------------------


@query("image_files_round_trip", f"WITH {T.CLIPPED_SQL} SELECT image, x, y, v FROM px WHERE image % 3 < 2")
def image_files_round_trip(spark, sf):
    """Images written as npy files by the sink, found again by the folder source with pushed filters, and read as pixels.

    Every third image has another name, which the pushed filter leaves out of the listing.
    """
    from ..sinks.images import save_images
    from ..sources.folder import folder
    from .verbs import image_of

    images = T.gray_images(spark, sf)
    name = F.concat(F.when(F.col("image") % 3 < 2, "img_").otherwise("other_"), F.col("image"))
    place = new_place(spark, "images")
    save_images(images.select(name.alias("name"), image_of(F.transform("pixels", lambda v: F.least(v, F.lit(255))), 8, 8).alias("im")), place, "npy")
    files = folder(spark, place).where(F.col("ext").isin("npy", "png") & F.col("name").contains("img_"))
    data = F.expr("substring(content, length(content) - 63, 64)")  # what follows the header
    values = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
    read = files.select(F.regexp_extract("stem", "([0-9]+)$", 1).cast("long").alias("image"), values.alias("pixels"))
    return P.explode_pixels(read, width=8).select("image", "x", "y", "v")


def folder_listing(spark, path: str) -> DataFrame:
    """(path, stem, ext) of the image files of a folder whose names hold "image", by the folder source."""
    from ..sources.folder import folder

    return folder(spark, path, content=False).where(F.col("ext").isin(*IMAGE_FORMATS) & F.col("name").contains("image")).select("path", "stem", "ext")
