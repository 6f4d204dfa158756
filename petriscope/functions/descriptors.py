"""Intensity, moment, texture and Zernike descriptors of the pixel relation.

Every function takes pixels (…, c, x, y, v) and the columns ``by`` that name an
image or object, and gives one row per ``by``.  Channels are described by
themselves and averaged; ``v`` counts where it is positive.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HU_MOMENTS, RAW_MOMENTS, ZERNIKE_ORDERS
from .joining import merged
from .ordering import dealt
from .polygons import let, settled

#: Fixed value: single-precision epsilon, added inside logarithms.
EPS = 1.1920928955078125e-07
LEVELS = 64
#: Pixels that a task of :func:`glcm` has: its sorts and sums hold about 5 kB for each, in cells and margins, where images are small.
SHARE = 1 << 16


def intensity(pixels: DataFrame, by: list[str], compat: bool = False) -> DataFrame:
    """min, max, sum, mean, std (means over channels; ``compat``: Q2), median and mad of all channels together.

    Counts of equal values are combined before they move and dealt by image
    once; medians come from running counts over sorted values, which spill where
    an image is large, so no row or buffer holds an image's values.
    """
    v, n = F.col("v"), F.col("n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counts = pixels.groupBy(*by, "c", F.when(F.col("v") > 0, F.col("v").cast("double")).alias("v")).agg(F.count("*").alias("n")).repartition(*by)
    some = F.when(v.isNotNull(), n).otherwise(0)
    channel, image = Window.partitionBy(*by, "c"), Window.partitionBy(*by)
    counts = counts.withColumns({"total": F.sum(v * n).over(channel), "mass": F.nullif(F.sum(some).over(channel), F.lit(0)), "all": F.sum(some).over(image), "seen": F.sum(some).over(image.orderBy("v"))})
    counts = counts.withColumns({"low": F.min(reached(v, "seen", "all", 1)).over(image), "high": F.min(reached(v, "seen", "all", 0)).over(image)})
    counts = counts.withColumn("median", (F.col("low") + F.col("high")) / 2).withColumn("gap", F.abs(v - F.col("median")))
    counts = counts.withColumn("seen", F.sum(some).over(image.orderBy("gap")))
    mean = F.col("total") / F.col("mass")
    per = counts.groupBy(*by, "c").agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.first("total").alias("total"), F.first(mean).alias("mean"), F.sqrt(F.sum(n * F.pow(v - mean, F.lit(2))) / F.first("mass")).alias("std"),
        F.first("median").alias("median"), F.min(reached(F.col("gap"), "seen", "all", 1)).alias("low"), F.min(reached(F.col("gap"), "seen", "all", 0)).alias("high"),
    )
    names = ("lo", "hi", "total", "mean", "std")
    if compat:
        last = lambda c: F.max_by(zero(F.col(c)), "c") / F.count("*")
        stats = [last("mean" if n == "std" else n).alias(n) for n in names]
    else:
        stats = [F.avg(zero(F.col(n))).alias(n) for n in names]
    one = per.groupBy(*by).agg(*stats, zero(F.max("median")).alias("median"), zero((F.min("low") + F.min("high")) / 2).alias("mad"))
    return one.select(*by, *(F.col(a).alias(f"intensity_{b}") for a, b in zip(names, ("min", "max", "sum", "mean", "std"), strict=True)), F.col("median").alias("intensity_median"), F.col("mad").alias("intensity_mad"))


def intensity_sum(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, c, sum) of all values of each channel, negative ones too, unlike the sum of :func:`intensity`."""
    return pixels.groupBy(*by, "c").agg(F.sum(F.col("v").cast("double")).alias("sum"))


def reached(v: Column, seen: str, total: str, back: int) -> Column:
    """``v`` where the values up to it hold the middle place (``back`` 1: the lower of two), else null."""
    return F.when(F.col(seen) > F.floor((F.col(total) - back) / 2), v)


def raw_moments(pixels: DataFrame, by: list[str]) -> DataFrame:
    """m00 to m03 of each channel (column c stays)."""
    v, x, y = (F.col(c).cast("double") for c in "vxy")
    power = lambda c, n: reduce(lambda a, b: a * b, [c] * n) if n else F.lit(1.0)
    return pixels.where("v > 0").groupBy(*by, "c").agg(*(F.sum(v * power(x, int(m[1])) * power(y, int(m[2]))).alias(m) for m in RAW_MOMENTS))


def central_moments(raw: DataFrame) -> DataFrame:
    """Adds u11 to u03 to raw moments."""
    m = {c: F.col(c) for c in RAW_MOMENTS}
    x, y = m["m10"] / m["m00"], m["m01"] / m["m00"]
    return raw.withColumns(
        {
            "u11": m["m11"] - x * m["m01"],
            "u20": m["m20"] - x * m["m10"],
            "u02": m["m02"] - y * m["m01"],
            "u21": m["m21"] - 2 * x * m["m11"] - y * m["m20"] + 2 * x * x * m["m01"],
            "u12": m["m12"] - 2 * y * m["m11"] - x * m["m02"] + 2 * y * y * m["m10"],
            "u30": m["m30"] - 3 * x * m["m20"] + 2 * x * x * m["m10"],
            "u03": m["m03"] - 3 * y * m["m02"] + 2 * y * y * m["m01"],
        }
    )


def hu_moments(central: DataFrame) -> DataFrame:
    """Adds the invariants i1 to i7 to central moments."""
    n = {c: F.col(c) / F.pow("m00", F.lit(1 + (int(c[1]) + int(c[2])) / 2)) for c in ("u11", "u20", "u02", "u21", "u12", "u30", "u03")}
    p, q, r = n["u20"] - n["u02"], n["u30"] - 3 * n["u12"], n["u30"] + n["u12"]
    z, y = n["u21"] + n["u03"], 3 * n["u21"] - n["u03"]
    a, b = r * (r * r - 3 * z * z), z * (3 * r * r - z * z)
    values = (n["u20"] + n["u02"], p * p + 4 * n["u11"] * n["u11"], q * q + y * y, r * r + z * z, q * a + y * b, p * (r * r - z * z) + 4 * n["u11"] * r * z, y * a - q * b)
    return central.withColumns(dict(zip(HU_MOMENTS, values, strict=True)))


def moments(pixels: DataFrame, by: list[str]) -> DataFrame:
    """All 24, averaged over channels; images without a positive pixel have 0."""
    full = hu_moments(central_moments(raw_moments(pixels, by)))
    names = [c for c in full.columns if c not in (*by, "c")]
    channels = pixels.select(*by, "c").distinct()
    return merged(channels, full, [*by, "c"], "left").groupBy(*by).agg(*(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"moments_{c}") for c in names))


def glcm(pixels: DataFrame, by: list[str], angles: tuple[int, ...] = (0, 45, 90, 135)) -> DataFrame:
    """(by, c, angle, i, j, p, n, t): symmetric co-occurrence of 64 grey levels, as shares p of n in t.

    An angle without any pair has one row of null i, j and p.  Pixels are dealt
    once, by image and channel, about ``SHARE`` a task; the limits of a channel, the neighbours along
    lines of each direction, and all that :func:`haralick` adds up keep to that.
    """
    key = [*by, "c"]
    whole = Window.partitionBy(*key)
    low, high = F.min("v").over(whole).cast("double"), F.max("v").over(whole).cast("double")
    share = (F.col("v") - low) / F.nullif(high - low, F.lit(0.0)) * (LEVELS - 1)
    level = dealt(pixels, key, SHARE).select(*key, "x", "y", F.coalesce(F.floor(share + 0.5), F.lit(0)).cast("int").alias("g"))
    #: The line that a pixel and its neighbour share, and the coordinate that grows by one along it.
    lines = {0: (F.col("y"), "x"), 45: (F.col("x") - F.col("y"), "x"), 90: (F.col("x"), "y"), 135: (F.col("x") + F.col("y"), "y")}
    steps = []
    for a in angles:
        line, along = lines[a]
        ahead = Window.partitionBy(*key, line).orderBy(along)
        level = level.withColumn(f"n{a}", F.when(F.lead(along).over(ahead) == F.col(along) + 1, F.lead("g").over(ahead)))
        g = F.when(F.col(f"n{a}").isNotNull(), F.col("g"))
        steps += [F.struct(F.lit(a).alias("angle"), i.alias("i"), j.alias("j")) for i, j in ((g, F.col(f"n{a}")), (F.col(f"n{a}"), g))]
    count = level.select(*key, F.inline(F.array(*steps))).groupBy(*key, "angle", "i", "j").agg(F.count("i").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*key, "angle")).alias("t")
    shares = count.select("*", total).where(F.col("i").isNotNull() | (F.col("t") == 0))
    return shares.select(*key, "angle", "i", "j", F.when(F.col("t") > 0, F.col("n") / F.nullif("t", F.lit(0))).alias("p"), "n", "t")


def haralick(cells: DataFrame, key: list[str]) -> DataFrame:
    """The 13 features of each matrix (key, i, j, p, n, t); absent cells are 0.

    Margins and the shares of sums and differences stand beside each cell, so a
    sum over a margin is a sum over cells; only the 64 or fewer values of a
    margin are gathered.  Polynomials are added up over whole counts.  Features of matrices without any pair, and correlation
    where one level is all, are null.
    """
    p, i, j = F.col("p"), F.col("i"), F.col("j")
    log2 = lambda x: F.log2(x + F.lit(EPS))
    beside = lambda *e: F.sum("p").over(Window.partitionBy(*key, *e))
    at = cells.select(*key, "i", "j", "p", "n", "t", beside(i).alias("px"), beside(i + j).alias("plus"), beside(F.abs(i - j)).alias("minus"))
    plus, minus, level = F.col("plus"), F.col("minus"), i + 1
    whole = lambda e: F.sum(e * F.col("n")).cast("double")  # noqa: E731 - exact below 2**53
    one = at.groupBy(*key).agg(
        F.sum(p * p).alias("energy"), whole((i - j) * (i - j)).alias("apart"), whole(level).alias("mu"), whole(level * level).alias("sq"), whole(level * (j + 1)).alias("both"),
        F.sum(p / (1 + (i - j) * (i - j))).alias("inverse_difference_moment"), whole(i + j).alias("s1"), whole((i + j) * (i + j)).alias("s2"), F.nullif(F.max("t"), F.lit(0)).cast("double").alias("t"),
        (-F.sum(p * F.log2(plus + F.when(plus <= EPS, 1.0).otherwise(0.0)))).alias("sum_entropy"), (-F.sum(p * log2(p))).alias("entropy"),
        F.sum(p * minus).alias("minus_squares"), (-F.sum(p * log2(minus))).alias("difference_entropy"), (-F.sum(p * log2(F.col("px")))).alias("hx"),
        F.collect_set(F.when(i.isNotNull(), F.struct("i", "px"))).alias("margin"),
    )
    values = F.transform("margin", lambda m: m["px"])
    alike = let(values, lambda m: F.transform(F.array_distinct(m), lambda v: F.struct(v.alias("v"), F.size(F.filter(m, lambda q: q == v)).alias("n"))))
    crossed = let(alike, lambda m: F.aggregate(m, F.lit(0.0), lambda s, a: s + F.aggregate(m, F.lit(0.0), lambda t, b: t + a["n"] * b["n"] * a["v"] * b["v"] * log2(a["v"] * b["v"]))))
    one = settled(one, {"hxy2": crossed})
    t = F.col("t")
    spread = lambda squares, a, b: F.col(squares) * t - F.col(a) * F.col(b)
    hxy = -F.col("entropy")
    features = {
        "contrast": F.col("apart") / t,
        "correlation": spread("both", "mu", "mu") / F.nullif(spread("sq", "mu", "mu"), F.lit(0.0)),
        "sum_of_squares": spread("sq", "mu", "mu") / (t * t),
        "sum_average": F.col("s1") / t,
        "sum_variance": spread("s2", "s1", "s1") / (t * t),
        "difference_variance": (F.col("minus_squares") - F.lit(1.0 / LEVELS)) / LEVELS,
        "infocorr1": (F.col("hxy2") - hxy) / F.nullif(F.col("hx"), F.lit(0.0)),
        "infocorr2": F.when(hxy.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 1 - F.exp(-2 * (hxy - F.col("hxy2")))))),
    }
    return one.withColumns(features).drop("apart", "mu", "sq", "both", "s1", "s2", "t", "minus_squares", "hx", "hxy2", "margin")


def texture(pixels: DataFrame, by: list[str], defined_only: bool = False) -> DataFrame:
    """Features averaged over four angles and all channels; NaN where one of them has none (Q5).

    ``defined_only`` leaves the angles and channels without a value out of a
    feature's mean instead.
    """
    from ..schema import TEXTURE

    features = haralick(glcm(pixels, by), [*by, "c", "angle"])
    value = lambda c: F.col(c) if defined_only else F.coalesce(F.col(c), F.lit(float("nan")))
    return features.groupBy(*by).agg(*(F.avg(value(t.removeprefix("texture_"))).alias(t) for t in TEXTURE))


def radial_terms(n: int, m: int) -> list[tuple[float, int]]:
    """(coefficient, power) of a radial polynomial."""
    f = math.factorial
    return [((-1) ** s * f(n - s) / (f(s) * f((n + m) // 2 - s) * f((n - m) // 2 - s)), n - 2 * s) for s in range((n - m) // 2 + 1)]


def zernike(pixels: DataFrame, by: list[str], width: Column | int, height: Column | int) -> DataFrame:
    """30 magnitudes in one aggregation of 60 sums.

    r^m cos(m t) and r^m sin(m t) are the parts of (x + iy)^m, each made of the
    one before by two products; what is left of a radial polynomial is one in r^2.  So a
    pixel costs products only, no powers or angles.
    """
    w, h = (F.lit(float(n)) if isinstance(n, int) else n.cast("double") for n in (width, height))
    sure = lambda e: F.coalesce(e, F.lit(0.0))  # noqa: E731 - never null, which makes the code of 60 sums short enough to be compiled
    at = pixels.select(*by, "c", sure(F.col("v").cast("double")).alias("v"), sure((F.col("x") - w / 2) / (w / 2)).alias("px"), sure((F.col("y") - h / 2) / (h / 2)).alias("py"))
    at = at.withColumn("q1", F.col("px") * F.col("px") + F.col("py") * F.col("py"))
    at = at.withColumn("v", F.when(F.sqrt("q1") <= 1, F.col("v")).otherwise(0.0))
    for k in range(2, max(n for n, _ in ZERNIKE_ORDERS) // 2 + 1):
        at = at.withColumn(f"q{k}", F.col(f"q{k - 1}") * F.col("q1"))
    at = at.withColumns({"re0": F.col("v"), "im0": F.lit(0.0)})
    for m in range(1, max(m for _, m in ZERNIKE_ORDERS) + 1):
        re, im = F.col(f"re{m - 1}"), F.col(f"im{m - 1}")
        at = at.withColumns({f"re{m}": re * F.col("px") - im * F.col("py"), f"im{m}": re * F.col("py") + im * F.col("px")})
    sums = [F.sum("v").alias("mass")]
    for n, m in ZERNIKE_ORDERS:
        rest = reduce(lambda a, b: a + b, (F.lit(float(c)) * (F.col(f"q{(k - m) // 2}") if k > m else F.lit(1.0)) for c, k in radial_terms(n, m)))
        sums += [F.sum(F.col(f"{part}{m}") * rest).alias(f"{part}_{n}{m}") for part in ("re", "im")]
    one = at.groupBy(*by, "c").agg(*sums)
    size = lambda n, m: F.coalesce((n + 1) / math.pi * F.sqrt(F.pow(f"re_{n}{m}", F.lit(2)) + F.pow(f"im_{n}{m}", F.lit(2))) / F.nullif(F.abs("mass"), F.lit(0.0)), F.lit(0.0))
    return one.groupBy(*by).agg(*(F.avg(size(n, m)).alias(f"zernike_{n}{m}") for n, m in ZERNIKE_ORDERS))
