"""Bilinear resize of the pixel relation, as a separable sparse product: two joins with weights, each added up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keeps ties of the rounding from falling either way with the order of the sums.
TIE = 1e-9


def axis_weights(sizes: DataFrame, new: int, method: str = "triangle") -> DataFrame:
    """(old, o, p, weight): what source p of an axis of ``old`` pixels adds to place o of ``new``; zero weights are left out.

    ``triangle``: a filter that widens when it shrinks, its weights adding up
    to 1.  ``corner``: a place's source is (place - 1/2) * ratio between two
    neighbours, cut to the axis above; before the first pixel the line runs on.
    """
    at = sizes.select(F.col("old").cast("long").alias("old")).distinct().select("old", F.explode(F.sequence(F.lit(0), F.lit(new - 1))).alias("o"))
    scale, last = F.col("old") / F.lit(new), F.col("old") - 1
    if method == "triangle":
        reach, center = F.greatest(scale, F.lit(1.0)), (F.col("o") + 0.5) * scale - 0.5
        at = at.select("old", "o", center.alias("center"), reach.alias("reach"), F.explode(F.sequence(F.greatest(F.ceil(center - reach), F.lit(0)), F.least(F.floor(center + reach), last))).alias("p"))
        at = at.withColumn("weight", 1 - F.abs(F.col("p") - F.col("center")) / F.col("reach")).where("weight > 0")
        total = at.groupBy("old", "o").agg(F.sum("weight").alias("total"))
        return at.join(total, ["old", "o"]).select("old", "o", "p", (F.col("weight") / F.col("total")).alias("weight"))
    if method != "corner":
        raise ValueError(f"no method {method}")
    place = (F.col("o") - 0.5) * scale
    low, high = F.greatest(F.floor(place), F.lit(0)), F.least(F.greatest(F.ceil(place), F.lit(0)), last)
    ends = F.inline(F.array(F.struct(low.alias("p"), (1 - (place - low)).alias("weight")), F.struct(high.alias("p"), (place - low).alias("weight"))))
    return at.select("old", "o", ends).groupBy("old", "o", "p").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def resized(pixels: DataFrame, by: list[str], width: int, height: int, method: str = "triangle", limits: tuple[int, int] | None = None) -> DataFrame:
    """(by, c, x, y, v) of images (by, c, x, y, v, width, height) resized; ``limits`` rounds to whole numbers within them.

    One axis after the other; the weights of an axis depend on its size only
    and are a few rows each.  Images of any size are any number of rows.
    """
    wide = axis_weights(pixels.select(F.col("width").alias("old")), width, method).toDF("width", "o", "x", "weight")
    high = axis_weights(pixels.select(F.col("height").alias("old")), height, method).toDF("height", "o", "y", "weight")
    one = pixels.join(wide, ["width", "x"]).groupBy(*by, "c", "height", "y", F.col("o").alias("x")).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    out = one.join(high, ["height", "y"]).groupBy(*by, "c", "x", F.col("o").alias("y")).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    v = F.col("v")
    if limits is not None:
        v = F.least(F.greatest(F.floor(v + 0.5 + TIE), F.lit(limits[0])), F.lit(limits[1]))
    return out.select(*by, "c", "x", "y", v.alias("v"))
