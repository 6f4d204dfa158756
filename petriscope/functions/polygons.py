"""Polygons as array<struct<x, y>> columns: order, measures and boxes by higher-order functions, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value computed once.

    Inside a lambda, an outer expression would be computed for every element:
    the optimizer moves it there, as it stands there only once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, computed once a row however often they are used.

    What a generator gives, the optimizer neither copies into later expressions
    nor into filters below.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def dedup_points(p: Column) -> Column:
    """Sorted by x, then y; repeated points once."""
    return F.array_sort(F.array_distinct(p))


def mean_point(p: Column) -> tuple[Column, Column]:
    mean = lambda c: F.aggregate(p, F.lit(0.0), lambda a, q: a + q[c]) / F.size(p)
    return mean("x"), mean("y")


def order_points(p: Column, decimals: int = 9) -> Column:
    """By descending angle around the mean, nearer ones first; angles are compared to ``decimals`` places."""
    cx, cy = mean_point(p)

    def keyed(m: Column) -> Column:
        dx, dy = lambda q: q["x"] - m["x"], lambda q: q["y"] - m["y"]
        return F.transform(p, lambda q: F.struct((-F.round(F.atan2(dy(q), dx(q)), decimals)).alias("a"), F.round(F.pow(dx(q), F.lit(2)) + F.pow(dy(q), F.lit(2)), decimals).alias("d"), q["x"].alias("x"), q["y"].alias("y")))

    return F.transform(F.array_sort(let(F.struct(cx.alias("x"), cy.alias("y")), keyed)), lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y")))


def shifted(p: Column) -> Column:
    """Each point's successor around the ring."""
    return F.concat(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def _ring_sum(p: Column, f) -> Column:
    return F.aggregate(F.zip_with(p, shifted(p), f), F.lit(0.0), lambda a, x: a + x)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(p: Column) -> Column:
    return _ring_sum(p, _cross) / 2


def area(p: Column) -> Column:
    return F.abs(signed_area(p))


def perimeter(p: Column) -> Column:
    return _ring_sum(p, lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], F.lit(2)) + F.pow(b["y"] - a["y"], F.lit(2))))


def centroid(p: Column, compat: bool = False) -> tuple[Column, Column]:
    """Centre of mass; ``compat`` divides by the unsigned area, which negates it for clockwise rings (Q1)."""
    a = F.nullif(area(p) if compat else signed_area(p), F.lit(0.0))
    mean = lambda c: _ring_sum(p, lambda s, t: (s[c] + t[c]) * _cross(s, t)) / (6 * a)
    return mean("x"), mean("y")


def bounding_box(p: Column) -> Column:
    pick = lambda f, c: f(F.transform(p, lambda q: q[c]))
    return F.struct(pick(F.array_min, "x").alias("x_min"), pick(F.array_min, "y").alias("y_min"), pick(F.array_max, "x").alias("x_max"), pick(F.array_max, "y").alias("y_max"))


def xywh(box: Column) -> Column:
    return F.struct(box["x_min"].alias("x"), box["y_min"].alias("y"), (box["x_max"] - box["x_min"]).alias("w"), (box["y_max"] - box["y_min"]).alias("h"))


def _away(p: Column, m: dict[str, Column]) -> Column:
    """Distance from a point to each corner."""
    return F.transform(p, lambda q: F.sqrt(F.pow(q["x"] - m["x"], F.lit(2)) + F.pow(q["y"] - m["y"], F.lit(2))))


def _edge_gap(p: Column, m: dict[str, Column]) -> Column:
    """Least distance from a point to the edges."""

    def edge(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((m["x"] - a["x"]) * dx + (m["y"] - a["y"]) * dy) / size))).otherwise(0.0)
        return F.sqrt(F.pow(m["x"] - a["x"] - t * dx, F.lit(2)) + F.pow(m["y"] - a["y"] - t * dy, F.lit(2)))

    return F.array_min(F.zip_with(p, shifted(p), edge))


def convex_hull(p: Column) -> Column:
    """Corners of the hull from the least point, without points on its edges; fewer than three points as they are.

    Monotone chain: the stack is the state of a fold over the sorted points.
    Along a convex chain the turns towards a new point are right up to some
    corner and wrong from there on, so popping keeps a prefix: a filter.
    """
    stack = "array<struct<x:double,y:double>>"

    def half(points: Column) -> Column:
        def push(s: Column, q: Column) -> Column:
            def right(c: Column, i: Column) -> Column:
                b = F.get(s, i - 1)
                return (i == 0) | ((c["x"] - b["x"]) * (q["y"] - b["y"]) - (c["y"] - b["y"]) * (q["x"] - b["x"]) < 0)

            return F.concat(F.filter(s, right), F.array(q))

        return F.aggregate(points, F.array().cast(stack), push)

    def ring(points: Column) -> Column:
        there, back = half(points), half(F.reverse(points))
        but_last = lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))
        return F.when(F.size(points) < 3, points).otherwise(F.concat(let(there, but_last), let(back, but_last)))

    return let(F.array_sort(F.array_distinct(p)).cast(stack), ring)


def max_feret(p: Column, hull: Column | None = None) -> Column:
    """Largest distance between two points; both are corners of the hull."""
    hull = convex_hull(p) if hull is None else hull
    far = let(hull, lambda h: F.array_max(F.transform(h, lambda a: F.array_max(F.transform(h, lambda b: F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))))))
    return F.sqrt(far)


def min_feret(p: Column, hull: Column | None = None) -> Column:
    """Least width over the directions of the edges; the point farthest from an edge is a corner of the hull."""
    hull = convex_hull(p) if hull is None else hull

    def of(h: Column) -> Column:
        def width(a: Column, b: Column) -> Column:
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            size = F.sqrt(dx * dx + dy * dy)
            return F.when(size > 0, F.array_max(F.transform(h, lambda q: F.abs(dx * (q["y"] - a["y"]) - dy * (q["x"] - a["x"])))) / size)

        return F.array_min(F.filter(F.zip_with(p, shifted(p), width), lambda w: w.isNotNull() & (w > 1.1920928955078125e-07)))

    return F.coalesce(let(hull, of), F.lit(0.0))


def closed(p: Column) -> Column:
    """The ring with its first point at the end, once."""
    return F.when(F.get(p, F.lit(0)) == F.element_at(p, -1), p).otherwise(F.concat(p, F.slice(p, 1, 1)))


def resample(p: Column, n: int) -> Column:
    """n points at equal distances along the closed ring, the last the first; a ring of no length repeats its point.

    The lengths up to each corner and the n targets are merged: a segment holds the targets
    that lie on it, a range of numbers.
    """

    def of(ring: Column) -> Column:
        parts = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.sqrt(F.pow(b["x"] - a["x"], F.lit(2)) + F.pow(b["y"] - a["y"], F.lit(2))).alias("d")))

        def laid(s: Column) -> Column:
            ends = F.aggregate(s, F.array(F.lit(0.0)), lambda t, q: F.concat(t, F.array(F.element_at(t, -1) + q["d"])))

            def merged(e: Column) -> Column:
                total = F.element_at(e, -1)
                step = total / (n - 1)

                def on(q: Column, k: Column) -> Column:
                    here = F.get(e, k)
                    first = F.when(k == 0, F.lit(0)).otherwise(F.least(F.floor(here / step), F.lit(n - 1)) + 1)
                    last = F.when(k == F.size(s) - 1, F.lit(n - 1)).otherwise(F.least(F.floor(F.get(e, k + 1) / step), F.lit(n - 1)))
                    share = lambda i: F.least(F.greatest((i * step - here) / F.nullif(q["d"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
                    at = lambda i, c: q["a"][c] + F.coalesce(share(i), F.lit(0.0)) * (q["b"][c] - q["a"][c])
                    some = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
                    return F.transform(some, lambda i: F.struct(at(i, "x").alias("x"), at(i, "y").alias("y")))

                return F.when(total > 0, F.flatten(F.transform(s, on))).otherwise(F.array_repeat(F.get(ring, F.lit(0)), n))

            return let(ends, merged)

        return let(parts, laid)

    return let(closed(p), of)


#: Points that an ellipse is fitted to, at least; a pivot of the normal equations up to which points lie on a line or a pair of lines.
ELLIPSE_POINTS, SINGULAR = 32, 1e-9


def ellipse(p: Column) -> Column:
    """struct<major, minor, eccentricity> of the conic a x2 + b xy + c y2 + d x + e y = 1 of least squares; null where that is no ellipse.

    Rings of fewer points than ``ELLIPSE_POINTS`` are resampled; points are
    taken from their mean, in units of the farthest, so the sums of the normal equations
    are of one size, and these are solved by Gauss-Jordan elimination, as a fold over the columns.
    """
    point = "array<struct<x:double,y:double>>"
    ring = let(closed(p), lambda r: F.when(F.size(r) < ELLIPSE_POINTS, resample(r, ELLIPSE_POINTS)).otherwise(r)).cast(point)

    def centred(r: Column) -> Column:
        n = F.size(r) - 1
        mean = lambda c: F.aggregate(F.slice(r, F.lit(2), n), F.lit(0.0), lambda s, q: s + q[c]) / n
        return let(F.struct(mean("x").alias("x"), mean("y").alias("y")), lambda m: F.transform(r, lambda q: F.struct((q["x"] - m["x"]).alias("x"), (q["y"] - m["y"]).alias("y"))))

    def scaled(r: Column) -> Column:
        unit = F.array_max(F.transform(r, lambda q: F.greatest(F.abs(q["x"]), F.abs(q["y"]))))
        return let(F.nullif(unit, F.lit(0.0)), lambda u: F.struct(u.alias("unit"), F.transform(r, lambda q: F.struct((q["x"] / u).alias("x"), (q["y"] / u).alias("y"))).alias("r")))

    powers = ((2, 0), (1, 1), (0, 2), (1, 0), (0, 1))

    def solved(z: Column) -> Column:
        def monomial(q: Column, i: int, j: int) -> Column:
            out = F.lit(1.0)
            for c in ("x",) * i + ("y",) * j:
                out = out * q[c]
            return out

        total = lambda i, j: F.aggregate(z["r"], F.lit(0.0), lambda s, q: s + monomial(q, i, j))
        sums = {(i, j): F.lit(0.0) for i in range(5) for j in range(5)} | {(i, j): total(i, j) for i in range(5) for j in range(5) if 0 < i + j <= 4}
        rows = F.array(*(sums[a[0] + b[0], a[1] + b[1]] for a in powers for b in (*powers, (0, 0))))

        def step(m: Column, k: Column) -> Column:
            at = lambda i, j: F.get(m, (i * 6 + j).cast("int"))
            pivot = F.when(at(k, k) > SINGULAR, at(k, k))
            return F.transform(m, lambda v, t: F.when(F.floor(t / 6) == k, v / pivot).otherwise(v - at(F.floor(t / 6), k) * at(k, F.pmod(t, F.lit(6))) / pivot))

        return let(F.aggregate(F.array(*(F.lit(k).cast("long") for k in range(5))), rows, step), lambda m: axes(m, z["unit"]))

    def axes(m: Column, unit: Column) -> Column:
        a, b, c, d, e = (F.get(m, F.lit(6 * k + 5)) for k in range(5))
        # middle of the conic, its level there, and the eigenvalues of its quadratic form
        det = F.nullif(4 * a * c - b * b, F.lit(0.0))
        x, y = (b * e - 2 * c * d) / det, (b * d - 2 * a * e) / det
        level = 1 + a * x * x + b * x * y + c * y * y
        half = lambda f: F.struct(((a + c) / 2 - f / 2).alias("low"), ((a + c) / 2 + f / 2).alias("high"), level.alias("level"))

        def lengths(v: Column) -> Column:
            p, q = v["level"] / F.nullif(v["low"], F.lit(0.0)), v["level"] / F.nullif(v["high"], F.lit(0.0))
            big, small = F.greatest(p, q), F.least(p, q)
            return F.when(small > 0, F.struct((2 * unit * F.sqrt(big)).alias("major"), (2 * unit * F.sqrt(small)).alias("minor"), F.sqrt(1 - small / big).alias("eccentricity")))

        return let(half(F.sqrt((a - c) * (a - c) + b * b)), lengths)

    return let(let(let(ring, centred), scaled), solved)


def form_simple(objects: DataFrame, poly: str = "poly", compat: bool = False) -> DataFrame:
    """Adds every form descriptor that needs no hull or fit."""
    p = F.col(poly)
    cx, cy = centroid(p, compat)
    mx, my = mean_point(p)
    box = bounding_box(p)
    out = settled(objects, {"form_centroid_x": cx, "form_centroid_y": cy, "form_center_x": mx, "form_center_y": my, "form_area": area(p), "form_perimeter": perimeter(p), "__w": box["x_max"] - box["x_min"], "__h": box["y_max"] - box["y_min"]})
    a, length, w, h = (F.col(c) for c in ("form_area", "form_perimeter", "__w", "__h"))
    none = F.lit(0.0)
    thread = (length + F.sqrt(F.greatest(length * length - 16 * a, none))) / 4
    middle = {"x": F.col("form_centroid_x"), "y": F.col("form_centroid_y")}
    out = settled(out, {"__edge": _edge_gap(p, middle), "__away": _away(p, middle)})
    return out.withColumns(
        {
            "form_area_bbox": w * h,
            "form_elongation": F.least(w, h) / F.nullif(F.greatest(w, h), none),
            "form_thread_length": thread,
            "form_thread_width": a / F.nullif(thread, none),
            "form_extent": a / F.nullif(w * h, none),
            "form_form_factor": 4 * math.pi * a / F.nullif(length * length, none),
            "form_equivalent_diameter": 2 * F.sqrt(a / math.pi),
            "form_minimum_radius": F.col("__edge"),
            "form_maximum_radius": F.array_max("__away"),
            "form_mean_radius": F.aggregate("__away", none, lambda s, x: s + x) / F.size(p),
        }
    ).drop("__w", "__h", "__edge", "__away")


def form(objects: DataFrame, poly: str = "poly", compat: bool = False) -> DataFrame:
    """Adds all 23 form descriptors."""
    p = F.col(poly)
    out = settled(form_simple(objects, poly, compat), {"__hull": convex_hull(p), "__e": ellipse(p)})
    hull, e = F.col("__hull"), F.col("__e")
    out = settled(out, {"form_area_convex": area(hull), "form_min_feret": min_feret(p, hull), "form_max_feret": max_feret(p, hull)})
    none = F.lit(0.0)
    return out.withColumns(
        {"form_solidity": F.col("form_area") / F.nullif("form_area_convex", none), "form_major_axis": e["major"], "form_minor_axis": e["minor"], "form_eccentricity": e["eccentricity"]}
    ).drop("__hull", "__e")


# --- boxes ------------------------------------------------------------------


def object_crops(objects: DataFrame, pad: int = 1, min_size: int = 1, compat: bool = False) -> DataFrame:
    """(…, crop): boxes padded, cut to the image and filtered at its border and by size.

    ``objects`` has bbox, width and height.  Clean boxes include their last
    pixel and are tested unpadded; ``compat`` keeps Q6 and Q7.
    """
    b, w, h = F.col("bbox"), F.col("width"), F.col("height")
    last = 0 if compat else 1
    x0, y0, x1, y1 = b["x_min"] - pad, b["y_min"] - pad, b["x_max"] + last + pad, b["y_max"] + last + pad
    border = (x0 <= 0) | (y0 <= 0) | (x1 >= w) | (y1 >= h) if compat else (b["x_min"] <= 0) | (b["y_min"] <= 0) | (b["x_max"] >= w - 1) | (b["y_max"] >= h - 1)
    ax, ay = F.greatest(x0, F.lit(0)).cast("int"), F.greatest(y0, F.lit(0)).cast("int")
    bx, by = F.least(x1, w).cast("int"), F.least(y1, h).cast("int")
    out = objects.where(~border).withColumn("crop", F.struct(ax.alias("x"), ay.alias("y"), (bx - ax).alias("w"), (by - ay).alias("h")))
    return out.where((F.col("crop.w") >= max(1, min_size)) & (F.col("crop.h") >= max(1, min_size)))


def box_descriptors(box: Column) -> dict[str, Column]:
    w, h = box["x_max"] - box["x_min"], box["y_max"] - box["y_min"]
    return {"bbox_width": w, "bbox_height": h, "bbox_area": w * h}


# --- JSON -------------------------------------------------------------------


def parse_polygons(text: Column, keys: tuple[str, ...]) -> Column:
    """array<array<struct<x, y>>> of the first key that holds polygons of two numbers a point; null if none does."""

    def of(key: str) -> Column:
        raw = F.from_json(F.get_json_object(text, f"$.{key}"), "array<array<array<double>>>")
        good = F.forall(raw, lambda p: p.isNotNull() & F.forall(p, lambda q: (F.size(q) == 2) & F.forall(q, lambda v: v.isNotNull())))
        return F.when(raw.isNotNull() & good, F.transform(raw, lambda p: F.transform(p, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))))

    return F.coalesce(*(of(k) for k in keys))


def parse_boxes(text: Column, keys: tuple[str, ...]) -> Column:
    """array<struct<x_min, y_min, x_max, y_max>> of the first key that holds arrays of four numbers."""

    def of(key: str) -> Column:
        raw = F.from_json(F.get_json_object(text, f"$.{key}"), "array<array<double>>")
        good = F.forall(raw, lambda b: b.isNotNull() & (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull()))
        return F.when(raw.isNotNull() & good, F.transform(raw, lambda b: F.struct(b[0].alias("x_min"), b[1].alias("y_min"), b[2].alias("x_max"), b[3].alias("y_max"))))

    return F.coalesce(*(of(k) for k in keys))
