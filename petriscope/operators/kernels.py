"""numpy kernels over one image, mask or polygon.

Images are (height, width, channels) arrays, masks (height, width), polygons
(n, 2) arrays of x, y.  ``compat`` gives the historical result where that
differs from the clean definition; each such place names its quirk.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from ..schema import ZERNIKE_ORDERS

EPS = float(np.finfo(np.float32).eps)


# --- pixels -----------------------------------------------------------------


def cast(values: np.ndarray, dtype: str) -> np.ndarray:
    """Conversion to another pixel type: fractions are cut, what doesn't fit becomes 0."""
    to = np.dtype(dtype)
    if to.kind == "f":
        return values.astype(to)
    v = np.trunc(values.astype(np.float64)) if values.dtype.kind == "f" else values
    info = np.iinfo(to)
    # float64 can't hold the largest 64-bit integers: compare with the next power of two
    fits = (v >= float(info.min)) & (v < float(info.max) + 1 if info.bits == 64 else v <= info.max) if v.dtype.kind == "f" else (v >= info.min) & (v <= info.max)
    return np.where(fits, v, 0).astype(to)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int, clamp: bool = False) -> np.ndarray:
    """The part at (x, y); beyond the edge it is cut (``clamp``) or an error."""
    height, width = image.shape[:2]
    if not clamp and (x < 0 or y < 0 or w < 0 or h < 0 or x + w > width or y + h > height):
        raise ValueError("crop is out of bounds")
    x, y = min(max(x, 0), width), min(max(y, 0), height)
    return image[y : min(y + max(h, 0), height), x : min(x + max(w, 0), width)]


def crop_masked(image: np.ndarray, mask: np.ndarray, background: bool = False) -> np.ndarray:
    """Pixels outside (or, for ``background``, inside) the mask become 0."""
    keep = (mask == 0) if background else (mask != 0)
    return np.where(keep[:, :, None], image, 0).astype(image.dtype)


def interleaved(image: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Values with x and y as the old multi-channel code numbered them (quirk Q3)."""
    flat = image.reshape(-1)
    i = np.arange(len(flat))
    return [(flat, i % image.shape[1], i // image.shape[1])]


# --- intensity --------------------------------------------------------------


def intensity_channels(image: np.ndarray, compat: bool = False) -> np.ndarray:
    """(channels, 5): min, max, sum, mean, std of the positive values of each channel, 0 if there are none."""
    out = np.zeros((image.shape[2], 5))
    for c in range(image.shape[2]):
        all_ = image[:, :, c].astype(np.float64).ravel()
        v = all_[all_ > 0]
        if len(v):
            mean = v.mean()
            spread = all_ if compat else v  # Q4: the whole-image form let other pixels into the spread
            out[c] = v.min(), v.max(), v.sum(), mean, math.sqrt(((spread - mean) ** 2).sum() / len(v))
    return out


def intensity(image: np.ndarray, compat: bool = False) -> np.ndarray:
    """min, max, sum, mean, std (means over channels), and median, mad of all channels' positive values."""
    per = intensity_channels(image)
    v = image.astype(np.float64).ravel()
    v = v[v > 0]
    median = float(np.median(v)) if len(v) else 0.0
    mad = float(np.median(np.abs(v - median))) if len(v) else 0.0
    if compat and image.shape[2] > 1:  # Q2: the last channel's share only, and the mean again for the spread
        five = per[-1, [0, 1, 2, 3, 3]] / image.shape[2]
    else:
        five = per.mean(0)
    return np.array([*five, median, mad])


# --- moments ----------------------------------------------------------------


def _moments(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    keep = v > 0
    v, x, y = v[keep], x[keep].astype(np.float64), y[keep].astype(np.float64)
    powers = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (3, 0), (0, 3))
    return np.array([(v * x**p * y**q).sum() for p, q in powers])


def central_moments(raw: np.ndarray) -> np.ndarray:
    """u11, u20, u02, u21, u12, u30, u03 from the raw moments; 0 without mass."""
    m00, m10, m01, m11, m20, m02, m21, m12, m30, m03 = raw
    if m00 == 0:
        return np.zeros(7)
    x, y = m10 / m00, m01 / m00
    return np.array(
        [
            m11 - x * m01,
            m20 - x * m10,
            m02 - y * m01,
            m21 - 2 * x * m11 - y * m20 + 2 * x * x * m01,
            m12 - 2 * y * m11 - x * m02 + 2 * y * y * m10,
            m30 - 3 * x * m20 + 2 * x * x * m10,
            m03 - 3 * y * m02 + 2 * y * y * m01,
        ]
    )


def hu_moments(m00: float, u: np.ndarray) -> np.ndarray:
    """The seven invariants."""
    if m00 == 0:
        return np.zeros(7)
    scale = np.array([m00**2, m00**2, m00**2, m00**2.5, m00**2.5, m00**2.5, m00**2.5])
    n11, n20, n02, n21, n12, n30, n03 = u / scale
    p, q, r, z, y = n20 - n02, n30 - 3 * n12, n30 + n12, n21 + n03, 3 * n21 - n03
    a, b = r * (r * r - 3 * z * z), z * (3 * r * r - z * z)
    return np.array([n20 + n02, p * p + 4 * n11 * n11, q * q + y * y, r * r + z * z, q * a + y * b, p * (r * r - z * z) + 4 * n11 * r * z, y * a - q * b])


def moments(image: np.ndarray, compat: bool = False) -> np.ndarray:
    """24 moments; those of several channels are averaged."""
    h, w, channels = image.shape
    y, x = np.divmod(np.arange(h * w), max(w, 1))
    parts = interleaved(image) if compat else [(image[:, :, c].ravel(), x, y) for c in range(channels)]
    out = []
    for part in parts:
        raw = _moments(*part)
        u = central_moments(raw)
        out.append(np.concatenate([raw, u, hu_moments(raw[0], u)]))
    return np.mean(out, 0)


# --- texture ----------------------------------------------------------------

LEVELS = 64
OFFSETS = {0: (1, 0), 45: (1, 1), 90: (0, 1), 135: (-1, 1)}


def glcm(channel: np.ndarray, angle: int = 0, distance: int = 1) -> np.ndarray:
    """Symmetric co-occurrence of 64 grey levels at an offset, as shares; all NaN without any pair (Q5)."""
    v = channel.astype(np.float64)
    low, high = (v.min(), v.max()) if v.size else (0, 0)
    level = np.floor((v - low) / (high - low) * (LEVELS - 1) + 0.5).astype(np.int64) if high > low else np.zeros(v.shape, np.int64)
    dx = int(math.floor(math.cos(math.radians(angle)) * distance + 0.5)) if math.cos(math.radians(angle)) >= 0 else -int(math.floor(-math.cos(math.radians(angle)) * distance + 0.5))
    dy = int(math.floor(math.sin(math.radians(angle)) * distance + 0.5))
    h, w = v.shape
    a = level[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
    b = level[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    if not a.size:
        return np.full((LEVELS, LEVELS), np.nan)
    count = np.bincount((a * LEVELS + b).ravel(), minlength=LEVELS * LEVELS).reshape(LEVELS, LEVELS)
    both = count + count.T
    return both / both.sum()


def haralick(p: np.ndarray) -> np.ndarray:
    """The 13 features of a co-occurrence matrix."""
    n = len(p)
    i, j = np.indices(p.shape)
    px, py = p.sum(1), p.sum(0)
    k = np.arange(1, n + 1)
    mx, my = (k * px).sum(), (k * py).sum()
    vx, vy = ((k - mx) ** 2 * px).sum(), ((k - my) ** 2 * py).sum()
    plus = np.bincount((i + j).ravel(), p.ravel(), 2 * n - 1)
    minus = np.bincount(np.abs(i - j).ravel(), p.ravel(), n)
    s = np.arange(2 * n - 1)
    mean_sum = (s * plus).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        correlation = ((i + 1 - mx) * (j + 1 - my) * p).sum() / np.sqrt(vx * vy)
        outer = np.outer(px, py)
        hx, hy = -(px * np.log2(px + EPS)).sum(), -(py * np.log2(py + EPS)).sum()
        hxy, hxy2 = (p * np.log2(p + EPS)).sum(), (outer * np.log2(outer + EPS)).sum()
        info1 = (hxy2 - hxy) / max(hx, hy)
        info2 = np.sqrt(max(0.0, 1 - np.exp(-2 * (hxy - hxy2)))) if not np.isnan(hxy) else np.nan
    return np.array(
        [
            (p * p).sum(),
            ((i - j) ** 2 * p).sum(),
            correlation,
            ((i + 1 - mx) ** 2 * p).sum(),
            (p / (1 + (i - j) ** 2)).sum(),
            mean_sum,
            (s * s * plus).sum() - mean_sum**2,
            -(plus * np.log2(plus + np.where(plus <= EPS, 1, 0))).sum(),
            -(p * np.log2(p + EPS)).sum(),
            minus.var(),
            -(minus * np.log2(minus + EPS)).sum(),
            info1,
            info2,
        ]
    )


def texture(image: np.ndarray) -> np.ndarray:
    """Features averaged over four angles and all channels."""
    return np.mean([haralick(glcm(image[:, :, c], a)) for a in OFFSETS for c in range(image.shape[2])], 0)


# --- Zernike ----------------------------------------------------------------


def radial_polynomial(n: int, m: int, r):
    f = math.factorial
    return sum((-1) ** s * f(n - s) / (f(s) * f((n + m) // 2 - s) * f((n - m) // 2 - s)) * np.power(r, n - 2 * s) for s in range((n - m) // 2 + 1))


@lru_cache(maxsize=64)
def zernike_basis(w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """(basis, inside): conjugate polynomials of the pixels inside the unit disk, one row per order."""
    y, x = np.divmod(np.arange(w * h), w)
    x, y = (x - w / 2) / (w / 2), (y - h / 2) / (h / 2)
    r, t = np.hypot(x, y), np.arctan2(y, x)
    inside = r <= 1
    r, t = r[inside], t[inside]
    return np.array([radial_polynomial(n, m, r) * np.exp(-1j * m * t) for n, m in ZERNIKE_ORDERS]), inside


def _zernike(values: np.ndarray, w: int, h: int) -> np.ndarray:
    basis, inside = zernike_basis(w, h)
    f = values.astype(np.float64)[inside]
    mass = f.sum()
    if not len(f) or mass == 0:
        return np.zeros(len(ZERNIKE_ORDERS))
    return np.abs(basis @ (f / mass)) * (np.array([n for n, _ in ZERNIKE_ORDERS]) + 1) / math.pi


def zernike(image: np.ndarray, compat: bool = False) -> np.ndarray:
    """30 magnitudes up to order 9, averaged over channels."""
    h, w, channels = image.shape
    if compat and channels > 1:  # Q3
        wide = np.zeros(w * h * channels)
        wide[:] = image.reshape(-1)
        y, x = np.divmod(np.arange(len(wide)), w)
        x, y = (x - w / 2) / (w / 2), (y - h / 2) / (h / 2)
        r, t = np.hypot(x, y), np.arctan2(y, x)
        f = np.where(r <= 1, wide, 0)
        mass = f.sum()
        return np.array([abs((n + 1) / math.pi * (f / mass * radial_polynomial(n, m, r) * np.exp(-1j * m * t)).sum()) if mass else 0.0 for n, m in ZERNIKE_ORDERS])
    return np.mean([_zernike(image[:, :, c].ravel(), w, h) for c in range(channels)], 0)


# --- connected components, contours -----------------------------------------


def connected_components(mask: np.ndarray) -> np.ndarray:
    """8-connected components of the non-zero pixels, numbered from 1 in raster order of their first pixel.

    Runs of each row are linked with those they touch in the row above.
    """
    h, w = mask.shape
    on = np.zeros((h, w + 2), np.int8)
    on[:, 1:-1] = mask != 0
    step = np.diff(on, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    parent = np.arange(len(row))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        for k in range(first[y], first[y + 1]):
            while a < b and end[a] < start[k]:
                a += 1
            t = a
            while t < b and start[t] <= end[k]:
                p, q = root(t), root(k)
                parent[max(p, q)] = min(p, q)
                t += 1
    roots = np.array([root(k) for k in range(len(row))], np.int64)
    _, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w), np.int64)
    for k in range(len(row)):
        out[row[k], start[k] : end[k]] = number[k] + 1
    return out


#: Neighbours clockwise from the left one, as (dx, dy) with y downwards.
_AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def trace_border(on: np.ndarray, x: int, y: int) -> np.ndarray:
    """Outer border of the component whose first pixel in raster order is (x, y), by border following."""
    h, w = on.shape

    def filled(px: int, py: int) -> bool:
        return 0 <= px < w and 0 <= py < h and bool(on[py, px])

    second = next((d for d in range(8) if filled(x + _AROUND[d][0], y + _AROUND[d][1])), None)
    if second is None:
        return np.array([[x, y]])
    origin, last = (x, y), (x + _AROUND[second][0], y + _AROUND[second][1])
    here, back = origin, second
    points = []
    while True:
        points.append(here)
        for k in range(1, 9):
            d = (back - k) % 8
            there = (here[0] + _AROUND[d][0], here[1] + _AROUND[d][1])
            if filled(*there):
                break
        if there == origin and here == last:
            return np.array(points)
        here, back = there, (d + 4) % 8


def find_contours(mask: np.ndarray) -> list[np.ndarray]:
    """Outer borders of all components, in raster order."""
    labels = connected_components(mask)
    flat = labels.ravel()
    seen, at = np.unique(flat, return_index=True)
    return [trace_border(labels == k, i % mask.shape[1], i // mask.shape[1]) for k, i in zip(seen, at, strict=True) if k]


def label_mask(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label image, ascending labels): a mask of one value is split into components, any other is labelled already."""
    values = np.unique(mask)
    values = values[values != 0]
    if len(values) == 1:
        mask = connected_components(mask)
        values = np.unique(mask)
        values = values[values != 0]
    return mask, values


def label_polygons(mask: np.ndarray) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """(label image, labels, polygons): of each label its longest outer border of over two points."""
    labels, values = label_mask(mask)
    out, names = [], []
    if len(values):
        ys, xs = np.nonzero(labels)
        which = np.searchsorted(values, labels[ys, xs])
        x0, y0 = np.full(len(values), 1 << 60), np.full(len(values), 1 << 60)
        x1, y1 = np.full(len(values), -1), np.full(len(values), -1)
        np.minimum.at(x0, which, xs), np.minimum.at(y0, which, ys)
        np.maximum.at(x1, which, xs), np.maximum.at(y1, which, ys)
        for k, value in enumerate(values):
            part = labels[y0[k] : y1[k] + 1, x0[k] : x1[k] + 1] == value
            borders = find_contours(part)
            longest = max(range(len(borders)), key=lambda b: (len(borders[b]), b))
            if len(borders[longest]) > 2:
                names.append(int(value))
                out.append(borders[longest].astype(np.float64) + [x0[k], y0[k]])
    return labels, names, out


# --- polygons ---------------------------------------------------------------


def dedup_points(p: np.ndarray) -> np.ndarray:
    """Sorted by x, then y; repeated points once."""
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    new = np.ones(len(p), bool)
    new[1:] = (np.abs(np.diff(p, axis=0)) > EPS).any(1)
    return p[new]


def order_points(p: np.ndarray) -> np.ndarray:
    """By descending angle around the mean, nearer ones first."""
    d = p - p.mean(0)
    return p[np.lexsort((np.hypot(d[:, 0], d[:, 1]), -np.arctan2(d[:, 1], d[:, 0])))]


def closed(p: np.ndarray) -> np.ndarray:
    return p if len(p) > 1 and (p[0] == p[-1]).all() else np.concatenate([p, p[:1]])


def opened(p: np.ndarray) -> np.ndarray:
    return p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p


def resample_points(p: np.ndarray, n: int) -> np.ndarray:
    """n points at equal distances along the closed path; the last is the first.  A path of no length repeats its point."""
    ring = closed(p)
    along = np.r_[0, np.cumsum(np.hypot(*np.diff(ring, axis=0).T))]
    if along[-1] == 0:
        return np.repeat(ring[:1], n, 0)
    at = np.linspace(0, along[-1], n)
    return np.stack([np.interp(at, along, ring[:, k]) for k in (0, 1)], 1)


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Corners of the hull from the least point, without points on its edges."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) >= 0:
                out.pop()
            out.append(q)
        return out

    upper, lower = half(p), half(p[::-1])
    return np.array(upper[:-1] + lower[:-1])


def signed_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def segment_distance(point: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of a point to segments."""
    d = b - a
    size = (d * d).sum(-1)
    t = np.clip(np.where(size > 0, ((point - a) * d).sum(-1) / np.where(size > 0, size, 1), 0), 0, 1)
    return np.hypot(*(point - (a + t[..., None] * d)).T)


def fit_ellipse(p: np.ndarray) -> np.ndarray:
    """major axis, minor axis, eccentricity, angle of the least-squares conic; NaN if that is no ellipse."""
    ring = closed(p)
    if len(ring) < 32:
        ring = resample_points(p, 32)
    ring = ring - ring[1:].mean(0)
    x, y = ring.T
    (a, b, c, d, e), *_ = np.linalg.lstsq(np.stack([x * x, x * y, y * y, x, y], 1), np.ones(len(x)), rcond=1e-8)
    form = np.array([[a, b / 2], [b / 2, c]])
    with np.errstate(all="ignore"):
        if abs(np.linalg.det(form)) < 1e-300:
            return np.full(4, np.nan)
        middle = np.linalg.solve(-2 * form, [d, e])
        level = 1 + middle @ form @ middle
        values, vectors = np.linalg.eigh(form)
        half = np.sqrt(level / values)
        big = int(np.nanargmax(half)) if not np.isnan(half).all() else 0
        major, minor = half[big], half[1 - big]
        angle = math.atan2(vectors[1, big], vectors[0, big]) % math.pi
        return np.array([2 * major, 2 * minor, math.sqrt(1 - (minor / major) ** 2) if minor <= major else np.nan, angle])


def feret(p: np.ndarray) -> tuple[float, float]:
    """(least, largest) width of the polygon: over edges and over pairs of corners."""
    q = np.roll(p, -1, 0)
    edge = q - p
    size = np.hypot(*edge.T)
    ok = size > 0
    edge, at, size = edge[ok], p[ok], size[ok]
    least = math.inf
    for k in range(0, len(edge), 512):
        d = p[None] - at[k : k + 512, None]
        width = np.abs(edge[k : k + 512, None, 0] * d[..., 1] - edge[k : k + 512, None, 1] * d[..., 0]).max(1) / size[k : k + 512]
        width = width[width > EPS]
        least = min(least, width.min(initial=math.inf))
    hull = convex_hull(p)
    gap = hull[:, None] - hull[None]
    return (0.0 if math.isinf(least) else float(least)), float(np.sqrt((gap**2).sum(-1)).max())


def form(points: np.ndarray, compat: bool = False, ordered: bool = True) -> np.ndarray:
    """The 23 form descriptors of a polygon.

    As everywhere, points are first deduplicated and put in angular order
    (``ordered``).  With ``compat`` the centroid divides by the unsigned area
    and so is negated by that order, radii included (Q1).
    """
    p = order_points(dedup_points(points)) if ordered else opened(points)
    q = np.roll(p, -1, 0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    signed = cross.sum() / 2
    area = abs(signed)
    width, height = p.max(0) - p.min(0)
    box, hull = width * height, abs(signed_area(convex_hull(p)))
    length = np.hypot(*(q - p).T).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        centroid = ((p + q) * cross[:, None]).sum(0) / (6 * np.float64(area if compat else signed))
        center = p.mean(0)
        ratio = np.float64(min(width, height)) / max(width, height)
        thread = (length + math.sqrt(max(length**2 - 16 * area, 0))) / 4
        major, minor, eccentricity, _ = fit_ellipse(p)
        radii = np.hypot(*(p - centroid).T)
        small, large = feret(p)
        return np.array(
            [
                *centroid, *center, area, box, hull, length, ratio, thread, np.float64(area) / thread, np.float64(area) / hull, np.float64(area) / box,
                4 * math.pi * area / np.float64(length) ** 2, 2 * math.sqrt(area / math.pi), eccentricity, major, minor,
                segment_distance(centroid, p, q).min(), radii.max(), radii.mean(), small, large,
            ]
        )


def bounding_box(p: np.ndarray) -> tuple[float, float, float, float]:
    return (*p.min(0), *p.max(0))  # type: ignore[return-value]


def fill_polygon(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """0/1 mask of the pixels inside or on the outline of a polygon.

    Inside: even-odd crossings of the pixel's row; outline: every edge sampled
    once per pixel of its longer side.
    """
    out = np.zeros((height, width), np.uint8)
    p = np.trunc(points)
    q = np.roll(p, -1, 0)
    y = np.arange(height)[:, None]
    up = (p[:, 1] <= y) & (q[:, 1] > y) | (q[:, 1] <= y) & (p[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0])
    row, edge = np.nonzero(up)
    x = np.ceil(at[row, edge]).astype(np.int64)
    flips = np.zeros((height, width + 1), np.int64)
    np.add.at(flips, (row, np.clip(x, 0, width)), 1)
    out[np.cumsum(flips, 1)[:, :width] % 2 == 1] = 1
    steps = np.maximum(np.abs(q - p).max(1), 1).astype(np.int64)
    of = np.repeat(np.arange(len(p)), steps + 1)
    t = (np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(steps + 1)][:-1], steps + 1)) / steps[of]
    line = np.floor(p[of] + t[:, None] * (q - p)[of] + 0.5).astype(np.int64)
    ok = (line >= 0).all(1) & (line[:, 0] < width) & (line[:, 1] < height)
    out[line[ok, 1], line[ok, 0]] = 1
    return out


def draw_points(points: np.ndarray, pad: int = 0) -> np.ndarray:
    """The polygon on a canvas of its own size and ``pad`` on every side."""
    p = np.trunc(points)
    low = p.min(0)
    w, h = (p.max(0) - low + 1 + 2 * pad).astype(int)
    return fill_polygon(p - low + pad, w, h)


def draw_centered(points: np.ndarray, width: int, height: int, pad: int = 0) -> np.ndarray:
    """The polygon scaled to fit a canvas, sides in proportion, and put in its middle (the old masks of polygons, Q9)."""
    p = points - points.min(0)
    size = np.maximum(p.max(0), 1)
    inner = np.maximum(np.array([width, height]) - 2 * pad - 1, 1)
    p = p * (inner / size).min()
    return fill_polygon(p + (np.array([width, height]) - 1 - p.max(0)) / 2, width, height)


# --- boxes ------------------------------------------------------------------


def object_crop(box, width: int, height: int, pad: int, min_size: int, compat: bool = False) -> tuple[int, int, int, int] | None:
    """(x, y, w, h) of an object's crop, or None if it is filtered.

    A box that touches the image border, or whose crop is smaller than
    ``min_size``, is filtered.  ``compat`` takes inclusive ends for exclusive
    ones and tests the padded box (Q6, Q7).
    """
    x0, y0, x1, y1 = map(float, box)
    if compat:
        lo_x, lo_y, hi_x, hi_y = x0 - pad, y0 - pad, x1 + pad, y1 + pad
        if lo_x <= 0 or lo_y <= 0 or hi_x >= width or hi_y >= height:
            return None
    else:
        lo_x, lo_y, hi_x, hi_y = x0 - pad, y0 - pad, x1 + 1 + pad, y1 + 1 + pad
        if x0 <= 0 or y0 <= 0 or x1 >= width - 1 or y1 >= height - 1:
            return None
    ax, ay, bx, by = int(max(lo_x, 0)), int(max(lo_y, 0)), int(min(hi_x, width)), int(min(hi_y, height))
    w, h = bx - ax, by - ay
    return (ax, ay, w, h) if w >= max(min_size, 1) and h >= max(min_size, 1) else None


# --- resizing ---------------------------------------------------------------


def _triangle(old: int, new: int) -> np.ndarray:
    """(new, old) weights of a triangle filter that widens when it shrinks."""
    scale = old / new
    reach = max(scale, 1.0)
    center = (np.arange(new) + 0.5) * scale - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(old)[None] - center[:, None]) / reach)
    return w / w.sum(1, keepdims=True)


def _corner(old: int, new: int) -> np.ndarray:
    """(new, old) weights of the general form: a place's source is (place - 1/2) * ratio; before the first pixel the line runs on."""
    at = (np.arange(new) - 0.5) * (old / new)
    low = np.maximum(np.floor(at), 0).astype(int)
    high = np.clip(np.ceil(at), 0, old - 1).astype(int)
    t = at - low
    w = np.zeros((new, old))
    np.add.at(w, (np.arange(new), low), 1 - t)
    np.add.at(w, (np.arange(new), high), t)
    return w


def resize_method(image: np.ndarray) -> str:
    """8 and 16 bits of one or three channels, and single-precision colour, take the triangle; all others the corner form."""
    kind, channels = image.dtype.kind + str(image.dtype.itemsize), image.shape[2]
    return "triangle" if (kind in ("u1", "u2") and channels in (1, 3)) or (kind == "f4" and channels == 3) else "corner"


def resize(image: np.ndarray, width: int, height: int, method: str | None = None, compat: bool = False) -> np.ndarray:
    """Bilinear resize, by :func:`resize_method` unless one is named; integers are rounded, floats only with ``compat`` (Q21)."""
    if image.shape[:2] == (height, width):
        return image.copy()
    method = method or resize_method(image)
    weights = {"triangle": _triangle, "corner": _corner}[method]
    out = np.einsum("yh,hwc,xw->yxc", weights(image.shape[0], height), image.astype(np.float64), weights(image.shape[1], width), optimize=True)
    if image.dtype.kind != "f":
        info = np.iinfo(image.dtype)
        return np.clip(np.floor(out + 0.5), info.min, info.max).astype(image.dtype)
    return (np.floor(out + 0.5) if compat and image.shape[2] != 3 else out).astype(image.dtype)
