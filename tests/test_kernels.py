"""Array kernels. Inputs and expected numbers of the descriptors are fixed values: the results to match, given as text."""

import math

import numpy as np
import pytest

from petriscope.operators import kernels as K


def gray(rows):
    return np.array(rows)[:, :, None]


@pytest.mark.parametrize(
    ("mask", "labels"),
    [
        ([10, 10, 0, 10, 0, 20, 0, 20, 20], [1, 1, 0, 1, 0, 1, 0, 1, 1]),
        ([10, 10, 10, 0, 0, 0, 20, 20, 20], [1, 1, 1, 0, 0, 0, 2, 2, 2]),
    ],
)
def test_components(mask, labels):
    assert K.connected_components(np.array(mask).reshape(3, 3)).ravel().tolist() == labels


def test_components_match_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.random((13, 17)) < 0.4
        got, seen, n = K.connected_components(m), np.zeros(m.shape, int), 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if seen[y, x]:
                continue
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 13 and 0 <= b < 17 and m[a, b] and not seen[a, b]:
                    seen[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (got == seen).all()


def test_contours():
    block = np.zeros((3, 3), int)
    block[:2, :2] = 1
    assert K.find_contours(block)[0].tolist() == [[0, 0], [0, 1], [1, 1], [1, 0]]
    row = np.zeros((5, 5), int)
    row[2, :3] = 1
    assert K.find_contours(row)[0].tolist() == [[0, 2], [1, 2], [2, 2], [1, 2]]
    assert K.find_contours(np.eye(1, dtype=int))[0].tolist() == [[0, 0]]


def test_labelled_contours():
    m = np.array([[2, 2, 0], [2, 0, 1], [0, 1, 1]])
    labels, names, polygons = K.label_polygons(m)
    assert names == [1, 2]
    assert [p.tolist() for p in polygons] == [[[2, 1], [1, 2], [2, 2]], [[0, 0], [0, 1], [1, 0]]]


def test_eleven_blobs():
    y, x = np.mgrid[:60, :200]
    m = np.zeros((60, 200), int)
    for k in range(11):
        m |= ((x - 10 - 17 * k) ** 2 + (y - 30) ** 2 < 36).astype(int)
    labels, names, polygons = K.label_polygons(m * 255)
    assert len(names) == len(polygons) == 11


def test_polygon_points():
    square = np.array([[0, 0], [0, 1], [1, 1], [1, 0]], float)
    assert K.convex_hull(np.r_[square, [[0.5, 0.5], [0, 0.5]]]).tolist() == [[0, 0], [0, 1], [1, 1], [1, 0]]
    assert K.dedup_points(np.r_[square, square]).tolist() == [[0, 0], [0, 1], [1, 0], [1, 1]]
    assert K.order_points(square).tolist() == [[0, 1], [1, 1], [1, 0], [0, 0]]
    ring = K.resample_points(np.array([[0, 1], [1, 1], [1, 0], [0, 0]], float), 5)
    assert np.allclose(ring, [[0, 1], [1, 1], [1, 0], [0, 0], [0, 1]])
    assert K.resample_points(np.ones((3, 2)), 4).tolist() == [[1, 1]] * 4  # Q23
    assert K.draw_points(np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float), 1).tolist() == [[0, 0, 0, 0], [0, 1, 1, 0], [0, 1, 1, 0], [0, 0, 0, 0]]


def circle(n=360):
    t = np.linspace(0, 2 * math.pi, n, endpoint=False)
    return np.stack([np.cos(t), np.sin(t)], 1)


def test_form_circle_and_square():
    v = dict(zip(__import__("petriscope.schema", fromlist=["FORM"]).FORM, K.form(circle() + 5), strict=True))
    assert v["form_area"] == pytest.approx(math.pi, rel=1e-3)
    assert v["form_perimeter"] == pytest.approx(2 * math.pi, rel=1e-3)
    assert v["form_centroid_x"] == pytest.approx(5)
    assert v["form_major_axis"] == pytest.approx(2, rel=1e-3)
    assert v["form_eccentricity"] == pytest.approx(0, abs=0.05)
    square = np.array([[-1, -1], [-1, 1], [1, 1], [1, -1]], float)
    v = dict(zip(__import__("petriscope.schema", fromlist=["FORM"]).FORM, K.form(square), strict=True))
    assert v["form_area"] == 4 and v["form_perimeter"] == 8 and v["form_solidity"] == 1
    assert v["form_min_feret"] == pytest.approx(2) and v["form_max_feret"] == pytest.approx(math.sqrt(8))
    assert np.allclose(K.form(square), K.form(np.r_[square, square[:1]]))


def test_q1_negated_centroid():
    square = np.array([[4, 4], [4, 6], [6, 6], [6, 4]], float)
    assert K.form(square)[:2].tolist() == [5, 5]
    assert K.form(square, compat=True)[:2].tolist() == [-5, -5]


def test_intensity():
    image = np.array([0, 1, 2, 0, 1, 3, 0, 1, 4, 0, 1, 5]).reshape(2, 2, 3)
    per = K.intensity_channels(image)
    assert per[:, 0].tolist() == [0, 1, 2] and per[:, 1].tolist() == [0, 1, 5]
    assert per[:, 2].tolist() == [0, 4, 14] and per[:, 3].tolist() == [0, 1, 3.5]
    assert np.allclose(per[:, 4], [0, 0, 1.118034])
    assert K.intensity(image)[5:].tolist() == [1.5, 0.5]


def test_q2_last_channel():
    image = np.array([1, 2, 3, 4, 5, 6, 7, 8]).reshape(2, 2, 2)
    v = K.intensity(image, compat=True)
    assert v[:5].tolist() == [1, 4, 10, 2.5, 2.5]
    assert K.intensity(image)[0] == 1.5


def test_q4_spread_of_all_pixels():
    image = gray([[0, 2], [0, 4]])
    assert K.intensity_channels(image)[0, 4] == 1
    assert K.intensity_channels(image, compat=True)[0, 4] > 1


def test_moments():
    image = gray(np.eye(4, dtype=int))
    v = K.moments(image)
    assert v[:10].tolist() == [4, 6, 6, 14, 14, 14, 36, 36, 36, 36]
    assert np.allclose(v[17:19], [0.625, 0.390625])
    y, x = np.mgrid[:10, :10]
    v = K.moments(gray(x + y))
    assert v[:4].tolist() == [900, 4875, 4875, 25650]
    assert np.allclose(v[10:12], [-756.25, 6668.75])
    assert not K.moments(gray(np.zeros((2, 2)))).any()


def test_q3_interleaved_channels():
    image = np.arange(1, 9).reshape(2, 2, 2)
    assert not np.allclose(K.moments(image), K.moments(image, compat=True))
    assert not np.allclose(K.zernike(image), K.zernike(image, compat=True))


def test_texture_constants():
    v = K.haralick(K.glcm(np.array([[0, 0], [255, 255]]), 0))
    want = [0.5, 0, 1, 992.25, 1, 63, 3969, 1, 1, 0.015380859, 0, -1, 0.92987347]
    assert np.allclose(v, want, atol=1e-5)


def test_q5_degenerate_texture():
    v = K.haralick(K.glcm(np.full((3, 3), 7), 0))
    assert math.isnan(v[2]) and v[0] == 1
    assert np.isnan(K.glcm(np.ones((3, 1)), 0)).all()


def test_zernike():
    assert [float(K.radial_polynomial(2, 0, r)) for r in (0.0, 0.5, 1.0)] == [-1, -0.5, 1]
    rng = np.random.default_rng(0)
    assert K.zernike(gray(rng.integers(1, 9, (8, 8))))[0] == pytest.approx(1 / math.pi)
    assert not K.zernike(gray([[3]])).any()


def test_resize():
    image = gray(np.arange(9).reshape(3, 3))
    a, b = K.resize(image, 5, 5), K.resize(image, 5, 5, "corner")
    assert a.shape == b.shape == (5, 5, 1)
    assert (K.resize(image, 3, 3) == image).all()
    f = image.astype(np.float32)
    assert (K.resize(f, 5, 5, compat=True) == np.round(K.resize(f, 5, 5, compat=True))).all()  # Q21


def test_casts():
    assert K.cast(np.array([-1.0, 3.9, 300.0, 7.0]), "u1").tolist() == [0, 3, 0, 7]
    assert K.cast(np.array([-5, 70000]), "u2").tolist() == [0, 0]


def test_crops():
    image = gray(np.arange(9).reshape(3, 3))
    assert K.crop(image, 1, 1, 5, 5, clamp=True).shape == (2, 2, 1)
    with pytest.raises(ValueError):
        K.crop(image, 1, 1, 5, 5)
    mask = np.array([[1, 0, 0], [0, 0, 0], [0, 0, 2]])
    assert K.crop_masked(image, mask).sum() == 8 and K.crop_masked(image, mask, background=True).sum() == 28


def test_q6_q7_crop_of_an_object():
    assert K.object_crop((2, 2, 4, 4), 10, 10, 1, 1) == (1, 1, 5, 5)
    assert K.object_crop((2, 2, 4, 4), 10, 10, 1, 1, compat=True) == (1, 1, 4, 4)
    assert K.object_crop((0, 2, 4, 4), 10, 10, 1, 1) is None
    assert K.object_crop((20, 20, 30, 30), 10, 10, 1, 1) is None  # Q19


def test_q9_polygon_masks():
    p = np.array([[2, 2], [6, 2], [6, 4], [2, 4]], float)
    assert K.fill_polygon(p, 10, 10).sum() == 15
    assert K.draw_centered(p, 10, 10).sum() != 15


@pytest.mark.parametrize(
    ("kind", "channels", "method"),
    [("u1", 1, "triangle"), ("u1", 3, "triangle"), ("u2", 3, "triangle"), ("f4", 3, "triangle"), ("u1", 2, "corner"), ("f4", 1, "corner"), ("f8", 3, "corner"), ("i4", 1, "corner")],
)
def test_resize_by_type_and_channels(kind, channels, method):
    image = np.arange(24 * channels).reshape(4, 6, channels).astype(kind)
    assert K.resize_method(image) == method
    assert (K.resize(image, 9, 7) == K.resize(image, 9, 7, method)).all()
