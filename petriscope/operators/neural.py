"""Vision transformers in numpy: preprocessing, forward pass, and embedding as an operator.

Weights come from a .npz file; none are shipped, and :func:`random_weights`
serves tests.  A worker loads a model once and runs real batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

from ..sources.catalogs import MODELS
from ..sources.codecs import unpack_image
from .kernels import resize

MEAN, STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def to_tensor(image: np.ndarray) -> np.ndarray:
    """(3, height, width): one channel repeated, three kept, any other number averaged."""
    a = image.astype(np.float32).transpose(2, 0, 1)
    return a if len(a) == 3 else np.repeat(a.mean(0, keepdims=True), 3, 0)


def preprocess(image: np.ndarray, model: str, compat: bool = False) -> np.ndarray:
    """Resized and scaled: by the type's range (``compat``: by 255, Q22) and channel statistics, or by the image's own range."""
    side = MODELS[model][1]
    a = to_tensor(resize(image, side, side))
    if model.startswith("subcell"):
        return (a - a.min()) / (a.max() - a.min() + 1e-6)
    top = 255 if compat or image.dtype.kind == "f" else np.iinfo(image.dtype).max
    return ((a / top - MEAN[:, None, None]) / STD[:, None, None]).astype(np.float32)


def random_weights(model: str, seed: int = 0, depth: int = 12) -> dict[str, np.ndarray]:
    width, side, patch = MODELS[model]
    rng = np.random.default_rng(seed)
    make = lambda *shape: rng.normal(0, 0.02, shape).astype(np.float32)
    out = {"cls": make(width), "position": make((side // patch) ** 2 + 1, width), "patch.w": make(3 * patch * patch, width), "patch.b": make(width), "norm.w": np.ones(width, np.float32), "norm.b": np.zeros(width, np.float32)}
    for k in range(depth):
        for name, shape in (("qkv", (width, 3 * width)), ("out", (width, width)), ("up", (width, 4 * width)), ("down", (4 * width, width))):
            out[f"{k}.{name}.w"], out[f"{k}.{name}.b"] = make(*shape), np.zeros(shape[1], np.float32)
        for name in ("norm1", "norm2"):
            out[f"{k}.{name}.w"], out[f"{k}.{name}.b"] = np.ones(width, np.float32), np.zeros(width, np.float32)
        if model.startswith("dino"):
            out[f"{k}.scale1"], out[f"{k}.scale2"] = np.full(width, 0.1, np.float32), np.full(width, 0.1, np.float32)
    return out


def _norm(x: np.ndarray, w: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    x = x - x.mean(-1, keepdims=True)
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * w + b


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def positions(table: np.ndarray, grid: int) -> np.ndarray:
    """Position embeddings for a grid, by nearest neighbour from the stored one."""
    own = int(round((len(table) - 1) ** 0.5))
    if own == grid:
        return table
    at = np.arange(grid) * own // grid
    return np.concatenate([table[:1], table[1:].reshape(own, own, -1)[at][:, at].reshape(grid * grid, -1)])


def forward(w: dict[str, np.ndarray], x: np.ndarray, model: str) -> np.ndarray:
    """(n, width) class tokens after the last norm, of (n, 3, side, side)."""
    width, side, patch = MODELS[model]
    n, heads, grid = len(x), width // 64, side // patch
    eps = 1e-12 if model.startswith("subcell") else 1e-6
    tiles = x.reshape(n, 3, grid, patch, grid, patch).transpose(0, 2, 4, 1, 3, 5).reshape(n, grid * grid, -1)
    h = tiles @ w["patch.w"] + w["patch.b"]
    h = np.concatenate([np.broadcast_to(w["cls"], (n, 1, width)), h], 1) + positions(w["position"], grid)
    k = 0
    while f"{k}.qkv.w" in w:
        y = _norm(h, w[f"{k}.norm1.w"], w[f"{k}.norm1.b"], eps) @ w[f"{k}.qkv.w"] + w[f"{k}.qkv.b"]
        q, key, v = y.reshape(n, -1, 3, heads, 64).transpose(2, 0, 3, 1, 4)
        a = q @ key.transpose(0, 1, 3, 2) / 8
        a = np.exp(a - a.max(-1, keepdims=True))
        y = ((a / a.sum(-1, keepdims=True)) @ v).transpose(0, 2, 1, 3).reshape(n, -1, width) @ w[f"{k}.out.w"] + w[f"{k}.out.b"]
        h = h + y * w.get(f"{k}.scale1", 1)
        y = _gelu(_norm(h, w[f"{k}.norm2.w"], w[f"{k}.norm2.b"], eps) @ w[f"{k}.up.w"] + w[f"{k}.up.b"]) @ w[f"{k}.down.w"] + w[f"{k}.down.b"]
        h = h + y * w.get(f"{k}.scale2", 1)
        k += 1
    return _norm(h[:, 0], w["norm.w"], w["norm.b"], eps)


@lru_cache(maxsize=2)
def load(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return dict(f)


EMBEDDINGS = "image string, object int, centroid_x float, centroid_y float, embedding array<float>, error string"


def embed_rows(model: str, weights: str, kind: str | None, pad: int, min_size: int, compat: bool = False, batch_size: int = 8):
    """mapInPandas: embeddings of whole images (``kind`` None) or of each object's crop."""
    from .objects import BAD_RING, crops_of

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = load(weights)
        for batch in batches:
            out, tensors = [], []
            for row in batch.to_dict("records"):
                try:
                    image = unpack_image(row["im"])
                    if kind is None:
                        parts = [(None, (0, 0, image.shape[1], image.shape[0]), None, image, None)]
                    else:
                        parts = list(crops_of(image, row, kind, "c", pad, min_size, compat))
                    for k, box, polygon, crop, _ in parts:
                        if crop is None:
                            out.append([row["image"], k, None, None, None, BAD_RING])
                            continue
                        x, y = polygon.mean(0) if polygon is not None else ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
                        tensors.append(preprocess(crop, model, compat))
                        out.append([row["image"], k, x, x if compat and kind else y, None, None])  # Q11
                except Exception as e:  # noqa: BLE001
                    out.append([row["image"], None, None, None, None, f"{type(e).__name__}: {e}"])
            good = [r for r in out if r[5] is None]
            for k in range(0, len(tensors), batch_size):
                for r, v in zip(good[k : k + batch_size], forward(w, np.stack(tensors[k : k + batch_size]), model), strict=True):
                    r[4] = v.astype(np.float32).tolist()
            yield pd.DataFrame(out, dtype=object, columns=["image", "object", "centroid_x", "centroid_y", "embedding", "error"])

    return rows, EMBEDDINGS
