"""Image files to and from arrays, with numpy and zlib alone.

Every decoder gives (height, width, channels) without alpha.  Formats that
need a decoder which isn't installed raise :class:`Unsupported`; readers turn
that into an error row.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable

import numpy as np


class Unsupported(ValueError):
    pass


def _no_alpha(a: np.ndarray) -> np.ndarray:
    return a[:, :, : {1: 1, 2: 1, 3: 3, 4: 3}.get(a.shape[2], a.shape[2])]


def decode_npy(raw: bytes) -> np.ndarray:
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    if a.dtype.kind + str(a.dtype.itemsize) not in ("u1", "u2", "u4", "i4", "i8", "f4", "f8"):
        raise Unsupported(f"npy of type {a.dtype}")
    if a.ndim not in (2, 3):
        raise Unsupported(f"npy of {a.ndim} dimensions")
    return np.ascontiguousarray(a.reshape(*a.shape[:2], -1).astype(a.dtype.newbyteorder("=")))


def encode_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    lines = raw.reshape(height, stride + 1)
    if (lines[:, 0] > 2).any():
        return _unfilter_diagonals(lines[:, 0], lines[:, 1:], step)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            row = line
        elif kind == 2:
            row = line + above
        else:
            row = np.cumsum(np.pad(line, (0, -stride % step)).reshape(-1, step), 0, dtype=np.uint8).ravel()[:stride]
        out[y] = above = row
    return out


def _unfilter_diagonals(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Averages and Paeth guesses need the left and the upper pixel: all pixels of an anti-diagonal are computed together."""
    height, width = len(lines), -(-lines.shape[1] // step)
    given = np.pad(lines, ((0, 0), (0, width * step - lines.shape[1]))).reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, paeth])
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, -1)[:, : lines.shape[1]].astype(np.uint8)


def decode_png(raw: bytes) -> np.ndarray:
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, palette = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, bits, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if interlaced:
        raise Unsupported("interlaced PNG")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stride = (width * channels * bits + 7) // 8
    rows = _unfilter(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8), height, stride, max(1, channels * bits // 8))
    if bits == 16:
        a = rows.view(">u2").astype(np.uint16).reshape(height, width, channels)
    elif bits == 8:
        a = rows.reshape(height, width, channels)
    else:
        flat = np.unpackbits(rows, axis=1).reshape(height, -1, bits)[:, : width * channels]
        a = (flat * (1 << np.arange(bits)[::-1])).sum(2).astype(np.uint8).reshape(height, width, channels)
        a = a if color == 3 else (a.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    return palette[a[:, :, 0]] if color == 3 else _no_alpha(a)


def encode_png(a: np.ndarray) -> bytes:
    a = a if a.ndim == 3 else a[:, :, None]
    if a.dtype.kind != "u" or a.dtype.itemsize > 2 or a.shape[2] not in (1, 3):
        raise Unsupported(f"PNG of {a.dtype} and {a.shape[2]} channels")
    lines = np.ascontiguousarray(a.astype(">u2") if a.dtype.itemsize == 2 else a).view(np.uint8).reshape(a.shape[0], -1)
    body = zlib.compress(np.pad(lines, ((0, 0), (1, 0))).tobytes(), 6)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8 * a.dtype.itemsize, {1: 0, 3: 2}[a.shape[2]], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def decode_pnm(raw: bytes) -> np.ndarray:
    """PBM, PGM and PPM, plain or raw."""
    kind = raw[:2].decode()
    fields, at = [], 2
    while len(fields) < (2 if kind in ("P1", "P4") else 3):
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    width, height, top = (*fields, 1)[:3]
    channels = 3 if kind in ("P3", "P6") else 1
    if kind in ("P1", "P2", "P3"):
        text = raw[at:].split() if kind != "P1" else [bytes([c]) for c in raw[at:] if c in b"01"]
        a = np.array([int(x) for x in text[: width * height * channels]])
    elif kind == "P4":
        a = np.unpackbits(np.frombuffer(raw, np.uint8, offset=at + 1).reshape(height, -1), axis=1)[:, :width]
    else:
        a = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, width * height * channels, at + 1)
    a = (1 - a) * 255 if kind in ("P1", "P4") else a
    return a.reshape(height, width, channels).astype(np.uint16 if top > 255 else np.uint8)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed, 8 (palette), 24 or 32 bits."""
    start, _, width, height, _, bits, packing = struct.unpack("<IIiiHHI", raw[10:34])
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise Unsupported("compressed BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        header = struct.unpack("<I", raw[14:18])[0]
        palette = np.frombuffer(raw, np.uint8, start - 14 - header, 14 + header).reshape(-1, 4)
        return palette[rows[:, :width]][:, :, 2::-1]
    return rows[:, : width * bits // 8].reshape(abs(height), width, -1)[:, :, 2::-1]


def decode_tga(raw: bytes) -> np.ndarray:
    """Grey or true colour, plain or run-length coded."""
    skip, _, kind = raw[0], raw[1], raw[2]
    width, height, bits, flags = struct.unpack("<HHBB", raw[12:18])
    n = bits // 8
    if kind not in (2, 3, 10, 11) or n not in (1, 3, 4):
        raise Unsupported(f"TGA of kind {kind}")
    at, need = 18 + skip, width * height
    if kind < 9:
        a = np.frombuffer(raw, np.uint8, need * n, at).reshape(need, n)
    else:
        parts, have = [], 0
        while have < need:
            count, run = (raw[at] & 127) + 1, raw[at] & 128
            part = np.frombuffer(raw, np.uint8, n * (1 if run else count), at + 1).reshape(-1, n)
            parts.append(np.repeat(part, count, 0) if run else part)
            at += 1 + part.size
            have += count
        a = np.concatenate(parts)[:need]
    a = a.reshape(height, width, n)
    a = a if flags & 32 else a[::-1]
    return a[:, :, 2::-1] if n > 1 else a


def decode_qoi(raw: bytes) -> np.ndarray:
    width, height = struct.unpack(">II", raw[4:12])
    out = np.zeros((width * height, 4), np.uint8)
    seen, pixel, at, k = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, 0
    while k < len(out):
        b = raw[at]
        at += 1
        run = 1
        r, g, bl, al = pixel
        if b == 254:
            pixel, at = (*raw[at : at + 3], al), at + 3
        elif b == 255:
            pixel, at = tuple(raw[at : at + 4]), at + 4
        elif b >> 6 == 0:
            pixel = seen[b]
        elif b >> 6 == 1:
            pixel = ((r + (b >> 4 & 3) - 2) & 255, (g + (b >> 2 & 3) - 2) & 255, (bl + (b & 3) - 2) & 255, al)
        elif b >> 6 == 2:
            dg, c = (b & 63) - 32, raw[at]
            at += 1
            pixel = ((r + dg + (c >> 4) - 8) & 255, (g + dg) & 255, (bl + dg + (c & 15) - 8) & 255, al)
        else:
            run = (b & 63) + 1
        seen[(pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64] = pixel
        out[k : k + run] = pixel
        k += run
    return out.reshape(height, width, 4)[:, :, :3]


def decode_hdr(raw: bytes) -> np.ndarray:
    """Radiance RGBE, flat or run-length coded, as float32."""
    head, _, rest = raw.partition(b"\n\n")
    size, _, body = rest.partition(b"\n")
    _, height, _, width = size.split()
    width, height, at = int(width), int(height), 0
    out = np.zeros((height, width, 4), np.uint8)
    for y in range(height):
        if body[at : at + 2] == b"\x02\x02" and 8 <= width < 32768:
            at += 4
            for c in range(4):
                x = 0
                while x < width:
                    n = body[at]
                    if n > 128:
                        out[y, x : x + n - 128, c] = body[at + 1]
                        x, at = x + n - 128, at + 2
                    else:
                        out[y, x : x + n, c] = np.frombuffer(body, np.uint8, n, at + 1)
                        x, at = x + n, at + 1 + n
        else:
            out[y] = np.frombuffer(body, np.uint8, width * 4, at).reshape(width, 4)
            at += width * 4
    scale = np.where(out[:, :, 3:] > 0, np.ldexp(1.0, out[:, :, 3:].astype(int) - 136), 0)
    return (out[:, :, :3] * scale).astype(np.float32)


def decode_tiff(raw: bytes) -> np.ndarray:
    """First page of a strip TIFF: plain, deflate or pack-bits, 8 or 16 bits or float32."""
    end = {b"II": "<", b"MM": ">"}[raw[:2]]
    at = struct.unpack(end + "I", raw[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(end + "H", raw[at : at + 2])[0]):
        tag, kind, count = struct.unpack(end + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            place = at + 10 + 12 * k
            if struct.calcsize(code) * count > 4:
                place = struct.unpack(end + "I", raw[place : place + 4])[0]
            tags[tag] = struct.unpack_from(f"{end}{count}{code}", raw, place)
    one = lambda t, d=1: tags.get(t, (d,))[0]
    width, height, bits, channels, packing = one(256), one(257), one(258), one(277), one(259)
    if 273 not in tags or packing not in (1, 8, 32946, 32773) or bits not in (8, 16, 32) or one(284) != 1:
        raise Unsupported("TIFF of this layout")

    def unpack(part: bytes) -> bytes:
        if packing == 1:
            return part
        if packing != 32773:
            return zlib.decompress(part)
        out, i = bytearray(), 0
        while i < len(part):
            n = part[i]
            if n < 128:
                out += part[i + 1 : i + 2 + n]
                i += 2 + n
            else:
                out += part[i + 1 : i + 2] * (257 - n) if n > 128 else b""
                i += 2 if n > 128 else 1
        return bytes(out)

    data = b"".join(unpack(raw[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
    kind = np.dtype({8: "u1", 16: end + "u2", 32: end + ("f4" if one(339) == 3 else "u4")}[bits])
    a = np.frombuffer(data, kind, width * height * channels).reshape(height, width, channels)
    if one(317) == 2:
        a = np.cumsum(a, 1, dtype=kind)
    return _no_alpha(a.astype(kind.newbyteorder("=")))


DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {
    "npy": decode_npy, "png": decode_png, "pbm": decode_pnm, "pgm": decode_pnm, "ppm": decode_pnm, "bmp": decode_bmp,
    "tga": decode_tga, "qoi": decode_qoi, "hdr": decode_hdr, "tif": decode_tiff, "tiff": decode_tiff,
}


def decode(raw: bytes, ext: str) -> np.ndarray:
    ext = ext.lower()
    if ext not in DECODERS:
        try:
            from PIL import Image
        except ImportError:
            raise Unsupported(f"no decoder for {ext} is installed") from None
        return _no_alpha(np.atleast_3d(np.asarray(Image.open(io.BytesIO(raw)))))
    return DECODERS[ext](raw)


def decode_mask(raw: bytes, ext: str) -> np.ndarray:
    """(height, width) labels; one channel of an unsigned type is asked for."""
    a = decode(raw, ext)
    if a.shape[2] != 1 or a.dtype.kind != "u":
        raise ValueError(f"a mask has one channel of unsigned integers, not {a.shape[2]} of {a.dtype}")
    return a[:, :, 0].astype(np.int64)


def pack_image(a: np.ndarray) -> dict:
    return {"width": a.shape[1], "height": a.shape[0], "channels": a.shape[2], "dtype": a.dtype.kind + str(a.dtype.itemsize), "data": np.ascontiguousarray(a).tobytes()}


def unpack_image(im: dict) -> np.ndarray:
    kind = np.dtype(im["dtype"])
    if len(im["data"]) != im["width"] * im["height"] * im["channels"] * kind.itemsize:
        raise ValueError("buffer length does not fit width, height and channels")
    return np.frombuffer(im["data"], kind).reshape(im["height"], im["width"], im["channels"])
