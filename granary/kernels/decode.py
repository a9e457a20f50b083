"""Decoding of PNG, BMP and JPEG bytes with numpy and zlib; EXIF orientation. Other formats are explicit errors."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from granary.kernels.jpeg import decode_jpeg

#: Fixed value: largest picture that is decoded, in pixels.
PIXEL_CAP = 20_000_000
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(content: bytes) -> tuple[np.ndarray, str, str]:
    """RGB array as it is meant to be seen, mode and format of a picture; ``ValueError`` names what is wrong. A JPEG's EXIF
    orientation is applied."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return (*_png(content), "PNG")
    if content[:2] == b"BM":
        return _bmp(content), "RGB", "BMP"
    if content[:3] == b"\xff\xd8\xff":
        rgb, mode, orientation = decode_jpeg(content, PIXEL_CAP)
        return orient(rgb, orientation), mode, "JPEG"
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        raise ValueError("WebP is not supported")
    raise ValueError("not a picture")


def _png(content: bytes) -> tuple[np.ndarray, str]:
    pos, data, palette, head = 8, b"", None, None
    while pos + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[pos : pos + 8])
        body = content[pos + 8 : pos + 8 + size]
        if len(body) < size:
            raise ValueError("file ends too early")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
        pos += size + 12
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = head
    if w * h > PIXEL_CAP:
        raise ValueError("too many pixels")
    if depth != 8 or interlace or colour not in _CHANNELS:
        raise ValueError("only plain 8-bit PNG is supported")
    n = _CHANNELS[colour]
    try:
        raw = zlib.decompress(data)
    except zlib.error as e:
        raise ValueError("unreadable block") from e
    if len(raw) < h * (w * n + 1):
        raise ValueError("file ends too early")
    lines = np.frombuffer(raw[: h * (w * n + 1)], np.uint8).reshape(h, w * n + 1)
    out = np.zeros((h, w * n), np.uint8)
    before = np.zeros(w * n, np.uint8)
    for y in range(h):
        out[y] = before = _unfilter(int(lines[y, 0]), lines[y, 1:], before, n)
    px = out.reshape(h, w, n)
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        return palette[px[..., 0]], "P"
    if colour == 2:
        return px, "RGB"
    if colour == 6:
        return np.ascontiguousarray(px[..., :3]), "RGBA"
    return np.repeat(px[..., :1], 3, axis=2), "L" if colour == 0 else "LA"


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    if kind == 2:
        return line + up
    out = np.zeros(len(line) + n, np.uint8)
    a = out.tolist()
    x, b = line.tolist(), up.tolist()
    for i in range(len(x)):
        left, above, corner = a[i], b[i], b[i - n] if i >= n else 0
        if kind == 3:
            guess = (left + above) // 2
        elif kind == 4:
            p = left + above - corner
            da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
            guess = left if da <= db and da <= dc else above if db <= dc else corner
        else:
            raise ValueError("unknown filter")
        a[i + n] = (x[i] + guess) & 255
    return np.array(a[n:], np.uint8)


def _bmp(content: bytes) -> np.ndarray:
    if len(content) < 54:
        raise ValueError("file ends too early")
    start, = struct.unpack("<I", content[10:14])
    w, h, _, depth, packing = struct.unpack("<iiHHI", content[18:34])
    if depth not in (24, 32) or packing not in (0, 3):
        raise ValueError("only plain 24-bit and 32-bit BMP is supported")
    if w * abs(h) > PIXEL_CAP:
        raise ValueError("too many pixels")
    n, row = depth // 8, (w * depth // 8 + 3) // 4 * 4
    if len(content) < start + row * abs(h):
        raise ValueError("file ends too early")
    px = np.frombuffer(content, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * n].reshape(abs(h), w, n)[..., 2::-1]
    return np.ascontiguousarray(px[::-1] if h > 0 else px)


def orient(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as EXIF orientation 1 to 8 means it to be seen; other values change nothing."""
    flips = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.transpose(1, 0, 2), 6: lambda x: x.transpose(1, 0, 2)[:, ::-1], 7: lambda x: x[::-1, ::-1].transpose(1, 0, 2), 8: lambda x: x.transpose(1, 0, 2)[::-1]}
    return np.ascontiguousarray(flips.get(orientation, lambda x: x)(rgb))


def swap_channels(pixels: np.ndarray) -> np.ndarray:
    """BGR to RGB or back; anything but an 8-bit picture of three channels is an error."""
    if pixels.ndim != 3 or pixels.shape[2] != 3 or pixels.dtype != np.uint8 or not pixels.size:
        raise ValueError("a picture of three 8-bit channels is needed")
    return np.ascontiguousarray(pixels[..., ::-1])


def encode_png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of a picture (K6)."""
    h, w = rgb.shape[:2]
    lines = np.zeros((h, w * 3 + 1), np.uint8)
    lines[:, 1:] = rgb.reshape(h, w * 3)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
