"""Decoding of JPEG bytes with numpy: sequential and progressive Huffman coding, 8 bits, grey or three components.

Colours are within a level or two of other decoders': the inverse transform is computed in floating point, and half-sized colour
planes are interpolated linearly. Arithmetic coding, 12 bits and four components are errors.
"""

from __future__ import annotations

import struct

import numpy as np

#: The order in which an 8 x 8 block's frequencies are coded.
_ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in (((s - i, i) if s % 2 == 0 else (i, s - i)) for i in range(s + 1)) if y < 8 and x < 8])
_WAVES = np.array([[(0.5 if k else 0.5**1.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


class _Component:
    """A colour plane: sampling factors, quantiser, and coefficients of all its blocks, padded to whole units."""

    def __init__(self, key: int, h: int, v: int, quantiser: int):
        self.key, self.h, self.v, self.quantiser = key, h, v, quantiser
        self.dc = self.ac = None
        self.last = 0

    def lay(self, width: int, height: int, hmax: int, vmax: int) -> None:
        self.width, self.height = -(-width * self.h // hmax), -(-height * self.v // vmax)
        self.columns, self.rows = -(-self.width // 8), -(-self.height // 8)
        across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        self.stride = across * self.h
        self.blocks = [[0] * 64 for _ in range(self.stride * down * self.v)]


class _Bits:
    """Bits of an entropy-coded segment; beyond its end there are zeros, as many as a block may ask for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data + bytes(64), 0, 0, 0

    def fill(self) -> None:
        if self.at + 6 > len(self.data):
            raise ValueError("file ends too early")
        self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(self.data[self.at : self.at + 6])
        self.at += 6
        self.n += 48

    def code(self, table: list[int]) -> int:
        if self.n < 16:
            self.fill()
        entry = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not entry:
            raise ValueError("unreadable block")
        self.n -= entry >> 8
        return entry & 0xFF

    def take(self, count: int) -> int:
        if self.n < count:
            self.fill()
        self.n -= count
        return (self.held >> self.n) & ((1 << count) - 1)

    def number(self, size: int) -> int:
        """A signed number of ``size`` bits: those with a leading 0 are negative."""
        value = self.take(size)
        return value if value >> (size - 1) else value - (1 << size) + 1


def _table(body: bytes) -> tuple[list[int], int]:
    """For every 16 bits ahead the length of the code they begin with, times 256, and its symbol; and the bytes read."""
    counts, symbols, code, at = body[:16], body[16:], 0, 0
    out = np.zeros(1 << 16, np.int32)
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at, code = at + count, code << 1
    return out.tolist(), 16 + at


class _Scan:
    """One pass over some components: which frequencies it codes, and to which bit."""

    def __init__(self, parts: list[_Component], first: int, last: int, high: int, low: int, progressive: bool):
        self.parts, self.first, self.last, self.high, self.low, self.progressive = parts, first, last, high, low, progressive
        self.skip = 0  # blocks of a run that have nothing more to code

    def block(self, bits: _Bits, part: _Component, block: list[int]) -> None:
        if not self.progressive:
            self._dc(bits, part, block)
            self._ac(bits, part, block, 1, 63)
        elif self.first == 0:
            if self.high:
                block[0] |= bits.take(1) << self.low
            else:
                self._dc(bits, part, block)
        elif self.high:
            self._refine(bits, part, block)
        else:
            self._ac(bits, part, block, self.first, self.last)

    def _dc(self, bits: _Bits, part: _Component, block: list[int]) -> None:
        size = bits.code(part.dc)
        if size:
            part.last += bits.number(size)
        block[0] = part.last << self.low

    def _ac(self, bits: _Bits, part: _Component, block: list[int], k: int, last: int) -> None:
        if self.skip:
            self.skip -= 1
            return
        code, table, low = bits.code, part.ac, self.low
        while k <= last:
            symbol = code(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                if k > 63:
                    raise ValueError("unreadable block")
                block[k] = bits.number(size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                self.skip = (1 << run) - 1 + (bits.take(run) if run else 0)
                return

    def _refine(self, bits: _Bits, part: _Component, block: list[int]) -> None:
        """One more bit for what is known, and new frequencies of that bit's size between zeros."""
        unit, k = 1 << self.low, self.first

        def more(k: int) -> None:
            if bits.take(1) and not abs(block[k]) & unit:
                block[k] += unit if block[k] > 0 else -unit

        if not self.skip:
            while k <= self.last:
                symbol = bits.code(part.ac)
                zeros, size = symbol >> 4, symbol & 15
                if size == 0 and zeros < 15:
                    self.skip = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                    break
                value = (unit if bits.take(1) else -unit) if size else 0
                while k <= self.last:
                    if block[k]:
                        more(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        if value:
                            block[k] = value
                        break
                    k += 1
                k += 1
        if self.skip:
            for i in range(k, self.last + 1):
                if block[i]:
                    more(i)
            self.skip -= 1

    def read(self, segments: list[bytes], interval: int, units: tuple[int, int]) -> None:
        """All blocks in coded order; a restart begins a new segment with nothing remembered."""
        if len(self.parts) == 1:
            p = self.parts[0]
            order = [[(p, y * p.stride + x)] for y in range(p.rows) for x in range(p.columns)]
        else:
            order = [
                [(p, (my * p.v + v) * p.stride + mx * p.h + h) for p in self.parts for v in range(p.v) for h in range(p.h)]
                for my in range(units[1]) for mx in range(units[0])
            ]
        per = interval or len(order)
        for i, segment in enumerate(segments):
            bits, self.skip = _Bits(segment), 0
            for p in self.parts:
                p.last = 0
            for unit in order[i * per : (i + 1) * per]:
                for p, at in unit:
                    self.block(bits, p, p.blocks[at])
        if len(segments) * per < len(order):
            raise ValueError("file ends too early")


def _segments(content: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from ``at`` on, stuffing removed, and where the next marker stands."""
    out, start = [], at
    while True:
        at = content.find(b"\xff", at)
        if at < 0 or at + 1 >= len(content):
            raise ValueError("file ends too early")
        kind = content[at + 1]
        if kind == 0:
            at += 2
        elif 0xD0 <= kind <= 0xD7:
            out.append(content[start:at].replace(b"\xff\x00", b"\xff"))
            at += 2
            start = at
        elif kind == 0xFF:
            at += 1
        else:
            out.append(content[start:at].replace(b"\xff\x00", b"\xff"))
            return out, at


def _plane(part: _Component, quantiser: np.ndarray) -> np.ndarray:
    """Samples of a component, cut to its size."""
    coded = np.array(part.blocks, np.float64) * quantiser
    blocks = np.zeros_like(coded)
    blocks[:, _ZIGZAG] = coded
    samples = np.einsum("ky,nkl,lx->nyx", _WAVES, blocks.reshape(-1, 8, 8), _WAVES, optimize=True)
    image = samples.reshape(-1, part.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, part.stride * 8)
    return np.clip(np.rint(image + 128), 0, 255)[: part.height, : part.width]


def _double(plane: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples along an axis, each three parts of the nearest and one of the next."""
    x = np.moveaxis(plane, axis, 0)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    return np.moveaxis(np.stack([3 * x + before, 3 * x + after], 1).reshape(-1, *x.shape[1:]) / 4, 0, axis)


def decode_jpeg(content: bytes, most_pixels: int) -> tuple[np.ndarray, str, int]:
    """RGB array, mode (``L`` or ``RGB``) and EXIF orientation (1 if none is given); ``ValueError`` names what is wrong."""
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[int, list[int]] = {}
    parts: list[_Component] = []
    interval, transform, orientation, progressive, at = 0, None, 1, False, 2
    width = height = 0
    while True:
        at = content.find(b"\xff", at)
        if at < 0 or at + 2 > len(content):
            raise ValueError("file ends too early")
        kind = content[at + 1]
        if kind == 0xD9:
            break
        if at + 4 > len(content):
            raise ValueError("file ends too early")
        if kind in (0x00, 0x01, 0xFF) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quantisers[key] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                tables[body[0]], used = _table(body[1:])
                body = body[1 + used :]
        elif kind in (0xC0, 0xC1, 0xC2):
            precision, height, width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or n not in (1, 3):
                raise ValueError("only JPEG of 8 bits with one or three components is supported")
            if not width or not height or width * height > most_pixels:
                raise ValueError("too many pixels" if width and height else "no size")
            parts = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if n == 1:
                parts[0].h = parts[0].v = 1
            hmax, vmax = max(p.h for p in parts), max(p.v for p in parts)
            for p in parts:
                p.lay(width, height, hmax, vmax)
            progressive = kind == 0xC2
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("this JPEG coding is not supported")
        elif kind == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            orientation = exif_orientation(body[6:])
        elif kind == 0xDA:
            chosen = []
            for i in range(body[0]):
                part = next((p for p in parts if p.key == body[1 + 2 * i]), None)
                if part is None:
                    raise ValueError("no header")
                part.dc, part.ac = tables.get(body[2 + 2 * i] >> 4), tables.get(16 | body[2 + 2 * i] & 15)
                chosen.append(part)
            first, last, bits = body[1 + 2 * body[0] :][:3]
            segments, at = _segments(content, at)
            units = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            try:
                _Scan(chosen, first, last, bits >> 4, bits & 15, progressive).read(segments, interval, units)
            except TypeError as e:  # a table that was never given
                raise ValueError("unreadable block") from e
    if not parts or any(p.quantiser not in quantisers for p in parts):
        raise ValueError("no header")
    planes = []
    for p in parts:
        plane = _plane(p, quantisers[p.quantiser])
        if vmax == 2 * p.v:
            plane = _double(plane, 0)
        elif vmax != p.v:
            plane = plane.repeat(vmax // p.v, 0)
        if hmax == 2 * p.h:
            plane = _double(plane, 1)
        elif hmax != p.h:
            plane = plane.repeat(hmax // p.h, 1)
        planes.append(plane[:height, :width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[..., None], 3, axis=2), "L", orientation
    if transform == 0:
        rgb = np.stack(planes, -1)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8), "RGB", orientation


def exif_orientation(tiff: bytes) -> int:
    """Orientation 1 to 8 from the first directory of an EXIF block; 1 if there is none."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    at = struct.unpack(order + "I", tiff[4:8])[0]
    if at + 2 > len(tiff):
        return 1
    for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x112:
            value = struct.unpack(order + "H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1
