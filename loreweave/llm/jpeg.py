"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, chroma is upsampled, tensors are RGB.

A payload is stored without loss as quantised coefficients, the unit of the
format: byte b is the coefficient 256 + b, 64 bytes to a block. The encoder
writes spectral selection and successive approximation scans whose Huffman
tables have one symbol, so that codes have one width; the decoder reads any
Huffman-coded progressive file, and such scans in a few array operations.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

UNIT = 576
#: Fixed by the format: the zigzag order of a block's 64 coefficients.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")

_u = np.arange(8)
_C = np.where(_u == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * _u[None, :] + 1) * _u[:, None] * np.pi / 16)
#: Coefficients in zigzag order to 64 samples.
_IDCT = np.einsum("ux,vy->uvxy", _C, _C).reshape(64, 64)[ZIGZAG].astype(np.float32)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0
    high: int = 0
    own_wide: int = 0
    own_high: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""

    def samples(self, c: Component) -> np.ndarray:
        flat = (c.coef * self.quants[c.quant]).astype(np.float32) @ _IDCT + np.float32(128)
        return flat.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)

    def rgb(self) -> np.ndarray:
        """Full-resolution tensor, height x width x 3, 8 bits; chroma samples are repeated."""
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        planes = [np.repeat(np.repeat(self.samples(c), v // c.v, 0), h // c.h, 1)[: self.height, : self.width] for c in self.components]
        if len(planes) == 1:
            planes = [planes[0]] * 3
        else:
            y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
            planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
        return np.clip(np.rint(np.stack(planes, -1)), 0, 255).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, symbol: int) -> bytes:
    """A Huffman table of one symbol, whose code is the single bit 0."""
    return _segment(0xC4, bytes([kind << 4 | slot, 1, *[0] * 15, symbol]))


def _scan(ident: int, tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, ident, tables, first, last, high << 4 | low]))


def _packed(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled up with ones, 255 followed by 0."""
    rest = -bits.size % 8
    if rest:
        bits = np.append(bits.ravel(), np.ones(rest, np.uint8))
    return np.packbits(bits.ravel()).tobytes().replace(b"\xff", b"\xff\x00")


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG that holds ``payload`` (a positive multiple of 576 bytes) as coefficients."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    n = len(payload) // 64
    mcus = -(-n // 6)
    across = max(1, int(mcus**0.5))
    down = -(-mcus // across)
    mcus = across * down
    value = np.full(mcus * 6 * 64, 255, np.uint8)
    value[: len(payload)] = np.frombuffer(payload, np.uint8)
    # the coefficient 256 + b less its lowest bit, halved: 128 + b // 2, of eight bits
    top = ((value >> 1) | np.uint8(128)).reshape(-1, 64)
    low = (value & np.uint8(1)).reshape(-1, 64)
    parts = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0]) + bytes([1] * 64)), _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _table(0, 0, 8), _table(1, 0, 8), _table(1, 1, 0), _segment(0xDD, struct.pack(">H", 1))]
    spans = [(1, slice(0, 4 * mcus)), (2, slice(4 * mcus, 5 * mcus)), (3, slice(5 * mcus, 6 * mcus))]
    for ident, rows in spans:
        # a restart after each block makes every difference the value itself
        dc = top[rows, 0]
        out = np.empty((len(dc), 4), np.uint8)
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = dc >> 1, (dc << 7) | 127, 255, 0xD0 + np.arange(len(dc)) % 8
        flat = out.ravel()[:-2]
        parts += [_scan(ident, 0x00, 0, 0, 0, 1), np.insert(flat, 4 * np.flatnonzero(out[:, 1] == 255) + 2, 0).tobytes()]
    parts.append(_segment(0xDD, struct.pack(">H", 0)))
    nine = np.zeros((len(top), 64, 9), np.uint8)
    nine[:, :, 1:] = np.unpackbits(top, axis=None).reshape(-1, 64, 8)
    for ident, rows, first, last in ((1, spans[0][1], 1, 5), (2, spans[1][1], 1, 63), (3, spans[2][1], 1, 63), (1, spans[0][1], 6, 63)):
        parts += [_scan(ident, 0x00, first, last, 0, 1), _packed(nine[rows, first : last + 1])]
    for ident, rows in spans:
        parts += [_scan(ident, 0x00, 0, 0, 1, 0), _packed(low[rows, 0])]
    more = low.copy()
    more[:, 0] = 0  # the code for "no new coefficient", then a correction bit for each old one
    for ident, rows in spans:
        parts += [_scan(ident, 0x01, 1, 63, 1, 0), _packed(more[rows])]
    return b"".join([*parts, b"\xff\xd9"])


class _Bits:
    """Bits of one restart interval, read one code at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = int.from_bytes(data, "big"), 0, len(data) * 8

    def take(self, n: int) -> int:
        self.at += n
        shift = self.size - self.at
        return ((self.data >> shift) if shift >= 0 else (self.data << -shift) | ((1 << -shift) - 1)) & ((1 << n) - 1)

    def code(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def number(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    code, at, out = 0, 0, {}
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _refine(bits: _Bits, block: np.ndarray, k: int, last: int, plus: int, zeros: int) -> int:
    """Corrects coefficients from k on until ``zeros`` zero ones are passed; returns where the next zero one is, or last + 1."""
    while k <= last:
        if block[k]:
            if bits.take(1) and not abs(int(block[k])) & plus:
                block[k] += plus if block[k] > 0 else -plus
        else:
            if zeros == 0:
                break
            zeros -= 1
        k += 1
    return k


def _read_scan(pieces: list[bytes], plan: list, first: int, last: int, high: int, low: int, restart: int) -> None:
    """One scan code by code. ``plan``: for each unit its blocks (coefficients, index, component, DC and AC table)."""
    units, at, plus = len(plan), 0, 1 << low
    for data in pieces:
        bits, run, previous = _Bits(data), 0, {}
        for unit in plan[at : at + (restart or units)]:
            for coef, index, name, dc, ac in unit:
                block = coef[index]
                if first == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        previous[name] = previous.get(name, 0) + bits.number(bits.code(dc))
                        block[0] = previous[name] * plus
                    continue
                k = first
                if run:
                    if high:
                        _refine(bits, block, k, last, plus, 64)
                    run -= 1
                    continue
                while k <= last:
                    symbol = bits.code(ac)
                    zeros, size = symbol >> 4, symbol & 15
                    if not size and zeros < 15:
                        run = (1 << zeros) - 1 + (bits.take(zeros) if zeros else 0)
                        if high:
                            _refine(bits, block, k, last, plus, 64)
                        break
                    if high:
                        new = (plus if bits.take(1) else -plus) if size else 0
                        k = _refine(bits, block, k, last, plus, zeros)
                        if new and k <= last:
                            block[k] = new
                    else:
                        k += zeros
                        if size:
                            block[k] = bits.number(size) * plus
                    k += 1
        at += restart or units


def _fast_scan(pieces: list[bytes], coef: np.ndarray, first: int, last: int, high: int, low: int, restart: int, dc: dict, ac: dict) -> bool:
    """A scan of one component whose codes all have one width, by array operations; False where it isn't such a scan."""
    n = len(coef)
    plus = np.int32(1 << low)
    if first == 0 and high:
        if len(pieces) != 1:
            return False
        bits = np.unpackbits(np.frombuffer(pieces[0], np.uint8))
        if len(bits) < n:
            return False
        coef[:, 0] |= bits[:n].astype(np.int32) << low
        return True
    table = ac if first else dc
    if list(table) != [(1, 0)]:
        return False
    symbol = table[1, 0]
    if high:
        if symbol or len(pieces) != 1 or not coef[:, first : last + 1].all():
            return False
        width = last - first + 2
        bits = np.unpackbits(np.frombuffer(pieces[0], np.uint8))
        if len(bits) < n * width:
            return False
        bits = bits[: n * width].reshape(n, width)
        part = coef[:, first : last + 1]
        if bits[:, 0].any() or (np.abs(part) & plus).any():
            return False
        part += np.sign(part) * (bits[:, 1:].astype(np.int32) * plus)
        return True
    if not 0 < symbol < 16:
        return False
    each = 1 if first == 0 else last - first + 1
    if first == 0:
        if restart != 1 or len(pieces) != n:
            return False
        size = (symbol + 8) // 8
        data = b"".join(pieces)
        if len(data) != n * size:
            return False
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(n, 1, size * 8)[:, :, : symbol + 1]
    else:
        if len(pieces) != 1:
            return False
        bits = np.unpackbits(np.frombuffer(pieces[0], np.uint8))
        if len(bits) < n * each * (symbol + 1):
            return False
        bits = bits[: n * each * (symbol + 1)].reshape(n, each, symbol + 1)
    if bits[:, :, 0].any():
        return False
    if symbol == 8:
        value = np.packbits(np.ascontiguousarray(bits[:, :, 1:]), axis=-1)[:, :, 0].astype(np.int32)
    else:
        value = bits[:, :, 1:].astype(np.int32) @ (1 << np.arange(symbol - 1, -1, -1, dtype=np.int32))
    value = np.where(value >> (symbol - 1), value, value - (1 << symbol) + 1)
    coef[:, first : first + each] = value * plus
    return True


def decode(data: bytes, fast: bool = True) -> Image:
    """All scans of a progressive file, accumulated. ``fast`` False reads every code by itself."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quants: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], dict] = {}
    image, at, restart, comment = None, 2, 0, b""
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            h, v = max(c.h for c in comps), max(c.v for c in comps)
            across, down = -(-width // (8 * h)), -(-height // (8 * v))
            for c in comps:
                c.wide, c.high = across * c.h, down * c.v
                c.own_wide, c.own_high = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
                c.coef = np.zeros((c.wide * c.high, 64), np.int32)
            image = Image(width, height, comps, quants, comment)
        elif marker in (0xC0, 0xC1, 0xC9, 0xCA):
            raise ValueError("only Huffman-coded progressive files are read")
        elif marker == 0xDA:
            n = body[0]
            chosen = [(next(c for c in image.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            first, last, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            end = _END.search(data, at)
            stop = end.start() if end else len(data)
            pieces = [p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(data[at:stop])] if restart else [data[at:stop].replace(b"\xff\x00", b"\xff")]
            at = stop
            args = (first, last, approx >> 4, approx & 15, restart)
            pick = lambda k: (tables.get((0, k >> 4), {}), tables.get((1, k & 15), {}))
            if n == 1:
                c, k = chosen[0]
                whole = c.own_wide == c.wide and c.own_high == c.high
                if fast and whole and _fast_scan(pieces, c.coef, *args, *pick(k)):
                    continue
                plan = [[(c.coef, y * c.wide + x, c.ident, *pick(k))] for y in range(c.own_high) for x in range(c.own_wide)]
            else:
                c0 = image.components[0]
                plan = [[(c.coef, (my * c.v + y) * c.wide + mx * c.h + x, c.ident, *pick(k)) for c, k in chosen for y in range(c.v) for x in range(c.h)] for my in range(c0.high // c0.v) for mx in range(c0.wide // c0.h)]
            _read_scan(pieces, plan, *args)
        if image:
            image.comment = comment
    return image


def payload(image: Image) -> bytes:
    """The bytes that ``encode`` was given, from the coefficients."""
    size = struct.unpack(">Q", image.comment)[0]
    value = np.concatenate([c.coef for c in image.components]).ravel()[:size] - 256
    return value.astype(np.uint8).tobytes()


def pad(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def feature(image: Image) -> str:
    """Size, channel means (to a thousandth) and a checksum of the RGB tensor."""
    rgb = image.rgb()
    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // max(1, rgb.shape[0] * rgb.shape[1])
    return f"{image.width}x{image.height}:{mean[0]}:{mean[1]}:{mean[2]}:{zlib.crc32(np.ascontiguousarray(rgb)):08x}"
