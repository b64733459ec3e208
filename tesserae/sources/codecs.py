"""Payload codecs by number, and image decoding.

Lossless and near-lossless WebP are coded here, and so are raw and deflated
payloads of our own (numbers the format has not assigned). PNG is decoded here
and by Spark's image source, JPEG by that source (``images``). Lossy WebP and
depth payloads need libraries: ``add`` takes an encoder and decoder where there
is one, and nothing else stands in for them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from ..functions.registry import DEFLATED, RAW, SPLIT16, WEBP
from . import webp

_CODECS: dict[int, tuple[Callable, Callable]] = {
    RAW: (bytes, bytes),
    DEFLATED: (lambda data: zlib.compress(data, 6), zlib.decompress),
}


def add(number: int, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes]) -> None:
    _CODECS[number] = (encode, decode)


def encode(number: int, data: bytes, w: int = 0, h: int = 0, level: int = 100) -> bytes:
    """A payload of row-major pixels; images need their sides, and gray ones take a near-lossless ``level``."""
    if number in (WEBP, SPLIT16) and number not in _CODECS:
        return webp.encode_gray(w, h, data, level) if len(data) == w * h else webp.encode_lossless(w, h, data)
    return _find(number)[0](data)


def decode(number: int, data: bytes) -> bytes:
    """Pixels of a payload; those of WebP are RGB, gray ones alike in all channels."""
    if number in (WEBP, SPLIT16) and number not in _CODECS:
        return webp.decode_lossless(data)[2]
    return _find(number)[1](data)


def _find(number: int):
    if number not in _CODECS:
        raise LookupError(f"no codec for number {number}; add one")
    return _CODECS[number]


def png(w: int, h: int, rgb: bytes) -> bytes:
    """A PNG file of w by h RGB pixels, without row filters."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + rgb[3 * w * y : 3 * w * (y + 1)] for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_rgb(data: bytes):
    """(width, height, RGB bytes) of an 8-bit PNG: colour as it is, without alpha; gray three times."""
    import numpy as np

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 6):
        raise ValueError("only 8-bit gray, RGB and RGBA, not interlaced")
    w, h, bands = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * bands)
    image, above = np.empty((h, w * bands), np.uint8), np.zeros(w * bands, np.uint8)
    for y in range(h):
        rule, line = int(lines[y, 0]), lines[y, 1:]
        if rule > 4:
            raise ValueError("unknown row filter")
        if rule < 3:
            image[y] = line if rule == 0 else line + above if rule == 2 else np.cumsum(line.reshape(w, bands), axis=0, dtype=np.uint8).reshape(-1)
        else:
            image[y] = np.frombuffer(_unfiltered(line.tobytes(), above.tobytes(), bands, rule == 4), np.uint8)
        above = image[y]
    image = image.reshape(h, w, bands)
    return w, h, (np.repeat(image, 3, axis=2) if bands == 1 else image[:, :, :3]).tobytes()


def _unfiltered(line: bytes, above: bytes, bands: int, paeth: bool) -> bytearray:
    """A row whose bytes are differences to a mean of, or to the nearest among, those to the left, above and between."""
    out = bytearray(bands) + bytearray(len(line))  # zeros to the left of the image
    corners = bytes(bands) + above
    for i, byte in enumerate(line):
        left, up = out[i], above[i]
        if paeth:
            corner = corners[i]
            by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if by_left <= by_up and by_left <= by_corner else up if by_up <= by_corner else corner
        else:
            guess = left + up >> 1
        out[i + bands] = byte + guess & 255
    return out[bands:]


def decode_rgb(data: bytes):
    """(width, height, RGB bytes) of an image, by its first bytes."""
    if data[:3] == b"\xff\xd8\xff":
        import io

        raw = decode(0, data)  # an added JPEG codec gives a PNG or the pixels with their size before
        return png_rgb(raw) if raw[:4] == b"\x89PNG" else (*struct.unpack_from("<II", raw), io.BytesIO(raw[8:]).read())
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return png_rgb(data)
    raise ValueError("neither JPEG nor PNG")
