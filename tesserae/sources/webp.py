"""Lossless WebP: an encoder in numpy and a decoder of the whole bit stream, both from the public format description.

The encoder subtracts green from red and blue, predicts each pixel from its
neighbours by the rule that leaves least, and codes what is left with one
prefix code a channel. Near-lossless images have their values rounded before.
"""

from __future__ import annotations

import heapq
import struct

#: Fixed values of the format: order of code lengths, and places (across, up) of the 120 nearest pixels.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAREST = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_PREDICT, _COLOUR, _GREEN, _INDEXED = range(4)


# --- encoding ---


class _Bits:
    """Bits, lowest first; arrays of codes are written at once."""

    def __init__(self):
        self.parts = []

    def put(self, value: int, n: int) -> None:
        import numpy as np

        self.parts.append(np.array([value >> i & 1 for i in range(n)], np.uint8))

    def put_codes(self, codes, lengths) -> None:
        import numpy as np

        ends = np.cumsum(lengths, dtype=np.int64)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        starts = ends - lengths
        for i in range(int(lengths.max(initial=0))):
            live = lengths > i
            out[starts[live] + i] = codes[live] >> i & 1
        self.parts.append(out)

    def done(self) -> bytes:
        import numpy as np

        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def _lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of a prefix code for symbols by count, none longer than ``most``; a lone symbol has length 1."""
    least = 0
    while True:
        heap = [(max(c, least), i, (i,)) for i, c in enumerate(counts) if c]
        heapq.heapify(heap)
        depth = [0] * len(counts)
        if len(heap) == 1:
            depth[heap[0][2][0]] = 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(depth) <= most:
            return depth
        least = max(1, 2 * least, sum(counts) >> most + 2)


def _codes(lengths: list[int]) -> list[int]:
    """Canonical codes of the lengths, first bit lowest."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code, last = code << n - last, n
        out[symbol] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


def _put_code(bits: _Bits, counts):
    """Write the prefix code that suits ``counts``; codes and lengths by symbol, as arrays."""
    import numpy as np

    used = [s for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        bits.put(1, 1)
        bits.put(len(used) - 1, 1)
        bits.put(1, 1)
        for s in used:
            bits.put(s, 8)
        for s in used[: len(used) if len(used) == 2 else 0]:
            lengths[s] = 1
    else:
        lengths = _lengths(list(counts), 15)
        bits.put(0, 1)
        # runs of zeros are written short, other lengths one by one
        said, at = [], 0
        while at < len(lengths):
            run = 0
            while at + run < len(lengths) and not lengths[at + run] and run < 138:
                run += 1
            if run >= 3:
                said.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
                at += run
            else:
                said.append((lengths[at], 0, 0))
                at += 1
        of_lengths = _lengths([sum(s == i for s, _, _ in said) for i in range(19)], 7)
        lone = sum(map(bool, of_lengths)) == 1
        order = [of_lengths[i] for i in LENGTH_ORDER]
        n = max(4, max(i for i, x in enumerate(order) if x) + 1)
        bits.put(n - 4, 4)
        for x in order[:n]:
            bits.put(x, 3)
        bits.put(0, 1)
        codes = _codes(of_lengths)
        for s, extra, size in said:
            bits.put(codes[s], 0 if lone else of_lengths[s])
            bits.put(extra, size)
    return np.array(_codes(lengths), np.int64), np.array(lengths, np.int64)


def _put_image(bits: _Bits, argb, top: bool) -> None:
    """Pixels (n, 4: alpha, red, green, blue) as literals, one prefix code a channel."""
    import numpy as np

    bits.put(0, 1)  # no colour cache
    if top:
        bits.put(0, 1)  # one set of codes for the whole image
    coded = []
    for channel, size in ((2, 256 + 24), (1, 256), (3, 256), (0, 256)):
        coded.append((channel, *_put_code(bits, np.bincount(argb[:, channel], minlength=size).tolist())))
    _put_code(bits, [0] * 40)
    codes = np.stack([codes[argb[:, c]] for c, codes, _ in coded], axis=1).reshape(-1)
    bits.put_codes(codes, np.stack([n[argb[:, c]] for c, _, n in coded], axis=1).reshape(-1))


def _around(pixels):
    """Left, top, top left and top right of each pixel (h, w, 4), as the format has them inside the image."""
    import numpy as np

    h, w, _ = pixels.shape
    flat = np.concatenate([np.zeros((w + 1, 4), np.int64), pixels.reshape(-1, 4)])
    at = np.arange(h * w) + w + 1
    return (flat[np.maximum(0, at - d)].reshape(h, w, 4) for d in (1, w, w + 1, w - 1))


def _guesses(left, top, corner, right):
    """Predictions by number of the rule, as functions of neighbours; arrays or rows of four channels."""
    import numpy as np

    mean = lambda a, b: (a + b) >> 1
    clip = lambda x: np.clip(x, 0, 255)

    def select():
        by_left, by_top = np.abs(top - corner).sum(axis=-1, keepdims=True), np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(by_left < by_top, left, top)

    def half():
        a = mean(left, top)
        return clip(a + np.trunc((a - corner) / 2).astype(np.int64))

    black = np.zeros_like(left)
    black[..., 0] = 255
    return (
        lambda: black, lambda: left, lambda: top, lambda: right, lambda: corner, lambda: mean(mean(left, right), top),
        lambda: mean(left, corner), lambda: mean(left, top), lambda: mean(corner, top), lambda: mean(top, right),
        lambda: mean(mean(left, corner), mean(top, right)), select, lambda: clip(left + top - corner), half)


def _residuals(pixels, rule: int):
    """What the rule leaves of each pixel; the first row and column have rules of their own."""
    left, top, corner, right = _around(pixels)
    guess = _guesses(left, top, corner, right)[rule]().copy()
    guess[:, 0] = top[:, 0]
    guess[0] = left[0]
    guess[0, 0] = (255, 0, 0, 0)
    return (pixels - guess) & 255


def encode_lossless(w: int, h: int, rgb: bytes) -> bytes:
    """A WebP file of w by h RGB pixels."""
    import numpy as np

    if not (1 <= w <= 16_384 and 1 <= h <= 16_384):
        raise ValueError("sides must be from 1 to 16384 pixels")
    colour = np.frombuffer(rgb, np.uint8).reshape(h, w, 3).astype(np.int64)
    pixels = np.concatenate([np.full((h, w, 1), 255), colour], axis=2)
    pixels[:, :, 1] = (pixels[:, :, 1] - pixels[:, :, 2]) & 255
    pixels[:, :, 3] = (pixels[:, :, 3] - pixels[:, :, 2]) & 255

    def cost(rest):
        return sum(-(n * np.log2(n / n.sum())).sum() for n in (c[c > 0] for c in (np.bincount(rest[:, :, k].reshape(-1)) for k in (1, 2, 3))))

    rule, rest = min(((r, _residuals(pixels, r)) for r in (1, 2, 11, 12)), key=lambda x: cost(x[1]))
    bits = _Bits()
    bits.put(0x2F, 8)
    bits.put(w - 1, 14)
    bits.put(h - 1, 14)
    bits.put(0, 4)  # no alpha, version 0
    bits.put(1 | _GREEN << 1, 3)
    bits.put(1 | _PREDICT << 1, 3)
    bits.put(7, 3)  # blocks of 512 pixels
    _put_image(bits, np.tile(np.array([[255, 0, rule, 0]]), (-(-w // 512) * -(-h // 512), 1)), False)
    bits.put(0, 1)  # no more transforms
    _put_image(bits, rest.reshape(-1, 4), True)
    data = bits.done()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def near_lossless(values: bytes, level: int) -> bytes:
    """Values rounded to fewer levels: exact at 100, off by at most 1, 2, 4, 8 and 16 from 80, 60, 40, 20 and 0 on."""
    import numpy as np

    step = 1 << min(5, (100 - max(0, min(level, 100)) + 19) // 20)
    found = np.frombuffer(values, np.uint8).astype(np.int64)
    return np.minimum(255, (found + step // 2) // step * step).astype(np.uint8).tobytes()


def encode_gray(w: int, h: int, gray: bytes, level: int = 100) -> bytes:
    """A WebP file of gray pixels, each value in all three channels; ``level`` under 100 is near-lossless."""
    import numpy as np

    return encode_lossless(w, h, np.repeat(np.frombuffer(near_lossless(gray, level), np.uint8), 3).tobytes())


# --- decoding ---


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.held, self.n, self.at = data, 0, 0, 0

    def bits(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data) + 8:
                raise ValueError("the image ends too early")
            self.held |= (self.data[self.at] if self.at < len(self.data) else 0) << self.n
            self.at, self.n = self.at + 1, self.n + 8
        value = self.held & (1 << n) - 1
        self.held >>= n
        self.n -= n
        return value

    def symbol(self, code) -> int:
        """The next symbol of a code: a lone symbol, or symbols by (length, bits)."""
        if isinstance(code, int):
            return code
        found, n = 0, 0
        while True:
            found |= self.bits(1) << n
            n += 1
            symbol = code.get((n, found))
            if symbol is not None:
                return symbol
            if n > 15:
                raise ValueError("no such code")


def _code_of(lengths: list[int]):
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1:
        return used[0] if used else 0
    return {(n, code): s for s, (n, code) in enumerate(zip(lengths, _codes(lengths))) if n}


def _read_code(r: _Reader, size: int):
    if r.bits(1):
        n, wide = r.bits(1) + 1, r.bits(1)
        symbols = [r.bits(8 if wide else 1)] + [r.bits(8) for _ in range(n - 1)]
        return symbols[0] if n == 1 else {(1, i): s for i, s in enumerate(symbols)}
    order = [0] * 19
    for i in range(4 + r.bits(4)):
        order[LENGTH_ORDER[i]] = r.bits(3)
    code, most = _code_of(order), size
    if r.bits(1):
        most = 2 + r.bits(2 + 2 * r.bits(3))
    lengths, before = [], 8
    while len(lengths) < size and most:
        most -= 1
        s = r.symbol(code)
        if s < 16:
            lengths.append(s)
            before = s or before
        else:
            n = 3 + r.bits(2) if s == 16 else 3 + r.bits(3) if s == 17 else 11 + r.bits(7)
            lengths += [before if s == 16 else 0] * n
    return _code_of((lengths + [0] * size)[:size])


def _number(r: _Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + r.bits(extra) + 1


def _read_image(r: _Reader, w: int, h: int, top: bool) -> list[int]:
    """Pixels as numbers (alpha, red, green, blue from the highest byte on)."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    cache = [0] * (1 << cache_bits)
    which, shift, across = None, 0, 0
    groups = 1
    if top and r.bits(1):
        shift = r.bits(3) + 2
        across = (w + (1 << shift) - 1) >> shift
        which = [p >> 8 & 0xFFFF for p in _read_image(r, across, (h + (1 << shift) - 1) >> shift, False)]
        groups = max(which) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(r, n) for n in sizes] for _ in range(groups)]
    out: list[int] = []
    total, code = w * h, codes[0]

    def keep(pixel):
        out.append(pixel)
        if cache_bits:
            cache[(0x1E35A7BD * pixel & 0xFFFFFFFF) >> 32 - cache_bits] = pixel

    while len(out) < total:
        if which is not None:
            y, x = divmod(len(out), w)
            code = codes[which[(y >> shift) * across + (x >> shift)]]
        green = r.symbol(code[0])
        if green < 256:
            red, blue, alpha = (r.symbol(c) for c in code[1:4])
            keep(alpha << 24 | red << 16 | green << 8 | blue)
        elif green < 280:
            length, far = _number(r, green - 256), _number(r, r.symbol(code[4]))
            if far <= 120:
                dx, dy = NEAREST[far - 1]
                far = max(1, dx + dy * w)
            else:
                far -= 120
            if far > len(out):
                raise ValueError("a copy from before the image")
            for _ in range(min(length, total - len(out))):
                keep(out[-far])
        else:
            keep(cache[green - 280])
    return out


def _array(pixels: list[int], w: int, h: int):
    import numpy as np

    return np.array(pixels, ">u4").view(np.uint8).reshape(h, w, 4).astype(np.int64)


def _undo_prediction(rest, rules, bits: int):
    import numpy as np

    h, w, _ = rest.shape
    out = np.zeros((h, w, 4), np.int64)
    for y in range(h):
        for x in range(w):
            if not y:
                guess = out[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                guess = out[y - 1, 0]
            else:
                right = out[y - 1, x + 1] if x + 1 < w else out[y, 0]
                guess = _guesses(out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], right)[rules[y >> bits, x >> bits, 2] & 15]()
            out[y, x] = (rest[y, x] + guess) & 255
    return out


def _undo_colour(pixels, factors, bits: int):
    import numpy as np

    h, w, _ = pixels.shape
    own = factors[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    signed = lambda x: ((x + 128) & 255) - 128
    delta = lambda factor, value: signed(factor) * signed(value) >> 5
    out = pixels.copy()
    out[..., 1] = (pixels[..., 1] + delta(own[..., 3], pixels[..., 2])) & 255
    out[..., 3] = (pixels[..., 3] + delta(own[..., 2], pixels[..., 2]) + delta(own[..., 1], out[..., 1])) & 255
    return out


def decode_lossless(data: bytes):
    """(width, height, RGB bytes) of a lossless WebP file."""
    import numpy as np

    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP")
    at, body = 12, None
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + size % 2
    if body is None or body[:1] != b"\x2f":
        raise ValueError("not a lossless WebP")
    r = _Reader(body[1:])
    w, h = r.bits(14) + 1, r.bits(14) + 1
    if r.bits(4) >> 1:
        raise ValueError("unknown version")
    undo, inner = [], w
    while r.bits(1):
        kind = r.bits(2)
        if kind in (_PREDICT, _COLOUR):
            bits = r.bits(3) + 2
            sides = (inner + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits
            undo.append((kind, bits, _array(_read_image(r, *sides, False), *sides), inner))
        elif kind == _GREEN:
            undo.append((kind, 0, None, inner))
        else:
            n = r.bits(8) + 1
            table = np.cumsum(_array(_read_image(r, n, 1, False), n, 1), axis=1) & 255
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, bits, table[0], inner))
            inner = (inner + (1 << bits) - 1) >> bits
    pixels = _array(_read_image(r, inner, h, True), inner, h)
    for kind, bits, extra, width in reversed(undo):
        if kind == _PREDICT:
            pixels = _undo_prediction(pixels, extra, bits)
        elif kind == _COLOUR:
            pixels = _undo_colour(pixels, extra, bits)
        elif kind == _GREEN:
            pixels[..., 1] = (pixels[..., 1] + pixels[..., 2]) & 255
            pixels[..., 3] = (pixels[..., 3] + pixels[..., 2]) & 255
        else:
            each = 8 >> bits
            x = np.arange(width)
            index = pixels[:, x >> bits, 2] >> (x & (1 << bits) - 1) * each & (1 << each) - 1
            padded = np.concatenate([extra, np.zeros((256, 4), np.int64)])
            pixels = padded[index]
    return w, h, pixels[..., 1:].astype(np.uint8).tobytes()
