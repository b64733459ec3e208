import numpy as np
import pytest

from tesserae.sources import webp

RNG = np.random.default_rng(4)


def image(kind, w, h):
    y, x = np.mgrid[0:h, 0:w]
    if kind == "noise":
        return RNG.integers(0, 256, (h, w, 3)).astype(np.uint8)
    if kind == "flat":
        return np.full((h, w, 3), (7, 200, 31), np.uint8)
    if kind == "ramp":
        return np.stack([x * 3 + y, x + 2 * y, 255 - x], axis=2).astype(np.uint8)
    return np.repeat(((x // 2 + y // 2) % 256)[:, :, None], 3, axis=2).astype(np.uint8)


@pytest.mark.parametrize("kind", ["noise", "flat", "ramp", "gray"])
@pytest.mark.parametrize("size", [(1, 1), (1, 9), (13, 1), (40, 27)])
def test_what_is_encoded_is_decoded(kind, size):
    pixels = image(kind, *size)
    data = webp.encode_lossless(*size, pixels.tobytes())
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and len(data) % 2 == 0
    assert int.from_bytes(data[4:8], "little") == len(data) - 8
    assert webp.decode_lossless(data) == (*size, pixels.tobytes())


def test_more_than_one_block_and_smaller_than_raw():
    pixels = image("ramp", 600, 20)
    data = webp.encode_lossless(600, 20, pixels.tobytes())
    assert len(data) < pixels.size // 7
    assert webp.decode_lossless(data) == (600, 20, pixels.tobytes())


def test_known_file():
    """One red pixel, its bits written by hand: no transform, every code of one symbol."""
    bits = "".join(f"{v:0{n}b}"[::-1] for v, n in [(0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)])
    for symbol in (0, 255, 0, 255):
        bits += "1" + "0" + "1" + f"{symbol:08b}"[::-1]
    bits += "1" + "0" + "0" + "0"
    body = bytes(int(bits[i : i + 8][::-1].rjust(8, "0"), 2) for i in range(0, len(bits), 8))
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode_lossless(data) == (1, 1, b"\xff\0\0")


def test_copies_cache_and_palette():
    """A stream with a colour cache, a copy of a near pixel, and a palette of two colours, eight pixels a byte."""
    class Put(webp._Bits):
        pass

    bits = Put()
    for v, n in [(0x2F, 8), (15, 14), (1, 14), (0, 4), (1 | webp._INDEXED << 1, 3), (1, 8)]:
        bits.put(v, n)
    webp._put_image(bits, np.array([[255, 10, 20, 30], [0, 5, 5, 5]]), False)  # colours as differences
    bits.put(0, 1)
    bits.put(1, 1)
    bits.put(2, 4)  # a cache of four colours
    bits.put(0, 1)
    counts = [0] * 284
    counts[0b10110010] = counts[256] = counts[280] = counts[281] = 1
    cached = (0x1E35A7BD * (0xFF << 24 | 0b10110010 << 8) & 0xFFFFFFFF) >> 30
    counts[280 + cached] = 1
    codes, lengths = webp._put_code(bits, counts)
    for symbol in (0, 0, 255):
        webp._put_code(bits, [int(i == symbol) for i in range(256)])
    webp._put_code(bits, [0, 1] + [0] * 38)  # distance prefix 1: value 2, the pixel to the left
    for symbol in (0b10110010, 256, 280 + cached, 256):
        bits.put(int(codes[symbol]), int(lengths[symbol]))
    body = bits.done()
    data = b"RIFF\0\0\0\0WEBPVP8L" + len(body).to_bytes(4, "little") + body
    one, two = bytes([10, 20, 30]), bytes([15, 25, 35])
    line = b"".join(two if 0b10110010 >> i & 1 else one for i in range(8))
    assert webp.decode_lossless(data) == (16, 2, line * 4)


@pytest.mark.parametrize("level,most", [(100, 0), (80, 1), (60, 2), (40, 4), (0, 16), (-5, 16)])
def test_near_lossless_error_is_bounded(level, most):
    pixels = image("gray", 64, 64)[:, :, 0]
    w, h, rgb = webp.decode_lossless(webp.encode_gray(64, 64, pixels.tobytes(), level))
    got = np.frombuffer(rgb, np.uint8).reshape(h, w, 3).astype(int)
    assert (got[:, :, 0] == got[:, :, 1]).all() and (got[:, :, 0] == got[:, :, 2]).all()
    assert np.abs(got[:, :, 0] - pixels).max() <= most


def test_broken_files_are_refused():
    data = webp.encode_lossless(30, 30, image("noise", 30, 30).tobytes())
    for bad in (b"", b"RIFF", data[:40], data[:12] + b"VP8 " + data[16:], data[:20] + b"\0" + data[21:]):
        with pytest.raises(ValueError):
            webp.decode_lossless(bad)
    with pytest.raises(ValueError):
        webp.encode_lossless(0, 5, b"")


def test_code_lengths_stay_in_bounds():
    counts = [1]
    while len(counts) < 40:
        counts.append(sum(counts) + 1)
    lengths = webp._lengths(counts, 15)
    assert max(lengths) <= 15 and sum(2.0**-n for n in lengths) == 1
    assert webp._lengths([0, 5, 0], 7) == [0, 1, 0]
