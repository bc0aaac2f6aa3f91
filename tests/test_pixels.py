"""Image bytes that the test writes itself, against the pixels they were made from."""

import struct
import zlib

import numpy as np
import pytest

from ragloom.operators import images, pixels


def picture(seed, height=45, width=61):
    """Soft shapes, so that small changes change few bits."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    rgb = np.stack([128 + 60 * np.sin(x / rng.uniform(5, 20) + rng.uniform(0, 6)) + 60 * np.cos(y / rng.uniform(5, 20)) for _ in range(3)], 2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def png_of(rows, depth, colour, kinds=(0, 1, 2, 3, 4), palette=None, laced=0):
    """``rows``: packed bytes of each row; the filters take turns."""
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    out, above = b"", bytes(len(rows[0]))
    for y, row in enumerate(rows):
        kind, line = kinds[y % len(kinds)], bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind]) + bytes(line)
        above = row
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    width = WIDTH[0]
    packed = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, laced)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:50]) + chunk(b"IDAT", packed[50:]) + chunk(b"IEND", b"")


WIDTH = [61]


def test_png_of_every_kind():
    rgb = picture(1)
    grey = pixels.grey(rgb)
    height, width, _ = rgb.shape
    alpha = np.concatenate([rgb, np.full((height, width, 1), 9, np.uint8)], 2)
    wide = np.stack([rgb, np.full_like(rgb, 77)], 3)
    small = (grey // 16).astype(np.uint8)
    table = bytes(v for i in range(16) for v in (i * 10, 255 - i * 5, i))
    packed = [bytes(np.packbits(np.unpackbits(r[:, None], axis=1)[:, 4:].ravel())) for r in small]
    cases = [
        (png_of([r.tobytes() for r in rgb], 8, 2), grey), (png_of([r.tobytes() for r in alpha], 8, 6), grey), (png_of([r.tobytes() for r in wide], 16, 2), grey),
        (png_of([r.astype(np.uint8).tobytes() for r in grey], 8, 0), grey), (png_of(packed, 4, 0), small.astype(int) * 17),
        (png_of(packed, 4, 3, (0,), table), pixels.grey(np.frombuffer(table, np.uint8).reshape(-1, 3)[small])),
        (png_of([np.packbits(r > 100).tobytes() for r in grey], 1, 0, (0, 2)), (grey > 100) * 255),
    ]
    for data, want in cases:
        assert (pixels.png(data) == want).all() and pixels.luma(data) == pixels.shrink(want).ravel().tolist()
    assert pixels.luma(png_of([r.tobytes() for r in rgb], 8, 2, laced=1)) is None and pixels.luma(cases[0][0][:200]) is None


def gif_of(numbers, table, clear_every=100, laced=False):
    """Codes of growing width with clear codes now and then; words of one colour only, so the table grows as a reader's does."""
    height, width = numbers.shape
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)] if laced else range(height)
    bits, grown, size = [], 0, 5
    put = lambda v, n: bits.extend((v >> i) & 1 for i in range(n))
    for i, v in enumerate(int(numbers[y, x]) for y in order for x in range(width)):
        if i % clear_every == 0:
            put(16, size)
            grown = 18
        size = max(5, grown.bit_length())
        put(v, size)
        if i % clear_every:
            grown += 1
        size = max(5, grown.bit_length())
    put(17, size)
    bits += [0] * (-len(bits) % 8)
    data = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x83, 0, 0) + table + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0x40 if laced else 0) + b"\x04" + blocks + b"\x3b"


@pytest.mark.parametrize("laced", [False, True])
def test_gif(laced):
    numbers = (pixels.grey(picture(2)) // 16).astype(np.uint8)
    table = bytes(v for i in range(16) for v in (i * 16, i * 15, 255 - i))
    want = pixels.grey(np.frombuffer(table, np.uint8).reshape(-1, 3)[numbers])
    assert (pixels.gif(gif_of(numbers, table, 9, laced)) == want).all()


def test_hashes_of_alike_and_other_pictures():
    rng = np.random.default_rng(4)
    values = []
    for seed in range(6):
        rgb = picture(seed)
        noisy = np.clip(rgb.astype(int) + rng.integers(-3, 4, rgb.shape), 0, 255).astype(np.uint8)
        a, b = (images.average_hash(pixels.luma(png_of([r.tobytes() for r in p], 8, 2))) for p in (rgb, noisy))
        assert (a ^ b).bit_count() <= images.HAMMING
        values.append(a)
    assert sum((a ^ b).bit_count() > images.HAMMING for i, a in enumerate(values) for b in values[:i]) >= 13  # of 15 pairs
    assert images.average_hash([7] * 64) == (1 << 64) - 1  # at the mean counts as bright
    assert pixels.luma(b"") is None and pixels.luma(b"\xff\xd8\xff\xe0jpeg") is None
    blocks = np.repeat(np.repeat(np.arange(64).reshape(8, 8) * 4, 6, 0), 6, 1)
    assert np.abs(pixels.shrink(blocks) - np.arange(64).reshape(8, 8) * 4).max() < 8 and (pixels.shrink(np.full((3, 100), 9)) == 9).all()
