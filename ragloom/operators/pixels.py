"""Grey values of images from their bytes: PNG and the first frame of GIF, scaled to 8 x 8.

What is neither, is cut short or is interlaced in PNG's way has no grey values,
so it has no perceptual hash and counts as unlike any other image.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIDE = 8
#: Pixels beyond which an image is not read.
MOST = 1 << 26
#: Channels by PNG's kind of colour.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of (..., 3) bytes, as integers."""
    return rgb[..., :3].astype(np.int64) @ np.array([2126, 7152, 722]) // 10000


def shrink(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A grey image as side x side values, each a mean weighted by a triangle over its surroundings."""

    def weights(n: int) -> np.ndarray:
        scale = n / side
        reach = max(1.0, scale)
        far = np.abs(np.arange(n)[None] + 0.5 - (np.arange(side)[:, None] + 0.5) * scale) / reach
        w = np.maximum(0.0, 1.0 - far)
        return w / w.sum(1)[:, None]

    return np.clip(np.round(weights(image.shape[0]) @ image @ weights(image.shape[1]).T), 0, 255).astype(int)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes without PNG's row filter; ``step`` bytes back is the same channel of the pixel before."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out, up, left, corner = row.tolist(), above.tolist(), [0] * step, [0] * step
    for i, v in enumerate(out):
        k = i % step
        a, b, c = left[k], up[i], corner[k]
        if kind == 3:
            v += (a + b) // 2
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            v += a if p <= q and p <= r else b if q <= r else c
        out[i] = left[k] = v & 255
        corner[k] = b
    return np.array(out, np.uint8)


def png(data: bytes) -> np.ndarray | None:
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += size + 12
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(part)
        elif name == b"IEND":
            break
    width, height, depth, colour, _, _, laced = head
    if laced or not width or not height or width * height > MOST:
        return None
    channels = _CHANNELS[colour]
    bits = channels * depth
    line, step = (width * bits + 7) // 8, max(1, bits // 8)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), height * (line + 1)), np.uint8).reshape(height, line + 1)
    rows, above = np.empty((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        rows[y] = above = _unfilter(int(raw[y, 0]), raw[y, 1:], above, step)
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        rows = (np.unpackbits(rows, axis=1).reshape(height, -1, depth) << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.uint8)
        rows = rows if colour == 3 else rows * np.uint8(255 // ((1 << depth) - 1))
    values = rows[:, : width * channels].reshape(height, width, channels)
    if colour == 3:
        return grey(palette[values[..., 0]])
    return values[..., 0].astype(np.int64) if channels < 3 else grey(values)


def _lzw(data: bytes, least: int, most: int) -> list[int]:
    """Colour numbers of GIF's variable-length codes."""
    clear, out = 1 << least, []
    words: list[tuple[int, ...]] = []
    width, held, bits, last = least + 1, 0, 0, None
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear:
                words, width, last = [(i,) for i in range(clear)] + [(), ()], least + 1, None
                continue
            if code == clear + 1 or len(out) >= most:
                return out
            word = words[code] if code < len(words) else (*last, last[0])
            out += word
            if last is not None and len(words) < 4096:
                words.append((*last, word[0]))
                if len(words) == 1 << width and width < 12:
                    width += 1
            last = word
    return out


def gif(data: bytes) -> np.ndarray | None:
    _, _, flags = struct.unpack("<HHB", data[6:11])
    at, table = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        table, at = data[at : at + n], at + n
    while data[at] == 0x21:  # extensions
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    if data[at] != 0x2C:
        return None
    width, height, flags = struct.unpack("<HHB", data[at + 5 : at + 10])
    at += 10
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        table, at = data[at : at + n], at + n
    least, at, parts = data[at], at + 1, []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    if not width or not height or width * height > MOST:
        return None
    numbers = np.array(_lzw(b"".join(parts), least, width * height)[: width * height]).reshape(height, width)
    if flags & 0x40:  # rows come in four passes
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]
        numbers = numbers[np.argsort(order)]
    return grey(np.frombuffer(table, np.uint8).reshape(-1, 3)[numbers])


def luma(data: bytes) -> list[int] | None:
    """64 grey values of an image in rows, or None."""
    try:
        image = png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else gif(data) if data[:6] in (b"GIF87a", b"GIF89a") else None
    except Exception:  # noqa: BLE001 - any bytes may claim to be an image
        return None
    return None if image is None else shrink(image).ravel().tolist()
