"""PNG files to arrays of levels and back: every colour type, depth and interlacing of the format; no other codec is at hand."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Larger pictures are refused before their data are unpacked.
MOST_PIXELS = 1 << 26

#: Samples for each pixel by colour type: gray, RGB, palette, gray with alpha, RGB with alpha.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First column and row, and steps between columns and rows, of the seven interlaced passes.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    out, at = [], len(SIGNATURE)
    while not out or out[-1][0] != b"IEND":
        if at + 12 > len(data):
            raise ValueError("the file ends before its last chunk")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        out.append((kind, body))
        at += 12 + size
    return out


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows from filtered ones. Pixels of one anti-diagonal depend on earlier diagonals alone, so each is done at once."""
    height, n = raw.shape[0], (raw.shape[1] - 1) // step
    kind, data = raw[:, 0], raw[:, 1:].reshape(height, n, step).astype(np.int16)
    if height and kind.max() > 4:
        raise ValueError("unknown filter")
    out = np.zeros((height + 1, n + 1, step), np.int16)
    for t in range(n + height - 1):
        y = np.arange(max(0, t - n + 1), min(height, t + 1))
        x, f = t - y, kind[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[y + 1, x + 1] = (data[y, x] + np.select([f == 1, f == 2, f == 3, f == 4], [left, up, (left + up) >> 1, nearest], 0)) & 255
    return out[1:, 1:].reshape(height, n * step).astype(np.uint8)


def _samples(rows: np.ndarray, width: int, depth: int, per: int) -> np.ndarray:
    """height x width x samples from bytes; of 16 bits the upper 8."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return rows[:, : width * per].reshape(len(rows), width, per)


def decode(data: bytes) -> np.ndarray:
    """height x width (gray) or height x width x 3 levels in 0 to 255, without transparency; a damaged or oversized file raises ValueError."""
    chunks = _chunks(data)
    if chunks[0][0] != b"IHDR" or len(chunks[0][1]) != 13:
        raise ValueError("the header is missing")
    width, height, depth, colour, packing, filtering, interlaced = struct.unpack(">IIBBBBB", chunks[0][1])
    if not width or not height or width * height > MOST_PIXELS or depth not in _DEPTHS.get(colour, ()) or packing or filtering or interlaced > 1:
        raise ValueError("the header is wrong or names too large a picture")
    per, palette = _SAMPLES[colour], np.frombuffer(next((b for k, b in chunks if k == b"PLTE"), b""), np.uint8)
    row_bytes = lambda w: (w * per * depth + 7) // 8
    parts = [(x, y, dx, dy, (width - x + dx - 1) // dx, (height - y + dy - 1) // dy) for x, y, dx, dy in (_PASSES if interlaced else ((0, 0, 1, 1),))]
    parts = [p for p in parts if p[4] > 0 and p[5] > 0]
    size = sum(h * (1 + row_bytes(w)) for *_, w, h in parts)
    try:
        packed = zlib.decompressobj()
        raw = packed.decompress(b"".join(b for k, b in chunks if k == b"IDAT"), size)
    except zlib.error as e:
        raise ValueError("the picture's data are damaged") from e
    if len(raw) != size:
        raise ValueError("the picture's data are too short")
    image, at, flat = np.zeros((height, width, per), np.uint8), 0, np.frombuffer(raw, np.uint8)
    for x, y, dx, dy, w, h in parts:
        n = h * (1 + row_bytes(w))
        rows = _unfiltered(flat[at : at + n].reshape(h, -1), max(1, per * depth // 8))
        image[y::dy, x::dx] = _samples(rows, w, depth, per)
        at += n
    if colour == 3:
        if len(palette) % 3 or len(palette) <= 3 * int(image.max()):
            raise ValueError("the palette is too short")
        return palette.reshape(-1, 3)[image[:, :, 0]]
    if depth < 8:
        image = image * (255 // ((1 << depth) - 1))
    return image[:, :, 0] if per < 3 else image[:, :, :3]


def encode(image: np.ndarray) -> bytes:
    """A PNG file of height x width (gray) or height x width x 3 levels in 0 to 255."""
    levels = np.ascontiguousarray(image, np.uint8)
    height, width = levels.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), levels.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, 8, 0 if levels.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
