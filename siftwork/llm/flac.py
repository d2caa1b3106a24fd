"""Media columns as FLAC: a codec over NumPy, for batches of streams.

``encode_batch`` writes one mono 8-bit stream for each row, in blocks of 192 samples: STREAMINFO
with the MD5 of the samples, a SEEKTABLE with a point every ``SEEK_BLOCKS`` blocks, and a frame for
each block, the cheapest of a constant, a fixed linear predictor of order 0 to 4 with Rice coded
residuals, and verbatim samples. All frames of a batch are made at once.

``decode_batch`` reads such streams back at once: it finds the frames by their sync codes and
header checks, verifies the CRC-8 and CRC-16 of each, decodes all Rice residuals in step, and
undoes the predictors. Any other FLAC stream (linear predictors with coefficients, partitions,
escapes, stereo, other depths and block sizes) goes through ``decode_stream``, frame by frame.
``pcm_blocks`` gives blocks of PCM with their sample offsets, and ``seek`` one block without the rest.

Defined results: a null payload is an empty one; a stream that fails a check raises ``FlacError``,
as does one that ends early; a stream of no samples is empty. Equal payloads give equal streams.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.bytescan import pieces, spread
from siftwork.llm.common import table

BLOCK, RATE, SEEK_BLOCKS = 192, 8000, 64


class FlacError(ValueError):
    """A stream that isn't FLAC, is damaged, or ends early."""


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & mask
        out[i] = c
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_CRC8_LIST, _CRC16_LIST = _CRC8.tolist(), _CRC16.tolist()


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each span, all spans in step from the longest on."""
    order = np.argsort(starts - ends, kind="stable")
    at, size = starts[order], (ends - starts)[order]
    crc = np.zeros(len(at), np.uint16)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for t, n in enumerate(alive):
        byte = data[at[:n] + t]
        if bits == 8:
            crc[:n] = _CRC8[crc[:n] ^ byte]
        else:
            crc[:n] = (crc[:n] << np.uint16(8)) ^ _CRC16[(crc[:n] >> np.uint16(8)) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the UTF-8-like code, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1 if k < 7 else 36))
    tail = [0x80 | (n >> 6 * i & 0x3F) for i in reversed(range(size - 1))]
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1), *tail])


def _number_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of coded numbers, looked up by distinct number."""
    distinct, which = np.unique(numbers, return_inverse=True)
    coded = [_coded_number(int(n)) for n in distinct]
    width = max((len(c) for c in coded), default=1)
    out = np.zeros((len(coded), width), np.uint8)
    for i, c in enumerate(coded):
        out[i, : len(c)] = list(c)
    return out[which], np.array([len(c) for c in coded], np.int64)[which]


def _header(samples: int, md5: bytes, seek: bytes) -> bytes:
    info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + ((RATE << 44) | (7 << 36) | samples).to_bytes(8, "big") + md5
    blocks = b"\x00" + len(info).to_bytes(3, "big") + info if not seek else b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
    return b"fLaC" + (blocks if seek else b"\x80" + blocks[1:])


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of bytes 0 to 255; their lengths are positive multiples of 192."""
    size = np.array([len(p) for p in payloads], np.int64)
    if (size % BLOCK).any() or not size.all():
        raise FlacError("payloads must be positive multiples of 192 bytes")
    if not payloads:
        return []
    unsigned = np.frombuffer(b"".join(payloads), np.uint8)
    signed = (unsigned ^ 0x80).view(np.int8)
    x = signed.reshape(-1, BLOCK).astype(np.int16)
    per = size // BLOCK
    frames = len(x)
    number = np.arange(frames) - np.repeat(np.cumsum(per) - per, per)

    # the cheapest predictor and Rice parameter
    best = np.full(frames, 8 + 8 * BLOCK, np.int64)  # verbatim
    order, rice = np.full(frames, -1), np.zeros(frames, np.int64)
    folded = np.zeros((frames, BLOCK), np.uint16)
    residual = x
    for o in range(5):
        if o:
            residual = np.diff(residual, axis=1)
        u = ((residual << 1) ^ (residual >> 15)).view(np.uint16)
        total = u.sum(axis=1, dtype=np.int64)
        guess = np.clip(np.floor(np.log2(np.maximum(total / u.shape[1], 1))).astype(np.int64), 0, 7)
        for k in (guess, np.maximum(guess - 1, 0)):
            bits = 8 + 8 * o + 10 + (u >> k[:, None].astype(np.uint16)).sum(axis=1, dtype=np.int64) + (k + 1) * u.shape[1]
            less = bits < best
            best[less], order[less], rice[less] = bits[less], o, k[less]
            folded[less, o:] = u[less]
    constant = (x == x[:, :1]).all(axis=1)
    order[constant] = -2

    coded, coded_size = _number_bytes(number)
    body = np.where(constant, 16, best)
    head = 4 + coded_size + 1
    frame_size = head + (body + 7) // 8 + 2
    end = np.cumsum(frame_size)
    start = end - frame_size
    out = np.zeros(int(end[-1]), np.uint8)

    # Rice codes as bits
    coded_frames = np.flatnonzero(order >= 0)
    if len(coded_frames):
        o, k = order[coded_frames], rice[coded_frames]
        first = (start + head)[coded_frames] * 8 + 8 + 8 * o
        bits = np.zeros(len(out) * 8, np.uint8)
        for j in range(3):  # the parameter, in the last of 2 + 4 + 4 bits
            bits[first + 9 - j] = k >> j & 1
        lo = np.cumsum(np.full(len(o), BLOCK)) - BLOCK
        pick, of = spread(lo + o, lo + BLOCK)
        u, kk = folded[coded_frames].reshape(-1)[pick].astype(np.int64), k[of]
        length = (u >> kk) + 1 + kk
        upto = np.cumsum(length)
        begin_of = np.cumsum(BLOCK - o) - (BLOCK - o)
        before = np.concatenate([[0], upto])[begin_of]
        at = upto - length - before[of] + first[of] + 10
        stop = at + (u >> kk)
        bits[stop] = 1
        for j in range(int(k.max(initial=0))):
            low = np.flatnonzero(kk > j)
            bits[stop[low] + kk[low] - j] = (u[low] >> j) & 1
        out |= np.packbits(bits)
    # headers, warm-up and plain samples
    out[start], out[start + 1], out[start + 2], out[start + 3] = 0xFF, 0xF8, 0x14, 0x02
    for j in range(coded.shape[1]):
        some = coded_size > j
        out[start[some] + 4 + j] = coded[some, j]
    out[start + head - 1] = _crcs(out, start, start + head - 1, 8).astype(np.uint8)
    sub = start + head
    out[sub] = np.where(order >= 0, (8 + np.maximum(order, 0)) << 1, np.where(constant, 0, 2))
    raw = signed.view(np.uint8).reshape(-1, BLOCK)
    for j in range(4):
        some = order > j
        out[sub[some] + 1 + j] = raw[some, j]
    out[sub[constant] + 1] = raw[constant, 0]
    plain = np.flatnonzero(order == -1)
    if len(plain):
        out[sub[plain][:, None] + 1 + np.arange(BLOCK)] = raw[plain]
    crc = _crcs(out, start, end - 2, 16)
    out[end - 2], out[end - 1] = crc >> 8, crc & 0xFF

    streams, first_frame, at = [], 0, 0
    for n, frames_in in zip(size, per, strict=True):
        mine = start[first_frame : first_frame + frames_in]
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(mine[i] - mine[0]), BLOCK) for i in range(0, int(frames_in), SEEK_BLOCKS))
        md5 = hashlib.md5(signed[at : at + n].tobytes(), usedforsecurity=False).digest()
        streams.append(_header(int(n), md5, points) + out[mine[0] : end[first_frame + frames_in - 1]].tobytes())
        first_frame, at = first_frame + int(frames_in), at + int(n)
    return streams


class Info(NamedTuple):
    block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    audio: int  # where the first frame begins


def read_info(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, info, seek, last = 4, None, [], False
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata end early")
        last, kind, n = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = (int.from_bytes(body[2:4], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34])
        elif kind == 3:
            seek = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
        at += 4 + n
    if info is None:
        raise FlacError("no STREAMINFO")
    return Info(*info, seek, at)


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise FlacError("stream ends early")
        value = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n)
        self.at += n
        return value & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def _residuals(b: _Bits, block: int, order: int) -> list[int]:
    method, partitions = b.read(2), b.read(4)
    if method > 1:
        raise FlacError("unknown residual coding")
    width, out = 4 + method, []
    for p in range(1 << partitions):
        n = (block >> partitions) - (order if p == 0 else 0)
        k = b.read(width)
        if k == (1 << width) - 1:
            raw = b.read(5)
            out += [b.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            u = b.unary() << k | b.read(k)
            out.append(u >> 1 ^ -(u & 1))
    return out


_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(b: _Bits, block: int, bits: int) -> list[int]:
    if b.read(1):
        raise FlacError("bad subframe")
    kind = b.read(6)
    wasted = b.unary() + 1 if b.read(1) else 0
    bits -= wasted
    if kind == 0:
        out = [b.signed(bits)] * block
    elif kind == 1:
        out = [b.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(bits) for _ in range(order)]
        shift, weights = 0, _FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision, shift = b.read(4) + 1, b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        for r in _residuals(b, block, order):
            out.append(r + (sum(w * out[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise FlacError("reserved subframe")
    return [v << wasted for v in out] if wasted else out


def _crc(data: bytes, steps: list[int], bits: int) -> int:
    c = 0
    for byte in data:
        c = steps[(c >> (bits - 8)) ^ byte] ^ (c << 8 & (1 << bits) - 1)
    return c


def _frame(data: bytes, at: int, info: Info) -> tuple[list[list[int]], int]:
    """(samples of each channel, end of the frame), with both checks verified."""
    b = _Bits(data, at)
    if b.read(15) != 0x7FFC:
        raise FlacError(f"no frame at {at}")
    b.read(1)
    size_code, rate_code, layout, depth_code = b.read(4), b.read(4), b.read(4), b.read(3)
    b.read(1)
    lead = b.read(8)
    for _ in range(0 if lead < 0x80 else 7 - (~lead & 0xFF).bit_length()):
        b.read(8)
    block = 192 if size_code == 1 else 576 << size_code - 2 if 2 <= size_code <= 5 else 1 << size_code
    if not size_code:
        raise FlacError("reserved block size")
    if size_code in (6, 7):
        block = b.read(8 * (size_code - 5)) + 1
    if rate_code >= 12:
        b.read(8 if rate_code == 12 else 16)
    depth = (info.bits, 8, 12, 0, 16, 20, 24, 32)[depth_code]
    if b.read(8) != _crc(data[at : b.at // 8 - 1], _CRC8_LIST, 8):
        raise FlacError(f"CRC-8 of the frame at {at}")
    channels = [_subframe(b, block, depth + ((layout, c) in ((8, 1), (9, 0), (10, 1)))) for c in range(layout + 1 if layout < 8 else 2)]
    b.at = (b.at + 7) // 8 * 8
    end = b.at // 8
    if b.read(16) != _crc(data[at:end], _CRC16_LIST, 16):
        raise FlacError(f"CRC-16 of the frame at {at}")
    if layout >= 8:
        one, two = channels
        if layout == 8:
            channels = [one, [x - y for x, y in zip(one, two, strict=True)]]
        elif layout == 9:
            channels = [[x + y for x, y in zip(one, two, strict=True)], two]
        else:
            both = [(2 * m + (s & 1), s) for m, s in zip(one, two, strict=True)]
            channels = [[(m + s) >> 1 for m, s in both], [(m - s) >> 1 for m, s in both]]
    return channels, end + 2


def decode_stream(data: bytes) -> tuple[Info, list[list[int]]]:
    """Any FLAC stream: its STREAMINFO and the samples of each channel."""
    info = read_info(data)
    out: list[list[int]] = [[] for _ in range(info.channels)]
    at = info.audio
    while at < len(data) and (not info.samples or len(out[0]) < info.samples):
        block, at = _frame(data, at, info)
        for mine, new in zip(out, block, strict=True):
            mine += new
    if info.samples and len(out[0]) != info.samples:
        raise FlacError("stream ends early")
    return info, out


def seek(data: bytes, sample: int) -> tuple[int, list[list[int]]]:
    """(first sample, samples) of the block that holds a sample, from the nearest seek point before it."""
    info = read_info(data)
    if not 0 <= sample < info.samples:
        raise FlacError("no such sample")
    first, offset = max(((s, o) for s, o, _ in info.seek if s <= sample), default=(0, 0))
    at = info.audio + offset
    while True:
        block, at = _frame(data, at, info)
        if sample < first + len(block[0]):
            return first, block
        first += len(block[0])


def _own_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(start, end, header length) of every frame of streams of this module's form, all checks verified; else None."""
    sync = np.flatnonzero((data[:-5] == 0xFF) & (data[1:-4] == 0xF8) & (data[2:-3] == 0x14) & (data[3:-2] == 0x02))
    stream = np.searchsorted(starts, sync, "right") - 1
    inside = (stream >= 0) & (sync + 6 < ends[stream])
    sync, stream = sync[inside], stream[inside]
    lead = data[sync + 4]
    coded = 1 + sum((lead >= limit).astype(np.int64) for limit in (0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE))
    fits = (sync + 5 + coded < ends[stream]) & ((lead < 0x80) | (lead >= 0xC0))
    sync, stream, coded = sync[fits], stream[fits], coded[fits]
    good = _crcs(data, sync, sync + 4 + coded, 8) == data[sync + 4 + coded]
    sync, stream, coded = sync[good], stream[good], coded[good]
    if not np.array_equal(np.bincount(stream, minlength=len(starts)), blocks):
        return None
    number = np.arange(len(sync)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    expected, expected_size = _number_bytes(number)
    if not np.array_equal(coded, expected_size) or any((data[sync[coded > j] + 4 + j] != expected[coded > j, j]).any() for j in range(expected.shape[1])):
        return None
    first = np.cumsum(blocks) - blocks
    if not np.array_equal(sync[first], starts):
        return None
    end = np.append(sync[1:], 0)
    end[first + blocks - 1] = ends
    stored = data[end - 2].astype(np.uint16) << np.uint16(8) | data[end - 1]
    if not np.array_equal(_crcs(data, sync, end - 2, 16), stored):
        return None
    return sync, end, 5 + coded


def decode_batch(streams: list[bytes]) -> list[bytes]:
    """The payloads of 8-bit mono streams, as unsigned bytes; MD5s verified."""
    infos = [read_info(s) for s in streams]
    samples: list = [None] * len(streams)
    ours = [i for i, f in enumerate(infos) if f.block == BLOCK and f.channels == 1 and f.bits == 8 and f.samples and f.samples % BLOCK == 0]
    groups = [ours] if ours else []
    while groups:  # a stream of another encoder is told apart by halving, and doesn't slow down the others
        group = groups.pop()
        found = _decode_own([streams[i] for i in group], [infos[i] for i in group])
        if found is not None:
            for i, mine in zip(group, found, strict=True):
                samples[i] = mine
        elif len(group) > 1:
            groups += [group[: len(group) // 2], group[len(group) // 2 :]]
    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        if samples[i] is None:
            if info.channels != 1 or info.bits != 8:
                raise FlacError("not 8-bit mono")
            samples[i] = np.array(decode_stream(s)[1][0], np.int64).astype(np.int8)
    out = []
    for info, mine in zip(infos, samples, strict=True):
        if any(info.md5) and hashlib.md5(mine.tobytes(), usedforsecurity=False).digest() != info.md5:
            raise FlacError("MD5 of the samples")
        out.append((mine.view(np.uint8) ^ 0x80).tobytes())
    return out


def _decode_own(streams: list[bytes], infos: list[Info]) -> list[np.ndarray] | None:
    audio = [s[i.audio :] for s, i in zip(streams, infos, strict=True)]
    size = np.array([len(a) for a in audio], np.int64)
    data = np.frombuffer(b"".join(audio) + bytes(8), np.uint8)
    ends = np.cumsum(size)
    blocks = np.array([i.samples // BLOCK for i in infos], np.int64)
    found = _own_frames(data, ends - size, ends, blocks)
    if found is None:
        return None
    start, end, head = found
    sub = start + head
    kind = data[sub] >> 1
    x = np.zeros((len(start), BLOCK), np.int16)
    signed = data.view(np.int8)
    constant, plain, fixed = kind == 0, kind == 1, (kind >= 8) & (kind <= 12)
    if not (constant | plain | fixed).all() or (data[sub] & 1).any():
        return None
    x[constant] = signed[sub[constant] + 1][:, None]
    x[plain] = signed[sub[plain][:, None] + 1 + np.arange(BLOCK)]
    coded = np.flatnonzero(fixed)
    if len(coded):
        order = kind[coded].astype(np.int64) - 8
        at = (sub[coded] + 1 + order) * 8
        window = (data[:-2].astype(np.uint32) << np.uint32(16)) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | data[2:]
        code = window[at >> 3] >> 14  # ten bits, byte-aligned: method, partitions, parameter
        if (code >> 4).any():
            return None
        k = (code & 15).astype(np.int64)
        if (k > 7).any():
            return None
        bits = np.unpackbits(data)
        ones = np.append(np.flatnonzero(bits).astype(np.int32), np.int32(len(bits)))
        before = np.zeros(len(bits) + 1, np.int32)
        np.cumsum(bits, out=before[1:])
        at, mask = at + 10, (1 << k) - 1
        residual = np.zeros((BLOCK, len(coded)), np.int16)
        limit = end[coded] * 8
        for t in range(BLOCK):
            live = order <= t if t < 4 else slice(None)
            p = ones[before[np.minimum(at[live], len(bits))]].astype(np.int64)
            if (p >= limit[live]).any():
                raise FlacError("residuals run out of their frame")
            q, low = p - at[live], p + 1
            u = q << k[live] | ((window[np.minimum(low >> 3, len(window) - 1)].astype(np.int64) >> (24 - (low & 7) - k[live])) & mask[live])
            residual[t, live] = (u >> 1) ^ -(u & 1)
            at[live] = low + k[live]
        for o in range(5):
            mine = np.flatnonzero(order == o)
            if not len(mine):
                continue
            warm = signed[sub[coded[mine]][:, None] + 1 + np.arange(o)].astype(np.int16)
            levels = [np.diff(warm, n=j, axis=1)[:, :1] for j in range(o)]
            y = residual[o:, mine].T
            for lead in reversed(levels):
                y = np.cumsum(np.concatenate([lead, y], axis=1, dtype=np.int16), axis=1, dtype=np.int16)
            x[coded[mine]] = y
    flat = x.astype(np.int8).reshape(-1)
    bound = np.cumsum(blocks * BLOCK)
    return [flat[a:b] for a, b in zip(bound - blocks * BLOCK, bound, strict=True)]


def padded(text: bytes) -> bytes:
    """``text`` and blanks up to a positive multiple of 192 bytes."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b" ")


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes of the text, media: its padded bytes as FLAC."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                raw = part.column(text).cast(pa.large_binary()).fill_null(b"").to_pylist()
                media = encode_batch([padded(r) for r in raw])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def features(payload: bytes) -> str:
    """Levels of the signal in whole numbers: least, greatest, sum of squares, turns through zero."""
    x = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    return f"min={x.min()};max={x.max()};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def read_back(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload (decoded), media, feature."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "media", 1_500_000):
                payload = decode_batch(part.column("media").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("n_bytes"), pa.array(payload, pa.binary()), part.column("media"), pa.array([features(p) for p in payload])], names=[key, "n_bytes", "payload", "media", "feature"])

    return stored.select(key, "n_bytes", "media").mapInArrow(scan, f"`{key}` {stored.schema[key].dataType.simpleString()}, n_bytes long, payload binary, media binary, feature string")


def pcm_blocks(stored: DataFrame, key: str = "doc_id", blocks: int = SEEK_BLOCKS) -> DataFrame:
    """key, sample_offset, n_samples, pcm: runs of ``blocks`` blocks of unsigned 8-bit PCM, each readable alone."""
    step = blocks * BLOCK
    back = read_back(stored, key).select(key, "payload", F.explode(F.sequence(F.lit(0), F.length("payload") - 1, F.lit(step))).alias("sample_offset"))
    pcm = F.substring(F.col("payload"), F.col("sample_offset") + 1, F.lit(step))
    return back.select(key, F.col("sample_offset").cast("long").alias("sample_offset"), F.length(pcm).alias("n_samples"), pcm.alias("pcm"))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = read_back(store(docs))
    tail = F.crc32(F.expr("substring(payload, -16, 16)"))
    return back.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
