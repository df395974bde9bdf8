"""FLAC media columns: encode samples losslessly, decode Rice residuals and linear predictors, cut PCM blocks.

Frames are decoded side by side: every lane is one frame of one stream, and all lanes advance by one residual per
numpy step. Frames are found through the seek table where it has a point for each, else one after the other. Header
(CRC-8) and frame (CRC-16) checksums and the stream's MD5 are verified; a damaged stream raises ValueError.

Texts are stored as unsigned 8-bit samples: UTF-8 bytes, padded with spaces to a positive multiple of PAD.

Defined results: null and empty text becomes PAD spaces; a null medium has no blocks; texts of any length are stored
whole; repeated rows give equal values; an empty table gives an empty result; columns named like the added ones are
replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import byte_view, clash_free, materialize, release, slices

PAD, BLOCK, RATE = 192, 1152, 8000
#: Order and coefficient bits of the encoder's own predictors.
LPC_ORDER, LPC_BITS = 4, 10
#: Fixed values of the format: block sizes and sample sizes by code, polynomial predictors by order.
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Bytes of texts or media handled side by side; samples that features read by their offset; waves of described().
SLICE, PROBE, WAVES = 2 << 20, 16, 2


def crc_table(bits: int, poly: int) -> np.ndarray:
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) if c >> (bits - 1) & 1 else c << 1
        out.append(c & ((1 << bits) - 1))
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[starts:ends] for all lanes, byte by byte side by side."""
    table, crc = (CRC8, np.zeros(len(starts), np.int64)) if bits == 8 else (CRC16, np.zeros(len(starts), np.int64))
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, crc = starts[order], lengths[order], crc[order]
    live = len(starts)
    for k in range(int(lengths[0]) if live else 0):
        while live and lengths[live - 1] <= k:
            live -= 1
        byte = data[starts[:live] + k]
        crc[:live] = table[crc[:live] ^ byte] if bits == 8 else (crc[:live] << 8 & 0xFFFF) ^ table[crc[:live] >> 8 ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# --- encoding -------------------------------------------------------------------------------------------------------


def folded(residual: np.ndarray) -> np.ndarray:
    return np.where(residual >= 0, 2 * residual, -2 * residual - 1)


def rice_cost(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter of each row and the bits it takes."""
    n, total = max(u.shape[1], 1), u.sum(axis=1)
    guess = np.maximum(np.log2(np.maximum(total / n, 1e-9) * 0.69), 0).round().astype(np.int64).clip(0, 14)
    best, cost = guess, n * (guess + 1) + (u >> guess[:, None]).sum(axis=1)
    for k in (np.maximum(guess - 1, 0), np.minimum(guess + 1, 14)):
        bits = n * (k + 1) + (u >> k[:, None]).sum(axis=1)
        best, cost = np.where(bits < cost, k, best), np.minimum(bits, cost)
    return best, cost


def predictors(x: np.ndarray, order: int = LPC_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (rows, order) and shifts by Levinson-Durbin over each row's autocorrelation."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, lag:] * f[:, : f.shape[1] - lag]).sum(axis=1) for lag in range(order + 1)], axis=1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((len(x), order)), r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.abs(a).max(axis=1).clip(1e-6)
    shift = np.clip(LPC_BITS - 1 - np.floor(np.log2(top)).astype(np.int64) - 1, 0, 15)
    most = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.round(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int64), shift


def residual_of(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray, order: int) -> np.ndarray:
    n = x.shape[1]
    if not order:
        return x
    guess = sum(coefs[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j] for j in range(order))
    return x[:, order:] - (guess >> shift[:, None])


def put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Write values of a fixed width at bit positions; the positions after them."""
    for j in range(width):
        bits[at + j] = values >> (width - 1 - j) & 1
    return at + width


def utf8_number(n: int) -> bytes:
    """The format's extended UTF-8 form of a frame or sample number."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    lead = (0xFF << (8 - size)) & 0xFF
    return bytes([lead | n >> 6 * (size - 1)] + [0x80 | n >> 6 * k & 0x3F for k in range(size - 2, -1, -1)])


def encode_blocks(x: np.ndarray, numbers: np.ndarray, bits_per_sample: int) -> list[bytes]:
    """One frame for each row of x (mono samples), all rows of one length."""
    rows, n = x.shape
    lanes = np.arange(rows)
    zeros = np.zeros(rows, np.int64)
    sample_code = {v: k for k, v in SAMPLE_BITS.items()}[bits_per_sample]
    kind = np.full(rows, 1)  # subframe type, verbatim at first
    cost, k_best = np.full(rows, n * bits_per_sample), zeros.copy()
    order_of, coefs_of, shift_of = zeros.copy(), np.zeros((rows, LPC_ORDER), np.int64), zeros.copy()
    tries = [(8 + o, o, np.tile(np.array(FIXED[o], np.int64), (rows, 1)), zeros, 0) for o in range(3) if o < n]
    if n > 4 * LPC_ORDER:
        tries.append((32 + LPC_ORDER - 1, LPC_ORDER, *predictors(x), 9 + LPC_ORDER * LPC_BITS))
    for code, order, coefs, shift, extra in tries:
        k, bits = rice_cost(folded(residual_of(x, coefs, shift, order)))
        bits = bits + 10 + order * bits_per_sample + extra
        better = bits < cost
        kind, cost, k_best, order_of = np.where(better, code, kind), np.where(better, bits, cost), np.where(better, k, k_best), np.where(better, order, order_of)
        shift_of = np.where(better, shift, shift_of)
        coefs_of[better, :order] = coefs[better]
        coefs_of[better, order:] = 0
    flat = (x == x[:, :1]).all(axis=1)
    kind, cost = np.where(flat, 0, kind), np.where(flat, bits_per_sample, cost)

    size_code = next((c for c, v in BLOCK_CODES.items() if v == n), 6 if n <= 256 else 7)
    heads = []
    for number in numbers.tolist():
        head = bytes([0xFF, 0xF8, size_code << 4 | 4, sample_code << 1]) + utf8_number(number)
        heads.append(head + (bytes([n - 1]) if size_code == 6 else (n - 1).to_bytes(2, "big") if size_code == 7 else b""))
    head_len = np.array([len(h) for h in heads])
    joined = np.frombuffer(b"".join(heads), np.uint8)
    head_at = np.cumsum(head_len) - head_len
    crc8 = checksums(joined, head_at, head_at + head_len, 8)

    body_bits = 8 + cost
    sizes = head_len + 1 + (body_bits + 7) // 8  # up to the frame's CRC-16
    byte_at = np.cumsum(sizes) - sizes
    bits = np.zeros(int(sizes.sum()) * 8, np.uint8)
    at = (byte_at + head_len + 1) * 8
    at = put(bits, at, kind << 1, 8)
    pick = np.flatnonzero(kind == 0)
    put(bits, at[pick], x[pick, 0] & (1 << bits_per_sample) - 1, bits_per_sample)
    pick = np.flatnonzero(kind == 1)
    if len(pick):
        put(bits, (at[pick, None] + np.arange(n) * bits_per_sample).ravel(), (x[pick] & (1 << bits_per_sample) - 1).ravel(), bits_per_sample)
    for code in sorted(set(kind.tolist()) - {0, 1}):
        pick = lanes[kind == code]
        order, to = int(order_of[pick[0]]), at[pick]
        for j in range(order):
            to = put(bits, to, x[pick, j] & (1 << bits_per_sample) - 1, bits_per_sample)
        if code >= 32:
            to = put(bits, to, np.full(len(pick), LPC_BITS - 1), 4)
            to = put(bits, to, shift_of[pick], 5)
            for j in range(order):
                to = put(bits, to, coefs_of[pick, j] & (1 << LPC_BITS) - 1, LPC_BITS)
        k = k_best[pick]
        to = put(bits, to, zeros[pick], 6)  # method 0, one partition
        to = put(bits, to, k, 4)
        u = folded(residual_of(x[pick], coefs_of[pick], shift_of[pick], order))
        wide = (u >> k[:, None]) + 1 + k[:, None]
        begin = to[:, None] + np.cumsum(wide, axis=1) - wide
        stop = begin + (u >> k[:, None])
        bits[stop.ravel()] = 1
        for j in range(int(k.max(initial=0))):
            has = np.broadcast_to((k > j)[:, None], u.shape)
            bits[(stop + 1 + j)[has]] = (u >> np.maximum(k - 1 - j, 0)[:, None] & 1)[has].astype(np.uint8)
    packed = np.packbits(bits)
    for i, h in enumerate(heads):
        packed[byte_at[i] : byte_at[i] + len(h)] = np.frombuffer(h, np.uint8)
    packed[byte_at + head_len] = crc8
    crc = checksums(packed, byte_at, byte_at + sizes, 16)
    whole = packed.tobytes()
    return [whole[a : a + s] + c.to_bytes(2, "big") for a, s, c in zip(byte_at.tolist(), sizes.tolist(), crc.tolist())]


def encode_streams(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """One FLAC stream for each payload of unsigned 8-bit samples, with a seek point for every frame."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64) - 128
    sizes = np.array([len(p) for p in payloads], np.int64)
    frames = -(-sizes // block)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = (np.cumsum(sizes) - sizes)[owner] + number * block
    length = np.minimum(block, sizes[owner] - number * block)
    coded: list[bytes] = [b""] * len(owner)
    for n in np.unique(length).tolist():
        pick = np.flatnonzero(length == n)
        for i, frame in zip(pick.tolist(), encode_blocks(samples[start[pick, None] + np.arange(n)], number[pick], 8)):
            coded[i] = frame
    out, first = [], np.cumsum(frames) - frames
    for p, payload in enumerate(payloads):
        own = coded[first[p] : first[p] + frames[p]]
        lengths = [len(f) for f in own]
        info = block.to_bytes(2, "big") * 2 + min(lengths, default=0).to_bytes(3, "big") + max(lengths, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        points = np.zeros(len(own), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        points["sample"], points["offset"] = np.arange(len(own)) * block, np.cumsum(lengths) - lengths
        points["count"] = length[first[p] : first[p] + frames[p]]
        table = points[: ((1 << 24) - 1) // 18].tobytes()
        out.append(b"fLaC\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


# --- decoding -------------------------------------------------------------------------------------------------------


class Bits:
    """Big-endian bit access to a buffer at many positions."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(16, np.uint8)))
        wide = np.zeros(len(self.data) - 7, np.uint64)
        for k in range(8):
            wide = wide << np.uint64(8) | self.data[k : k + len(wide)].astype(np.uint64)
        self.wide, self.last = wide, len(wide) - 1

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 or more bits from each position, at the top."""
        return self.wide[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (0 to 56, a number or one for each position) as unsigned."""
        n = np.asarray(n, np.int64)
        return np.where(n > 0, self.window(at) >> ((64 - n) & 63).astype(np.uint64), np.uint64(0)).astype(np.int64)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        v, n = self.read(at, n), np.asarray(n, np.int64)
        return np.where(n > 0, v - ((v >> np.maximum(n - 1, 0) & 1) << n), 0)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Number of 0 bits before the next 1."""
        top = (self.window(at) >> np.uint64(32)).astype(np.int64)
        out = 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        lane = np.flatnonzero(top == 0)
        while len(lane):
            if (at[lane] + out[lane] > 8 * self.last).any():
                raise ValueError("a residual runs past the end")
            top = (self.window(at[lane] + out[lane]) >> np.uint64(32)).astype(np.int64)
            out[lane] += 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
            lane = lane[top == 0]
        return out


def decode_residuals(bits: Bits, at: np.ndarray, order: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Residuals into out (most samples, lanes), all lanes one symbol per step; the positions after them."""
    method, partitions = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual method")
    at = at + 6
    span = sizes >> partitions
    k, raw = np.zeros(len(at), np.int64), np.full(len(at), -1)
    steps = np.unique(span)
    for i in range(int(sizes.max(initial=0))):
        live = (i >= order) & (i < sizes)
        if i <= int(order.max(initial=0)) or (i % steps == 0).any():
            lane = np.flatnonzero(live & ((i == order) | (i % span == 0)))
            width = 4 + method[lane]
            k[lane] = bits.read(at[lane], width)
            at[lane] += width
            escape = k[lane] == (1 << width) - 1
            raw[lane] = np.where(escape, bits.read(at[lane], 5), -1)
            at[lane] += 5 * escape
            k[lane] = np.where(escape, 0, k[lane])
        plain = live & (raw < 0)
        if plain.all():
            q = bits.zeros(at)
            u = q << k | bits.read(at + q + 1, k)
            out[i] = (u >> 1) ^ -(u & 1)
            at += q + 1 + k
            continue
        lane = np.flatnonzero(plain)
        q = bits.zeros(at[lane])
        u = q << k[lane] | bits.read(at[lane] + q + 1, k[lane])
        out[i, lane] = (u >> 1) ^ -(u & 1)
        at[lane] += q + 1 + k[lane]
        lane = np.flatnonzero(live & (raw >= 0))
        if len(lane):
            out[i, lane] = bits.signed(at[lane], raw[lane])
            at[lane] += raw[lane]
    return at


def decode_channel(bits: Bits, at: np.ndarray, sizes: np.ndarray, depth: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One subframe of each lane: samples (most samples, lanes) and the positions after them."""
    most, lanes = int(sizes.max(initial=0)), len(at)
    kind = bits.read(at + 1, 6)
    wasted = bits.read(at + 7, 1)
    at = at + 8
    extra = np.where(wasted == 1, bits.zeros(at) + 1, 0)
    at = at + extra
    depth = depth - extra
    kinds[:] = kind
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise ValueError("reserved subframe type")
    x = np.zeros((most, lanes), np.int64)
    lane = np.flatnonzero(kind == 0)
    x[:, lane] = bits.signed(at[lane], depth[lane])
    at[lane] += depth[lane]
    lane = np.flatnonzero(kind == 1)
    if len(lane):
        steps = np.arange(most)[:, None]
        x[:, lane] = bits.signed(at[lane] + steps * depth[lane], np.broadcast_to(depth[lane], (most, len(lane))))
        at[lane] += depth[lane] * sizes[lane]
    lane = np.flatnonzero(kind >= 8)
    if len(lane):
        order, depth, own = order[lane], depth[lane], at[lane]
        top = int(order.max(initial=0))
        y = np.zeros((most, len(lane)), np.int64)
        for j in range(top):
            has = np.flatnonzero(j < order)
            y[j, has] = bits.signed(own[has], depth[has])
            own[has] += depth[has]
        coefs, shift = np.zeros((top, len(lane)), np.int64), np.zeros(len(lane), np.int64)
        for o in range(1, 5):
            has = np.flatnonzero(kind[lane] == 8 + o)
            if len(has):
                coefs[:o, has] = np.array(FIXED[o])[:, None]
        lpc = np.flatnonzero(kind[lane] >= 32)
        if len(lpc):
            width = bits.read(own[lpc], 4) + 1
            shift[lpc] = bits.signed(own[lpc] + 4, 5)
            own[lpc] += 9
            if (shift[lpc] < 0).any():
                raise ValueError("negative predictor shift")
            for j in range(int(order[lpc].max(initial=0))):
                has = j < order[lpc]
                coefs[j, lpc[has]] = bits.signed(own[lpc[has]], width[has])
                own[lpc[has]] += width[has]
        warm = y[:top].copy()
        at[lane] = decode_residuals(bits, own, order, sizes[lane], y)
        for j in range(top):
            y[j] = np.where(j < order, warm[j], y[j])
        for i in range(1, most if top else 0):
            guess = sum(coefs[j] * y[i - 1 - j] for j in range(min(top, i)))
            y[i] += np.where(i >= order, guess >> shift, 0)
        x[:, lane] = y
    return x << extra, at


def decode_frames(bits: Bits, starts: np.ndarray, depth_of: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Frames at byte positions: samples (channels, n) of each, the byte positions after them, subframe types."""
    at = starts * 8
    if (bits.read(at, 14) != 0x3FFE).any() or bits.read(at + 14, 1).any():
        raise ValueError("no frame where one should start")
    size_code, rate_code, channel, sample = bits.read(at + 16, 4), bits.read(at + 20, 4), bits.read(at + 24, 4), bits.read(at + 28, 3)
    at = at + 32
    lead = bits.read(at, 8)
    ones = 8 - np.frexp((255 - lead).astype(np.float64))[1]
    at = at + 8 * np.maximum(ones, 1)
    table = np.array([BLOCK_CODES.get(c, 0) for c in range(16)])
    sizes = table[size_code]
    sizes = np.where(size_code == 6, bits.read(at, 8) + 1, np.where(size_code == 7, bits.read(at, 16) + 1, sizes))
    at = at + np.where(size_code == 6, 8, np.where(size_code == 7, 16, 0))
    at = at + np.where(rate_code == 12, 8, np.where((rate_code == 13) | (rate_code == 14), 16, 0))
    head = at >> 3
    if (checksums(bits.data, starts, head, 8) != bits.read(at, 8)).any():
        raise ValueError("frame header checksum differs")
    if (sizes == 0).any() or (channel > 10).any():
        raise ValueError("reserved frame header")
    at = at + 8
    depth = np.array([SAMPLE_BITS.get(c, 0) for c in range(8)])[sample]
    depth = np.where(sample == 0, depth_of, depth)
    channels = np.where(channel < 8, channel + 1, 2)
    got, types = [], np.zeros((int(channels.max(initial=1)), len(at)), np.int64)
    for c in range(int(channels.max(initial=0))):
        lane = np.flatnonzero(c < channels)
        side = ((channel == 8) | (channel == 10)) & (c == 1) | (channel == 9) & (c == 0)
        kinds = np.zeros(len(lane), np.int64)
        x, after = decode_channel(bits, at[lane], sizes[lane], (depth + side)[lane], kinds)
        types[c, lane] = kinds
        whole = np.zeros((int(sizes.max()), len(at)), np.int64)
        whole[: len(x), lane] = x
        got.append(whole)
        at[lane] = after
    if len(got) > 1:
        a, b = got[0].copy(), got[1].copy()
        mid = (a << 1) | (b & 1)
        got[0] = np.where(channel == 9, a + b, np.where(channel == 10, (mid + b) >> 1, a))
        got[1] = np.where(channel == 8, a - b, np.where(channel == 10, (mid - b) >> 1, b))
    end = (at + 7) >> 3
    if (checksums(bits.data, starts, end, 16) != bits.read(end * 8, 16)).any():
        raise ValueError("frame checksum differs")
    stacked = np.stack(got)
    return [stacked[:channels[i], : sizes[i], i] for i in range(len(at))], end + 2, types[0]


def stream_parts(data: bytes) -> dict:
    """Metadata of one stream: info fields, seek points (sample, offset, count), byte position of the first frame."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, out = 4, {"points": np.zeros((0, 3), np.int64)}
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind & 127 == 3:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
            points = points[points["sample"] != np.iinfo(np.uint64).max]
            out["points"] = np.stack([points[c].astype(np.int64) for c in points.dtype.names], axis=1)
        at += 4 + size
        if kind & 128:
            return out | {"first": at}


def decode_streams(streams: list[bytes]) -> list[tuple[dict, list[tuple[int, np.ndarray]], np.ndarray]]:
    """(metadata, [(sample offset, samples (channels, n))], subframe types) of each stream, checksums verified."""
    parts = [stream_parts(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    bits = Bits(np.frombuffer(b"".join(streams), np.uint8))
    blocks: list[list] = [[] for _ in streams]
    types: list[list] = [[] for _ in streams]
    seekable = [i for i, p in enumerate(parts) if len(p["points"]) and p["points"][:, 2].sum() == p["samples"]]
    if seekable:
        owner = np.repeat(seekable, [len(parts[i]["points"]) for i in seekable])
        starts = np.concatenate([base[i] + parts[i]["first"] + parts[i]["points"][:, 1] for i in seekable])
        offsets = np.concatenate([parts[i]["points"][:, 0] for i in seekable])
        got, _, kinds = decode_frames(bits, starts, np.array([p["bits"] for p in parts])[owner])
        for i, offset, x, kind in zip(owner.tolist(), offsets.tolist(), got, kinds.tolist()):
            blocks[i].append((offset, x))
            types[i].append(kind)
    at = {i: int(base[i] + p["first"]) for i, p in enumerate(parts) if i not in set(seekable) and base[i] + p["first"] < base[i + 1]}
    seen = dict.fromkeys(at, 0)
    while at:
        lanes = list(at)
        got, after, kinds = decode_frames(bits, np.array([at[i] for i in lanes]), np.array([parts[i]["bits"] for i in lanes]))
        for i, x, end, kind in zip(lanes, got, after.tolist(), kinds.tolist()):
            blocks[i].append((seen[i], x))
            types[i].append(kind)
            seen[i] += x.shape[1]
            at[i] = end
            if end >= base[i + 1]:
                del at[i]
    return [(p, b, np.array(t, np.int64)) for p, b, t in zip(parts, blocks, types)]


def pcm(meta: dict, x: np.ndarray) -> bytes:
    """Interleaved signed little-endian samples."""
    width = (meta["bits"] + 7) // 8
    return np.ascontiguousarray(x.T).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def blocks_of(meta: dict, frames: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, bytes]]:
    """PCM blocks of one stream: sample offset, samples, PCM bytes, in order of the offsets."""
    return [(at, x.shape[1], pcm(meta, x)) for at, x in sorted(frames, key=lambda f: f[0])]


def read_samples(meta: dict, blocks: list[tuple[int, int, bytes]], start: int, stop: int) -> bytes:
    """PCM bytes of samples start to stop (exclusive), found by seeking to the block that holds the first."""
    width, out = (meta["bits"] + 7) // 8 * meta["channels"], []
    for at, n, raw in blocks[max(bisect_right(blocks, start, key=lambda b: b[0]) - 1, 0) :]:
        if at >= stop:
            break
        out.append(raw[max(start - at, 0) * width : max(min(stop - at, n), 0) * width])
    return b"".join(out)


def verify(meta: dict, blocks: list[tuple[int, int, bytes]]) -> None:
    """The blocks follow one another without a gap and their MD5 is the stream's."""
    at, digest = 0, hashlib.md5()
    for offset, n, raw in blocks:
        if offset != at:
            raise ValueError("a block is missing")
        at += n
        digest.update(raw)
    if any(meta["md5"]) and digest.digest() != meta["md5"]:
        raise ValueError("stream digest differs")


def payload_of(meta: dict, frames: list[tuple[int, np.ndarray]]) -> bytes:
    """Unsigned 8-bit payload of a mono stream after its MD5 is verified."""
    blocks = blocks_of(meta, frames)
    verify(meta, blocks)
    return unsigned(b"".join(raw for _, _, raw in blocks))


def unsigned(raw: bytes) -> bytes:
    """Unsigned form of signed 8-bit PCM."""
    return (np.frombuffer(raw, np.uint8) ^ 0x80).tobytes()


# --- columns --------------------------------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    return raw + b" " * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_bytes and media, the text as a FLAC stream; one narrow pass."""
    docs = docs.drop("n_bytes", "media")
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string("n_bytes long, media binary").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text, SLICE):
            data, offsets = byte_view(piece.column(text))
            whole, ends = data.tobytes(), offsets.tolist()
            media = encode_streams([padded(whole[a:b]) for a, b in zip(ends, ends[1:])])
            yield pa.RecordBatch.from_arrays(piece.columns + [pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=piece.schema.names + ["n_bytes", "media"])

    return docs.mapInArrow(run, schema)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, block_offsets array<long>"


def describe(media: bytes, meta: dict, frames: list, types: np.ndarray) -> tuple:
    """FEATURES of one stored stream, from the PCM blocks it decodes to; the tail and the middle are read by offset."""
    blocks = blocks_of(meta, frames)
    verify(meta, blocks)
    digest, size, energy, peak, crossings, before = hashlib.sha256(), 0, 0, 0, 0, None
    for _, n, raw in blocks:
        x = np.frombuffer(raw, np.int8).astype(np.int64)
        digest.update(unsigned(raw))
        size, energy, peak = size + n, energy + int((x * x).sum()), max(peak, int(np.abs(x).max(initial=0)))
        below = x < 0
        crossings += int((below[1:] != below[:-1]).sum()) + (before is not None and bool(below[0]) != before)
        before = bool(below[-1])
    tail = zlib.crc32(unsigned(read_samples(meta, blocks, size - PROBE, size)))
    middle = zlib.crc32(unsigned(read_samples(meta, blocks, size // 2, size // 2 + PROBE)))
    lpc, fixed = int((types >= 32).sum()), int(((types >= 8) & (types < 32)).sum())
    feature = f"blocks={len(blocks)};lpc={lpc};fixed={fixed};other={len(blocks) - lpc - fixed};energy={energy};peak={peak};crossings={crossings};middle={middle}"
    return size, digest.hexdigest(), tail, len(media), hashlib.sha256(media).hexdigest(), feature, len(blocks), [at for at, _, _ in blocks]


def features(stored: DataFrame) -> DataFrame:
    """stored plus FEATURES of its media column, decoded and verified."""
    added = T._parse_datatype_string(FEATURES)
    stored = stored.drop(*added.names)
    schema = T.StructType(stored.schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "media", SLICE):
            media = piece.column("media").to_pylist()
            told = [m for m in media if m is not None]
            found = iter([describe(m, *x) for m, x in zip(told, decode_streams(told))])
            rows = [next(found) if m is not None else (None,) * len(added.names) for m in media]
            arrays = [pa.array(list(c), f) for c, f in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(piece.columns + arrays, names=piece.schema.names + added.names)

    return stored.mapInArrow(run, schema)


def pcm_blocks(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each decoded block: key, block, sample_offset, n_samples, channels, rate, pcm. A range of samples is
    read by filtering on sample_offset."""
    kind = stored.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "media", SLICE):
            pairs = [(k, m) for k, m in zip(piece.column(key).to_pylist(), piece.column("media").to_pylist()) if m is not None]
            rows = []
            for (k, _), (meta, frames, _) in zip(pairs, decode_streams([m for _, m in pairs])):
                rows += [(k, i, at, n, meta["channels"], meta["rate"], raw) for i, (at, n, raw) in enumerate(blocks_of(meta, frames))]
            if rows:
                types = (piece.schema.field(key).type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                names = [key, "block", "sample_offset", "n_samples", "channels", "rate", "pcm"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return stored.select(key, "media").mapInArrow(run, f"{key} {kind}, block int, sample_offset long, n_samples int, channels int, rate int, pcm binary")


def described(docs: DataFrame, waves: int = WAVES) -> DataFrame:
    """FEATURES of docs(doc_id, text) from media stored in the shared folder and read back.

    Documents go in waves by a hash of their identifier; a wave's media leave the folder when its features are written,
    so scratch space is a wave's media and not the corpus'. Each wave reads the texts anew."""
    wave, done = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(waves)), []
    for w in range(waves):
        media = materialize(store(docs.filter(wave == w)).drop("text"), "media", "zstd")
        done.append(materialize(features(media).drop("media"), "features", "zstd"))
        release(media)
    return reduce(DataFrame.unionByName, done)


def op2_flac(spark, sf_dir: str) -> DataFrame:
    """Features of every document's text stored as FLAC, read back and cut into PCM blocks."""
    return described(clash_free(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
