"""FLAC streams of 8-bit mono samples: a numpy encoder, and a decoder of Rice residuals and linear predictors.

Many frames are handled at once: the k-th sample of every frame of a slice is decoded by the same few array operations, so the
cost of a Python step is shared by thousands of frames. Frame headers carry CRC-8 and frames CRC-16; both are checked, as is
the MD5 of all samples. A seek table gives every frame's first sample and byte offset, so the PCM blocks that the decoder
emits can be read from any of them.

The decoder reads what the format allows for 8-bit mono: constant, verbatim, fixed (order 0-4) and LPC (order 1-32)
subframes, both Rice methods, escaped partitions, wasted bits and any partition order. Streams without a seek table are
decoded frame after frame.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field
from functools import cache

import numpy as np

BLOCK = 4096
RATE = 8000
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}  # fixed values of the format: predictor coefficients


class FlacError(ValueError):
    pass


@cache
def crc8_table() -> bytes:
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value << 1) ^ (0x107 if value & 0x80 else 0)
        out.append(value)
    return bytes(out)


def crc8(data: bytes) -> int:
    table, value = crc8_table(), 0
    for byte in data:
        value = table[value ^ byte]
    return value


@cache
def crc16_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders (polynomial 0x8005) of one byte, and of two bytes."""
    one = np.arange(256, dtype=np.int64) << 8
    for _ in range(8):
        one = np.where(one & 0x8000, (one << 1) ^ 0x18005, one << 1)
    both = np.arange(65536, dtype=np.int64)
    for _ in range(2):
        both = ((both << 8) & 0xFFFF) ^ one[both >> 8]
    return one, both


def crc16_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of ``buf``."""
    one, both = crc16_tables()
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    at, sizes = starts[order].copy(), (ends - starts)[order]
    value = np.zeros(len(at), np.int64)
    odd = sizes % 2 == 1
    value[odd] = one[buf[at[odd]]]
    at[odd] += 1
    pairs = sizes // 2
    active = np.searchsorted(-pairs, -np.arange(pairs[0] if len(pairs) else 0), side="left")
    for n in active:
        own = at[:n]
        value[:n] = both[value[:n] ^ (buf[own].astype(np.int64) << 8) ^ buf[own + 1]]
        at[:n] += 2
    out = np.empty_like(value)
    out[order] = value
    return out


def utf8_number(value: int) -> bytes:
    """A number of up to 36 bits in the format's extended UTF-8."""
    if value < 128:
        return bytes([value])
    tail = []
    while value >= 1 << (6 - len(tail)):
        tail.append(0x80 | value & 63)
        value >>= 6
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | value, *reversed(tail)])


# --- encoder -----------------------------------------------------------------------------------------------------------


def encode(payloads: list[bytes], block: int = BLOCK, partition_order: int = 0, lpc: tuple[tuple[int, ...], int] | None = None) -> list[bytes]:
    """A FLAC stream for each payload; its bytes, less 128, are the samples.

    Each frame takes the cheapest of constant, verbatim, fixed predictors of order 0 to 2 and, where ``lpc`` gives (coefficients,
    shift), that linear predictor. Frames of equal payloads are encoded once for all of them.
    """
    which = {p: k for k, p in enumerate(dict.fromkeys(payloads))}
    unique = list(which)
    data = np.frombuffer(b"".join(unique), np.uint8).astype(np.int32) - 128
    sizes, owner, number = [], [], []
    for k, p in enumerate(unique):
        n = -(-len(p) // block)
        sizes += [block] * (n - 1) + ([len(p) - block * (n - 1)] if n else [])
        owner += [k] * n
        number += range(n)
    frames = _encode_frames(data, np.array(sizes, np.int64), number, partition_order, lpc)
    own: list[list[tuple[int, bytes]]] = [[] for _ in unique]
    for k, n, frame in zip(owner, sizes, frames, strict=True):
        own[k].append((n, frame))
    streams = []
    for k, p in enumerate(unique):
        largest = max(16, min(block, len(p)))
        lengths = [len(f) for _, f in own[k]] or [0]
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        info = struct.pack(">HH", largest, largest) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + md5
        points, first, offset = [], 0, 0
        for n, frame in own[k]:
            points.append(struct.pack(">QQH", first, offset, n))
            first, offset = first + n, offset + len(frame)
        seek = b"".join(points)
        head = b"fLaC" + bytes([0 if points else 0x80]) + len(info).to_bytes(3, "big") + info
        if points:
            head += bytes([0x83]) + len(seek).to_bytes(3, "big") + seek
        streams.append(head + b"".join(f for _, f in own[k]))
    return [streams[which[p]] for p in payloads]


def _fold(residual: np.ndarray) -> np.ndarray:
    return np.where(residual < 0, -2 * residual - 1, 2 * residual)


def _rice(mean: np.ndarray) -> np.ndarray:
    """Rice parameters for folded residuals of these means."""
    return np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.7 + 1e-9)), 0, 14).astype(np.int64)


def _encode_frames(data: np.ndarray, sizes: np.ndarray, number: list[int], partition_order: int, lpc) -> list[bytes]:
    if not len(sizes):
        return []
    count = len(sizes)
    base = np.cumsum(sizes) - sizes
    frame = np.repeat(np.arange(count), sizes)
    place = np.arange(len(data)) - base[frame]

    def residual(coefs, shift=0):
        """What is left of each sample after the prediction; 0 in the warm-up."""
        if not coefs:
            return data
        sums = np.zeros(len(data), np.int64)
        for lag, c in enumerate(coefs, 1):
            sums[lag:] += c * data[:-lag]
        return np.where(place < len(coefs), 0, data - (sums >> shift)).astype(np.int32)

    def bits_of(folded, k, extra):
        """Nearly what each frame takes with these residuals, beside its header: ``k`` samples of warm-up and ``extra`` bits."""
        total, n = np.add.reduceat(folded.astype(np.int64), base), np.maximum(sizes - k, 1)
        rice = _rice(total / n)
        return n * (rice + 1) + (total >> rice) + 8 * k + extra

    order, linear, folded = np.zeros(count, np.int64), np.zeros(count, bool), _fold(data)
    cost = bits_of(folded, 0, 0)
    for coefs, shift in [(FIXED[1], 0), (FIXED[2], 0)] + ([lpc] if lpc else []):
        k, own = len(coefs), (coefs, shift) == lpc
        other = _fold(residual(coefs, shift))
        total = bits_of(other, k, 9 + 15 * k if own else 0)
        better = (total < cost) & (sizes > k)
        if better.any():
            folded = np.where(better[frame], other, folded)
            cost, order, linear = np.where(better, total, cost), np.where(better, k, order), np.where(better, own, linear)

    parts_of = np.where((sizes % (1 << partition_order) == 0) & (sizes >> partition_order > order), partition_order, 0)
    part = place // np.maximum(sizes >> parts_of, 1)[frame]
    first_part = np.cumsum(1 << parts_of) - (1 << parts_of)
    part = part + first_part[frame]
    n_parts = int(first_part[-1] + (1 << parts_of[-1]))
    coded = place >= order[frame]
    held = np.bincount(part, coded, n_parts)
    mean = np.bincount(part, folded * coded, n_parts) / np.maximum(held, 1)
    k = _rice(mean)
    rice = k[part]
    quotient = folded >> rice
    width = np.where(coded, quotient + 1 + rice, 0).astype(np.int64)
    starts_part = np.zeros(len(data), bool)
    starts_part[base] = True
    starts_part[1:] |= part[1:] != part[:-1]
    extra = np.where(starts_part, 4, 0)
    extra[base] += 6

    bits = np.add.reduceat(width + extra, base)
    low, high = np.minimum.reduceat(data, base), np.maximum.reduceat(data, base)
    # An LPC subframe has its coefficients between the warm-up and the residual: 4 + 5 + 15 bits each.
    between = np.where(linear, 9 + 15 * order, 0)
    kind = np.where(low == high, 0, np.where(-(-(bits + between) // 8) + order > sizes, 1, 2))  # constant, verbatim, predicted
    between[kind != 2] = 0
    raw = data.astype(np.int8).view(np.uint8)
    heads = []
    for f in range(count):
        head = b"\xff\xf8\x74\x02" + utf8_number(number[f]) + struct.pack(">H", int(sizes[f]) - 1)
        head += bytes([crc8(head)])
        own = raw[base[f] : base[f] + sizes[f]]
        if kind[f] == 0:
            head += b"\x00" + own[:1].tobytes()
        elif kind[f] == 1:
            head += b"\x02" + own.tobytes()
        elif not linear[f]:
            head += bytes([(8 | int(order[f])) << 1]) + own[: order[f]].tobytes()
        else:
            head += bytes([(32 | int(order[f]) - 1) << 1]) + own[: order[f]].tobytes()
        heads.append(head)
    head_sizes = np.array([len(h) for h in heads])
    frame_sizes = head_sizes + np.where(kind == 2, -(-(bits + between) // 8), 0) + 2
    at = np.cumsum(frame_sizes) - frame_sizes

    out = np.zeros(8 * int(frame_sizes.sum()), np.uint8)
    bit_base = 8 * (at + head_sizes)
    steps = np.cumsum(width + extra)
    code_at = steps - width - (steps[base] - (width + extra)[base])[frame] + (bit_base + between)[frame]
    use = coded & (kind == 2)[frame]

    def put(values, places, n):
        for j in range(n):
            out[places + j] = (values >> (n - 1 - j)) & 1

    where, values, rices = code_at[use] + quotient[use], folded[use], rice[use]
    out[where] = 1
    for j in range(int(rices.max()) if len(rices) else 0):
        some = rices > j
        out[where[some] + rices[some] - j] = (values[some] >> j) & 1
    opens = np.flatnonzero(starts_part & (kind == 2)[frame])
    # The parameter stands right before its partition's first code; the method and the order before the first of all.
    put(rice[opens], code_at[opens] - 4, 4)
    firsts = base[kind == 2]
    put(parts_of[kind == 2], code_at[firsts] - 8, 4)
    predicted = np.flatnonzero(between)
    if len(predicted):
        coefs, shift = lpc
        put(np.full(len(predicted), 14), bit_base[predicted], 4)
        put(np.full(len(predicted), shift & 31), bit_base[predicted] + 4, 5)
        for j, c in enumerate(coefs):
            put(np.full(len(predicted), c & 0x7FFF), bit_base[predicted] + 9 + 15 * j, 15)
    packed = np.packbits(out)
    for f, head in enumerate(heads):
        packed[at[f] : at[f] + head_sizes[f]] = np.frombuffer(head, np.uint8)
    ends = at + frame_sizes - 2
    crc = crc16_of(packed, at, ends)
    packed[ends], packed[ends + 1] = crc >> 8, crc & 255
    return [packed[a : a + n].tobytes() for a, n in zip(at, frame_sizes, strict=True)]


# --- decoder -----------------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """Header of a frame and its subframe; ``bit`` is where the next field starts."""

    start: int
    size: int
    number: int
    bit: int = 0
    kind: str = ""
    order: int = 0
    wasted: int = 0
    coefs: tuple[int, ...] = ()
    shift: int = 0
    warm: list[int] = field(default_factory=list)


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {k: 256 << (k - 8) for k in range(8, 16)}  # fixed values of the format


def parse_frame(data, start: int) -> Frame:
    if bytes(data[start : start + 2]) not in (b"\xff\xf8", b"\xff\xf9"):
        raise FlacError(f"no frame at byte {start}")
    code, rate, at = data[start + 2] >> 4, data[start + 2] & 15, start + 4
    if data[start + 3] >> 4 or data[start + 3] >> 1 & 7 not in (0, 1):
        raise FlacError("only 8-bit mono is supported")
    lead, number = data[at], data[at]
    at += 1
    if lead >= 0xC0:
        more = 1
        while lead & (0x40 >> more):
            more += 1
        number = lead & (0x3F >> more)
        for _ in range(more):
            number = number << 6 | data[at] & 63
            at += 1
    if code == 6:
        size, at = data[at] + 1, at + 1
    elif code == 7:
        size, at = (data[at] << 8 | data[at + 1]) + 1, at + 2
    elif code in SIZES:
        size = SIZES[code]
    else:
        raise FlacError("reserved block size")
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(bytes(data[start:at])) != data[at]:
        raise FlacError(f"CRC-8 of the header at byte {start}")
    frame = Frame(start, size, number, 8 * (at + 1))

    def read(n: int) -> int:
        first, last = frame.bit >> 3, (frame.bit + n + 7) >> 3
        value = int.from_bytes(bytes(data[first:last]), "big") >> (8 * last - frame.bit - n)
        frame.bit += n
        return value & ((1 << n) - 1)

    if read(1):
        raise FlacError("padding bit")
    kind = read(6)
    if read(1):
        frame.wasted = 1
        while not read(1):
            frame.wasted += 1
    bits = 8 - frame.wasted
    if kind == 0:
        frame.kind, frame.warm = "constant", [_signed(read(bits), bits)]
    elif kind == 1:
        frame.kind = "verbatim"
    elif 8 <= kind <= 12:
        frame.kind, frame.order, frame.coefs = "fixed", kind - 8, FIXED[kind - 8]
    elif kind >= 32:
        frame.kind, frame.order = "lpc", kind - 31
    else:
        raise FlacError("reserved subframe")
    if frame.kind in ("fixed", "lpc"):
        frame.warm = [_signed(read(bits), bits) for _ in range(frame.order)]
    if frame.kind == "lpc":
        precision = read(4) + 1
        frame.shift = _signed(read(5), 5)
        frame.coefs = tuple(_signed(read(precision), precision) for _ in range(frame.order))
    return frame


@cache
def _zeros16() -> np.ndarray:
    """Leading zeros of 16 bits."""
    out = np.full(65536, 16, np.int64)
    for k in range(16):
        out[1 << k : 2 << k] = 15 - k
    return out


def _windows(buf: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte on."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    out = np.zeros(len(buf), np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(buf)]
    return out


def decode_frames(buf: np.ndarray, starts: list[int]) -> tuple[list[np.ndarray], list[int], list[Frame]]:
    """Samples, end and header of the frame at each place."""
    data = memoryview(buf)
    frames = [parse_frame(data, s) for s in starts]
    sizes = np.array([f.size for f in frames], np.int64)
    base = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int32)
    bit = np.array([f.bit for f in frames], np.int64)
    coded = [i for i, f in enumerate(frames) if f.kind in ("fixed", "lpc")]
    for i, f in enumerate(frames):
        own = slice(base[i], base[i] + f.size)
        if f.kind == "constant":
            out[own] = f.warm[0]
        elif f.kind == "verbatim":
            bits = 8 - f.wasted
            raw = np.unpackbits(buf[bit[i] >> 3 : (bit[i] + f.size * bits + 7) >> 3])[bit[i] & 7 :][: f.size * bits].reshape(f.size, bits)
            values = raw.astype(np.int32) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int32))
            out[own] = np.where(values >> (bits - 1), values - (1 << bits), values)
            bit[i] += f.size * bits
        else:
            out[base[i] : base[i] + f.order] = f.warm
    if coded:
        coded = np.array(coded)
        order = np.array([frames[i].order for i in coded], np.int64)
        bit[coded] = _residuals(buf, bit[coded], out, base[coded], sizes[coded], order)
        _predict(out, base[coded], sizes[coded], [frames[i] for i in coded])
    ends = (bit + 7) >> 3
    if (ends + 2 > len(buf)).any():
        raise FlacError("the stream ends inside a frame")
    crc = crc16_of(buf, np.array(starts, np.int64), ends)
    wrong = crc != (buf[ends].astype(np.int64) << 8 | buf[ends + 1])
    if wrong.any():
        raise FlacError(f"CRC-16 of the frame at byte {starts[int(np.argmax(wrong))]}")
    for i, f in enumerate(frames):
        if f.wasted:
            out[base[i] : base[i] + f.size] <<= f.wasted
    return [out[b : b + n] for b, n in zip(base, sizes, strict=True)], (ends + 2).tolist(), frames


def _residuals(buf, bit, out, base, sizes, order) -> np.ndarray:
    """Decode the Rice-coded residuals of all frames into ``out``; returns where each ends."""
    windows, zeros, limit = _windows(buf), _zeros16(), 8 * len(buf)
    one = np.uint64(1)

    def peek(where):
        if len(where) and where.max() >= limit:
            raise FlacError("the stream ends inside a frame")
        return windows[where >> 3] << (where & 7).astype(np.uint64)

    def take(where, n: int):
        return (peek(where) >> np.uint64(64 - n)).astype(np.int64)

    method = take(bit, 2)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    wide = np.where(method == 1, 5, 4)
    parts = np.int64(1) << take(bit + 2, 4)
    bit = bit + 6
    if ((sizes % parts != 0) | (sizes // parts < order)).any():
        raise FlacError("partition order")
    for p in range(int(parts.max())):
        own = np.flatnonzero(parts > p)
        each = sizes[own] // parts[own]
        count = each - (order[own] if p == 0 else 0)
        rice = take(bit[own], 5) >> (5 - wide[own])
        bit[own] += wide[own]
        escaped = rice == (1 << wide[own]) - 1
        for i in np.flatnonzero(escaped):  # rare: a partition of plain numbers
            f = own[i]
            n = int(take(bit[f : f + 1], 5)[0])
            bit[f] += 5
            to = base[f] + (order[f] if p == 0 else p * each[i])
            for j in range(count[i]):
                if n:
                    out[to + j] = _signed(int(take(bit[f : f + 1], n)[0]), n)
                    bit[f] += n
        ranked = np.flatnonzero(~escaped)
        ranked = ranked[np.argsort(-count[ranked], kind="stable")]
        lanes, count, each = own[ranked], count[ranked], each[ranked]
        k = rice[ranked].astype(np.uint64)
        where = bit[lanes]
        to = base[lanes] + (order[lanes] if p == 0 else p * each)
        down, signed_k = np.uint64(63) - k, k.astype(np.int64)
        active = np.searchsorted(-count, -np.arange(count[0] if len(count) else 0), side="left")
        for step, n in enumerate(active):
            at = where[:n]
            word = peek(at)
            run = zeros[word >> np.uint64(48)]
            if run.max() == 16:
                run = _long_runs(peek, zeros, at, run)
                word = peek(at + run)
            else:
                word = word << run.astype(np.uint64)
            low = ((word << one) >> one) >> down[:n]  # the k bits after the 1
            folded = (run << signed_k[:n]) | low.astype(np.int64)
            out[to[:n] + step] = (folded >> 1) ^ -(folded & 1)
            where[:n] = at + run + 1 + signed_k[:n]
        bit[lanes] = where
    if (bit > limit).any():
        raise FlacError("the stream ends inside a frame")
    return bit


def _long_runs(peek, zeros, at, run):
    """Zeros before the next 1 where they may be over 15."""
    run = run.copy()
    more = np.flatnonzero(run == 16)
    while len(more):
        step = zeros[peek(at[more] + run[more]) >> np.uint64(48)]
        run[more] += step
        more = more[step == 16]
    return run


def _predict(out, base, sizes, frames) -> None:
    """Add the predictions to the residuals in ``out``."""
    groups: dict[tuple[int, ...] | int, list[int]] = {}
    for i, f in enumerate(frames):
        if f.order:
            groups.setdefault(f.order, []).append(i)
    for order, members in groups.items():
        members.sort(key=lambda i: -sizes[i])
        coefs = np.array([frames[i].coefs for i in members], np.int64).T
        shift = np.array([frames[i].shift for i in members], np.int64)
        if (shift < 0).any():
            raise FlacError("negative shift")
        own, n = base[members], sizes[members]
        active = np.searchsorted(-n, -np.arange(n[0]), side="left")
        past = [out[own + order - 1 - j].astype(np.int64) for j in range(order)]  # the latest first
        for place in range(order, int(n[0])):
            m = active[place]
            total = sum(coefs[j, :m] * past[j][:m] for j in range(order))
            value = out[own[:m] + place] + (total >> shift[:m])
            out[own[:m] + place] = value
            past = [value, *(x[:m] for x in past[:-1])]


@dataclass
class Block:
    """PCM bytes of one frame, with the sample and the byte of the stream that it starts at."""

    sample: int
    offset: int
    pcm: bytes


def _metadata(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Total samples, MD5, seek points and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, total, md5, points = 4, None, b"", []
    while True:
        head, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("the stream ends inside its metadata")
        if head & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise FlacError("only 8-bit mono is supported")
            total, md5 = packed & (1 << 36) - 1, body[18:34]
        elif head & 127 == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
        if head & 128:
            break
    if total is None:
        raise FlacError("no stream information")
    return total, md5, points, at


def decode(streams: list[bytes]) -> list[list[Block]]:
    """PCM blocks of each stream, unsigned 8 bits a sample; raises FlacError on any damage."""
    known = [_metadata(s) for s in streams]
    place = np.cumsum([0, *map(len, streams)])
    buf = np.frombuffer(b"".join(streams), np.uint8)
    out: list[list[Block]] = [[] for _ in streams]
    wave = []  # (stream, byte of the buffer) of the frames to decode together
    follow = []
    for k, (total, _, points, at) in enumerate(known):
        first = place[k] + at
        if points and sum(n for _, _, n in points) == total:
            wave += [(k, int(first + offset)) for _, offset, _ in points]
        elif total:
            wave.append((k, int(first)))
            follow.append(k)
    seeking = set(follow)
    while wave:
        samples, ends, frames = decode_frames(buf, [at for _, at in wave])
        again = []
        for (k, at), values, end in zip(wave, samples, ends, strict=True):
            done = out[k][-1].sample + len(out[k][-1].pcm) if out[k] else 0
            out[k].append(Block(done, at - int(place[k]) - known[k][3], (values + 128).astype(np.uint8).tobytes()))
            if k in seeking and done + len(values) < known[k][0]:
                again.append((k, end))
        wave = again
    for blocks, (total, md5, points, _) in zip(out, known, strict=True):
        pcm = b"".join(b.pcm for b in blocks)
        if len(pcm) != total or (any(md5) and hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 128).tobytes()).digest() != md5):
            raise FlacError("MD5 or length of the samples")
        if points and points[0][0] == 0 and len(points) == len(blocks) and any(b.sample != s for b, (s, _, _) in zip(blocks, points, strict=True)):
            raise FlacError("seek table")
    return out
