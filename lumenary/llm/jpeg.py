"""Baseline JPEG in numpy: grey images of one flat block per sample, and DC-only decoding of any.

Many images are worked on at once: the restart intervals of all of them are lanes that advance
block by block together.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# Fixed values of the format: code counts by length and values of the usual luminance DC table,
# and an AC table with end-of-block alone.
DC_COUNTS, DC_VALUES = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_COUNTS, AC_VALUES = (1,) + (0,) * 15, (0,)
SOI, EOI, SOF0, DHT, SOS, DQT, DRI, COM, APP0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDA, 0xDB, 0xDD, 0xFE, 0xE0
#: Samples of a block's side, the most blocks of an image's side, and the least ones of a row.
SIDE, MOST, ROW = 8, 65535 // 8, 24
LANES = 1 << 14
#: The next marker that isn't a stuffed zero or a restart.
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def codes(counts, values) -> dict[int, tuple[int, int]]:
    """Value to (code, length) of a canonical Huffman table."""
    out, code, k = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for v in values[k : k + c]:
            out[v] = (code, n)
            code += 1
        k, code = k + c, code << 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def shape(n: int) -> tuple[int, int]:
    """Blocks (wide, high) of an image that holds n samples, wide a multiple of ROW."""
    wide = ROW * max(1, -(-n // (ROW * (MOST // ROW * ROW))))
    return wide, -(-n // wide)


def _head(n: int) -> bytes:
    wide, high = shape(n)
    parts = [
        bytes([0xFF, SOI]), _segment(COM, b"samples=%d" % n), _segment(DQT, bytes([0]) + bytes([SIDE]) * 64),
        _segment(SOF0, bytes([8]) + (high * SIDE).to_bytes(2, "big") + (wide * SIDE).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(DHT, bytes([0x00, *DC_COUNTS, *DC_VALUES])), _segment(DHT, bytes([0x10, *AC_COUNTS, *AC_VALUES])),
        _segment(DRI, wide.to_bytes(2, "big")), _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0])),
    ]
    return b"".join(parts)


@lru_cache(1)
def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of a whole flat block, by its DC difference plus 255."""
    dc, (end, end_n) = codes(DC_COUNTS, DC_VALUES), codes(AC_COUNTS, AC_VALUES)[0]
    bits, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        low = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], length[d + 255] = ((code << size | low) << end_n) | end, n + size + end_n
    return bits, length


def _scan(samples: np.ndarray, wide: int, number: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of rows of wide samples, a restart marker after each but an image's last.

    number: each row's place in its image. Returns the bytes and where each row's begin (with
    the end).
    """
    lanes = samples.reshape(-1, wide).astype(np.int16) - 128
    diff = np.empty_like(lanes)
    diff[:, 0], diff[:, 1:] = lanes[:, 0], lanes[:, 1:] - lanes[:, :-1]
    bits, length = _block_codes()
    diff += 255
    value, size = bits[diff], length[diff]
    ends = np.cumsum(size, axis=1)
    lane_bytes = (ends[:, -1] + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(lane_bytes)])
    at = (begin[:-1, None] << 3) + ends - size
    value <<= 24 - (at & 7) - size
    at >>= 3
    total = int(begin[-1])
    out = np.zeros(total + 3, np.int64)
    flat, value = at.reshape(-1), value.reshape(-1)
    for k, shift in enumerate((16, 8, 0)):
        part = np.bincount(flat, (value >> shift) & 255, minlength=total)
        out[k : k + len(part)] += part.astype(np.int64)
    out = out[:total].astype(np.uint8)
    pad = (lane_bytes << 3) - ends[:, -1]
    out[begin[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # a zero after each 255, a marker after each row but an image's last
    add = np.zeros(total + 1, np.int64)
    add[1:] += out == 255
    add[begin[1:][~last]] += 2
    place = np.arange(total + 1) + np.cumsum(add)
    full = np.zeros(int(place[-1]), np.uint8)
    full[place[:-1]] = out
    mark = place[begin[1:][~last]] - 2
    full[mark], full[mark + 1] = 255, 0xD0 + (number[~last] & 7)
    return full.tobytes(), place[begin]


def encode_flat(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream per payload, one 8 by 8 block of that grey for each byte.

    The quantiser of 8 makes the block's DC level the byte less 128, so nothing is lost. A
    payload over one image's capacity becomes several images, one after the other.
    """
    most = (MOST // ROW * ROW) ** 2 // 576 * 576
    out: list[list[bytes]] = [[] for _ in payloads]
    small: list[int] = []
    for k, p in enumerate(payloads):
        if len(p) and shape(min(len(p), most))[0] == ROW:
            small.append(k)
            continue
        for a in range(0, len(p), most):
            piece = p[a : a + most]
            wide, high = shape(len(piece))
            rows = np.frombuffer(piece + b"\xff" * (wide * high - len(piece)), np.uint8)
            step = max(1, LANES * 64 // wide)
            parts = []
            for r in range(0, high, step):
                number = np.arange(r, min(r + step, high))
                parts.append(_scan(rows[r * wide : (r + step) * wide], wide, number, number == high - 1)[0])
            out[k].append(_head(len(piece)) + b"".join(parts) + bytes([0xFF, EOI]))
    if small:
        rows = [shape(len(payloads[k]))[1] for k in small]
        data = b"".join(payloads[k] + b"\xff" * (r * ROW - len(payloads[k])) for k, r in zip(small, rows))
        first = np.concatenate([[0], np.cumsum(rows)])
        number = np.arange(first[-1]) - np.repeat(first[:-1], rows)
        raw, place = _scan(np.frombuffer(data, np.uint8), ROW, number, np.append(number[1:] == 0, True))
        cut = place[first]
        for k, a, b in zip(small, cut.tolist(), cut[1:].tolist()):
            out[k].append(_head(len(payloads[k])) + raw[a:b] + bytes([0xFF, EOI]))
    return [b"".join(x) for x in out]


class Frame:
    """What the markers of one image say, and where its luminance scan is."""

    def __init__(self):
        self.width = self.height = self.restart = 0
        self.tables: dict[int, tuple] = {}
        self.quant: dict[int, int] = {}
        self.parts: list[tuple[int, int, int, int]] = []
        self.scan: tuple[int, int] = (0, 0)
        self.order: list[tuple[int, int, int]] = []  # (component, DC table, AC table) of the scan
        self.comments: list[bytes] = []


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """The first image from at on, and where the next begins. Baseline only."""
    f = Frame()
    if data[at : at + 2] != bytes([0xFF, SOI]):
        raise ValueError("no JPEG image")
    at += 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        while data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        at += 2
        if marker == EOI:
            return f, at
        size = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + size]
        at += size
        if marker == DQT:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                f.quant[name] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker == DHT:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                f.tables[body[k]] = (tuple(body[k + 1 : k + 17]), tuple(body[k + 17 : k + 17 + n]))
                k += 17 + n
        elif marker in (SOF0, 0xC1):
            f.height, f.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            f.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == DRI:
            f.restart = int.from_bytes(body[:2], "big")
        elif marker == COM:
            f.comments.append(body)
        elif marker == SOS:
            found = SCAN_END.search(data, at)
            if not found:
                raise ValueError("the scan has no end")
            end = found.start()
            order = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            if not f.order and any(c == f.parts[0][0] for c, _, _ in order):
                f.order, f.scan = order, (at, end)
            at = end


@lru_cache(32)
def _lookup(dc: tuple, ac: tuple) -> tuple:
    """By the next 16 bits: bits taken, DC difference, and whether the block ends there.

    Where the code and its bits don't fit, state 1 has only the size; ac_len, ac_run and
    ac_size are for the AC codes that follow.
    """
    def table(spec):
        length, value = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        for v, (code, n) in codes(*spec).items():
            length[code << (16 - n) : (code + 1) << (16 - n)] = n
            value[code << (16 - n) : (code + 1) << (16 - n)] = v
        return length, value

    dc_len, size = table(dc)
    ac_len, ac_val = table(ac)
    window = np.arange(65536)
    fits = (dc_len > 0) & (dc_len + size <= 16)
    rest = np.where(fits, 16 - dc_len - size, 0)
    low = (window >> rest) & ((1 << size) - 1)
    diff = np.where(fits, np.where((size > 0) & (low < (1 << np.maximum(size - 1, 0))), low - (1 << size) + 1, low), 0)
    taken = np.where(fits, dc_len + size, 0)
    after = (window << taken) & 0xFFFF
    n = ac_len[after]
    ends = fits & (n > 0) & (ac_val[after] == 0) & (taken + n <= 16)
    return np.where(ends, taken + n, taken), diff, ends, fits, dc_len, size, ac_len, ac_val


def _peek(word: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (word[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(16)


def _block(word: np.ndarray, pos: np.ndarray, look: tuple) -> np.ndarray:
    """Advance pos over one block per lane; the DC differences."""
    taken, diff, ends, fits, dc_len, dc_size, ac_len, ac_val = look
    window = _peek(word, pos)
    d = diff[window]
    pos += taken[window]
    rest = np.flatnonzero(~ends[window])
    if len(rest):
        p, w = pos[rest], window[rest]
        slow = np.flatnonzero(~fits[w])
        if len(slow):
            p[slow] += dc_len[w[slow]]
            n = dc_size[w[slow]]
            low = (_peek(word, p[slow]) >> (16 - np.minimum(n, 16)).astype(np.uint32)).astype(np.int64)
            d[rest[slow]] = np.where(low < (1 << np.maximum(n - 1, 0)), low - (1 << n) + 1, low)
            p[slow] += n
        k, live = np.zeros(len(rest), np.int64), np.arange(len(rest))
        while len(live):
            w = _peek(word, p[live])
            v = ac_val[w]
            run, size = v >> 4, v & 15
            p[live] += np.maximum(ac_len[w], 1) + size
            k[live] = np.where((size == 0) & (run != 15), 63, k[live] + run + 1)
            live = live[k[live] < 63]
        pos[rest] = p
    return d


def thumbnails(images: list[tuple[bytes, Frame]]) -> list[np.ndarray]:
    """The luminance of each image, a sample for each 8 by 8 block: the DC levels alone."""
    out: list = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for k, (_, f) in enumerate(images):
        inside = {c: (h, v) for c, h, v, _ in f.parts}
        plan = tuple((c == f.parts[0][0], *(inside[c] if len(f.order) > 1 else (1, 1)), f.tables[d], f.tables[16 + a], c) for c, d, a in f.order)
        groups.setdefault((plan, f.restart), []).append(k)
    for (plan, restart), members in groups.items():
        raw, begins, units, shapes = [], [], [], []
        at = 0
        for k in members:
            data, f = images[k]
            scan = data[f.scan[0] : f.scan[1]]
            high, wide = max(v for _, _, v, _ in f.parts), max(h for _, h, _, _ in f.parts)
            _, h, v, q = f.parts[0]
            if len(plan) > 1:
                mcus = (-(-f.width // (8 * wide)), -(-f.height // (8 * high)))
            else:
                mcus = (-(-(-(-f.width * h // wide)) // 8), -(-(-(-f.height * v // high)) // 8))
            shapes.append((mcus, (-(-(-(-f.width * h // wide)) // 8), -(-(-(-f.height * v // high)) // 8)), f.quant[q]))
            n = mcus[0] * mcus[1]
            per = restart or n
            units.append(np.array([min(per, n - x) for x in range(0, n, per)], np.int64))
            raw.append(scan)
            begins.append(at)
            at += len(scan)
        byte = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8)
        ff = np.flatnonzero(byte[:-1] == 255)
        follow = byte[ff + 1]
        keep = np.ones(len(byte), bool)
        keep[ff[follow == 0] + 1] = False
        mark = ff[(follow >= 0xD0) & (follow <= 0xD7)]
        keep[mark] = keep[mark + 1] = False
        place = np.cumsum(keep) - keep
        lane = np.sort(np.concatenate([place[begins], place[mark + 2]])).astype(np.int64)
        data = np.concatenate([byte[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
        word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        del data
        count = np.concatenate(units)
        if len(lane) != len(count):
            raise ValueError("restart markers don't match the image's size")
        blocks = plan[0][1] * plan[0][2] if plan[0][0] else next(h * v for y, h, v, *_ in plan if y)
        result = np.zeros((len(lane), int(count.max()), blocks), np.int16)
        looks = [_lookup(d, a) for _, _, _, d, a, _ in plan]
        for a in range(0, len(lane), LANES):
            n_here, pos = count[a : a + LANES], lane[a : a + LANES] << 3
            level = np.zeros((len(plan), len(pos)), np.int64)
            rows = np.arange(len(pos))
            for m in range(int(n_here.max())):
                if n_here.min() <= m:
                    rows = rows[n_here[rows] > m]
                whole = len(rows) == len(pos)
                for c, (y, h, v, *_rest) in enumerate(plan):
                    for b in range(h * v):
                        if whole:
                            level[c] += _block(word, pos, looks[c])
                            if y:
                                result[a : a + len(pos), m, b] = level[c]
                        else:
                            p = pos[rows]
                            level[c, rows] += _block(word, p, looks[c])
                            pos[rows] = p
                            if y:
                                result[a + rows, m, b] = level[c, rows]
        first = np.concatenate([[0], np.cumsum([len(u) for u in units])])
        for j, k in enumerate(members):
            (mw, mh), (bw, bh), q = shapes[j]
            got = result[first[j] : first[j + 1]]
            flat = got.reshape(-1, blocks) if restart else got[0, : mw * mh]
            flat = flat.reshape(-1, blocks)[: mw * mh]
            h = next(h for y, h, *_ in plan if y)
            grid = flat.reshape(mh, mw, blocks // h, h).transpose(0, 2, 1, 3).reshape(mh * (blocks // h), mw * h)[:bh, :bw]
            out[k] = np.clip((grid.astype(np.int32) * q + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
    return out


def thumb_hash(image: np.ndarray) -> int:
    """64 bits: whether each mean of a 9 by 8 grid of cells is under its right neighbour's."""
    rows = np.linspace(0, image.shape[0], 9).astype(int)
    cols = np.linspace(0, image.shape[1], 10).astype(int)
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    sums[1:, 1:] = image.cumsum(0, dtype=np.int64).cumsum(1)
    top = np.minimum(rows[:-1], image.shape[0] - 1)
    left = np.minimum(cols[:-1], image.shape[1] - 1)
    low, right = np.maximum(rows[1:], top + 1), np.maximum(cols[1:], left + 1)
    cell = sums[np.ix_(low, right)] - sums[np.ix_(top, right)] - sums[np.ix_(low, left)] + sums[np.ix_(top, left)]
    area = (low - top)[:, None] * (right - left)[None, :]
    mean = cell / area
    return int.from_bytes(np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes(), "big")
