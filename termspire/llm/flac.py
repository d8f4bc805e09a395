"""A FLAC codec for 8-bit mono streams that works on many frames at once.

Streams are the standard format: STREAMINFO with an MD5, a seek table with a
point for each frame, and frames with CRC-8 headers and CRC-16 ends. The
encoder chooses constant, verbatim, fixed (order 0 to 4) or quantised linear
prediction per block; the decoder reads all of these, Rice partitions with both
parameter widths and escape codes.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from functools import lru_cache

import numpy as np

BLOCK = 4096
LPC_ORDER, LPC_BITS = 4, 10
#: Compressed bytes that are decoded, and samples that are encoded, in one go.
AT_ONCE = 1 << 18


def _table(poly: int, width: int) -> list[int]:
    top, full = 1 << (width - 1), (1 << width) - 1
    out = []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & full if c & top else c << 1 & full
        out.append(c)
    return out


_CRC8, _CRC16 = _table(0x07, 8), np.array(_table(0x8005, 16), np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


@lru_cache(16)
def _weights(n: int) -> np.ndarray:
    """What a byte adds to the CRC-16 of a message that goes on for so many bytes."""
    out = np.empty((n, 256), np.uint16)
    out[0] = _CRC16
    for i in range(1, n):
        last = out[i - 1]
        out[i] = (last << 8) ^ _CRC16[last >> 8]
    return out


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-16 of each data[start:end]; CRCs are linear, so each byte's share is looked up by its distance to the end."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.uint16)
    w = _weights(1 << int(n.max()).bit_length()).ravel()
    upto = np.cumsum(n)
    first = upto - n
    i = np.arange(int(upto[-1]), dtype=np.int32)
    byte = data[i + np.repeat((starts - first).astype(np.int32), n)]
    left = np.repeat((upto - 1).astype(np.int32), n) - i
    return np.bitwise_xor.reduceat(w.take(left << 8 | byte), first)


def _utf8(n: int) -> bytes:
    """The format's extended UTF-8 of a frame number."""
    if n < 0x80:
        return bytes([n])
    k = 1
    while n >> (6 * k + 6 - k):
        k += 1
    return bytes([(0xFF << (7 - k) | n >> 6 * k) & 0xFF, *(0x80 | n >> 6 * i & 0x3F for i in range(k - 1, -1, -1))])


def _header(number: int, size: int) -> bytes:
    h = bytes([0xFF, 0xF8, (0xC0 if size == BLOCK else 0x70) | 4, 0x02]) + _utf8(number)
    if size != BLOCK:
        h += struct.pack(">H", size - 1)
    return h + bytes([crc8(h)])


def _predictors(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors by Levinson's recursion, for all blocks at once."""
    within = np.arange(len(x)) - np.repeat(first, n)
    y = (x - np.repeat(np.add.reduceat(x, first) / n, n)).astype(np.float32)
    r = []
    for lag in range(LPC_ORDER + 1):
        product = np.zeros(len(x), np.float32)
        product[lag:] = y[lag:] * y[: len(y) - lag]
        if lag:
            product[within < lag] = 0
        r.append(np.add.reduceat(product, first, dtype=np.float64))
    r[0] = r[0] + 1e-6 + r[0] * 1e-9
    a, e = np.zeros((LPC_ORDER, len(n))), r[0].copy()
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / e
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        e = np.maximum(e * (1 - k * k), 1e-9)
    top = np.abs(a).max(axis=0)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(np.maximum(top, 1e-3))), 0, 15).astype(np.int64)
    most = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)), -most, most).astype(np.int64), shift


def _encode_blocks(x: np.ndarray, n: np.ndarray, heads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Frames of the blocks that follow one another in ``x``, and the bytes of each frame."""
    count = len(n)
    first = np.cumsum(n) - n
    frame = np.repeat(np.arange(count, dtype=np.int32), n)
    within = np.arange(len(x), dtype=np.int32) - np.repeat(first.astype(np.int32), n)
    coef, shift = _predictors(x, first, n)
    res, fixed, costs = [], x, []
    for _ in range(5):
        res.append(fixed)
        nxt = np.zeros_like(fixed)
        nxt[1:] = fixed[1:] - fixed[:-1]
        fixed = nxt
    guess = np.zeros_like(x)
    for j in range(LPC_ORDER):
        guess[j + 1 :] += np.repeat(coef[j].astype(np.int32), n)[j + 1 :] * x[: -j - 1]
    res.append(x - (guess >> np.repeat(shift.astype(np.int32), n)))
    orders = np.array([0, 1, 2, 3, 4, LPC_ORDER])
    warm = {o: within < o for o in range(1, 5)}
    for r, o in zip(res, orders, strict=True):
        size = np.abs(r)
        if o:
            size[warm[o]] = 0
        costs.append(np.add.reduceat(size, first) + 0.0)
    costs[5] += LPC_BITS * LPC_ORDER * 4
    best = np.argmin(costs, axis=0)
    order = orders[best]
    r = x.copy()
    chosen = np.repeat(best, n)
    for b in np.unique(best):
        np.copyto(r, res[b], where=chosen == b)
    ahead = within >= np.repeat(order.astype(np.int32), n)
    u = ((r << 1) ^ (r >> 31)) * ahead
    # Four partitions of each block; the first one lacks the warm-up samples, zeros here.
    part_n = ((n // 4)[:, None] - np.where(np.arange(4) == 0, order[:, None], 0)).ravel()
    part_first = (first[:, None] + (n // 4)[:, None] * np.arange(4)).ravel()
    mean = np.add.reduceat(u, part_first) / part_n
    low = np.clip(np.log2(mean * 0.7 + 0.5).astype(np.int64), 0, 13)
    each = np.repeat(n // 4, 4)
    bits_by_k = [np.add.reduceat(u >> np.repeat((low + d).astype(np.int32), each), part_first) + part_n * (low + d + 1) for d in (0, 1)]
    k = (low + (bits_by_k[1] < bits_by_k[0])).reshape(count, 4)
    rice = np.minimum(*bits_by_k).reshape(count, 4).sum(axis=1)
    lpc = best == 5
    body = 8 + 8 * order + np.where(lpc, 9 + LPC_BITS * LPC_ORDER, 0) + 6 + 16 + rice
    constant = np.maximum.reduceat(x, first) == np.minimum.reduceat(x, first)
    verbatim = ~constant & (body >= 8 + 8 * n)
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))
    head = np.array([len(h) for h in heads])
    size = head + (body + 7) // 8 + 2
    at = np.cumsum(size) - size
    total = int(size.sum())
    flat = np.frombuffer(b"".join(heads), np.uint8)
    data = np.zeros(total, np.uint8)
    data[np.repeat(at - (np.cumsum(head) - head), head) + np.arange(len(flat))] = flat
    byte = at + head
    data[byte] = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 31 + LPC_ORDER, 8 + order))) << 1
    data[byte[constant] + 1] = x[first[constant]] & 0xFF
    # Verbatim and warm-up samples stand at whole bytes.
    raw = np.flatnonzero(np.repeat(verbatim, n) | (~ahead & ~np.repeat(constant, n)))
    data[byte[frame[raw]] + 1 + within[raw]] = x[raw] & 0xFF
    coded = ~constant & ~verbatim
    if coded.any():
        pos = 8 * (byte + 1 + order)
        both = np.flatnonzero(coded & lpc)
        fields = [(pos[both], np.full(len(both), LPC_BITS - 1), 4), (pos[both] + 4, shift[both], 5)]
        fields += [(pos[both] + 9 + LPC_BITS * j, coef[j][both] & ((1 << LPC_BITS) - 1), LPC_BITS) for j in range(LPC_ORDER)]
        pos = pos + np.where(lpc, 9 + LPC_BITS * LPC_ORDER, 0)
        fields.append((pos[coded] + 2, np.full(coded.sum(), 2), 4))
        pos = pos + 6
        # A code is its high part in unary, a one, and k low bits; partitions open with k.
        use = np.flatnonzero(np.repeat(coded, n) & ahead)
        f, w, v = frame[use], within[use], u[use]
        kk = np.repeat(k.ravel().astype(np.int32), each)[use]
        opens = np.isin(use, np.where(np.arange(4) == 0, first[:, None] + order[:, None], part_first.reshape(count, 4))[coded].ravel(), assume_unique=True)
        width = (v >> kk) + 1 + kk + 4 * opens
        end = np.cumsum(width)
        new = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        base = pos[f[new]] - (end - width)[new]
        start = end - width + np.repeat(base, np.diff(np.append(new, len(f))))
        o = np.flatnonzero(opens)
        fields += [(start[o], kk[o], 4), (start + (v >> kk) + 4 * opens, (1 << kk) | (v & ((1 << kk) - 1)), kk + 1)]
        # Every field has 32 bits at most; it falls into one or two words, and fields don't overlap, so sums set bits.
        sums = np.zeros(total // 4 + 3)
        for p, value, wide in fields:
            word = p >> 5
            shifted = value.astype(np.uint64) << (64 - (p & 31) - wide).astype(np.uint64)
            sums += np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), len(sums))
            sums += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), len(sums))
        data |= sums.astype(">u4").view(np.uint8)[:total]
    end = at + size - 2
    c = crc16(data, at, end)
    data[end], data[end + 1] = c >> 8, c & 0xFF
    return data.tobytes(), size


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes less 128 are its samples; lengths are positive multiples of 64."""
    heads, sizes, owner = [], [], []
    for i, p in enumerate(payloads):
        if not p or len(p) % 64:
            raise ValueError("a payload needs a positive multiple of 64 bytes")
        for k, at in enumerate(range(0, len(p), block)):
            sizes.append(min(block, len(p) - at))
            heads.append(_header(k, sizes[-1]))
            owner.append(i)
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    n, frames, lengths = np.array(sizes), [], []
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        before = ends[i] - n[i]
        j = max(i + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        data, size = _encode_blocks(x[before : ends[j - 1]], n[i:j], heads[i:j])
        cut = np.append(0, np.cumsum(size)).tolist()
        frames += [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        lengths += size.tolist()
        i = j
    out, k = [], 0
    for i, p in enumerate(payloads):
        mine = range(k, k + -(-len(p) // block))
        k = mine.stop
        points, offset, sample = [], 0, 0
        for f in mine:
            points.append(struct.pack(">QQH", sample, offset, sizes[f]))
            offset, sample = offset + lengths[f], sample + sizes[f]
        md5 = hashlib.md5(bytes(np.frombuffer(p, np.uint8) ^ 0x80)).digest()
        ls = [lengths[f] for f in mine]
        rate = 8000 << 44 | 0 << 41 | 7 << 36 | len(p)
        info = struct.pack(">HH", block, block) + min(ls).to_bytes(3, "big") + max(ls).to_bytes(3, "big") + rate.to_bytes(8, "big") + md5
        seek = b"".join(points)
        meta = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
        out.append(b"fLaC" + meta + b"".join(frames[f] for f in mine))
    return out


def metadata(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """(samples, MD5, seek points, place of the first frame)."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", []
    while not last:
        kind, n = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + n]
        if kind & 0x7F == 0:
            rate = int.from_bytes(body[10:18], "big")
            if (rate >> 41 & 7, rate >> 36 & 31) != (0, 7):
                raise ValueError("only 8-bit mono is read")
            total, md5 = rate & ((1 << 36) - 1), body[18:34]
        elif kind & 0x7F == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        last, at = bool(kind & 0x80), at + 4 + n
    return total, md5, points, at


def _decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples, frame numbers and ends of the frames at ``starts`` of ``data``; a damaged frame raises."""
    data = np.append(data, np.zeros(16, np.uint8))
    if (data[starts] != 0xFF).any() or ((data[starts + 1] & 0xFE) != 0xF8).any():
        raise ValueError("no frame at a seek point")
    code, form = data[starts + 2] >> 4, data[starts + 3]
    if (form >> 4).any() or (((form >> 1) & 7) > 1).any():
        raise ValueError("only 8-bit mono is read")
    lead = data[starts + 4]
    more = np.zeros(len(starts), np.int64)
    for k in range(1, 7):
        more[lead >= (0xFF << (7 - k) & 0xFF)] = k
    more[lead < 0xC0] = 0
    number = np.where(more == 0, lead, lead & (0x3F >> more)).astype(np.int64)
    for k in range(int(more.max(initial=0))):
        has = more > k
        number[has] = number[has] << 6 | (data[starts[has] + 5 + k] & 0x3F)
    at = starts + 5 + more
    two = data[at].astype(np.int64) << 8 | data[at + 1]
    c = code.astype(np.int64)
    n = np.select([c == 1, c <= 5, c == 6, c == 7], [192, 576 << np.maximum(c - 2, 0), data[at].astype(np.int64) + 1, two + 1], 256 << np.maximum(c - 8, 0))
    at = at + np.where(c == 6, 1, np.where(c == 7, 2, 0)) + np.select([(data[starts + 2] & 15) == 12, (data[starts + 2] & 15) >= 13], [1, 2], 0)
    for s, e in zip(starts.tolist(), at.tolist(), strict=True):
        if crc8(data[s:e].tobytes()) != data[e]:
            raise ValueError("a frame header's CRC-8 is wrong")
    wide = [data[i : len(data) - 7 + i].astype(np.int64) << (32 - 8 * i) for i in range(5)]
    window = wide[0] | wide[1] | wide[2] | wide[3] | wide[4]  # the 40 bits from each byte on
    ones = np.flatnonzero(np.unpackbits(data)).astype(np.int32)
    gaps = np.diff(ones, prepend=np.int32(-1), append=np.int32(8 * len(data)))
    nxt = np.repeat(np.append(ones, np.int32(8 * len(data) - 1)), gaps)  # the first one at or after each bit

    def get(pos: np.ndarray, width) -> np.ndarray:
        pos = np.minimum(pos, 8 * len(window) - 8)
        return window[pos >> 3] >> (40 - (pos & 7) - width) & ((1 << width) - 1)

    signed = lambda v, w: v - ((v >> (w - 1)) << w)
    pos = 8 * (at + 1)
    kind = get(pos, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits aren't read")
    kind, pos = kind >> 1, pos + 8
    top = int(n.max(initial=0))
    x = np.zeros((top, len(starts)), np.int32)
    ends = np.zeros(len(starts), np.int64)
    row = np.arange(top)[:, None]
    const, verb = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    x[:, const] = signed(get(pos[const], 8), 8)
    ends[const] = pos[const] + 8
    byte = data[np.minimum(pos[verb] // 8 + row, len(data) - 1)].astype(np.int32)
    x[:, verb] = np.where(byte > 127, byte - 256, byte)
    ends[verb] = pos[verb] + 8 * n[verb]
    rest = np.flatnonzero(kind > 1)
    lpc = kind >= 32
    if ((kind[rest] < 8) | ((kind[rest] > 12) & ~lpc[rest])).any():
        raise ValueError("a reserved kind of subframe")
    order = np.where(lpc, kind - 31, np.clip(kind - 8, 0, 4))
    coefs = {}
    if len(rest):
        rest = rest[np.argsort(-n[rest], kind="stable")]
        p, o, m = pos[rest], order[rest], n[rest]
        for j in range(int(o.max(initial=0))):
            has = o > j
            x[j, rest[has]] = signed(get(p[has] + 8 * j, 8), 8)
        p = p + 8 * o
        own = np.flatnonzero(lpc[rest])
        width, by = get(p[own], 4) + 1, signed(get(p[own] + 4, 5), 5)
        cs = [signed(get(p[own] + 9 + width * j, width), width).tolist() for j in range(int(o[own].max(initial=0)))]
        for i, f in enumerate(rest[own].tolist()):
            coefs[f] = ([c[i] for c in cs[: order[f]]], int(by[i]))
        p[own] += 9 + width * o[own]
        five = np.where(get(p, 2) == 1, 5, 4)
        parts = get(p + 2, 4)
        p = p + 6
        res = np.zeros((top, len(rest)), np.int32)
        begun = o.copy()
        for part in range(1 << int(parts.max(initial=0))):
            live = np.flatnonzero(part < (1 << parts))
            if not len(live):
                break
            until = (m[live] >> parts[live]) * (part + 1)
            count = until - begun[live]
            k = get(p[live], five[live])
            escaped = k == (1 << five[live]) - 1
            here = p[live] + five[live]
            raw = np.where(escaped, get(here, 5), 0)
            here = here + 5 * escaped
            by = np.argsort(-np.where(escaped, 0, count), kind="stable")
            cs = np.where(escaped, 0, count)[by]
            kb, hb = k[by], here[by].astype(np.int32)
            most = int(cs.max(initial=0))
            S = np.zeros((most, len(live)), np.int32)
            one = np.zeros((most, len(live)), np.int32)
            step = (kb + 1).astype(np.int32)
            for i, a in enumerate(np.searchsorted(-cs, -np.arange(most), side="left").tolist()):
                S[i, :a] = hb[:a]
                one[i, :a] = to = nxt[hb[:a]]
                hb[:a] = to + step[:a]
            ok = np.arange(most)[:, None] < cs
            at_row, at_col = np.nonzero(ok)
            to = one[ok].astype(np.int64)
            kf = kb[at_col]
            u = (to - S[ok]) << kf | get(to + 1, kf)
            res[at_row + begun[live][by][at_col], live[by][at_col]] = (u >> 1) ^ -(u & 1)
            done = np.empty(len(live), np.int64)
            done[by] = hb
            for i in np.flatnonzero(escaped):
                w = int(raw[i])
                q = here[i] + w * np.arange(count[i])
                res[begun[live[i]] : until[i], live[i]] = signed(get(q, w), w) if w else 0
                done[i] = here[i] + w * count[i]
            p[live] = done
            begun[live] = until
        ends[rest] = p
        for o_ in range(5):
            cols = np.flatnonzero((o == o_) & ~lpc[rest])
            if not len(cols):
                continue
            y = res[o_:, cols]
            warm = x[:o_, rest[cols]]
            for d in range(o_ - 1, -1, -1):
                y = np.cumsum(y, axis=0, dtype=np.int32) + np.diff(warm, d, axis=0)[-1]
            x[o_:, rest[cols]] = y
        own = sorted(coefs)
        if own:
            where = {f: i for i, f in enumerate(rest.tolist())}
            r = res[:, [where[f] for f in own]]
            most = max(len(coefs[f][0]) for f in own)
            C = np.array([coefs[f][0][::-1] for f in own]).T if len({len(coefs[f][0]) for f in own}) == 1 else np.array([[0] * (most - len(coefs[f][0])) + coefs[f][0][::-1] for f in own]).T
            C = C.astype(np.int32)
            by = np.array([coefs[f][1] for f in own], np.int32)
            oo = order[own]
            late = int(oo.max())
            y = np.zeros((top + most, len(own)), np.int32)
            y[most:] = x[:, own]
            for i in range(int(oo.min()), int(n[own].max())):
                guess = (y[i : i + most] * C).sum(axis=0, dtype=np.int32) >> by
                y[most + i] = guess + r[i] if i >= late else np.where(i >= oo, guess + r[i], y[most + i])
            x[:, own] = y[most:]
    ends = -(-ends // 8)
    if (ends + 2 > len(data) - 16 + 0).any() or (crc16(data, starts, ends) != (data[ends].astype(np.uint16) << 8 | data[ends + 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    return [x[: n[i], i] for i in range(len(starts))], number, ends + 2


def decode(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks as (sample offset, bytes): each block can be sought by its offset.

    Frames are found by the seek table if it has them all, else one after another. Frame
    checksums, frame numbers, the number of samples and the MD5 are verified; a
    fault raises ValueError.
    """
    metas = [metadata(m) for m in media]
    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in media]
    todo: list[tuple[int, int, int, int]] = []
    for i, (total, _, points, first) in enumerate(metas):
        whole = points and points[0][:2] == (0, 0) and all(a[0] + a[2] == b[0] for a, b in zip(points, points[1:], strict=False)) and points[-1][0] + points[-1][2] == total
        if whole:
            stops = [first + p[1] for p in points[1:]] + [len(media[i])]
            todo += [(i, p[0], first + p[1], e) for p, e in zip(points, stops, strict=True)]
        else:
            at, sample, k = first, 0, 0
            data = np.frombuffer(media[i], np.uint8)
            while at < len(data):
                (x,), number, end = _decode_frames(data[at : at + 70_000], np.array([0]))
                if number[0] != k:
                    raise ValueError("a frame is missing")
                found[i].append((sample, x))
                at, sample, k = at + int(end[0]), sample + len(x), k + 1
    # Frames of like sizes are decoded together.
    todo.sort(key=lambda f: f[3] - f[2])
    k = 0
    while k < len(todo):
        group, size = [], 0
        while k < len(todo) and (not group or size < AT_ONCE):
            group.append(todo[k])
            size += todo[k][3] - todo[k][2]
            k += 1
        lengths = np.array([e - s for _, _, s, e in group])
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(media[i][s:e] for i, _, s, e in group), np.uint8)
        blocks, _, ends = _decode_frames(data, starts)
        if (ends != starts + lengths).any():
            raise ValueError("a frame doesn't end where the next one starts")
        for (i, sample, _, _), x in zip(group, blocks, strict=True):
            found[i].append((sample, x))
    out = []
    for (total, md5, _, _), blocks in zip(metas, found, strict=True):
        raw = [(s, x.astype(np.int8).tobytes()) for s, x in sorted(blocks, key=lambda b: b[0])]
        pcm = b"".join(b for _, b in raw)
        if len(pcm) != total or (any(md5) and hashlib.md5(pcm).digest() != md5):
            raise ValueError("the samples don't match the stream's length or MD5")
        out.append([(s, bytes(np.frombuffer(b, np.uint8) ^ 0x80)) for s, b in raw])
    return out


def read(media: bytes, start: int, count: int) -> bytes:
    """The bytes of samples ``start`` to ``start + count``, cut to the stream: only the frames that hold them are decoded, by the seek table."""
    total, _, points, first = metadata(media)
    start, stop = max(0, start), min(total, start + count)
    if not points:
        return b"".join(b for _, b in decode([media])[0])[start:stop]
    at = [p[0] for p in points]
    i, j = max(bisect.bisect_right(at, start) - 1, 0), bisect.bisect_left(at, stop)
    if start >= stop or i >= j:
        return b""
    begin, end = first + points[i][1], first + points[j][1] if j < len(points) else len(media)
    starts = np.array([first + p[1] - begin for p in points[i:j]])
    blocks, _, _ = _decode_frames(np.frombuffer(media[begin:end], np.uint8), starts)
    pcm = b"".join(x.astype(np.int8).tobytes() for x in blocks)
    return bytes(np.frombuffer(pcm, np.uint8) ^ 0x80)[start - at[i] : stop - at[i]]
