"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks that are coded independently (each resets its model and carries the crc32 of
its ids). Within a block the next id's distribution is a mixture of three predictions: the id that last
followed the same two ids (order 2), the id that last followed the same id (order 1), and the block's
own id frequencies (order 0). The weights come from the hits that the predictions have had so far in
the same situation, and are renewed every WINDOW ids. The mixture drives a 48-bit range coder. Blocks of a group are coded side by side
as numpy lanes, so each step serves all of them. A block lists its distinct ids once and codes their
places in that list, which keeps a lane's tables small enough for the CPU's caches.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE, TOTAL, CONTEXT_BITS, WINDOW = 14, 20, 12, 16
LANES, BLOCK = 2048, 2048
GROUP = LANES * BLOCK
REFRESH = (128, 512)
TOP, LOW32, M48 = np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64((1 << 48) - 1)
HEADER = struct.Struct("<4sIIIII")
K1, K2, DOWN = np.uint32(2654435761), np.uint32(2246822519), np.uint32(32 - CONTEXT_BITS)


def _frequencies(counts: np.ndarray | None, seen: int, sizes: np.ndarray) -> np.ndarray:
    """Cumulative order-0 frequencies of each lane's alphabet, each lane's shifted by its number << SCALE."""
    lanes, width = len(sizes), int(sizes.max()) + 2
    out = np.zeros((lanes, width), np.int32)
    each = (1 << SCALE) // np.maximum(sizes, 1)
    if seen:
        spare = (1 << SCALE) - sizes[:, None]
        out[:, 1:] = np.cumsum(counts.reshape(lanes, width)[:, :-1] * spare // seen + 1, axis=1)
    else:
        out[:] = np.arange(width) * each[:, None]
    # places beyond a lane's alphabet never occur; clip them so that the flat table ascends
    np.minimum(out, 1 << SCALE, out=out)
    out += (np.arange(lanes, dtype=np.int32) << SCALE)[:, None]
    return out.reshape(-1)


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's keys in order (equal ones by place), and the places they came from as flat indexes."""
    bits = int(keys.shape[1] - 1).bit_length()
    kind = np.int32 if int(keys.max(initial=0)) >> (31 - bits) == 0 else np.int64
    packed = (keys.astype(kind) << bits) | np.arange(keys.shape[1], dtype=kind)
    packed.sort(axis=1)
    at = (packed & ((1 << bits) - 1)) + (np.arange(len(keys)) * keys.shape[1])[:, None]
    packed >>= bits
    return packed, at


def _last_after(context: np.ndarray, ids: np.ndarray, none: int) -> np.ndarray:
    """For each place of each row, the id at the last earlier place with the same context, or none."""
    keys, at = _ordered(context)
    found = np.full(ids.shape, none, np.int32)
    found[:, 1:] = np.where(keys[:, 1:] == keys[:, :-1], ids.take(at[:, :-1]), none)
    out = np.empty(ids.size, np.int32)
    out[at] = found
    return out.reshape(ids.shape)


def _weights(tally: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sixty-fourths of the range for order 1 and order 2, by situation (last axis): order 1 alone, none, they differ, they agree."""
    n, k1, k2 = tally & 0xFFFF, (tally >> 16) & 0xFFFF, tally >> 32
    a1 = (62 * (2 * k1 + 1) // (2 * n + 4)).astype(np.int32)
    a2 = (62 * (2 * k2 + 1) // (2 * n + 4)).astype(np.int32)
    a1[..., 1] = a1[..., 3] = 0
    a2[..., 0] = a2[..., 1] = 0
    return a1, a2


def encode_group(ids: np.ndarray) -> bytes:
    """Up to GROUP ids to one self-contained group."""
    n = len(ids)
    block = min(BLOCK, -(-max(256, -(-n // LANES)) // WINDOW) * WINDOW)
    lanes = -(-n // block)
    if not n:
        return HEADER.pack(b"IDG2", 0, block, 0, 0, 0)
    # a short last lane repeats its last id, so its list stays the same
    padded = np.concatenate([ids, np.full(lanes * block - n, ids[-1], ids.dtype)]).reshape(lanes, block)
    known, at = _ordered(padded)
    new = np.ones(known.shape, bool)
    new[:, 1:] = known[:, 1:] != known[:, :-1]
    place = np.cumsum(new, axis=1, dtype=np.int32)
    x = np.empty(lanes * block, np.int32)
    x[at] = place - 1
    sizes = place[:, -1].astype(np.int64)
    listed = np.diff(known[new].astype(np.int64), prepend=0)
    listed[np.cumsum(sizes) - sizes] = known[:, 0]
    names = zlib.compress(listed.astype("<u4").tobytes(), 1)
    del padded, known, at, new, place, listed
    none = int(sizes.max())
    width = none + 2
    x = x.reshape(lanes, block)
    prev1 = np.full_like(x, none)
    prev1[:, 1:] = x[:, :-1]
    prev2 = np.full_like(x, none)
    prev2[:, 2:] = x[:, :-2]
    p1 = _last_after(prev1, x, none)
    p2 = _last_after(((prev2.astype(np.uint32) * K1) ^ (prev1.astype(np.uint32) * K2)) >> DOWN, x, none)
    del prev1, prev2
    state = (2 * (p2 < none) + (p1 == p2)).astype(np.int8)
    hit1, hit2 = p1 == x, p2 == x
    gained = 1.0 + hit1 * 65536.0 + hit2 * 4294967296.0
    windows = block // WINDOW
    cell = (np.arange(lanes * windows, dtype=np.int32) * 4).repeat(WINDOW).reshape(lanes, block) + state
    sums = np.bincount(cell.reshape(-1), gained.reshape(-1), lanes * windows * 4).astype(np.int64).reshape(lanes, windows, 4)
    tally = np.zeros_like(sums)
    tally[:, 1:] = np.cumsum(sums, axis=1)[:, :-1]
    del gained, sums
    a1, a2 = (w.reshape(-1).take(cell) for w in _weights(tally))
    del cell, tally, state
    a0 = 64 - a1 - a2
    cum = ((p1 < x) * a1 + (p2 < x) * a2) << SCALE
    freq = (hit1 * a1 + hit2 * a2) << SCALE
    del p1, p2, hit1, hit2, a1, a2
    edges = [0, *[r for r in REFRESH if r < block], block]
    row, shift = (np.arange(lanes, dtype=np.int64) * width)[:, None], (np.arange(lanes, dtype=np.int32) << SCALE)[:, None]
    counts = np.zeros(lanes * width, np.int64)
    for lo, hi in zip(edges, edges[1:]):
        f0 = _frequencies(counts, lo, sizes)
        part = row + x[:, lo:hi]
        at = f0.take(part)
        cum[:, lo:hi] += a0[:, lo:hi] * (at - shift)
        freq[:, lo:hi] += a0[:, lo:hi] * (f0.take(part + 1) - at)
        if hi < block:
            counts += np.bincount(part.reshape(-1), minlength=lanes * width)
    cum, freq = np.ascontiguousarray(cum.T), np.ascontiguousarray(freq.T)
    short = n - (lanes - 1) * block
    room = block * 2 + 8
    out = np.zeros(lanes * room, np.uint32)
    low, rng, pos = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64), np.arange(lanes) * room
    for t in range(block):
        if t == short:
            low_all, rng_all, pos_all = low, rng, pos
            low, rng, pos = low[:-1], rng[:-1], pos[:-1]
            if not len(low):
                low, rng, pos = low_all, rng_all, pos_all
                break
        r = rng >> np.uint64(TOTAL)
        low += r * cum[t, : len(low)].astype(np.uint64)
        np.multiply(r, freq[t, : len(low)].astype(np.uint64), out=rng)
        if low.max() > M48:
            k = np.flatnonzero(low > M48)
            out[pos[k] - 1] += 1
            low &= M48
        while len(k := np.flatnonzero(rng < TOP)):
            part, at = low[k], pos[k]
            out[at] = part >> np.uint64(32)
            pos[k] = at + 1
            low[k] = (part & LOW32) << np.uint64(16)
            rng[k] <<= np.uint64(16)
    if short < block and lanes > 1:
        low, pos = low_all, pos_all
    for down in (32, 16, 0):
        out[pos] = (low >> np.uint64(down)) & np.uint64(0xFFFF)
        pos += 1
    out, pos = out.reshape(lanes, room), pos - np.arange(lanes) * room
    while (carry := out >> 16).any():
        out &= 0xFFFF
        out[:, :-1] += carry[:, 1:]
    words = out.astype("<u2")
    table = np.array([[zlib.crc32(np.ascontiguousarray(ids[k * block : (k + 1) * block], "<u4")), pos[k], sizes[k]] for k in range(lanes)], "<u4")
    body = b"".join(words[k, : pos[k]].tobytes() for k in range(lanes))
    return HEADER.pack(b"IDG2", n, block, lanes, len(names), len(body)) + table.tobytes() + names + body


def _places(table: np.ndarray, lanes: int) -> np.ndarray:
    """For each order-0 value of each lane, the place whose range holds it."""
    table = table.reshape(lanes, -1)
    sizes = np.diff(table, axis=1, append=(np.arange(1, lanes + 1, dtype=np.int32) << SCALE)[:, None])
    return np.repeat(np.tile(np.arange(table.shape[1], dtype=np.int16), lanes), sizes.reshape(-1))


def decode_group(buf: memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the group at a place, and the place after it. Raises ValueError for a damaged block."""
    magic, n, block, lanes, named, size = HEADER.unpack_from(buf, at)
    if magic != b"IDG2":
        raise ValueError("not a group of coded ids")
    at += HEADER.size
    if not n:
        return np.zeros(0, "<u4"), at
    table = np.frombuffer(buf, "<u4", 3 * lanes, at).reshape(lanes, 3)
    at += 12 * lanes
    names = np.frombuffer(zlib.decompress(buf[at : at + named]), "<u4")
    words = np.frombuffer(buf, "<u2", size // 2, at + named)
    end = at + named + size
    sizes = table[:, 2].astype(np.int64)
    none = int(sizes.max())
    width = none + 2
    starts = np.concatenate([[0], np.cumsum(table[:, 1].astype(np.int64))])
    if starts[-1] != len(words):
        raise ValueError("a group's length is wrong")
    words = np.concatenate([words, np.zeros(8, "<u2")]).astype(np.uint64)
    pos = starts[:-1].copy()
    code = np.zeros(lanes, np.uint64)
    for _ in range(3):
        code = (code << np.uint64(16)) | words[pos]
        pos += 1
    rng = np.full(lanes, 1 << 48, np.uint64)
    every = np.arange(lanes, dtype=np.int64)
    row, shift, slot, cells = every * width, every.astype(np.int32) << SCALE, every << CONTEXT_BITS, every * 4
    after1, after2 = np.full(lanes * width, none, np.int16), np.full(lanes << CONTEXT_BITS, none, np.int16)
    tally = np.zeros(lanes * 4, np.int64)
    x = np.full((block, lanes), none, np.int32)
    prev = np.full(lanes, none, np.int32)
    older = prev.astype(np.uint32) * K1
    short = n - (lanes - 1) * block
    f0 = _frequencies(None, 0, sizes)
    order0 = _places(f0, lanes)
    counts, since = np.zeros(lanes * width, np.int64), 0
    most, sixteen = np.uint64((1 << TOTAL) - 1), np.uint64(16)
    for t in range(block):
        if t in REFRESH:
            counts += np.bincount((np.arange(lanes) * width + x[since:t]).reshape(-1), minlength=lanes * width)
            f0, since = _frequencies(counts, t, sizes), t
            order0 = _places(f0, lanes)
        if t % WINDOW == 0:
            a1s, a2s = (w.reshape(-1) for w in _weights(tally.reshape(lanes, 4)))
        if t == short:
            if lanes == 1:
                break
            row, shift, slot, cells = row[:-1], shift[:-1], slot[:-1], cells[:-1]
            prev, older, code, rng, pos = prev[:-1], older[:-1], code[:-1], rng[:-1].copy(), pos[:-1].copy()
        i1 = row + prev
        here = prev.astype(np.uint32)
        i2 = slot + ((older ^ (here * K2)) >> DOWN)
        older = here * K1
        p1, p2 = after1.take(i1), after2.take(i2)
        cell = cells + (p2 < none) * 2 + (p1 == p2)
        a1, a2 = a1s.take(cell), a2s.take(cell)
        a0 = 64 - a1 - a2
        w1, w2 = a1 << SCALE, a2 << SCALE
        r = rng >> np.uint64(TOTAL)
        v = np.minimum(code // r, most).astype(np.int32)
        j1, j2 = row + p1, row + p2
        f1, f2 = f0.take(j1), f0.take(j2)
        low1, low2 = a0 * (f1 - shift) + w2 * (p2 < p1), a0 * (f2 - shift) + w1 * (p1 < p2)
        size1, size2 = a0 * (f0.take(j1 + 1) - f1) + w1, a0 * (f0.take(j2 + 1) - f2) + w2
        up1, up2 = v >= low1 + size1, v >= low2 + size2
        is2 = (v >= low2) > up2
        got, cum, freq = np.where(is2, p2, p1), np.where(is2, low2, low1), np.where(is2, size2, size1)
        k = np.flatnonzero(~(is2 | ((v >= low1) > up1)))
        if len(k):
            off, base, mix = shift[k], row[k], a0[k]
            ahead = w1[k] * up1[k] + w2[k] * up2[k]
            u = (v[k] - ahead) // mix + off
            place = order0.take(u)
            at_ = base + place
            fx = f0.take(at_)
            got[k] = place
            cum[k] = mix * (fx - off) + ahead
            freq[k] = mix * (f0.take(at_ + 1) - fx)
        code -= r * cum.astype(np.uint64)
        rng = r * freq.astype(np.uint64)
        thin = rng < TOP
        code = np.where(thin, (code << sixteen) | words.take(pos), code)
        rng <<= thin * sixteen
        pos += thin
        while len(k := np.flatnonzero(rng < TOP)):
            q = pos[k]
            code[k] = (code[k] << sixteen) | words[q]
            pos[k] = q + 1
            rng[k] <<= sixteen
        after1[i1] = got
        after2[i2] = got
        tally[cell] += 1 + ((p1 == got) * 65536) + ((p2 == got) * 4294967296)
        x[t, : len(got)] = got
        prev = got
    first = np.concatenate([[0], np.cumsum(sizes)])
    known = [np.cumsum(names[first[k] : first[k + 1]].astype(np.int64)).astype("<u4") for k in range(lanes)]
    ids = np.concatenate([known[k].take(x[: block if k < lanes - 1 else short, k], mode="clip") for k in range(lanes)])
    for k in range(lanes):
        if zlib.crc32(ids[k * block : (k + 1) * block]) != table[k, 0]:
            raise ValueError(f"block {k} fails its checksum")
    return ids, end
