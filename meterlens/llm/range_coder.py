"""Adaptive context-mixing range coder for token ids below 65,536, many blocks at a time.

A block is coded by itself, from a blank model: each id is first held against the id
that followed the last two ids before (order 2), then against the one that followed the
last id (order 1); each yes or no is coded with a probability mixed, in the logistic
domain, from what orders 2, 1 and 0 say, with weights that learn. An id that neither
foretells is coded by how often it has come this way (order 0), or as new.

All arithmetic is on integers, so that every machine decodes alike. This module fixes
the format; op1 runs RangeCoder.java (see jvm_coder.py), which is held to its bytes. Blocks
advance in step: NumPy works on the same position of up to LANES blocks at once, which keeps the
model of a block small (see Lanes) and the number of interpreted steps low.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LANES = 2048, 1024
_SLOTS, _GROUPS = 4096, BLOCK // 64
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_64 = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: logistic domain (12 bits, 256 per unit) to a 16-bit probability, by integer interpolation; stretch: its inverse over 12-bit probabilities."""
    knots = [1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4024, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094]
    x = np.arange(-2048, 2048) + 2048
    low, part = x >> 7, x & 127
    k = np.array(knots)
    squash = ((k[low] * (128 - part) + k[low + 1] * part) >> 3).clip(32, 65535 - 32)
    stretch = (np.searchsorted(squash, np.arange(4096) * 16 + 8) - 2048).clip(-2047, 2047)
    return squash.astype(np.int64), stretch.astype(np.int64)


_SQUASH, _STRETCH = _tables()
_AFTER_GROUP = (np.arange(_GROUPS + 1) > np.arange(_GROUPS)[:, None]).astype(np.int16)
_AFTER = (np.arange(65) > np.arange(64)[:, None]).astype(np.int16)


class Lanes:
    """Models of n blocks, about 40 kB each."""

    def __init__(self, n: int) -> None:
        self.n, self.at = n, np.arange(n)
        self.slots1, self.slots2 = np.zeros(n * _SLOTS, np.uint32), np.zeros(n * _SLOTS, np.uint32)  # an id, and above it how sure
        self.many = np.zeros(n, np.int64)
        self.groups, self.within = np.zeros((n, _GROUPS + 1), np.int16), np.zeros((n * _GROUPS, 65), np.int16)
        self.odds = np.full((2, 3, n * 32), 1 << 15, np.int64)
        self.weights = np.full((2, 3, n), 1 << 15, np.int64)
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.low, self.range = np.zeros(n, _64), np.full(n, (1 << 64) - 1, _64)

    # What is foretold, and learning from what came.

    def foretell(self, k: int) -> None:
        mixed = self.last[:k] * 0x9E3779B1
        base = self.at[:k] * _SLOTS
        self.i1 = base + ((mixed & 0xFFFFFFFF) >> 20)
        self.i2 = base + (((mixed ^ (self.before[:k] * 0x85EBCA6B)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20)
        found1, found2 = self.slots1[self.i1].astype(np.int64), self.slots2[self.i2].astype(np.int64)
        self.c1, self.g1 = found1 >> 16, found1 & 0xFFFF
        self.c2, self.g2 = found2 >> 16, found2 & 0xFFFF

    def learn(self, ids: np.ndarray) -> None:
        for i, c, g, slots in ((self.i1, self.c1, self.g1, self.slots1), (self.i2, self.c2, self.g2, self.slots2)):
            stay = np.where(c >= 2, (c >> 1 << 16) + g, ids + (1 << 16))
            slots[i] = np.where(g == ids, (np.minimum(c + 1, 15) << 16) + g, stay)
        k = len(ids)
        self.before[:k] = self.last[:k]
        self.last[:k] = ids

    def mix(self, which: int, own: np.ndarray) -> np.ndarray:
        """16-bit probability that the foretold id comes, in lanes `own`. which: 0 for order 2's, 1 for order 1's.

        What is foretold has come in its block, so order 0 always knows it.
        """
        c1, c2 = self.c1[own], self.c2[own]
        first, second = (c1, c2) if which else (c2, np.where((c1 > 0) & (self.g1[own] == self.g2[own]), 16 + c1, c1))
        base = own * 32
        self.cells = [base + x for x in (first, second, np.maximum(c1, c2) + 16)]
        self.inputs = [_STRETCH[self.odds[which, j][c] >> 4] for j, c in enumerate(self.cells)]
        total = sum(self.weights[which, j][own] * s for j, s in enumerate(self.inputs)) >> 16
        self.p = _SQUASH[np.minimum(np.maximum(total, -2047), 2047) + 2048]
        return self.p

    def mixed(self, which: int, own: np.ndarray, bit: np.ndarray) -> None:
        want = bit.astype(np.int64) << 16
        err = want - self.p
        for j, (cell, s) in enumerate(zip(self.cells, self.inputs)):
            odds = self.odds[which, j]
            old = odds[cell]
            odds[cell] = np.minimum(np.maximum(old + ((want - old) >> 5), 64), 65535 - 64)
            self.weights[which, j][own] += (s * err) >> 15

    def count(self, own: np.ndarray, place: np.ndarray) -> None:
        """One more of the ids at these places (from 1)."""
        g, j = (place - 1) >> 6, (place - 1) & 63
        row = own * _GROUPS + g
        self.groups[own] = self.groups.take(own, 0) + _AFTER_GROUP.take(g, 0)
        self.within[row] = self.within.take(row, 0) + _AFTER.take(j, 0)

    def meet(self, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Gives ids that came for the first time their places."""
        place = self.many[own] + 1
        self.many[own] = place
        return place


class _Out(Lanes):
    def __init__(self, n: int) -> None:
        super().__init__(n)
        self.room = 3 * BLOCK + 8
        self.words, self.used = np.zeros(n * self.room, np.uint16), np.zeros(n, np.int64)
        self.place = np.zeros(n << 16, np.uint16)  # of an id among those met, from 1

    def meet(self, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        place = super().meet(own, ids)
        self.place[(own << 16) + ids] = place
        return place

    def _narrow(self, own: np.ndarray, low: np.ndarray, size: np.ndarray) -> None:
        """Stores the interval; once it is small, puts out its leading words (cutting it where they might still change)."""
        self.low[own], self.range[own] = low, size
        while True:
            small = np.flatnonzero(size < _BOT)
            if not len(small):
                return
            own, low, size = own[small], low[small], size[small]
            same = (low ^ (low + size)) < _TOP
            size = np.where(same, size, (~low + _64(1)) & (_BOT - _64(1))) << _64(16)
            self.words[own * self.room + self.used[own]] = low >> _64(48)
            self.used[own] += 1
            low = low << _64(16)
            self.low[own], self.range[own] = low, size

    def flag(self, own: np.ndarray, p: np.ndarray, bit: np.ndarray) -> None:
        r, p = self.range[own] >> _64(16), p.astype(_64)
        self._narrow(own, np.where(bit, self.low[own], self.low[own] + r * p), np.where(bit, r * p, r * (_64(65536) - p)))

    def part(self, own: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        r = self.range[own] // total.astype(_64)
        self._narrow(own, self.low[own] + r * start.astype(_64), r * size.astype(_64))

    def rare(self, own: np.ndarray, ids: np.ndarray) -> None:
        place = self.place[(own << 16) + ids].astype(np.int64)
        known, all_ = place > 0, self.groups[own, _GROUPS].astype(np.int64)
        escape = self.many[own] + 1
        g, j = np.maximum(place - 1, 0) >> 6, np.maximum(place - 1, 0) & 63
        row = own * _GROUPS + g
        inside = self.within[row, j].astype(np.int64)
        start = np.where(known, self.groups[own, g] + inside, all_)
        size = np.where(known, self.within[row, j + 1] - inside, escape)
        self.part(own, start, size, all_ + escape)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            new = own[fresh]
            r = self.range[new] >> _64(16)
            self._narrow(new, self.low[new] + r * ids[fresh].astype(_64), r)
            place[fresh] = self.meet(new, ids[fresh])
        self.count(own, place)


class _In(Lanes):
    def __init__(self, n: int, words: np.ndarray) -> None:
        super().__init__(n)
        self.words, self.room = words.reshape(-1), words.shape[1]
        self.used = np.full(n, 4)
        self.met = np.zeros(n * (BLOCK + 1), np.uint16)  # by place
        self.code = sum(words[:, i].astype(_64) << _64(48 - 16 * i) for i in range(4))

    def meet(self, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        place = super().meet(own, ids)
        self.met[own * (BLOCK + 1) + place] = ids
        return place

    def _narrow(self, own: np.ndarray, low: np.ndarray, size: np.ndarray) -> None:
        self.low[own], self.range[own] = low, size
        while True:
            small = np.flatnonzero(size < _BOT)
            if not len(small):
                return
            own, low, size = own[small], low[small], size[small]
            same = (low ^ (low + size)) < _TOP
            size = np.where(same, size, (~low + _64(1)) & (_BOT - _64(1))) << _64(16)
            self.code[own] = (self.code[own] << _64(16)) | self.words[own * self.room + np.minimum(self.used[own], self.room - 1)]
            self.used[own] += 1
            low = low << _64(16)
            self.low[own], self.range[own] = low, size

    def flag(self, own: np.ndarray, p: np.ndarray) -> np.ndarray:
        r, p, low = self.range[own] >> _64(16), p.astype(_64), self.low[own]
        bit = self.code[own] - low < r * p
        self._narrow(own, np.where(bit, low, low + r * p), np.where(bit, r * p, r * (_64(65536) - p)))
        return bit

    def rare(self, own: np.ndarray) -> np.ndarray:
        all_, escape = self.groups[own, _GROUPS].astype(np.int64), self.many[own] + 1
        r = self.range[own] // (all_ + escape).astype(_64)
        value = np.minimum(((self.code[own] - self.low[own]) // r).astype(np.int64), all_ + escape - 1)
        known = value < all_
        g = np.minimum((self.groups[own, 1:] <= value[:, None].astype(np.int16)).sum(1, dtype=np.int16).astype(np.int64), _GROUPS - 1)
        rest = (value - self.groups[own, g]).astype(np.int16)
        row = self.within[own * _GROUPS + g]
        j = np.minimum((row[:, 1:] <= rest[:, None]).sum(1, dtype=np.int16).astype(np.int64), 63)
        at = np.arange(len(own))
        inside = row[at, j].astype(np.int64)
        start = np.where(known, self.groups[own, g] + inside, all_)
        size = np.where(known, row[at, j + 1] - inside, escape)
        self._narrow(own, self.low[own] + r * start.astype(_64), r * size.astype(_64))
        place = np.where(known, g * 64 + j + 1, 0)
        ids = self.met[own * (BLOCK + 1) + place].astype(np.int64)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            new = own[fresh]
            r = self.range[new] >> _64(16)
            first = np.minimum((self.code[new] - self.low[new]) // r, _64(65535))
            self._narrow(new, self.low[new] + r * first, r)
            ids[fresh] = first.astype(np.int64)
            place[fresh] = self.meet(new, ids[fresh])
        self.count(own, place)
        return ids


def encode_blocks(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(number of ids, crc32 of the ids as little-endian 32-bit integers, code) of each block of at most BLOCK ids."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids must be below 65,536")
    out = []
    for first in range(0, len(ids), LANES * BLOCK):
        part = ids[first : first + LANES * BLOCK]
        n = -(-len(part) // BLOCK)
        rows = np.zeros((n, BLOCK), np.int64)
        rows.reshape(-1)[: len(part)] = part
        sizes = np.full(n, BLOCK)
        sizes[-1] = len(part) - BLOCK * (n - 1)
        lanes, columns = _Out(n), np.ascontiguousarray(rows.T)
        for t in range(int(sizes[0])):
            k = n if t < sizes[-1] else n - 1  # only the last block may be shorter
            want = columns[t, :k]
            lanes.foretell(k)
            open_ = np.ones(k, bool)
            for which, has in ((0, lanes.c2 > 0), (1, (lanes.c1 > 0) & ((lanes.c2 == 0) | (lanes.g1 != lanes.g2)))):
                own = np.flatnonzero(has & open_)
                if len(own):
                    p = lanes.mix(which, own)
                    bit = (lanes.g1 if which else lanes.g2)[own] == want[own]
                    lanes.flag(own, p, bit)
                    lanes.mixed(which, own, bit)
                    open_[own] = ~bit
            own = np.flatnonzero(open_)
            if len(own):
                lanes.rare(own, want[own])
            lanes.learn(want)
        for _ in range(4):
            lanes.words[lanes.at * lanes.room + lanes.used] = lanes.low >> _64(48)
            lanes.low <<= _64(16)
            lanes.used += 1
        words = lanes.words.reshape(n, lanes.room)
        for i in range(n):
            own = part[i * BLOCK : i * BLOCK + sizes[i]]
            out.append((int(sizes[i]), zlib.crc32(own.astype("<u4").tobytes()), words[i, : lanes.used[i]].astype("<u2").tobytes()))
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids; blocks must be full but for the last of each run of LANES. Raises ValueError where a checksum differs."""
    out = []
    for first in range(0, len(blocks), LANES):
        own_blocks = blocks[first : first + LANES]
        n = len(own_blocks)
        codes = [np.frombuffer(b[2], "<u2") for b in own_blocks]
        words = np.zeros((n, max(map(len, codes)) + 8), np.uint16)
        for i, c in enumerate(codes):
            words[i, : len(c)] = c
        sizes = np.array([b[0] for b in own_blocks])
        lanes, columns = _In(n, words), np.zeros((BLOCK, n), np.int64)
        for t in range(int(sizes[0])):
            k = n if t < sizes[-1] else n - 1
            lanes.foretell(k)
            ids, open_ = np.zeros(k, np.int64), np.ones(k, bool)
            for which, has in ((0, lanes.c2 > 0), (1, (lanes.c1 > 0) & ((lanes.c2 == 0) | (lanes.g1 != lanes.g2)))):
                own = np.flatnonzero(has & open_)
                if len(own):
                    p = lanes.mix(which, own)
                    bit = lanes.flag(own, p)
                    lanes.mixed(which, own, bit)
                    hit = own[bit]
                    ids[hit] = (lanes.g1 if which else lanes.g2)[hit]
                    open_[hit] = False
            own = np.flatnonzero(open_)
            if len(own):
                ids[own] = lanes.rare(own)
            columns[t, :k] = ids
            lanes.learn(ids)
        rows = columns.T
        for i, (size, crc, _) in enumerate(own_blocks):
            found = rows[i, :size].astype("<u4")
            if zlib.crc32(found.tobytes()) != crc:
                raise ValueError("a block's ids do not match its checksum")
            out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
