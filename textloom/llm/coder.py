"""Adaptive context-mixing range coder for token ids below 65536.

Ids are cut into blocks that start from nothing and carry a CRC-32, so each can
be decoded alone. A block is cut into lanes of equal length which are coded side
by side, one id of each at a time; the lanes share the block's model, which
learns after every such step. Every number is an integer, so all machines agree.

Order 2 (the two ids before) and order 1 (the one before) each guess an id, by
what followed lately, and know how sure they are. Two decisions are coded: is it
order 2's guess, and if not, is it order 1's? The probability of each mixes, in
the logistic domain with weights that learn, the estimates of all three orders:
by order 2's sureness, by order 1's, and by how common the guessed id is (order
0). An id that neither guesses is coded by order 0's adaptive frequencies; one
that the block has not shown before is announced there and written out.

All sureness and frequency classes are small, so a mixed probability depends on
one of 1024 cells; cells are mixed anew every few steps and then looked up.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK, LANES, SHORTEST = 1 << 22, 8192, 512
MAGIC = b"TLC3"
_U = np.uint64
#: Entries of the order-2 table, slots of order 0 and the pseudo id that announces a new id.
_CONTEXTS, _SLOTS, _NEW = 19, 17, 65536
_HASH1, _HASH2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Steps between two times that cells are counted (the first steps all are), mixed anew, and that order 0 is made anew.
_COUNT, _LEARN, _RENEW = 4, 16, 64
_STRETCH = np.array([round(math.log((p + 0.5) / (4096 - p - 0.5)) * 256) for p in range(4096)], np.int64)
_SQUASH = np.array([round(65536 / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], np.int64)
#: What a wrong (even places) and a right guess (odd places) add to sureness; a wrong guess at sureness 0 or 1 is replaced, at sureness 1.
_SURER = np.array([0, 1, 0, 1, -1, 1, -2, 1, -2, 1, -3, 1, -3, 1, -4, 0], np.int32)


def _at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """table[places], the places being known to be inside."""
    return table.take(places, mode="clip")


class _Decision:
    """Mixed probabilities, of 65536, that a guess is right: cells by (own sureness, other's sureness, same guess, class of frequency)."""

    SHAPE = (8, 8, 2, 8)

    def __init__(self):
        self.seen = np.zeros((*self.SHAPE, 2), np.int64)
        self.weights = np.full((3, 2), 24000, np.int64)
        self.learn(self.seen)

    def learn(self, new: np.ndarray) -> None:
        """new: how often each cell was wrong and right since the last time."""
        if new.any():
            n = new.sum(-1)
            off = (new[..., 1] << 16) - n * self.mixed
            total = np.maximum(1, n.sum((0, 1, 3)))
            for k, s in enumerate(self.inputs):
                self.weights[k] += ((off * s).sum((0, 1, 3)) >> 10) * 3 // total
            self.weights = np.clip(self.weights, -200_000, 200_000)
        self.seen += new - (self.seen >> 6)
        by = [self.seen.sum(axes, keepdims=True) for axes in ((1, 3), (0, 3), (0, 1, 2))]
        self.inputs = [_STRETCH[np.clip((4096 * x[..., 1] + 1024) // (x.sum(-1) + 4), 1, 4094)] for x in by]
        dot = sum(w[:, None] * s for w, s in zip(self.weights, self.inputs)) >> 16
        self.mixed = np.clip(_SQUASH[np.clip(dot, -2047, 2047) + 2047], 24, 65400)


class _Model:
    """What a block's lanes share."""

    def __init__(self, lanes: int):
        self.e1, self.e2 = np.zeros(65536, np.int32), np.zeros(1 << _CONTEXTS, np.int32)
        self.a, self.b = _Decision(), _Decision()
        self.new_a, self.new_b = np.zeros(2048, np.int64), np.zeros(4096, np.int64)
        self.counts, self.lately = np.zeros(_NEW + 1, np.int64), []
        self.c1, self.step = np.zeros(lanes, np.int64), 0
        self.last = self.hash1 = self.hash2 = np.zeros(lanes, np.uint32)
        self._renew()
        self._probabilities()

    def _probabilities(self) -> None:
        self.pa = self.a.mixed.reshape(-1)
        b = self.b.mixed.copy()
        b[:, :, 1] = 0  # the same guess again
        self.pb = b.reshape(-1)

    def _renew(self) -> None:
        """Order 0 from the ids that it coded: slots in proportion to counts, one at least for an id that was seen."""
        if self.lately:
            now = np.bincount(np.concatenate(self.lately), minlength=_NEW + 1)
            self.counts += now
            self.counts[_NEW] = now[_NEW]
            self.lately = []
        self.counts[_NEW] += 1
        seen = self.counts > 0
        size = seen + self.counts * ((1 << _SLOTS) - int(seen.sum())) // int(self.counts.sum())
        size[_NEW] += (1 << _SLOTS) - int(size.sum())
        self.start, self.size = (np.cumsum(size) - size).astype(_U), size.astype(_U)
        self.slot = np.repeat(np.arange(_NEW + 1, dtype=np.int32), size)
        # Classes of frequency by powers of four.
        self.common = np.searchsorted(np.array([1, 2, 8, 32, 128, 512, 2048]), size, "right").astype(np.int32)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Guesses of order 2 and 1, and where their parts of 65536 end; the rest, 2 or more, is order 0's."""
        self.at2 = ((self.hash1 + self.hash2) >> np.uint32(32 - _CONTEXTS)).astype(np.int64)
        self.x1, self.x2 = _at(self.e1, self.c1), _at(self.e2, self.at2)
        self.g1, self.g2 = g1, g2 = self.x1 >> 3, self.x2 >> 3
        self.s1, self.s2 = s1, s2 = self.x1 & 7, self.x2 & 7
        same = (g1 == g2).astype(np.int32) << 3
        self.cell_a = ((s2 << 7 | s1 << 4 | same) + _at(self.common, g2)).astype(np.int64)
        self.cell_b = ((s1 << 7 | s2 << 4 | same) + _at(self.common, g1)).astype(np.int64)
        end_a = _at(self.pa, self.cell_a)
        end_b = end_a + ((65534 - end_a) * _at(self.pb, self.cell_b) >> 16)
        return g2, g1, end_a.view(_U), end_b.view(_U)

    def learn(self, ids: np.ndarray, is2: np.ndarray, is12: np.ndarray, rest: np.ndarray) -> None:
        """ids: int32; is2, is12: order 2, or one of both, was right; rest: what order 0 coded."""
        t = self.step = self.step + 1
        if t % _COUNT == 1 or t < _LEARN:
            self.new_a += np.bincount(self.cell_a << 1 | is2, minlength=2048)
            self.new_b += np.bincount(self.cell_b << 2 | is12.astype(np.int64) << 1 | is2, minlength=4096)
        if len(rest):
            self.lately.append(rest)
        fresh = ids << 3 | 1
        for table, at, x, sure, right in ((self.e1, self.c1, self.x1, self.s1, self.g1 == ids), (self.e2, self.at2, self.x2, self.s2, is2)):
            table[at] = np.where((sure < 2) & ~right, fresh, x + _at(_SURER, sure << 1 | right))
        u = ids.view(np.uint32)
        self.hash2, self.hash1 = self.last * _HASH2, u * _HASH1
        self.c1, self.last = ids.astype(np.int64), u
        if t % _LEARN == 0 or t < _LEARN:
            self.a.learn(self.new_a.reshape(*_Decision.SHAPE, 2))
            b = self.new_b.reshape(*_Decision.SHAPE, 4)
            self.b.learn(np.stack([b[:, :, :, :, 0], b[:, :, :, :, 2]], -1) * np.array([1, 0])[:, None, None])
            self._probabilities()
            self.new_a[:] = self.new_b[:] = 0
        if t % _RENEW == 0 or t & (t - 1) == 0:
            self._renew()


def _encode_block(ids: np.ndarray) -> bytes:
    steps = max(SHORTEST, -(-len(ids) // LANES))
    lanes = -(-len(ids) // steps)
    padded = np.zeros(lanes * steps, np.int32)
    padded[: len(ids)] = ids
    rows = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model, new = _Model(lanes), []
    low, rng = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    # Words come out with their carries, which are passed on at the end; at: the place of a lane's next word.
    words, at, zero = np.zeros((steps + 2, lanes), _U), np.arange(lanes), np.zeros(lanes, _U)
    flat = words.reshape(-1)

    def add(more: np.ndarray) -> None:
        low[:] += more
        over = np.flatnonzero(low < more)
        if len(over):
            flat[at[over] - lanes] += _U(1)

    for now in rows:
        g2, g1, end_a, end_b = model.predict()
        is2 = now == g2
        is12 = is2 | (now == g1)
        part = rng >> _U(16)
        end_a *= part
        end_b *= part
        begin = np.where(is2, zero, end_a)
        size = np.where(is2, end_a, end_b) - begin
        on = np.flatnonzero(~is12)
        symbol = _at(now, on).astype(np.int64)
        own = _at(model.size, symbol)
        fresh = np.flatnonzero(own == 0)
        if len(fresh):
            new.append(symbol[fresh])
            coded = symbol.copy()
            coded[fresh] = _NEW
            own[fresh] = model.size[_NEW]
        else:
            coded = symbol
        base = _at(end_b, on)
        part = (_at(rng, on) - base) >> _U(_SLOTS)
        begin[on] = base + part * _at(model.start, coded)
        size[on] = part * own
        add(begin)
        rng = size
        out = np.flatnonzero(rng < _U(1 << 32))
        place, done = _at(at, out), _at(low, out)
        flat[place] = done >> _U(32)
        at[out] = place + lanes
        low[out] = done << _U(32)
        rng[out] = _at(rng, out) << _U(32)
        model.learn(now, is2, is12, coded if not len(fresh) else np.concatenate([symbol, np.full(len(fresh), _NEW)]))
    add(np.full(lanes, 2**32 - 1, _U))
    flat[at] = low >> _U(32)
    n = at // lanes + 1
    words = words[: int(n.max())]
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> _U(32)
    data = words.astype("<u4").T[np.arange(len(words)) < n[:, None]].tobytes()
    side = np.concatenate(new).astype("<u2").tobytes() if new else b""
    lengths = n.astype("<u4").tobytes()
    head = struct.pack("<IIIIII", len(ids), steps, lanes, len(data), len(side), zlib.crc32(ids.astype("<u2").tobytes()))
    return head + struct.pack("<I", zlib.crc32(lengths, zlib.crc32(head))) + lengths + data + side


def _decode_block(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The ids of the block at a place, and the place behind it."""
    if len(data) < at + 28:
        raise ValueError("a block is cut short")
    total, steps, lanes, n_data, n_side, crc, head = struct.unpack_from("<IIIIIII", data, at)
    if len(data) < at + 28 + 4 * lanes + n_data + n_side or zlib.crc32(data[at + 28:at + 28 + 4 * lanes], zlib.crc32(data[at:at + 24])) != head:
        raise ValueError("a block is damaged")
    at += 28
    n = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    at += 4 * lanes
    # A zero follows each lane's words.
    words = np.zeros(n_data // 4 + lanes, _U)
    words[np.arange(n_data // 4) + np.repeat(np.arange(lanes), n)] = np.frombuffer(data, "<u4", n_data // 4, at)
    side = np.append(np.frombuffer(data, "<u2", n_side // 2, at + n_data), np.uint16(0)).astype(np.int64)
    pos, zero, used = np.cumsum(n + 1) - n - 1, np.zeros(lanes, _U), 0
    out, model = np.zeros((steps, lanes), np.int32), _Model(lanes)
    rng, code = np.full(lanes, 2**64 - 1, _U), np.zeros(lanes, _U)

    for _ in range(2):
        code = code << _U(32) | _at(words, pos)
        pos += 1
    for t in range(steps):
        g2, g1, end_a, end_b = model.predict()
        part = rng >> _U(16)
        end_a *= part
        end_b *= part
        is2, is12 = code < end_a, code < end_b
        begin = np.where(is2, zero, end_a)
        size = np.where(is2, end_a, end_b) - begin
        now = np.where(is2, g2, g1)
        on = np.flatnonzero(~is12)
        base = _at(end_b, on)
        part, c = (_at(rng, on) - base) >> _U(_SLOTS), _at(code, on) - base
        coded = _at(model.slot, (c // np.maximum(part, _U(1))).view(np.int64)).astype(np.int64)
        begin[on] = base + part * _at(model.start, coded)
        size[on] = part * _at(model.size, coded)
        code -= begin
        rng = size
        fresh = np.flatnonzero(coded == _NEW)
        rest = coded
        if len(fresh):
            coded = coded.copy()
            coded[fresh] = _at(side, np.arange(used, used + len(fresh)))
            used += len(fresh)
            rest = np.concatenate([coded, np.full(len(fresh), _NEW)])
        now[on] = coded
        more = np.flatnonzero(rng < _U(1 << 32))
        place = _at(pos, more)
        code[more] = _at(code, more) << _U(32) | _at(words, place)
        pos[more] = place + 1
        rng[more] = _at(rng, more) << _U(32)
        out[t] = now
        model.learn(now, is2, is12, rest)
    ids = out.T.reshape(-1)[:total]
    if zlib.crc32(ids.astype("<u2").tobytes()) != crc:
        raise ValueError("a block is damaged")
    return ids, at + n_data + n_side


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The ids (any number of them) as one string: magic, number of ids, then blocks, each with CRCs of its ids and of its head, its lanes' lengths and words, and its new ids."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and not 0 <= ids.min() <= ids.max() < 65536:
        raise ValueError("ids must be below 65536")
    return b"".join([MAGIC, struct.pack("<Q", len(ids)), *(_encode_block(ids[a:a + block]) for a in range(0, len(ids), block))])


def decode(data: bytes) -> np.ndarray:
    """The ids of encode(); a block that does not match its CRC raises ValueError."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    (total,), at, out, got = struct.unpack_from("<Q", data, 4), 12, [], 0
    while got < total:
        ids, at = _decode_block(data, at)
        if not len(ids):
            raise ValueError("a block is damaged")
        out.append(ids)
        got += len(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int64)
