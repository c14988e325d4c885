"""Token ids in compressed segments: an adaptive context-mixing range coder over independent blocks.

A segment holds the ids of consecutive documents, cut into blocks of BLOCK ids. Every block
starts from a fresh model and has its own checksum, so blocks are coded side by side: one
numpy step codes one id of every block.

For each id an order-2 and an order-1 context predict one id each. One symbol says which
prediction is right, order-2, else order-1, else none; without a right one it goes on with the
order-0 model's adaptive size class of the id. The probabilities of the former are a mix: two
adaptive estimates that order-2 is right, one for each order's record, whose weight follows
the better one, and an estimate for order-1. The low bits of an id without a right prediction
stand as they are behind the range coder's digits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"QTS2"
BLOCK = 1024
#: Slots of the order-1 and order-2 tables of a block, as 1 << SLOT_BITS. Larger tables save 0.3% of the bytes and take longer where processes share a cache.
SLOT_BITS = 8
#: Probabilities are parts of 1 << BITS, those of size classes of 1 << CLASS_BITS.
BITS, CLASS_BITS = 15, 14
_ALL, _HALF = 1 << BITS, 1 << (BITS - 1)
#: Predictions have _TOP parts at most, the classes the rest; no estimate leaves [_LEAST, its goal], so every part is at least one.
_TOP, _LEAST = _ALL - 1024, 64
_GOAL2, _GOAL1 = _TOP - 2 * _LEAST, _ALL - 1024
_HEADER = struct.Struct("<4sQQIIQ")  # magic, ids before in the shard, ids, documents, blocks, bytes of all blocks

# What the lower ends of the sixteen classes drift to after each class: nearly all for that class.
_GOAL = np.array([[32 * i + ((1 << CLASS_BITS) - 512) * (i > c) for i in range(16)] for c in range(16)], np.int16)
# The sum of the bytes of a word, each small, is the highest byte of the product.
_BYTES = np.uint64(0x0101010101010101)


class _Model:
    """Predictions and adaptive probabilities of many blocks; integers only, so both sides agree.

    A slot holds 4 * id + trust.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.row, self.lanes8, self.lanes4 = lane << SLOT_BITS, lane * 8, lane * 4
        self.slots1, self.slots2 = np.zeros(lanes << SLOT_BITS, np.int32), np.zeros(lanes << SLOT_BITS, np.int32)
        self.by2, self.by1 = np.full(lanes * 8, _TOP // 2, np.int32), np.full(lanes * 8, _TOP // 2, np.int32)
        self.second = np.full(lanes * 4, _HALF, np.int32)
        self.weight = np.full(lanes, 8, np.int32)
        self.classes = np.tile(np.arange(16, dtype=np.int16) << (CLASS_BITS - 4), (lanes, 1))
        self.last, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def look(self) -> None:
        """The two predictions and where the parts for order-2 and order-1 end."""
        mask = (1 << SLOT_BITS) - 1
        mixed = self.last * 40503
        self.at1 = (mixed >> 5 & mask) + self.row
        self.at2 = (self.last * 2654435761 + self.mixed >> 9 & mask) + self.row
        self.mixed = mixed
        self.s1, self.s2 = s1, s2 = self.slots1.take(self.at1), self.slots2.take(self.at2)
        self.g1, self.g2, self.t1, self.t2 = s1 >> 2, s2 >> 2, s1 & 3, s2 & 3
        same = (self.g1 == self.g2).view(np.int8)
        self.i2, self.i1, self.ib = (self.t2 * 2 + same) + self.lanes8, (self.t1 * 2 + same) + self.lanes8, self.t1 + self.lanes4
        self.p2, self.p1, self.pb = self.by2.take(self.i2), self.by1.take(self.i1), self.second.take(self.ib)
        self.better = self.p2 - self.p1
        self.end2 = (self.better * self.weight >> 4) + self.p1
        self.end1 = ((_TOP - self.end2) * self.pb >> BITS) + self.end2

    def learn(self, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        """After an id (int32): the records of both orders, their weight and the two slots."""
        hit2, hit1 = right2.astype(np.int32), right1.astype(np.int32)
        goal = hit2 * (_GOAL2 - _LEAST) + _LEAST
        self.by2[self.i2] = (goal - self.p2 >> 4) + self.p2
        self.by1[self.i1] = (goal - self.p1 >> 4) + self.p1
        # one step towards the order that gave what happened more, order-2 where they are level
        weight = ((self.better ^ (hit2 - 1)) >> 31 | 1) + self.weight
        self.weight = np.minimum(np.maximum(weight, 1, out=weight), 15, out=weight)
        tried = np.where(right2, self.pb, (hit1 * (_GOAL1 - 1024) + 1024 - self.pb >> 4) + self.pb)
        self.second[self.ib] = tried
        fresh = ids << 2
        for slots, at, right, s, t in ((self.slots1, self.at1, right1, self.s1, self.t1), (self.slots2, self.at2, right2, self.s2, self.t2)):
            slots[at] = np.where(right, s + (t != 3), np.where(t > 0, s - 1, fresh))
        self.last = ids.astype(np.int64)

    def literal(self, which: np.ndarray, rows: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of class c within the parts that predictions leave, for the lanes `which` and their classes; then the classes drift."""
        flat, at = rows.reshape(-1), np.arange(0, 16 * len(c), 16) + c
        end1 = self.end1.take(which)
        left = _ALL - end1
        low = left * flat.take(at) >> CLASS_BITS
        high = left * np.where(c == 15, 1 << CLASS_BITS, flat.take(at + 1, mode="clip")) >> CLASS_BITS
        rows += _GOAL.take(c, axis=0) - rows >> 5
        self.classes.view("V32").reshape(-1)[which] = rows.view("V32").reshape(-1)
        return end1 + low, high - low


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 32, np.int64)
        self.digits = np.zeros((lanes, steps + 8), np.uint32)  # a put narrows by BITS at most, less than a digit
        self.flat = self.digits.reshape(-1)
        self.at = np.arange(lanes) * self.digits.shape[1] + 1  # digit 0 takes a carry out of the first

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow every lane's interval to [start, start + size) of 1 << BITS."""
        r = self.range >> BITS
        self.low += r * start  # a carry stays above the 32 bits and leaves with the next digit
        self.range = r * size
        small = np.flatnonzero(self.range < 1 << 16)
        if len(small):
            low, at = self.low.take(small), self.at.take(small)
            self.flat[at] = low >> 16
            self.at[small] = at + 1
            self.low[small] = (low << 16) & 0xFFFFFFFF
            self.range[small] <<= 16

    def end(self) -> list[bytes]:
        for digit in (self.low >> 16, self.low & 0xFFFF):
            self.flat[self.at] = digit
            self.at += 1
        while (carry := self.digits >> np.uint32(16)).any():
            self.digits &= np.uint32(0xFFFF)
            self.digits[:, :-1] += carry[:, 1:]
        out = self.digits.astype("<u2")
        ends = self.at - np.arange(len(out)) * out.shape[1]
        return [out[i, 1:n].tobytes() for i, n in enumerate(ends)]


class _Reader:
    def __init__(self, parts: list[bytes]):
        lanes, width = len(parts), max(map(len, parts)) // 2 + 4
        digits = np.zeros((lanes, width), np.int64)
        for i, p in enumerate(parts):
            digits[i, : len(p) // 2] = np.frombuffer(p, "<u2")
        self.flat = np.concatenate([digits.reshape(-1), np.zeros(8 * BLOCK, np.int64)])
        self.code = (digits[:, 0] << 16) | digits[:, 1]
        self.at = np.arange(lanes) * width + 2
        self.range = np.full(lanes, 1 << 32, np.int64)

    def ask(self) -> np.ndarray:
        self.r = self.range >> BITS
        return np.minimum(self.code // self.r, _ALL - 1)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        self.code -= self.r * start
        self.range = self.r * size
        small = np.flatnonzero(self.range < 1 << 16)
        if len(small):
            at = self.at.take(small)
            self.code[small] = (self.code.take(small) << 16) | self.flat.take(at, mode="clip")
            self.at[small] = at + 1
            self.range[small] <<= 16


def _low_words(literal: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each block (row) the low bits of its literal ids as 16-bit words, highest bit first."""
    at = np.flatnonzero(literal)
    counts = np.count_nonzero(literal, axis=1)
    bits = np.maximum(sizes.reshape(-1).take(at), 1).astype(np.int32)
    values = ids.reshape(-1).take(at) & ((1 << bits) - 1)
    sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(bits, dtype=np.int32)])
    upto = sums[np.cumsum(counts)]
    before = np.concatenate([np.zeros(1, np.int32), upto[:-1]])
    words = upto - before + 15 >> 4
    ends = np.cumsum(words, dtype=np.int32)
    place = sums[:-1] + np.repeat((ends - words << 4) - before, counts)
    word, pair = place >> 4, values.astype(np.uint32) << (32 - (place & 15) - bits).astype(np.uint32)
    flat = np.zeros(int(ends[-1]) + 2, np.uint32)
    if len(at):
        # the bits that start in a word stand in it and the next one
        first = np.flatnonzero(np.diff(word, prepend=-1))
        word, pair = word.take(first), np.add.reduceat(pair, first, dtype=np.uint32)
        flat[word] = pair >> np.uint32(16)
        flat[word + 1] += pair & np.uint32(0xFFFF)
    flat = flat.astype("<u2")
    return [flat[e - k : e].tobytes() for e, k in zip(ends.tolist(), words.tolist(), strict=True)]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Code ids (below 65536) in blocks of BLOCK; a shorter last one is filled up with zeros.

    A block is the number of its digits (16 bits), the range coder's digits, the words of low bits.
    """
    lanes = -(-len(ids) // BLOCK)
    if not lanes:
        return []
    grid, steps = np.zeros((lanes, BLOCK), np.int32), min(BLOCK, len(ids))
    grid.reshape(-1)[: len(ids)] = ids
    sizes = np.maximum(np.frexp(np.maximum(grid, 1).astype(np.float32))[1] - 1, 0).astype(np.int8)  # class: bits below the highest
    columns, classes = np.ascontiguousarray(grid.T), np.ascontiguousarray(sizes.T)
    m, w, literal = _Model(lanes), _Writer(lanes, steps), np.zeros((BLOCK, lanes), bool)
    for t in range(steps):
        x = columns[t]
        m.look()
        right2, right1 = x == m.g2, x == m.g1
        start = np.where(right2, 0, m.end2)
        size = np.where(right2, m.end2, m.end1 - m.end2)
        literal[t] = ~(right2 | right1)
        which = np.flatnonzero(literal[t])
        start[which], size[which] = m.literal(which, m.classes.take(which, axis=0), classes[t].take(which).astype(np.int64))
        w.put(start, size)
        m.learn(x, right2, right1)
    # some blocks at a time, for the arrays to stay in the processor's cache
    some = (slice(i, i + 64) for i in range(0, lanes, 64))
    low = [v for rows in some for v in _low_words(np.ascontiguousarray(literal[:, rows].T), grid[rows], sizes[rows])]
    return [struct.pack("<H", len(d) // 2) + d + v for d, v in zip(w.end(), low, strict=True)]


def decode_blocks(parts: list[bytes], n: int) -> np.ndarray:
    """The n ids of encode_blocks."""
    lanes = len(parts)
    if not lanes:
        return np.zeros(0, np.int32)
    ends = [2 + 2 * struct.unpack_from("<H", p)[0] for p in parts]
    low = [p[e:] for p, e in zip(parts, ends, strict=True)]
    words = np.concatenate([np.frombuffer(b"".join(low), "<u2").astype(np.uint32), np.zeros(2, np.uint32)])
    pairs = words[:-1] << np.uint32(16) | words[1:]
    sizes = np.array([len(v) // 2 for v in low], np.int64)
    place = np.cumsum(sizes) - sizes << 4
    steps = min(BLOCK, n)
    columns = np.zeros((BLOCK, lanes), np.int32)
    m, r = _Model(lanes), _Reader([p[2:e] for p, e in zip(parts, ends, strict=True)])
    for t in range(steps):
        m.look()
        part = r.ask()
        hit2 = part < m.end2
        start = np.where(hit2, 0, m.end2)
        size = np.where(hit2, m.end2, m.end1 - m.end2)
        x = np.where(hit2, m.g2, m.g1)
        which = np.flatnonzero(part >= m.end1)
        rows = m.classes.take(which, axis=0)
        end1 = m.end1.take(which)
        asked = (((part.take(which) - end1 + 1 << CLASS_BITS) - 1) // (_ALL - end1)).astype(np.int16)
        below = (rows <= asked[:, None]).view(np.uint64)
        c = ((below[:, 0] + below[:, 1]) * _BYTES >> np.uint64(56)).astype(np.int64) - 1
        start[which], size[which] = m.literal(which, rows, c)
        r.take(start, size)
        bits, at = np.maximum(c, 1), place.take(which)
        rest = ((pairs.take(at >> 4, mode="clip").astype(np.int64) << (at & 15)) & 0xFFFFFFFF) >> (32 - bits)
        place[which] = at + bits
        x[which] = np.where(c > 0, 1 << c | rest, rest)
        columns[t] = x
        m.learn(x, x == m.g2, x == m.g1)
    return np.ascontiguousarray(columns.T).reshape(-1)[:n]


def pack(before: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: header, document index (id, whether it is null, number of ids), block index (bytes, crc32), blocks."""
    parts = encode_blocks(ids)
    raw = memoryview(ids.astype("<u4").tobytes())
    crcs = [zlib.crc32(raw[4 * i * BLOCK : 4 * (i + 1) * BLOCK]) for i in range(len(parts))]
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + nulls.tobytes() + np.asarray(sizes, "<u4").tobytes()
    blocks = np.array([len(p) for p in parts], "<u4").tobytes() + np.array(crcs, "<u4").tobytes()
    body = b"".join(parts)
    return _HEADER.pack(MAGIC, before, len(ids), len(doc_ids), len(parts), len(body)) + index + blocks + body


def unpack(data: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """before, document ids, numbers of ids and all ids of a segment; raises ValueError on damage."""
    magic, before, n, n_docs, n_blocks, size = _HEADER.unpack_from(data)
    if magic != MAGIC or len(data) != _HEADER.size + n_docs * 13 + n_blocks * 8 + size:
        raise ValueError("not a whole segment")
    at = _HEADER.size
    doc_ids, at = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs
    nulls, at = np.frombuffer(data, np.uint8, n_docs, at), at + n_docs
    sizes, at = np.frombuffer(data, "<u4", n_docs, at), at + 4 * n_docs
    lengths, at = np.frombuffer(data, "<u4", n_blocks, at), at + 4 * n_blocks
    crcs, at = np.frombuffer(data, "<u4", n_blocks, at), at + 4 * n_blocks
    ends = at + np.cumsum(lengths, dtype=np.int64)
    ids = decode_blocks([data[e - k : e] for e, k in zip(ends, lengths, strict=True)], n)
    raw = memoryview(ids.astype("<u4").tobytes())
    for i in range(n_blocks):
        if zlib.crc32(raw[4 * i * BLOCK : 4 * (i + 1) * BLOCK]) != crcs[i]:
            raise ValueError(f"block {i} is damaged")
    return before, [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], sizes.astype(np.int64), ids
