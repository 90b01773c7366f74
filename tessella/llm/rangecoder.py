"""Adaptive context-mixing range coder for token ids, in blocks, many blocks in step.

A block of ``BLOCK`` ids is coded on its own: its model starts anew and its checksum is kept beside it.
For each id, the tables of order 2 and order 1 (what followed the last two ids, and the last one, in
this block) predict an id. The chance that the prediction holds is a logistic mix: order 2 gives a logit
for how often its prediction has held, order 1 one for its own and whether it agrees, order 0 one for the
predicted id's frequency; they are summed, and each learns in the block from the sum's error. The rest of
the chance is dealt to all ids by order 0: the frequencies of the whole file, kept in its header. One
interval of the range coder codes both.

All arithmetic is on integers, so every machine decodes alike. Blocks are coded in step as lanes of
numpy arrays: Python's cost is for a step of all lanes, not for an id.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
#: Blocks coded in step.
LANES = 4096
_SLOT_BITS = 10
_ORDER0_BITS = 18
_TOTAL = 1 << _ORDER0_BITS
_SIZE = 1 << 16

#: 12-bit chances of logits in 1/256; in a block no sum of logits can leave the table.
_ZERO = 1 << 14
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-_ZERO, _ZERO) / 256))), 16, 4080).astype(np.int32)
#: A slot is an id times 8 plus how sure it is, 0 for none yet.
_SURE, _THREE, _ONE = np.uint32(7), np.uint32(3), np.uint32(1)
_HASH1, _HASH2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_SLOT = np.uint32(32 - _SLOT_BITS)
#: Logits of a lane: 8 of order 2, 16 of order 1, 16 of order 0; their first values add up to a chance of a quarter.
_LOGITS, _FIRST = 40, -94
_RATE = 5

_U32, _U12, _UB, _UNIT = np.uint64(32), np.uint64(12), np.uint64(_ORDER0_BITS), np.uint64(12 + _ORDER0_BITS)
_DUE, _LOW32, _WHOLE = np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64(4096)


def order0(ids: np.ndarray) -> np.ndarray:
    """Frequencies of ids below 65536 that sum to 2**18; every id that occurs has one at least."""
    count = np.bincount(ids, minlength=_SIZE).astype(np.int64)
    if not len(ids):
        count[0] = 1
    have = count > 0
    share = np.where(have, np.maximum(1, count * (_TOTAL - _SIZE) // count.sum()), 0)
    share[np.argmax(share)] += _TOTAL - share.sum()
    return share


class _Lanes:
    """Models and coder states of some blocks in step."""

    def __init__(self, n: int, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.rank = np.frexp(freq.astype(np.float64))[1].clip(0, 15).astype(np.int64)
        lane = np.arange(n)
        self.base = np.stack([lane, lane + n]) << _SLOT_BITS
        self.slots = np.zeros(2 * n << _SLOT_BITS, np.uint32)
        self.logits = np.full(n * _LOGITS, _FIRST, np.int32)
        self.own = lane * _LOGITS + np.array([[0], [8], [24]])
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.context, self.before = np.zeros((2, n), np.uint32), np.zeros(n, np.uint32)

    def predict(self) -> None:
        # places are of the type that numpy indexes with
        self.at = (self.context >> _SLOT).astype(np.int64)
        self.at += self.base
        self.held = self.slots[self.at]
        self.sure, self.said = self.held & _SURE, self.held >> _THREE
        guess = np.where(self.sure[0] > 0, self.said[0], self.said[1])
        self.guess = guess.astype(np.int64)
        self.state = self.own.copy()
        self.state[:2] += self.sure
        self.state[1] += (self.said[1] == guess) << 3
        self.state[2] += self.rank[self.guess]
        self.logit = self.logits[self.state]
        total = self.logit[0] + self.logit[1]
        total += self.logit[2]
        self.chance = _SQUASH[total.astype(np.int64) + _ZERO]
        self.wide = self.chance.astype(np.uint64)
        self.unit = self.range >> _UNIT

    def narrow(self, hit: np.ndarray, start: np.ndarray, freq: np.ndarray) -> np.ndarray:
        """Narrow to the interval of a hit or of an id by order 0; where the interval began."""
        first, rest = self.wide << _UB, _WHOLE - self.wide
        begin = self.unit * np.where(hit, np.uint64(0), first + start * rest)
        self.low += begin
        self.range = self.unit * np.where(hit, first, freq * rest)
        return begin

    def learn(self, hit: np.ndarray, ids: np.ndarray) -> None:
        error = hit * np.int32(4096)
        error -= self.chance
        error >>= _RATE
        self.logits[self.state] = self.logit + error
        # a slot that fails loses its id at once if it was new, and half its standing otherwise
        ids = ids.astype(np.uint32)
        stays = np.where(self.sure > _ONE, self.held - ((self.sure + _ONE) >> _ONE), (ids << _THREE) + _ONE)
        self.slots[self.at] = np.where(self.said == ids, self.held + (self.sure < _SURE), stays)
        self.context[1] = ids * _HASH1
        np.add(self.context[1], self.before, out=self.context[0])
        self.before = ids * _HASH2

    def due(self) -> np.ndarray:
        """Lanes that must pass on 32 bits; where a carry could still come, the range is cut short."""
        i = np.flatnonzero(self.range < _DUE)
        self.range[i] = np.minimum(self.range[i], _DUE - (self.low[i] & _LOW32))
        return i

    def shift(self, i: np.ndarray) -> None:
        self.low[i] <<= _U32
        self.range[i] <<= _U32


def encode_blocks(ids: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """Payloads of the rows of ``ids`` [blocks, BLOCK]."""
    out: list[bytes] = []
    for k in range(0, len(ids), LANES):
        part = np.ascontiguousarray(ids[k : k + LANES].T).astype(np.int64)
        n = part.shape[1]
        m = _Lanes(n, freq)
        # an id takes 30 bits at most, so one word at most
        words = np.zeros((n, BLOCK + 2), np.uint32)
        filled = np.zeros(n, np.int64)
        for x in part:
            m.predict()
            hit = m.guess == x
            m.narrow(hit, m.start[x], m.freq[x])
            i = m.due()
            words[i, filled[i]] = (m.low[i] >> _U32).astype(np.uint32)
            filled[i] += 1
            m.shift(i)
            m.learn(hit, x)
        for _ in range(2):
            words[np.arange(n), filled] = (m.low >> _U32).astype(np.uint32)
            filled += 1
            m.low <<= _U32
        out += [words[i, : filled[i]].astype("<u4").tobytes() for i in range(n)]
    return out


def decode_blocks(payloads: list[bytes], freq: np.ndarray) -> np.ndarray:
    """Ids [blocks, BLOCK] of payloads; of damaged ones, some ids that their checksums tell from true ones."""
    found = np.zeros((len(payloads), BLOCK), np.uint16)
    symbol = np.repeat(np.arange(_SIZE), freq)
    for k in range(0, len(payloads), LANES):
        part = payloads[k : k + LANES]
        n = len(part)
        m = _Lanes(n, freq)
        words = np.zeros((n, BLOCK + 3), np.uint64)
        for i, p in enumerate(part):
            w = np.frombuffer(p[: 4 * (BLOCK + 2)], "<u4", len(p[: 4 * (BLOCK + 2)]) // 4)
            words[i, : len(w)] = w
        ahead = (words[:, 0] << _U32) | words[:, 1]  # the code less ``low``
        at = np.full(n, 2)
        steps = np.zeros((BLOCK, n), np.uint16)
        for t in range(BLOCK):
            m.predict()
            value = ahead // m.unit
            first = m.wide << _UB
            hit = value < first
            value -= first
            value //= _WHOLE - m.wide
            # where there is a hit the value is of no use, and of a damaged block it may be too large
            by_order0 = symbol[np.minimum(value, np.uint64(_TOTAL - 1)).view(np.int64)]
            x = np.where(hit, m.guess, by_order0)
            ahead -= m.narrow(hit, m.start[x], m.freq[x])
            i = m.due()
            m.shift(i)
            ahead[i] = (ahead[i] << _U32) | words[i, np.minimum(at[i], BLOCK + 2)]
            at[i] += 1
            m.learn(hit, x)
            steps[t] = x
        found[k : k + n] = steps.T
    return found


# files --------------------------------------------------------------------------------------------
# magic, then (u32 length, u32 crc32) and bytes of: the order-0 table, the documents, the block index;
# then the payloads. The table is (u16 id, u32 frequency) of ids that occur; documents are (i64 id, u8
# null, u32 n); the index is (u32 bytes, u32 crc32 of the block's ids, u32 ids) of each block.
MAGIC = b"TSRC\x02"
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
_FREQ = np.dtype([("id", "<u2"), ("freq", "<u4")])
_INDEX = np.dtype([("size", "<u4"), ("crc", "<u4"), ("n", "<u4")])


def pack(documents: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents (``_DOC``) and all their ids in a row; ids are below 65536."""
    if len(ids) and ids.max() >= _SIZE:
        raise ValueError("ids must be below 65536")
    freq = order0(ids)
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint16)
    padded[: len(ids)] = ids
    padded = padded.reshape(blocks, BLOCK)
    payloads = encode_blocks(padded, freq) if blocks else []
    index = np.zeros(blocks, _INDEX)
    for i, p in enumerate(payloads):
        n = min(BLOCK, len(ids) - i * BLOCK)
        index[i] = len(p), zlib.crc32(padded[i, :n].astype("<u4").tobytes()), n
    table = np.zeros(int((freq > 0).sum()), _FREQ)
    table["id"], table["freq"] = np.flatnonzero(freq), freq[freq > 0]
    head = b"".join(len(s).to_bytes(4, "little") + zlib.crc32(s).to_bytes(4, "little") + s for s in (table.tobytes(), documents.tobytes(), index.tobytes()))
    return MAGIC + head + b"".join(payloads)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and ids of a file; a wrong checksum or length raises ValueError."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at, parts = len(MAGIC), []
    for _ in range(3):
        size, crc = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        part = data[at + 8 : at + 8 + size]
        if len(part) != size or zlib.crc32(part) != crc:
            raise ValueError("damaged header")
        parts.append(part)
        at += 8 + size
    freq = np.zeros(_SIZE, np.int64)
    table = np.frombuffer(parts[0], _FREQ)
    freq[table["id"]] = table["freq"]
    documents, index = np.frombuffer(parts[1], _DOC), np.frombuffer(parts[2], _INDEX)
    payloads = []
    for size in index["size"].tolist():
        payloads.append(data[at : at + size])
        if len(payloads[-1]) != size:
            raise ValueError("file too short")
        at += size
    rows = decode_blocks(payloads, freq) if payloads else np.zeros((0, BLOCK), np.uint16)
    for i, (row, entry) in enumerate(zip(rows, index)):
        if zlib.crc32(row[: entry["n"]].astype("<u4").tobytes()) != entry["crc"]:
            raise ValueError(f"damaged block {i}")
    return documents, rows.reshape(-1)[: int(index["n"].sum())]
