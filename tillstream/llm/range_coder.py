"""An adaptive context-mixing range coder for token ids, in numpy, over many blocks at once.

Blocks are independent: each starts from an empty model and can be decoded alone. Step t codes id t
of all blocks of a group, so that the sequential work of a coder becomes array operations over blocks;
encoder and decoder run the same integer model. Per block:

- order 2 and order 1: hashed slots hold the id that last followed the context, with a confidence.
  The surer of the two predicts the next id; two adaptive bit models (by both confidences; by the
  predicting context) are mixed with a weight that moves to the better one, and code whether the
  prediction holds;
- order 0: if it does not, the id's high byte is coded with adaptive frequencies and its low byte
  with those of its group of high bytes; frequencies are taken over every REBUILD ids.

The coder keeps 48-bit low and range and puts out 16-bit words; where low and high would straddle a
word with too small a range, the range is cut, so no carry ever runs back.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
REBUILD = 256
SLOTS = 1 << 11
GROUPS = 16
FLAG_BITS, BYTE_BITS = 12, 14
TOP, LEAST = np.uint64((1 << 48) - 1), np.uint64(1 << 32)
U64 = np.uint64
_S16, _S32 = U64(16), U64(32)


class _Model:
    def __init__(self, n: int):
        self.n, self.lane = n, np.arange(n)
        self.t2, self.t1 = np.zeros(n * SLOTS, np.int32), np.zeros(n * SLOTS, np.int32)
        self.pa, self.pb = np.full(n * 64, 1024, np.int32), np.full(n * 512, 1024, np.int32)
        self.w = np.full(n, 32, np.int32)
        self.high, self.low = np.ones((n, 256), np.int32), np.ones((n, GROUPS * 256), np.int32)
        self.a, self.b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.slot, self.row16 = self.lane * SLOTS, self.lane * GROUPS
        self.rebuild()

    def rebuild(self) -> None:
        """Cumulative frequencies out of 2**BYTE_BITS, at least 1 each."""
        room = (1 << BYTE_BITS) - 256

        def cumulative(c: np.ndarray) -> np.ndarray:
            c = c.reshape(-1, 256)
            run = np.zeros((len(c), 257), np.int32)
            np.cumsum(c, axis=1, out=run[:, 1:])
            last = run[:, 256:].copy()
            run *= room  # a block's counts stay below 2**31 / room
            run //= last
            run += np.arange(257, dtype=np.int32)
            return run.reshape(-1)

        self.cum_high, self.cum_low = cumulative(self.high), cumulative(self.low)

    def predict(self) -> None:
        self.i2 = self.slot + (((self.a * 40503 + self.b * 30011) >> 4) & (SLOTS - 1))
        self.i1 = self.slot + ((self.b * 40503 >> 4) & (SLOTS - 1))
        e2, e1 = self.t2[self.i2], self.t1[self.i1]
        self.e2, self.e1 = e2, e1
        self.id2, self.c2, self.id1, self.c1 = e2 >> 3, e2 & 7, e1 >> 3, e1 & 7
        use2 = self.c2 >= self.c1
        self.guess = np.where(use2, self.id2, self.id1)
        self.ia = self.lane * 64 + self.c2 * 8 + self.c1
        self.ib = self.lane * 512 + (self.b & 127) * 4 + use2 * 2 + (self.id1 == self.id2)
        self.va, self.vb = a, b = self.pa[self.ia], self.pb[self.ib]
        self.p = np.clip((self.w * a + (64 - self.w) * b) >> 6, 32, 4096 - 32)

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        want = np.where(hit, 4096, 0).astype(np.int32)
        a, b = self.va, self.vb
        better = np.abs(want - a) < np.abs(want - b)
        self.w = np.minimum(np.maximum(self.w + (better * 2 - 1), 2), 62)
        self.pa[self.ia] = a + ((want - a) >> 4)
        self.pb[self.ib] = b + ((want - b) >> 4)
        fresh = ids << 3 | 1
        for table, at, e, old, c in ((self.t2, self.i2, self.e2, self.id2, self.c2), (self.t1, self.i1, self.e1, self.id1, self.c1)):
            # right: surer, up to 7; wrong: less sure, and replaced at the least confidence
            table[at] = np.where(old == ids, e + (c < 7), np.where(c > 1, e - 1, fresh))
        hi, lo = ids >> 8, ids & 255
        self.high[self.lane, hi] += 24
        self.low[self.lane, (hi & (GROUPS - 1)) * 256 + lo] += 24
        self.a, self.b = self.b, ids


def _shift(low: np.ndarray, rng: np.ndarray):
    """Which blocks put out (or take in) a word now, and the range after cutting; None if no block does."""
    settled = ((low ^ (low + rng)) >> _S32) == 0
    small = rng < LEAST
    go = settled | small
    if not go.any():
        return None
    cut = small & ~settled
    if cut.any():
        rng = np.where(cut, (LEAST - (low & (LEAST - U64(1)))) & TOP, rng)
    return go, rng


def encode(blocks: np.ndarray) -> list[bytes]:
    """Rows of ids below 65,536, all of one length; the coded words of each row."""
    n, steps = blocks.shape
    m = _Model(n)
    low, rng = np.zeros(n, np.uint64), np.full(n, TOP, np.uint64)
    width = steps * 5 + 16
    out, pos, base = np.zeros(n * width, np.uint16), np.zeros(n, np.int64), np.arange(n) * width

    def step(cum: np.ndarray, freq: np.ndarray, bits: int) -> None:
        nonlocal low, rng
        r = rng >> U64(bits)
        low = low + r * cum.astype(np.uint64)
        rng = r * freq.astype(np.uint64)

    def renew() -> None:
        nonlocal low, rng, pos
        while (s := _shift(low, rng)) is not None:
            go, rng = s
            out[base + pos] = (low >> _S32).astype(np.uint16)
            low = np.where(go, (low << _S16) & TOP, low)
            rng = np.where(go, (rng << _S16) & TOP, rng)
            pos = pos + go

    columns = np.ascontiguousarray(blocks.T).astype(np.int64)
    for t in range(steps):
        ids = columns[t]
        m.predict()
        hit = m.guess == ids
        step(np.where(hit, 0, m.p), np.where(hit, m.p, 4096 - m.p), FLAG_BITS)
        hi, lo = ids >> 8, ids & 255
        at = m.lane * 257 + hi
        c = m.cum_high[at]
        step(np.where(hit, 0, c), np.where(hit, 1 << BYTE_BITS, m.cum_high[at + 1] - c), BYTE_BITS)
        renew()
        at = (m.row16 + (hi & (GROUPS - 1))) * 257 + lo
        c = m.cum_low[at]
        step(np.where(hit, 0, c), np.where(hit, 1 << BYTE_BITS, m.cum_low[at + 1] - c), BYTE_BITS)
        renew()
        m.update(ids, hit)
        if t % REBUILD == REBUILD - 1:
            m.rebuild()
    for _ in range(3):
        out[base + pos] = (low >> _S32).astype(np.uint16)
        low, pos = (low << _S16) & TOP, pos + 1
    rows = out.reshape(n, width).astype("<u2")
    return [rows[i, :k].tobytes() for i, k in enumerate(pos.tolist())]


def decode(coded: list[bytes], steps: int) -> np.ndarray:
    """The first `steps` ids of each row."""
    n = len(coded)
    m = _Model(n)
    width = max(len(x) // 2 for x in coded) + 8
    words = np.zeros((n, width), np.uint64)
    for i, x in enumerate(coded):
        words[i, : len(x) // 2] = np.frombuffer(x, "<u2")
    words, base = words.reshape(-1), np.arange(n) * width
    low, rng = np.zeros(n, np.uint64), np.full(n, TOP, np.uint64)
    code = words[base] << _S32 | words[base + 1] << _S16 | words[base + 2]
    pos, last = np.full(n, 3, np.int64), width - 1

    def renew() -> None:
        nonlocal low, rng, code, pos
        while (s := _shift(low, rng)) is not None:
            go, rng = s
            nxt = words[base + np.minimum(pos, last)]
            low = np.where(go, (low << _S16) & TOP, low)
            code = np.where(go, ((code << _S16) & TOP) | nxt, code)
            rng = np.where(go, (rng << _S16) & TOP, rng)
            pos = pos + go

    def target(bits: int) -> tuple[np.ndarray, np.ndarray]:
        r = rng >> U64(bits)
        return r, np.minimum(((code - low) & TOP) // r, U64((1 << bits) - 1)).astype(np.int64)

    def search(cum: np.ndarray, row: np.ndarray, v: np.ndarray) -> np.ndarray:
        at = np.zeros(n, np.int64)
        for k in (128, 64, 32, 16, 8, 4, 2, 1):
            at = np.where(cum[row + at + k] <= v, at + k, at)
        return at

    out = np.zeros((steps, n), np.int64)
    for t in range(steps):
        m.predict()
        r, v = target(FLAG_BITS)
        hit = v < m.p
        low = low + r * np.where(hit, 0, m.p).astype(np.uint64)
        rng = r * np.where(hit, m.p, 4096 - m.p).astype(np.uint64)
        r, v = target(BYTE_BITS)
        row = m.lane * 257
        hi = search(m.cum_high, row, v)
        c = m.cum_high[row + hi]
        low = low + r * np.where(hit, 0, c).astype(np.uint64)
        rng = r * np.where(hit, 1 << BYTE_BITS, m.cum_high[row + hi + 1] - c).astype(np.uint64)
        renew()
        hi = np.where(hit, m.guess >> 8, hi)
        r, v = target(BYTE_BITS)
        row = (m.row16 + (hi & (GROUPS - 1))) * 257
        lo = search(m.cum_low, row, v)
        c = m.cum_low[row + lo]
        low = low + r * np.where(hit, 0, c).astype(np.uint64)
        rng = r * np.where(hit, 1 << BYTE_BITS, m.cum_low[row + lo + 1] - c).astype(np.uint64)
        renew()
        ids = np.where(hit, m.guess, hi << 8 | lo).astype(np.int64)
        out[t] = ids
        m.update(ids, hit)
        if t % REBUILD == REBUILD - 1:
            m.rebuild()
    return out.T
