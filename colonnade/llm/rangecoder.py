"""An adaptive context-mixing range coder for ids, run over many blocks in step.

Each block is reset: it starts with empty models and can be decoded alone. A
block is cut into up to LANES runs of ids, each with a range coder of its own;
all lanes of all blocks of a call are elements of numpy arrays, so that one step
codes one id in every lane. The lanes of a block share its models. For each id

- order 2 (the id last seen after these two) and order 1 (the id last seen after
  this one) each give a candidate with a confidence; order 0 gives the share of
  the order-2 candidate among the block's ids so far;
- one coding step tells whether the id is the order-2 candidate, or else the
  order-1 candidate, or neither. Its probabilities are mixed: the estimates by
  each order are stretched, weighted and squashed (weights learn by the error),
  and what was counted in the joint context is added to that;
- else order 0 codes the id by its frequency in the block so far; ids without a
  share there are escaped and coded plainly.

Estimates, weights and frequencies are brought up to date at set steps, from the
counts of all lanes since then. Where lanes of a block meet in a context, the
last one's id stays. All model arithmetic is on integers, so that every machine
gets the same bits.

payload: u32 ids of the alphabet, u32 lanes, u32 words of each lane, the lanes'
words (u16).
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LANES, LEAST_STEPS = 256, 64
LEAST, HALF = U(1 << 48), U(16)
SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
ONE_BITS, TWO_BITS = 15, 16
#: joint contexts: share of order 0 (8), orders agree (2), confidence of order 1 (8) and of order 2 (8)
SHAPE, JOINT = (8, 2, 8, 8), 1024
LEARNED = {1, 2, 4, 8, 16, 32, *range(64, 1 << 20, 64)}
REBUILT = {4, 16, 64, 128, 256, 384, 512, 768, *range(1024, 1 << 20, 512)}
_KNOTS = np.array([1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4022, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094], np.int64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(-2047, 2048)
    w, k = x & 127, (x >> 7) + 16
    squash = (_KNOTS[k] * (128 - w) + _KNOTS[np.minimum(k + 1, 32)] * w + 64) >> 7
    stretch = np.searchsorted(squash, np.arange(4096)) - 2047
    return squash.astype(np.int64), np.clip(stretch, -2047, 2047).astype(np.int64)


SQUASH, STRETCH = _tables()


class Encoder:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
        self.out, self.pos = np.zeros((lanes, 256), np.uint16), np.zeros(lanes, np.int64)

    def carry(self, lane: np.ndarray) -> None:
        """Adds one to what the lanes have written."""
        pos = self.pos[lane] - 1
        while len(lane):
            self.out[lane, pos] += np.uint16(1)
            more = self.out[lane, pos] == 0
            lane, pos = lane[more], pos[more] - 1

    def choose(self, two: np.ndarray, either: np.ndarray, is_two: np.ndarray, is_either: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = self.range >> HALF
        two, either = unit * two, unit * either
        base = np.where(is_either, two, either)
        base[is_two] = 0
        top = np.where(is_either, either, unit << HALF)
        np.copyto(top, two, where=is_two)
        self.range = top - base
        low = self.low + base
        over = np.flatnonzero(low < base)
        self.low = low
        if len(over):
            self.carry(over)
        return is_two, is_either

    def part(self, lane: np.ndarray, bits: int, cum: np.ndarray, size: np.ndarray) -> None:
        unit = self.range[lane] >> U(bits)
        base = unit * cum.astype(U)
        low = self.low[lane] + base
        self.low[lane], self.range[lane] = low, unit * size.astype(U)
        over = low < base
        if over.any():
            self.carry(lane[over])

    def shift(self) -> None:
        lane = np.flatnonzero(self.range < LEAST)
        while len(lane):
            pos, low = self.pos[lane], self.low[lane]
            if int(pos.max()) + 2 >= self.out.shape[1]:
                self.out = np.concatenate([self.out, np.zeros_like(self.out)], 1)
            self.out[lane, pos] = (low >> U(48)).astype(np.uint16)
            self.pos[lane] = pos + 1
            self.low[lane] = low << HALF
            wide = self.range[lane] << HALF
            self.range[lane] = wide
            lane = lane[wide < LEAST]

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Each lane's words and their number; the last word names the one multiple of 2^48 in its interval."""
        last = (self.low + (LEAST - U(1))) >> U(48)
        over = np.flatnonzero(self.low + (LEAST - U(1)) < self.low)
        lane = np.arange(len(self.pos))
        self.carry(over)
        if int(self.pos.max(initial=0)) + 1 >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], 1)
        self.out[lane, self.pos] = last.astype(np.uint16)
        return self.out, self.pos + 1


class Decoder:
    def __init__(self, words: np.ndarray):
        """words: each lane's, followed by zeros, four at least."""
        self.words, self.width = words.reshape(-1), words.shape[1]
        self.base = np.arange(len(words)) * self.width
        first = words[:, :4].astype(U)
        self.value = first[:, 0] << U(48) | first[:, 1] << U(32) | first[:, 2] << U(16) | first[:, 3]
        self.pos, self.range = np.full(len(words), 4), np.full(len(words), 0xFFFFFFFFFFFFFFFF, U)

    def choose(self, two: np.ndarray, either: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = self.range >> HALF
        two, either = unit * two, unit * either
        is_two, is_either = self.value < two, self.value < either
        base = np.where(is_either, two, either)
        base[is_two] = 0
        top = np.where(is_either, either, unit << HALF)
        np.copyto(top, two, where=is_two)
        self.range = top - base
        self.value -= base
        return is_two, is_either

    def slot(self, lane: np.ndarray, bits: int) -> np.ndarray:
        self.unit = self.range[lane] >> U(bits)
        return np.minimum(self.value[lane] // self.unit, U((1 << bits) - 1)).astype(np.int64)

    def part(self, lane: np.ndarray, cum: np.ndarray, size: np.ndarray) -> None:
        self.value[lane] -= self.unit * cum.astype(U)
        self.range[lane] = self.unit * size.astype(U)

    def shift(self) -> None:
        lane = np.flatnonzero(self.range < LEAST)
        while len(lane):
            pos = np.minimum(self.pos[lane], self.width - 1)
            self.value[lane] = (self.value[lane] << HALF) | self.words[self.base[lane] + pos]
            self.pos[lane] = pos + 1
            wide = self.range[lane] << HALF
            self.range[lane] = wide
            lane = lane[wide < LEAST]


class Mixer:
    """Probabilities (of 65536) of one outcome in each joint context of each block."""

    def __init__(self, blocks: int):
        self.hits, self.total = np.zeros((blocks, *SHAPE), np.int64), np.zeros((blocks, *SHAPE), np.int64)
        self.weights = np.full((4, blocks, 1, 1, 1, 1), 1 << 14, np.int64)

    def learn(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        self.hits += hits
        self.total += total
        # the estimates by order 0, by both candidates' agreement, and by the confidences of orders 1 and 2
        by = []
        for axis in range(1, 5):
            others = tuple(a for a in range(1, 5) if a != axis)
            p = (self.hits.sum(others, keepdims=True) * 4095 + 1024) // (self.total.sum(others, keepdims=True) + 1)
            by.append(STRETCH[np.clip(p, 1, 4094)])
        mix = sum(w * s for w, s in zip(self.weights, by)) >> 16
        p = SQUASH[np.clip(mix, -2047, 2047) + 2047]
        error, n = hits * 4096 - total * p, total.sum((1, 2, 3, 4), keepdims=True) + 1
        for k, s in enumerate(by):
            self.weights[k] += (error * s).sum((1, 2, 3, 4), keepdims=True) // n >> 8
        np.clip(self.weights, -(1 << 18), 1 << 18, out=self.weights)
        # the mix counts as much as MIXED events of the joint context itself
        return (self.hits * 65536 + p * 16 * 24) // (self.total + 24)


def _run(coder: Encoder | Decoder, blocks: int, lanes: int, steps: int, vocab: int, ids: np.ndarray | None) -> np.ndarray:
    """Codes ids (steps x all lanes), or decodes and returns them."""
    out = ids if ids is not None else np.zeros((steps, blocks * lanes), np.int64)
    block = np.repeat(np.arange(blocks), lanes)
    at1, at2, at_joint, at_id, at_slot = block << ONE_BITS, block << TWO_BITS, (block * JOINT).astype(np.int32), block * (vocab + 1), block << SLOT_BITS
    one, two = np.zeros(blocks << ONE_BITS, np.int32), np.zeros(blocks << TWO_BITS, np.int32)  # id << 3 | confidence
    mixers = Mixer(blocks), Mixer(blocks)
    p_two = np.full(blocks * JOINT, 1 << 12, U)
    p_either = p_two + p_two
    width = vocab + 1
    counts = np.zeros(blocks * width, np.int64)
    escape = np.arange(blocks) * width + vocab
    flat_size, flat_cum, share = np.zeros(blocks * width, np.int32), np.zeros(blocks * width, np.int32), np.zeros(blocks * width, np.int32)
    flat_size[escape] = SLOTS
    of_slot = np.full(blocks << SLOT_BITS, vocab, np.int32)
    events = np.zeros((64, blocks * lanes), np.int32)
    seen = counted = 0
    p1, p2 = np.zeros(blocks * lanes, np.int64), np.zeros(blocks * lanes, np.int64)
    for t in range(steps):
        if t in REBUILT:
            counts += np.bincount((out[counted:t] + at_id).ravel(), minlength=len(counts))
            counted = t
            used = np.flatnonzero(counts)
            size = counts[used] * (SLOTS - SLOTS // 16) // (t * lanes)
            share[used] = np.minimum(np.frexp(size.astype(np.float32))[1], 7) << 7
            flat_size[used] = size
            flat_size[escape] = SLOTS - np.add.reduceat(flat_size, escape - vocab) + flat_size[escape]
            used = np.flatnonzero(flat_size)
            size = flat_size[used]
            # the sizes of a block add up to SLOTS
            flat_cum[used] = np.cumsum(size) - size - (used // width << SLOT_BITS)
            of_slot = np.repeat((used % width).astype(np.int32), size)
        if t in LEARNED:
            met = np.bincount(events[: t - seen].ravel(), minlength=blocks * JOINT * 4).reshape(blocks, *SHAPE, 4)
            seen = t
            total = met.sum(-1)
            a = mixers[0].learn(met[..., 3], total)
            b = mixers[1].learn(met[..., 1], total - met[..., 3])
            b[:, :, 1] = 0  # where the orders agree there is no other candidate
            a = np.clip(a, 32, 65536 - 96)
            p_two = a.reshape(-1).astype(U)
            b = np.clip((65536 - a) * b >> 16, 16, 65536 - 32 - a)
            b[:, :, 1] = 0
            p_either = (a + b).reshape(-1).astype(U)
        s1 = at1 + (p1 & (1 << ONE_BITS) - 1)
        s2 = at2 + ((p1 * 40503 + p2 * 30011 >> 3) & (1 << TWO_BITS) - 1)
        e1, e2 = one.take(s1), two.take(s2)
        c1, c2, k1, k2 = e1 >> 3, e2 >> 3, e1 & 7, e2 & 7
        joint = share.take(at_id + c2) | (c1 == c2).view(np.int8).astype(np.int32) << 6
        joint |= k1 << 3
        joint |= k2
        joint += at_joint
        if ids is not None:
            got = ids[t]
            is_two = got == c2
            is_two, is_either = coder.choose(p_two.take(joint), p_either.take(joint), is_two, is_two | (got == c1))
        else:
            is_two, is_either = coder.choose(p_two.take(joint), p_either.take(joint))
            got = np.where(is_two, c2, c1).astype(np.int64)
        lit = np.flatnonzero(~is_either)
        if len(lit):
            base = at_id[lit]
            if ids is not None:
                want = got[lit]
                n = flat_size.take(base + want)
                gone = np.flatnonzero(n == 0)
                where = base + want
                where[gone] = base[gone] + vocab
                coder.part(lit, SLOT_BITS, flat_cum.take(where), flat_size.take(where))
                if len(gone):
                    coder.part(lit[gone], 16, want[gone], np.ones(len(gone), np.int64))
            else:
                want = of_slot.take(at_slot[lit] + coder.slot(lit, SLOT_BITS)).astype(np.int64)
                where = base + want
                coder.part(lit, flat_cum.take(where), flat_size.take(where))
                gone = np.flatnonzero(want == vocab)
                if len(gone):
                    plain = np.minimum(coder.slot(lit[gone], 16), vocab - 1)
                    coder.part(lit[gone], plain, np.ones(len(gone), np.int64))
                    want[gone] = plain
                got[lit] = want
        coder.shift()
        if ids is None:
            out[t] = got
        joint <<= 2
        joint += is_two
        joint += is_either
        # 1: the order-1 candidate; 3: the order-2 candidate
        joint += is_two
        events[t - seen] = joint
        fresh = got.astype(np.int32) << 3
        one[s1] = np.where(c1 == got, e1 + (k1 < 7), fresh)
        two[s2] = np.where(is_two, e2 + (k2 < 7), fresh)
        p2, p1 = p1, got
    return out


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = min(LANES, max(1, -(-n // LEAST_STEPS)))
    return lanes, -(-n // lanes)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """ids (blocks x ids, each under 65536) -> one payload for each block."""
    blocks, n = ids.shape
    lanes, steps = _shape(n)
    vocab = int(ids.max(initial=0)) + 1
    padded = np.zeros((blocks, lanes * steps), np.int64)
    padded[:, :n] = ids
    coder = Encoder(blocks * lanes)
    _run(coder, blocks, lanes, steps, vocab, np.ascontiguousarray(padded.reshape(blocks * lanes, steps).T))
    words, size = coder.finish()
    out = []
    for k in range(blocks):
        rows = slice(k * lanes, (k + 1) * lanes)
        inside = np.arange(words.shape[1])[None, :] < size[rows, None]
        out.append(np.array([vocab, lanes], "<u4").tobytes() + size[rows].astype("<u4").tobytes() + words[rows][inside].astype("<u2").tobytes())
    return out


def decode_blocks(payloads: list[bytes], n: int) -> np.ndarray:
    """The ids (blocks x n) of payloads of one shape."""
    lanes, steps = _shape(n)
    heads = [np.frombuffer(p, "<u4", 2 + lanes) for p in payloads]
    size = np.array([h[2:] for h in heads], np.int64).reshape(-1)
    words = np.zeros((len(size), int(size.max(initial=0)) + 5), np.uint16)
    words[np.arange(words.shape[1])[None, :] < size[:, None]] = np.concatenate([np.frombuffer(p, "<u2", offset=8 + 4 * lanes) for p in payloads])
    out = _run(Decoder(words), len(payloads), lanes, steps, max(int(h[0]) for h in heads), None)
    return np.ascontiguousarray(out.T).reshape(len(payloads), lanes * steps)[:, :n]
