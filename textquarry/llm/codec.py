"""Context-mixing range coder for token ids, many rows in step, with predictions fitted to each group of rows.

The rows of a group share one model, which its payload carries:
* order 2 and order 1: the id that most often follows the last two ids (by a hash of them) and the last one, each with a
  level of confidence, from its share of what follows there;
* order 0: the frequencies of the ids that neither foretells;
* the mix: for each pair of levels, how much of the range the surer guess, the other one and order 0 get.
What the mix gives to order 0 does not depend on which id order 0 names, so an id is coded in two moves: which of the
three foretold it, and, if order 0 did, which id it is. The second moves need no context: they are one sequence, dealt
out to rows of their own and coded apart. Rows are coded from empty contexts, all of a group together, one id of each at
a time, by array operations. The range coder keeps 64 bits of state, moves 32 bits at a time and carries into words that
have left; words stand in the order in which the decoder takes them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

MOST_IDS = 4096
CHUNK = 1 << 16  # ids that are compared with their guesses at a time
U = np.uint64
MIX_BITS = 12
MOST_BITS = 18  # of order 0; fewer than the 32 bits that the range has at least
_WORD, _LOW_WORD, _LEAST = U(32), U((1 << 32) - 1), U(1 << 32)
_SLOTS = 1 << 16  # of order 1, one for each id, and of order 2
_MUL_LAST, _MUL_BEFORE, _HALF, _ID = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(16), np.uint32(0xFFFF)
#: A guess reaches a level with so large a share of what follows; level 0 is no guess.
_SHARES = np.array([0.02, 0.06, 0.12, 0.25, 0.45, 0.7, 0.92])
_LEVELS = len(_SHARES) + 1
_WORTH = 8  # times that an id must follow for its place in the model to be worth it
_KINDS = 2 * _LEVELS * _LEVELS
_REST_LANES, _REST_STEPS = 4096, 64  # rows of what order 0 names, at most, and how long they are before there are more


def _guesses(pairs: np.ndarray) -> np.ndarray:
    """For each context its most frequent id, with the level above it, level << 16 | id; from sorted context << 16 | id."""
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    times, pairs = np.diff(first, append=len(pairs)), pairs[first]
    slots = pairs >> _HALF
    head = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    best = np.maximum.reduceat(times << 16 | (pairs & _ID), head)
    total = np.add.reduceat(times, head)
    level = np.searchsorted(_SHARES, ((best >> 16) - 1) / total, side="right") * (best >> 16 >= _WORTH)
    out = np.zeros(_SLOTS, np.uint32)
    out[slots[head]] = (level << 16 | (best & 0xFFFF)) * (level > 0)
    return out


class _Model:
    """Predictions of three orders and how they are mixed."""

    def __init__(self, one: np.ndarray, two: np.ndarray, faith: np.ndarray, bits: int, counts: np.ndarray):
        self.one, self.two, self.faith, self.bits, self.counts = one, two, faith, bits, counts
        first, both = faith.astype(U)
        self.first, self.both = first, both
        #: by move << 7 | kind of mix, for the moves hit, second guess, order 0
        self.begin = np.concatenate([np.zeros(_KINDS, U), first, both])
        self.share = np.concatenate([first, both - first, U(1 << MIX_BITS) - both])
        ends = np.cumsum(counts.astype(np.int64))
        self.place = (ends - counts).astype(U) << _WORD | counts.astype(U)

    @staticmethod
    def fitted(flat: np.ndarray, lanes: int) -> tuple[_Model, np.ndarray, np.ndarray]:
        """The model of ids by steps after two empty steps; for each id its move and kind of mix; ids left to order 0."""
        n = len(flat) - 2 * lanes
        now, last, before = flat[2 * lanes :], flat[lanes : lanes + n], flat[:n]
        pairs, slot = np.empty(n, np.uint32), np.empty(n, np.uint16)
        parts = [slice(a, a + CHUNK) for a in range(0, n, CHUNK)]
        for s in parts:
            context = last[s].astype(np.uint32)
            slot[s] = (context * _MUL_LAST + before[s].astype(np.uint32) * _MUL_BEFORE) >> _HALF
            pairs[s] = context << _HALF | now[s]
        pairs.sort()
        one = _guesses(pairs)
        for s in parts:
            pairs[s] = slot[s].astype(np.uint32) << _HALF | now[s]
        pairs.sort()
        two = _guesses(pairs)
        moves, rest = slot, []  # a slot is read before its place is used again
        seen = np.zeros(3 * _KINDS, np.int64)
        for s in parts:
            these = now[s]
            sure, other, kind = _ranked(one.take(last[s]), two.take(slot[s]))
            miss = sure.astype(np.uint16) != these
            left = miss & (other.astype(np.uint16) != these)
            kind += (miss.view(np.uint8) + left.view(np.uint8)).astype(np.uint32) * np.uint32(_KINDS)
            moves[s] = kind
            seen += np.bincount(kind, minlength=3 * _KINDS)
            rest.append(these[left])
        named = np.concatenate([np.zeros(0, np.uint16), *rest])
        others = sum((np.bincount(named[a : a + 8 * CHUNK], minlength=1 << 16) for a in range(0, len(named), 8 * CHUNK)), np.zeros(1 << 16, np.int64))
        hits_1, hits_2, _ = seen.reshape(3, _KINDS)
        whole, share = 1 << MIX_BITS, np.maximum(seen.reshape(3, _KINDS).sum(axis=0), 1)
        first = np.clip((hits_1 * whole + share // 2) // share, hits_1 > 0, whole - 2)
        both = first + np.minimum(np.maximum((hits_2 * whole + share // 2) // share, hits_2 > 0), whole - 1 - first)
        kinds, total = int((others > 0).sum()), max(1, int(others.sum()))
        bits = min(MOST_BITS, max(1, kinds).bit_length() + 4)
        counts = np.where(others > 0, 1 + others * ((1 << bits) - kinds) // total, 0)
        if kinds:
            counts[counts.argmax()] += (1 << bits) - counts.sum()
        model = _Model(one, two, np.stack([first, both]).astype("<u2"), bits, counts.astype("<u4"))
        return model, moves, named

    def packed(self) -> bytes:
        parts = [self.one & 0xFFFF, self.one >> 16, self.two & 0xFFFF, self.two >> 16, self.faith, self.counts & 0xFFFF, self.counts >> 16]
        kinds = ["<u2", "u1", "<u2", "u1", "<u2", "<u2", "u1"]
        return bytes([self.bits]) + zlib.compress(b"".join(p.astype(k).tobytes() for p, k in zip(parts, kinds, strict=True)), 1)

    @staticmethod
    def unpacked(raw: bytes) -> _Model:
        data, at, got = zlib.decompress(raw[1:]), 0, []
        for kind, n in (("<u2", _SLOTS), ("u1", _SLOTS), ("<u2", _SLOTS), ("u1", _SLOTS), ("<u2", 2 * _KINDS), ("<u2", 1 << 16), ("u1", 1 << 16)):
            got.append(np.frombuffer(data, kind, n, at))
            at += got[-1].nbytes
        one, two, counts = (got[i].astype(np.uint32) | got[i + 1].astype(np.uint32) << _HALF for i in (0, 2, 5))
        return _Model(one, two, got[4].reshape(2, _KINDS), raw[0], counts)


def _ranked(entry_1: np.ndarray, entry_2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The surer entry, the other one, and the kind of mix for their levels."""
    sure, other = np.maximum(entry_1, entry_2), np.minimum(entry_1, entry_2)
    kind = ((sure >> _HALF) * np.uint32(_LEVELS) + (other >> _HALF)) << np.uint32(1)
    kind |= sure.astype(np.uint16) == other.astype(np.uint16)
    return sure, other, kind


def _written(lanes: int, steps: int, bits: int, spans: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The words of `lanes` rows whose part of the range, of 1 << bits, in each step `spans` tells: begin and share."""
    most = lanes * (steps + 3)  # a step moves one word of a row at most; two end it, and one that is not kept is before them
    words, before = np.empty(most, "<u4"), np.empty(most, np.int64)  # in the order in which they leave, and where the row's last one is
    newest, n, shift, pause = np.arange(lanes), lanes, U(bits), _pause(bits)
    low, size = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    for t in range(steps):
        begin, share = spans(t)
        size >>= shift
        begin *= size
        size *= share
        low += begin
        over = np.flatnonzero(low < begin)
        if len(over):
            place = newest.take(over)
            while len(place):
                words[place] += np.uint32(1)
                place = before[place[words[place] == 0]]
        if t % pause == pause - 1:
            busy = np.flatnonzero(size < _LEAST)
            if len(busy):
                some, end = low.take(busy, mode="clip"), n + len(busy)
                words[n:end] = some >> _WORD
                before[n:end] = newest.take(busy, mode="clip")
                newest[busy] = np.arange(n, end)
                size[busy] = size.take(busy, mode="clip") << _WORD
                low[busy] = some << _WORD
                n = end
    left = n
    for word in (low >> _WORD, low & _LOW_WORD):
        words[n : n + lanes], before[n : n + lanes] = word, newest
        newest = np.arange(n, n + lanes)
        n += lanes
    # a row that moves a word out in the encoder takes in the one after the next in the decoder
    after = np.empty(n, np.int64)
    after[before[lanes:n]] = np.arange(lanes, n)
    return words.take(np.concatenate([after[:lanes], after.take(after[:left])]))


def _pause(bits: int) -> int:
    """Steps after which a range of 32 bits must have more again."""
    return max(1, int(_WORD) // bits)


def _taken(words: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Where rows stand in the range at first, and how large it is."""
    return words[:lanes].astype(U) << _WORD | words[lanes : 2 * lanes], np.full(lanes, (1 << 64) - 1, U)


def _refilled(value: np.ndarray, size: np.ndarray, words: np.ndarray, at: int) -> int:
    """Moves a word into the rows whose range is small; where the next one is."""
    busy = np.flatnonzero(size < _LEAST)
    if len(busy):
        value[busy] = value.take(busy, mode="clip") << _WORD | words[at : at + len(busy)]
        size[busy] = size.take(busy, mode="clip") << _WORD
    return at + len(busy)


def _rest_shape(n: int) -> tuple[int, int]:
    """Rows and steps for n ids of order 0."""
    lanes = min(_REST_LANES, -(-n // _REST_STEPS))
    return lanes, -(-n // max(1, lanes))


def encode(blocks: np.ndarray) -> bytes:
    """The payload of rows of ids (below 2 ** 16, at most MOST_IDS columns)."""
    if blocks.size and (blocks.min() < 0 or blocks.max() >= 1 << 16 or blocks.shape[1] > MOST_IDS):
        raise ValueError("ids must be under 65536, blocks at most 4096 ids long")
    lanes, steps = blocks.shape
    if not blocks.size:
        return np.array([lanes, 0, 0, 0], "<u4").tobytes()
    by_step = np.zeros((steps + 2, lanes), np.uint16)
    for a in range(0, lanes, 64):
        by_step[2:, a : a + 64] = blocks[a : a + 64].T
    model, moves, rest = _Model.fitted(by_step.ravel(), lanes)
    moves = moves.reshape(steps, lanes)

    def move(t: int) -> tuple[np.ndarray, np.ndarray]:
        at = moves[t].astype(np.intp)
        return model.begin.take(at, mode="clip"), model.share.take(at, mode="clip")

    def named(t: int) -> tuple[np.ndarray, np.ndarray]:
        place = model.place.take(of_step[t], mode="clip")
        return place >> _WORD, place & _LOW_WORD

    head, first = model.packed(), _written(lanes, steps, MIX_BITS, move)
    rows, length = _rest_shape(len(rest))
    of_step = np.concatenate([rest, rest[-1:].repeat(rows * length - len(rest))]).reshape(length, rows)
    second = _written(rows, length, model.bits, named)
    return np.array([lanes, len(rest), len(head), len(first)], "<u4").tobytes() + head + first.tobytes() + second.tobytes()


def _named(model: _Model, words: np.ndarray, n: int) -> np.ndarray:
    """The n ids that order 0 names."""
    rows, length = _rest_shape(n)
    out = np.empty((length, rows), np.uint16)
    id_at, shift = np.repeat(np.arange(len(model.counts), dtype=np.uint16), model.counts), U(model.bits)
    value, size = _taken(words, rows)
    at, pause, quotient = 2 * rows, _pause(model.bits), np.empty(rows, U)
    for t in range(length):
        size >>= shift
        np.floor_divide(value, size, out=quotient)
        found = id_at.take(quotient.view(np.int64), mode="clip", out=out[t])
        place = model.place.take(found, mode="clip")
        value -= size * (place >> _WORD)
        place &= _LOW_WORD
        size *= place
        if t % pause == pause - 1:
            at = _refilled(value, size, words, at)
    return out.ravel()[:n]


def decode(payload: bytes, steps: int) -> np.ndarray:
    """The rows of ids that `encode` was given."""
    lanes, n_rest, n_head, n_first = np.frombuffer(payload, "<u4", 4).tolist()
    out = np.zeros((steps + 2, lanes), np.uint16)
    if not out[2:].size:
        return out[2:].T
    model = _Model.unpacked(payload[16 : 16 + n_head])
    words = np.frombuffer(payload[16 + n_head :], "<u4")
    rest, used = _named(model, words[n_first:], n_rest), 0
    value, size = _taken(words, lanes)
    at, shift, pause = 2 * lanes, U(MIX_BITS), _pause(MIX_BITS)
    last, part = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    for t in range(steps):
        slot = last * _MUL_LAST
        slot += part
        slot >>= _HALF
        part = last * _MUL_BEFORE
        sure, other, kind = _ranked(model.one.take(last, mode="clip"), model.two.take(slot, mode="clip"))
        size >>= shift
        two = size * model.both.take(kind, mode="clip")
        left = value >= two
        told = np.flatnonzero(~left)
        there, unit, end = value.take(told), size.take(told), two.take(told)
        size <<= shift
        size -= two
        value -= two
        now = out[t + 2]
        n = np.count_nonzero(left)
        now[left] = rest[used : used + n]
        used += n
        one = unit * model.first.take(kind.take(told))
        hit = there < one
        begin = np.where(hit, U(0), one)
        value[told] = there - begin
        size[told] = np.where(hit, one, end) - begin
        now[told] = np.where(hit, sure.take(told), other.take(told))
        if t % pause == pause - 1:
            at = _refilled(value, size, words, at)
        last = now.astype(np.uint32)
    return out[2:].T
