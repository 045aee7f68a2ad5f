"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks of one size that are reset and checksummed independently. A block's ids
lie in up to LANES lanes, stretches of STEPS ids or, in a block that would need more lanes, of up
to twice as many; one id of every lane is coded a step, with numpy across the lanes, and all lanes
share the block's model, which then learns from the whole step.

Three orders predict each id: order 2 (by the last two ids) has one candidate, order 1 (by the
last id) two, each with a confidence, and order 0 a distribution over all ids. An id's
probability is what the event "this candidate is right" or "none is" gets, times, for none, its
share in order 0. The event's distribution mixes two adaptive ones: by the confidences of all
candidates, and by the last events and the confidence of order 2; the weight of each follows
what has served the lane better. Order 0 learns the ids that no candidate foretold. The model
is integers and correctly rounded float64 products, so encoder and decoder agree anywhere.

A lane's code is a range coder's: 48 bits of low and range, 16-bit words, carries settled when
the block ends.

Segment: magic, blocks and crc32 of the header (3 x uint32); per block ids, ids' upper bound,
words, crc32 of the ids and then the words (4 x uint32); per block the lanes' word counts
(uint16) and words, lane by lane. All little-endian.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC, LANES, STEPS, MAX_ID = 0x32435446, 4096, 1024, 1 << 20
BLOCK = 2 * LANES * STEPS
#: Events: the candidate of order 2, the two of order 1, none of them.
_EVENTS, _NONE = 4, 3
_EVENT_BITS, _ID_BITS = 15, 22  # totals of the two distributions
_LEAST, _LEAST_NONE = 8, 256  # of an event's share, so that a range of 32 bits bears an event and an id
_BOTTOM, _DIGIT = 1 << 32, (1 << 32) - 1
_ROWS, _LIMIT = 256, 1 << 16
_STEP0 = 32  # an id's weight in order 0 against the 1 of an id not yet seen
_TABLE2 = 20  # bits of the largest table of order 2
#: Fields of three edges in one integer, with room for their mix in sixteenths.
_FIELD, _PART = 20, (1 << 16) - 1
_PACK = 1 << _FIELD * np.arange(_EVENTS - 1)[:, None]
#: Where an event starts and ends in the mix: shifts, and what is added to the end.
_START, _END = np.array([63, 4, 24, 44]), np.array([4, 24, 44, 63])
_TOP = np.array([0, 0, 0, 1 << _EVENT_BITS])
#: A candidate's confidence after a miss.
_MISSED = np.array([0, 0, 1, 1, 2, 2, 3, 3])
#: The first candidate that is right, by 4 * order 2's + 2 * order 1's first + order 1's second.
_FIRST_RIGHT = np.array([3, 2, 1, 1, 0, 0, 0, 0])
_SLOT1 = 24  # bits of a candidate of order 1


def _slot_rules() -> tuple[np.ndarray, ...]:
    """How slots change, by what was right and the confidences.

    Order 2 (id * 8 + confidence), by 8 * right + confidence: what is added (at 0 the id is
    replaced). Order 1 (both ids, both confidences), by 64 * (2 * first right + second right) +
    8 * first's confidence + second's: the confidences after, 64 if the second is replaced and
    128 if the two change places.
    """
    sure = np.arange(8)
    add2 = np.concatenate([_MISSED - sure, (sure < 7) * 1])
    right, one, other = (x.reshape(-1) for x in np.meshgrid(np.arange(4), sure, sure, indexing="ij"))
    one_after = one + np.where(right >= 2, (one < 7) * 1, np.where(right == 1, 0, -1 * (one > 0)))
    fresh = (right == 0) & (other == 0)
    other_after = np.where(fresh, 1, other + np.where(right == 1, (other < 7) * 1, np.where(right >= 2, 0, -1 * (other > 0))))
    swap = other_after > one_after
    sures = np.where(swap, other_after << 3 | one_after, one_after << 3 | other_after)
    return add2.astype(np.int32), sures | fresh << 6 | swap << 7


_ADD2, _RULE1 = _slot_rules()
#: What order 1's confidences add to the row.
_SURES_ROW = (np.arange(64) & 56) >> 1 | (np.arange(64) & 6 > 0)


class _Events:
    """One adaptive distribution of events for each row."""

    def __init__(self):
        self.count = np.ones((_EVENTS, _ROWS), np.int64)
        self.edges = np.zeros((_EVENTS + 1, _ROWS), np.int64)
        self.edges[-1] = 1 << _EVENT_BITS
        self.renew()

    def add(self, at: np.ndarray) -> None:
        """at: event * ROWS + row."""
        self.count += 24 * np.bincount(at, minlength=_EVENTS * _ROWS).reshape(_EVENTS, _ROWS)

    def renew(self) -> None:
        full = self.count.sum(axis=0) > _LIMIT
        if full.any():
            self.count[:, full] = (self.count[:, full] >> 1) + 1
        upto = np.cumsum(self.count, axis=0)
        share = ((1 << _EVENT_BITS) - 3 * _LEAST - _LEAST_NONE) / upto[-1]
        for k in range(_NONE):
            self.edges[k + 1] = (upto[k] * share).astype(np.int64) + (k + 1) * _LEAST
        self.size = np.diff(self.edges, axis=0).reshape(-1)
        self.packed = (self.edges[1:_EVENTS] * _PACK).sum(axis=0)


class _Model:
    """What a block's lanes have in common, and each lane's own place."""

    def __init__(self, lanes: int, size: int, top: int):
        bits = min(_TABLE2, max(10, (size - 1).bit_length()))
        self.mask2 = (1 << bits) - 1
        self.two = np.zeros(1 << bits, np.int32)  # id * 8 + confidence
        self.pair = np.zeros(top, np.int64)  # first id, second id, confidences
        self.by_confidence, self.by_history = _Events(), _Events()
        self.seen, self.new, self.top = np.ones(top, np.int64), [], top
        self.place = np.arange(top + 1)
        self.cum = self.place.copy()
        self.learn0()
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.history, self.weight = np.zeros(lanes, np.int64), np.full(lanes, 8, np.int64)
        self.often = 16 if top <= 32 * lanes else 64
        self.step = 0

    def learn0(self) -> None:
        if self.new:
            self.seen += _STEP0 * np.bincount(np.concatenate(self.new), minlength=self.top)
            self.new = []
        upto = np.cumsum(self.seen)
        self.cum[1:] = (upto * (((1 << _ID_BITS) - self.top) / upto[-1])).astype(np.int64) + self.place[1:]
        self.cum[-1] = 1 << _ID_BITS

    def predict(self, m: int) -> None:
        """The first m lanes' candidates (c2, c1, c0) and the mixed edges of their events."""
        last = self.last[:m]
        self.at2 = (self.before[:m] * 0x9E3779B1 + last * 0x85EBCA6B >> 11) & self.mask2
        got2, got1 = self.two.take(self.at2).astype(np.int64), self.pair.take(last)
        self.got2, self.c2, self.c1, self.c0 = got2, got2 >> 3, got1 >> 6 + _SLOT1, got1 >> 6 & (1 << _SLOT1) - 1
        self.sure2, self.sures = got2 & 7, got1 & 63
        self.row_a = _SURES_ROW.take(self.sures) + (self.sure2 << 5) + ((self.c2 == self.c1).view(np.uint8) << 1)
        self.row_b = self.history[:m] | self.sure2 >> 1
        b = self.by_history.packed.take(self.row_b)
        self.mix = (self.by_confidence.packed.take(self.row_a) - b) * self.weight[:m] + (b << 4)

    def right(self, ids: np.ndarray) -> np.ndarray:
        """4 * (order 2 foretold it) + 2 * (order 1's first) + (order 1's second)."""
        return ((self.c2 == ids).view(np.uint8) << 2 | (self.c1 == ids).view(np.uint8) << 1 | (self.c0 == ids).view(np.uint8)).astype(np.int64)

    def share(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lanes' events start, and how long they are."""
        start = (self.mix >> _START.take(event)) & _PART
        return start, ((self.mix >> _END.take(event)) & _PART) + _TOP.take(event) - start

    def update(self, m: int, ids: np.ndarray, right: np.ndarray, event: np.ndarray, none: np.ndarray) -> None:
        """none: the lanes whose id no candidate foretold."""
        self.step += 1
        last, rows = self.last[:m], event * _ROWS
        at_a, at_b = rows + self.row_a, rows + self.row_b
        one, other = self.by_confidence.size.take(at_a), self.by_history.size.take(at_b)
        better = (one > other).view(np.int8) - (one < other).view(np.int8)
        self.weight[:m] = np.minimum(np.maximum(self.weight[:m] + better, 1), 15)
        self.by_confidence.add(at_a)
        self.by_history.add(at_b)
        if self.step < 16 or self.step % 4 == 0:
            self.by_confidence.renew()
            self.by_history.renew()
        self.history[:m] = (self.history[:m] | event) << 2 & 255
        rule = (right & 4) * 2 + self.sure2
        self.two[self.at2] = np.where(rule == 0, ids << 3, self.got2 + _ADD2.take(rule))
        rule = _RULE1.take((right & 3) << 6 | self.sures)
        second = np.where(rule & 64, ids, self.c0)
        change = (self.c1 ^ second) & -(rule >> 7)
        self.pair[last] = (self.c1 ^ change) << 6 + _SLOT1 | (second ^ change) << 6 | rule & 63
        if len(none):
            self.new.append(ids[none])
        if self.step & self.step - 1 == 0 or self.step % self.often == 0:
            self.learn0()
        self.before[:m], self.last[:m] = last, ids


def _shape(size: int) -> tuple[int, int]:
    """(lanes, steps) of a block; only the last lane can be short."""
    steps = min(size, STEPS)
    steps = max(steps, -(-size // LANES))
    return -(-size // steps), steps


def _across(grid: np.ndarray) -> np.ndarray:
    """The transposed grid, copied in strips that stay in the cache."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for k in range(0, len(grid), 32):
        out[:, k : k + 32] = grid[k : k + 32].T
    return out


def _encode_block(ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The lanes' word counts, and their words one lane after the other."""
    lanes, steps = _shape(len(ids))
    short = len(ids) - (lanes - 1) * steps
    grid = np.zeros(lanes * steps, np.uint32)
    grid[: len(ids)] = ids
    grid = _across(grid.reshape(lanes, steps))
    model = _Model(lanes, len(ids), top)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1)
    every = np.arange(lanes)
    out, used = np.zeros((min(1024, 3 * steps + 4), lanes), np.int32), every.copy()  # word by word, a lane a column
    flat = out.reshape(-1)
    for k in range(steps):
        if k % 64 == 0 and int(used.max()) // lanes + 3 * 64 + 4 > len(out):
            out = np.concatenate([out, np.zeros((len(out) + 256, lanes), np.int32)])
            flat = out.reshape(-1)
        m = lanes if k < short else lanes - 1
        now = grid[k, :m].astype(np.int64)
        model.predict(m)
        right = model.right(now)
        event = _FIRST_RIGHT.take(right)
        start, size = model.share(event)
        unit = span[:m] >> _EVENT_BITS
        low[:m] += unit * start
        span[:m] = unit * size
        none = np.flatnonzero(event == _NONE)
        if len(none):
            x = now.take(none)
            start, unit = model.cum.take(x), span.take(none) >> _ID_BITS
            low[none] += unit * start
            span[none] = unit * (model.cum.take(x + 1) - start)
        go = np.flatnonzero(span < _BOTTOM)
        while len(go):
            lo, place, s = low.take(go), used.take(go), span.take(go) << 16
            flat[place] = lo >> 32
            used[go] = place + lanes
            low[go], span[go] = (lo & _DIGIT) << 16, s
            go = go[s < _BOTTOM]
        model.update(m, now, right, event, none)
    low += _DIGIT  # the first value of the range with nothing after its top word
    flat[used] = low >> 32
    count = used // lanes + 1
    out = out[: int(count.max())]
    for k in range(len(out) - 1, 0, -1):  # carries
        out[k - 1] += out[k] >> 16
    return count, np.ascontiguousarray(out.astype(np.uint16).T)[np.arange(len(out)) < count[:, None]]


def _decode_block(count: np.ndarray, words: np.ndarray, size: int, top: int) -> np.ndarray:
    lanes, steps = _shape(size)
    short = size - (lanes - 1) * steps
    deep = int(count.max()) + 1
    laid = np.zeros((lanes, deep), np.uint16)  # no words are zeros
    laid[np.arange(deep) < count[:, None]] = words
    laid = _across(laid).reshape(-1)
    at = np.arange(lanes)
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = code << 16 | laid.take(at, mode="clip")
        at = at + lanes
    span = np.full(lanes, (1 << 48) - 1)
    model = _Model(lanes, size, top)
    grid = np.zeros((steps, lanes), np.uint32)
    for k in range(steps):
        m = lanes if k < short else lanes - 1
        model.predict(m)
        unit = span[:m] >> _EVENT_BITS
        event = np.zeros(m, np.uint8)
        for shift in _END[:_NONE].tolist():
            event += code[:m] >= unit * (model.mix >> shift & _PART)
        event = event.astype(np.int64)
        start, width = model.share(event)
        code[:m] -= unit * start
        span[:m] = unit * width
        now = np.where(event == 0, model.c2, np.where(event == 1, model.c1, model.c0))
        none = np.flatnonzero(event == _NONE)
        if len(none):
            unit = span.take(none) >> _ID_BITS
            value = np.minimum(code.take(none) // unit, (1 << _ID_BITS) - 1)
            order = np.sort(value << 32 | np.arange(len(none)))  # near values meet near places
            x = np.empty(len(none), np.int64)
            x[order & _DIGIT] = np.searchsorted(model.cum, order >> 32, side="right") - 1
            start = model.cum.take(x)
            now[none] = x
            code[none] -= unit * start
            span[none] = unit * (model.cum.take(x + 1) - start)
        go = np.flatnonzero(span < _BOTTOM)
        while len(go):
            place, s = at.take(go), span.take(go) << 16
            word = laid.take(place, mode="clip")
            code[go], span[go] = (code.take(go) << 16 | word) & (1 << 62) - 1, s  # damaged words must not overflow
            at[go] = place + lanes
            go = go[s < _BOTTOM]
        grid[k, :m] = now
        model.update(m, now, model.right(now), event, none)
    return np.ascontiguousarray(grid.T).reshape(-1)[:size]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of any number of ids below MAX_ID, in equal blocks of at most `block` ids.

    A short block takes as many steps as a full one, so none is left for the rest.
    """
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >= MAX_ID:
        raise ValueError(f"ids must be below {MAX_ID}")
    head, body = [], []
    for part in np.array_split(ids, -(-len(ids) // block)) if len(ids) else []:
        top = int(part.max()) + 1
        count, words = _encode_block(part, top)
        coded = count.astype("<u2").tobytes() + words.astype("<u2").tobytes()
        head.append([len(part), top, len(words), zlib.crc32(coded, zlib.crc32(part.tobytes()))])
        body.append(coded)
    table = np.array(head, "<u4").tobytes()
    return np.array([MAGIC, len(head), zlib.crc32(table)], "<u4").tobytes() + table + b"".join(body)


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if it is damaged."""
    if len(data) < 12:
        raise ValueError("the segment is cut short")
    magic, n, crc = np.frombuffer(data, "<u4", 3).tolist()
    if magic != MAGIC or len(data) < 12 + 16 * n:
        raise ValueError("this is no segment, or it is cut short")
    at = 12 + 16 * n
    if zlib.crc32(data[12:at]) != crc:
        raise ValueError("the segment's header fails its checksum")
    parts = [np.zeros(0, "<u4")]
    for k, (size, top, used, crc) in enumerate(np.frombuffer(data, "<u4", 4 * n, 12).reshape(n, 4).tolist()):
        lanes = _shape(size)[0]
        end = at + 2 * (lanes + used)
        coded = data[at:end]
        count = np.frombuffer(coded, "<u2", min(lanes, len(coded) // 2)).astype(np.int64)
        if len(coded) != end - at or int(count.sum()) != used:
            raise ValueError(f"block {k} does not fit its header")
        ids = _decode_block(count, np.frombuffer(coded, "<u2", used, 2 * lanes), size, top).astype("<u4")
        if zlib.crc32(coded, zlib.crc32(ids.tobytes())) != crc:
            raise ValueError(f"block {k} fails its checksum")
        parts.append(ids)
        at = end
    if at != len(data):
        raise ValueError("the segment's length does not fit its header")
    return np.concatenate(parts)
