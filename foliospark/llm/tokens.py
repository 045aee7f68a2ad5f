"""Whole-text token ids through the tokenizers library, memoised by piece.

A text's bytes are cut where the byte-level pre-tokeniser always ends a pre-token, whatever
stands further on either side: before a blank between two non-spaces, before punctuation after a
letter, and on either side of a line feed that a non-space follows. So the ids of a text are
its pieces' ids, one after the other, and each distinct piece is encoded once: unseen pieces are
joined into long texts that have the same cuts, encoded by the library, and cut apart again
by their byte lengths. Pieces of up to 15 bytes are found by their very bytes, as two
integers, in an open-addressing table of arrays; longer ones in a dict. The memo lives in the
Python worker across batches and is emptied beyond `limit` pieces, which changes cost only.

Texts that hold an added token's content, such as an end mark spelled out, go through the
library whole, as its special tokens cut a text before the pre-tokeniser does. So do pieces
whose tokens cross a cut, each by itself. Null is for the caller to replace; any text, of any
length, has the library's own ids.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PIECES, JOINED, SHORT = 2_400_000, 1 << 16, 15
_BLANK, _FEED = 0x20, 0x0A
#: The bytes of a short piece in its first and second eight, by its length.
_KEEP = np.array([[(1 << 8 * min(8, max(0, n - k))) - 1 for n in range(SHORT + 1)] for k in (0, 8)], np.uint64)
_SPREAD = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)))


def _no_space(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes of characters that are certainly no white space and no control characters."""
    out = (data > _BLANK) & (data != 0x7F)
    for lead, second, n in ((0xC2, (0x80, 0xA0), 2), (0xE1, (0x9A, 0x9A), 3), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80, 0x80), 3)):
        at = np.flatnonzero(data[:-1] == lead)
        at = at[(data[at + 1] >= second[0]) & (data[at + 1] <= second[1])]
        for k in range(n):
            out[at + k] = False
    return out


def _cuts(data: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Mask of the bytes before which every pre-token ends; the first and last byte are not judged."""
    cut = np.zeros(len(data), bool)
    letter = (data | 0x20) - np.uint8(0x61) < 26
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # Latin-1
    mark = (data - np.uint8(0x21) < 15) | (data == 0x3A) | (data == 0x3B) | (data == 0x3F)
    feed = (data[1:-1] == _FEED) & sure[2:]
    cut[1:-1] = (data[1:-1] == _BLANK) & sure[:-2] & sure[2:] | mark[1:-1] & letter[:-2] | feed
    cut[2:] |= feed
    return cut


def _spans(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all spans, one span after the other."""
    total = np.cumsum(lengths)
    return np.repeat(start - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


class _Table:
    """Places of short pieces by two integers, of which the second is never 0."""

    def __init__(self):
        self.used, self.bits = 0, 12
        self._make()

    def _make(self) -> None:
        self.one, self.two = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.place = np.zeros(1 << self.bits, np.int32)

    def _slots(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def mixed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = one * _SPREAD[0] ^ two * _SPREAD[1]
        out ^= out >> np.uint64(32)
        return out * _SPREAD[2]

    def find(self, one: np.ndarray, two: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Each piece's place, or -1."""
        slot = self._slots(mixed)
        held = self.two.take(slot)
        right = (held == two) & (self.one.take(slot) == one)
        out = np.where(right, self.place.take(slot), -1).astype(np.int64)
        todo = np.flatnonzero(~right & (held != 0))
        slot = slot[todo]
        while len(todo):
            slot = slot + 1 & (1 << self.bits) - 1
            held = self.two.take(slot)
            right = (held == two[todo]) & (self.one.take(slot) == one[todo])
            out[todo[right]] = self.place[slot[right]]
            go = ~right & (held != 0)
            todo, slot = todo[go], slot[go]
        return out

    def put(self, one: np.ndarray, two: np.ndarray, place: np.ndarray) -> None:
        """Pieces that are not held yet."""
        self.used += len(one)
        if self.used > 0.6 * (1 << self.bits):
            held = np.flatnonzero(self.two)
            old = self.one[held], self.two[held], self.place[held]
            while self.used > 0.4 * (1 << self.bits):
                self.bits += 1
            self._make()
            self._place(*old)
        self._place(one, two, place.astype(np.int32))

    def _place(self, one: np.ndarray, two: np.ndarray, place: np.ndarray) -> None:
        slot = self._slots(self.mixed(one, two))
        while len(one):
            free = np.flatnonzero(self.two.take(slot) == 0)
            self.place[slot[free]] = place[free]
            won = free[self.place[slot[free]] == place[free]]  # one piece a slot
            self.one[slot[won]], self.two[slot[won]] = one[won], two[won]
            rest = np.ones(len(one), bool)
            rest[won] = False
            one, two, place, slot = one[rest], two[rest], place[rest], slot[rest] + 1 & (1 << self.bits) - 1


class Encoder:
    def __init__(self, path: str, limit: int = PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        self.limit = limit
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # one character of a byte-level token is one byte
        self.clear()

    def clear(self) -> None:
        self.short, self.long = _Table(), {}
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used, self.filled = np.zeros(4096, np.uint32), 0, 0

    def _put(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(lengths), len(ids)
        while self.used + n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.start))
        while self.filled + m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.filled : self.filled + m] = ids
        self.start[self.used : self.used + n] = self.filled + np.cumsum(lengths) - lengths
        self.length[self.used : self.used + n] = lengths
        self.used, self.filled = self.used + n, self.filled + m

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_alone(self, data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> None:
        got = self._ids([data[a : a + n].tobytes().decode() for a, n in zip(at.tolist(), lengths.tolist(), strict=True)])
        if got:
            self._put(np.concatenate(got), np.array([len(x) for x in got], np.int64))

    def _learn_joined(self, data: np.ndarray, at: np.ndarray, lengths: np.ndarray, gap: int) -> None:
        """Pieces that start and end with a non-space, led by a blank (gap 0) or to be parted by a line feed (1)."""
        ends = np.cumsum(lengths + gap)
        cuts = np.searchsorted(ends, np.arange(JOINED, int(ends[-1]) + JOINED, JOINED)) if len(ends) else []
        low = 0
        for high in [min(int(c) + 1, len(at)) for c in cuts]:
            if high == low:
                continue
            a, n = at[low:high], lengths[low:high]
            low = high
            joined = data[_spans(a, n + gap)]
            ends = np.cumsum(n + gap)
            if gap:
                joined[ends - 1] = _FEED
            text = joined.tobytes().decode()
            if self._has_added(text):  # an added token with a blank in it
                self._learn_alone(data, a, n)
                continue
            ids = self._ids([text])[0]
            token_ends = np.cumsum(self.n_bytes[ids])
            last = np.searchsorted(token_ends, ends - gap)
            first = np.searchsorted(token_ends, ends - gap - n, side="right")
            before = np.concatenate([[0], token_ends])
            if token_ends[-1] != ends[-1] or not (np.array_equal(token_ends[last], ends - gap) and np.array_equal(before[first], ends - gap - n)):
                self._learn_alone(data, a, n)  # a token crosses a piece's end
                continue
            counts = last + 1 - first
            self._put(ids[_spans(first, counts)], counts)

    def _learn(self, data: np.ndarray, sure: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Encode the pieces there; their places."""
        led = data[at] == _BLANK
        whole = sure[at + lengths - 1] & (sure[at] | led & (lengths > 1) & sure[at + 1])
        out, base = np.empty(len(at), np.int64), self.used
        order = [np.flatnonzero(m) for m in (whole & led, whole & ~led, ~whole)]
        out[np.concatenate(order)] = base + np.arange(len(at))
        self._learn_joined(data, at[order[0]], lengths[order[0]], 0)
        self._learn_joined(data, at[order[1]], lengths[order[1]], 1)
        self._learn_alone(data, at[order[2]], lengths[order[2]])
        return out

    def _find_short(self, data: np.ndarray, sure: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Memo places of pieces of up to SHORT bytes; 16 bytes of data stand from each on."""
        keys = np.ndarray(len(data) - 15, "V16", data, strides=(1,))[at].view(np.uint64).reshape(-1, 2)
        one = keys[:, 0] & _KEEP[0].take(lengths)
        two = keys[:, 1] & _KEEP[1].take(lengths) | lengths.astype(np.uint64) << np.uint64(56)
        mixed = _Table.mixed(one, two)
        out = self.short.find(one, two, mixed)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            lost = lost[np.argsort(mixed[lost])]
            a, b = one[lost], two[lost]
            first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            new = lost[first]
            place = self._learn(data, sure, at[new], lengths[new])
            self.short.put(one[new], two[new], place)
            out[lost] = place[np.cumsum(first) - 1]
        return out

    def _find_long(self, data: np.ndarray, sure: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        buffer = data.tobytes()
        pieces = [buffer[a : a + n] for a, n in zip(at.tolist(), lengths.tolist(), strict=True)]
        new: dict[bytes, int] = {}
        for k, p in enumerate(pieces):
            if p not in self.long:
                new.setdefault(p, k)
        if new:
            where = np.fromiter(new.values(), np.int64, len(new))
            self.long.update(zip(new, self._learn(data, sure, at[where], lengths[where]).tolist(), strict=True))
        return np.array([self.long[p] for p in pieces], np.int64)

    def _has_added(self, text: str) -> bool:
        return any(c in text for c in self.added)

    def _with_whole(self, texts: list[str], whole: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """encode() where the texts numbered in `whole` go through the library by themselves."""
        rest, counts = [k for k in range(len(texts)) if k not in whole], np.zeros(len(texts), np.int64)
        ids, n = self.encode([texts[k] for k in rest])
        counts[rest] = n
        parts: list[np.ndarray] = [*np.split(ids, np.cumsum(n)[:-1])] if rest else []
        for k in sorted(whole):
            parts.insert(k, self._ids([texts[k]])[0])
            counts[k] = len(parts[k])
        return np.concatenate(parts).astype(np.uint32), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and each text's number of ids."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.used > self.limit:
            self.clear()
        whole = [k for k, t in enumerate(texts) if self._has_added(t)]
        if whole:
            return self._with_whole(texts, set(whole))
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1) - 1  # a zero byte stands after each text
        data = np.frombuffer(b"\0".join([*raw, bytes(16)]), np.uint8)
        sure = _no_space(data)
        sure[ends] = False
        cut = _cuts(data, sure)
        cut[ends] = cut[ends - sizes] = True
        cut[ends[-1] + 1 :] = False
        at = np.flatnonzero(cut)
        stop = np.searchsorted(at, ends)  # the zero bytes among the pieces
        lengths = np.diff(at, append=ends[-1] + 1)
        lengths[stop] = 0
        place = np.zeros(len(at), np.int64)
        some = np.flatnonzero((lengths > 0) & (lengths <= SHORT))
        place[some] = self._find_short(data, sure, at[some], lengths[some])
        some = np.flatnonzero(lengths > SHORT)
        if len(some):
            place[some] = self._find_long(data, sure, at[some], lengths[some])
        counts = self.length.take(place)
        counts[stop] = 0
        total = np.cumsum(counts)[stop]
        return self.flat[_spans(self.start.take(place), counts)], np.diff(total, prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after every text's, and the longer counts."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id), counts + 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
