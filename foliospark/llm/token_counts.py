"""Greedy word-piece counts by a linear longest-match automaton, without building pieces.

The vocabulary is a byte trie. Each node has a failure link and the number of pieces popped
on the way: a node that spells a piece pops it and fails to the root; any other node pops
what longest-match takes off the front of its string and fails to the node of what is left.
So a word is read once, left to right, and every step forward or back is O(1). All distinct
words of a batch are read together, one byte a step, in numpy; one of over LONG_WORD bytes is
read by itself, in time that follows its length (about 0.2 s a MB).

A word is a run of bytes other than ASCII white space, read with one blank before it, as in
vocabularies whose word-initial pieces start with a blank. A byte that no piece starts with
counts as one unknown piece. Null and empty texts have no words. Every row is counted, repeated
ones too; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, utf8

MEMO_WORDS = 500_000
LONG_WORD = 256  # bytes beyond which a word is read by itself


class LongestMatch:
    def __init__(self, pieces: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in child[at]:
                    child[at][c] = len(child)
                    child.append({})
                    is_piece.append(False)
                at = child[at][c]
            is_piece[at] = True
        is_piece[0] = False
        for c in range(256):  # unknown bytes
            if c not in child[0]:
                child[0][c] = len(child)
                child.append({})
                is_piece.append(True)
        # Breadth first. -1: what is left cannot be read as a prefix of any piece from here.
        fail, popped = [0] * len(child), [0] * len(child)
        queue = []
        for v in child[0].values():
            popped[v], fail[v] = 1, 0  # a piece, or one unknown byte
            queue.append(v)
        for u in queue:
            for c, v in child[u].items():
                queue.append(v)
                if is_piece[v]:
                    popped[v], fail[v] = 1, 0
                    continue
                z, n = fail[u], popped[u]
                while c not in child[z]:
                    z, n = fail[z], n + popped[z]
                fail[v], popped[v] = child[z][c], n
        self.fail_list, self.popped_list = fail, popped
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)
        self.steps = {u << 8 | c: v for u, out in enumerate(child) for c, v in out.items()}
        edges = sorted((u << 8 | c, v) for u, out in enumerate(child) for c, v in out.items())
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.to = np.array([v for _, v in edges], np.int64)

    def _step(self, at: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = at << 8 | byte
        place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[place] == key, self.to[place], -1)

    def _count_one(self, word: bytes) -> int:
        step, fail, popped, at, total = self.steps.get, self.fail_list, self.popped_list, 0, 0
        for c in word:
            while (to := step(at << 8 | c)) is None:
                total += popped[at]
                at = fail[at]
            at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word."""
        out = np.zeros(len(words), np.int64)
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        out[short] = self._count_together([words[k] for k in short])
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = self._count_one(w)
        return out

    def _count_together(self, words: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = (np.cumsum(lengths) - lengths)[order]
        longest = lengths[order]
        at, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k in range(int(longest[0]) if len(words) else 0):
            n = int(np.searchsorted(-longest, -k, side="left"))  # words longer than k
            byte = data[starts[:n] + k]
            todo = np.arange(n)
            while len(todo):
                go = self._step(at[todo], byte[todo])
                ok = go >= 0
                at[todo[ok]] = go[ok]
                todo = todo[~ok]
                total[todo] += self.popped[at[todo]]
                at[todo] = self.fail[at[todo]]
        todo = np.flatnonzero(at)
        while len(todo):
            total[todo] += self.popped[at[todo]]
            at[todo] = self.fail[at[todo]]
            todo = todo[at[todo] > 0]
        out = np.zeros(len(words), np.int64)
        out[order] = total
        return out


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file: base64 text and rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@lru_cache(maxsize=2)
def _machine(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    return LongestMatch(vocabulary(path)), {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for every row. The memo of words lives in the worker and is bounded."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, memo = _machine(path)
        for batch in slices(batches):
            if len(memo) > MEMO_WORDS:
                memo.clear()
            split = [t.split() for t in utf8(batch.column(1))]
            n_words = np.fromiter(map(len, split), np.int64, len(split))
            words = [w for ws in split for w in ws]
            sizes = np.fromiter(map(memo.get, words, repeat(-1)), np.int64, len(words))
            lost = np.flatnonzero(sizes < 0)
            if len(lost):
                missing = [words[k] for k in lost.tolist()]
                new = list(dict.fromkeys(missing))
                found = dict(zip(new, machine.count([b" " + w for w in new]).tolist(), strict=True))
                sizes[lost] = np.fromiter(map(found.__getitem__, missing), np.int64, len(missing))
                memo.update((w, n) for w, n in found.items() if len(w) <= LONG_WORD)
            n_tokens = np.bincount(np.repeat(np.arange(len(split)), n_words), sizes, len(split)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
