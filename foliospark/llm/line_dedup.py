"""Fuzzy line deduplication over the whole corpus: MinHash bands, exact Jaccard, union-find.

A line is a stretch between newlines with a character other than ASCII white space, compared
with A-Z lower-cased and that white space collapsed. Equal lines are one node: the first in
the documents' order, whatever files and partitions they are read from. Nodes are similar at
Jaccard >= `threshold` over character shingles (a line shorter than one shingle is its own only
shingle). Signatures of bands * rows minima are banded; with the defaults a pair at 0.8 meets
in some band with probability 0.997, at 0.85 with 0.9999.

Every pair that meets in a band is compared, by the band's size. One of up to SMALL nodes
yields its pairs. A larger band is one group of nodes with their texts: each node not yet
reached is compared with those reached that have one of its rarest shingles, which a similar
one must, so a crowd of near copies costs one comparison each and a crowd that only shares a
passage few. Bands over LARGE nodes or CHARS characters are cut into blocks, each compared
within and with one node of the first; where that leaves a band in several components, every
two of its blocks are compared. So no band is gathered whole and no candidate is left out.
One line of each component stays: the first. Everything else of the text stays as it is,
blank lines included.

Texts travel in blocks. Digests and band keys are dealt as packed arrays to buckets of their
range, which numpy sorts; a bucket holds a bounded number of entries, as a digest's later
copies are dropped and a crowded key's members passed on while it is filled.

Null and empty texts have no lines. A text whose lines are all removed keeps its blank lines.
Repeated rows lose their lines to the first of them. A text of over 2**26 lines is refused.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, documents, slices, stage, unstage
from .repeats import bucket_of, make_blocks

SHINGLE, BANDS, ROWS, THRESHOLD, SMALL, LARGE = 5, 20, 6, 0.8, 16, 4096
CHARS = 1 << 20  # of a block; a longer line is one by itself
CACHED = 1 << 15  # characters whose shingles are numbered at a time
BLOCK_BYTES = 2 << 20
PACK, HELD = 1 << 18, 1 << 21  # entries that a task sends on, and holds of one bucket, at a time
BUCKET_BYTES, BUCKET_KEYS = 16 << 20, 1 << 18  # of text and of band keys that a bucket is for
_INDEX_BITS = 26  # of a line id; the block is above
_MIX = np.random.default_rng(11).integers(0, 2**31, 64, np.uint32) * np.uint32(2) + np.uint32(1)


_SPACES = re.compile(rb"[ \t\r\f\v]+")


def normal(line: str) -> str:
    """A-Z lower-cased and ASCII white space collapsed; empty if there is nothing else."""
    return _collapsed(line.encode("utf-8", "replace").lower()).decode()


def _has_more_than_blanks(text: bytes) -> bool:
    return b"  " in text or b"\t" in text or b"\r" in text or b"\f" in text or b"\v" in text


def _collapsed(line: bytes) -> bytes:
    return (_SPACES.sub(b" ", line) if _has_more_than_blanks(line) else line).strip(b" ")


def block_texts(blob: bytes, sizes: list[int]) -> Iterator[bytes]:
    data, at = zstandard.ZstdDecompressor().decompress(blob), 0
    for n in sizes:
        yield data[at : at + n]
        at += n


def text_lines(text: bytes) -> list[bytes]:
    """A text's normalised lines in order; a line's index among its block's is its place in its id."""
    lines = text.lower().split(b"\n")
    if _has_more_than_blanks(text):
        return [x for line in lines if (x := _collapsed(line))]
    return [x for line in lines if (x := line.strip(b" "))]


def block_lines(blob: bytes, sizes: list[int], at: np.ndarray) -> tuple[list[str], list[int]]:
    """The normalised lines of a block at these indexes, and each text's number of lines."""
    counts, out, k, chosen = [], [], 0, at.tolist()
    place = 0
    for text in block_texts(blob, sizes):
        lines = text_lines(text)
        counts.append(len(lines))
        while place < len(chosen) and chosen[place] < k + len(lines):
            out.append(lines[chosen[place] - k].decode("utf-8", "replace"))
            place += 1
        k += len(lines)
    return out, counts


def shingle_codes(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of all lines' shingles, and where each line's start; every line has one or more."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(lengths) - lengths
    count = np.maximum(lengths - size + 1, 1)
    firsts = np.cumsum(count) - count
    full = np.concatenate([codes + np.uint32(1), np.zeros(size, np.uint32)])
    mixed = np.zeros(len(codes), np.uint32)
    for k, m in enumerate(_MIX[:size]):
        mixed += full[k : k + len(codes)] * m
    for k in np.flatnonzero(lengths < size).tolist():  # characters past the line's end count as none
        at, n = int(starts[k]), int(lengths[k])
        mixed[at] = np.sum(full[at : at + n] * _MIX[:n], dtype=np.uint32)
    kept = mixed[np.repeat(starts - firsts, count) + np.arange(int(count.sum()))]
    kept ^= kept >> np.uint32(16)
    kept *= np.uint32(0x85EBCA6B)
    kept ^= kept >> np.uint32(13)
    kept *= np.uint32(0xC2B2AE35)
    kept ^= kept >> np.uint32(16)
    return kept, firsts


def signatures(lines: list[str], bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> np.ndarray:
    """(lines x bands) 64-bit keys, each over `rows` minima of the line's shingles."""
    rng = np.random.default_rng(7)
    mult = rng.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(lines), bands), np.uint64)
    for first in range(0, len(lines), 256):
        part = lines[first : first + 256]
        codes, starts = shingle_codes(part, shingle)
        x = np.empty_like(codes)
        for b in range(bands):
            key = np.full(len(part), b + 1, np.uint64)
            for r in range(rows):
                np.multiply(codes, mult[b * rows + r], out=x)
                key = (key ^ np.minimum.reduceat(x, starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[first : first + 256, b] = key
    return out


def shingle_set(line: str, size: int = SHINGLE) -> frozenset[str]:
    return frozenset(line[i : i + size] for i in range(max(1, len(line) - size + 1)))


def similarity(x: frozenset[str], y: frozenset[str]) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def jaccard(a: str, b: str, size: int = SHINGLE) -> float:
    return similarity(shingle_set(a, size), shingle_set(b, size))


def _with_lines(blocks: DataFrame, **sets: DataFrame) -> DataFrame:
    """blocks left-joined with the lists of packed line numbers (block, part) that each set has in them."""
    for name, packed in sets.items():
        blocks = blocks.join(packed.groupBy("block").agg(F.collect_list("part").alias(name)).hint("shuffle_hash"), "block", "left")
    return blocks


def _numbers(parts: list[bytes] | None) -> np.ndarray:
    """Sorted line numbers of a block from their packed lists."""
    return np.sort(np.concatenate([np.frombuffer(p, np.int32) for p in parts])).astype(np.int64) if parts else np.zeros(0, np.int64)


def _by_block(ids: np.ndarray) -> pa.RecordBatch:
    """Line ids as rows (block, part)."""
    ids = np.sort(ids)
    block = ids >> _INDEX_BITS
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(ids) else np.zeros(1, np.int64)
    at = (ids & ((1 << _INDEX_BITS) - 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array([at[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["block", "part"])


def packed_ids(ids: DataFrame) -> DataFrame:
    """ids(id) as rows (block, part), the ids of a batch and block together."""
    return ids.mapInArrow(lambda batches: (_by_block(b.column(0).to_numpy()) for b in batches), "block bigint, part binary")


def deal(parts: Iterator[tuple[np.ndarray, ...]], n: int) -> Iterator[pa.RecordBatch]:
    """Arrays of equal length as rows (bucket, each array's bytes), PACK entries at a time; the first's upper bits choose one of n buckets."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        bucket = bucket_of(columns[0], n)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *(pa.array([c[x:y].tobytes() for x, y in spans], pa.binary()) for c in columns)], names=["bucket", *(f"c{k}" for k in range(len(columns)))])

    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
            if size >= PACK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _dealt(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, arrays) of every row of deal()."""
    for batch in batches:
        for bucket, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield bucket, [np.frombuffer(c, k) for c, k in zip(columns, kinds, strict=True)]


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of deal((high, low, order, id)) sorted by bucket to the packed ids of each digest's least (order, id)."""

    def least(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
        high, low, order, ids = (np.concatenate(c) for c in zip(*rows, strict=True))
        at = np.lexsort((ids, order, low, high))
        high, low = high[at], low[at]
        first = at[np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])]
        return [np.concatenate(c)[first] for c in zip(*rows, strict=True)]

    now, rows, size = None, [], 0
    for bucket, row in _dealt(batches, (np.uint64, np.uint64, np.int64, np.int64)):
        if bucket != now:
            if rows:
                yield _by_block(least(rows)[3])
            now, rows, size = bucket, [], 0
        rows.append(row)
        size += len(row[0])
        if size > HELD:  # a bucket is no larger than its distinct lines
            rows = [least(rows)]
            size = 0
    if rows:
        yield _by_block(least(rows)[3])


def _pairs_of(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b, null) of keys of up to SMALL nodes, members (null, id, key) of larger ones; entries in any order."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    edge = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(edge) - 1
    sizes = np.bincount(group)
    big = (sizes > SMALL)[group]
    if big.any():
        yield _met(pa.nulls(int(big.sum()), pa.int64()), node[big], key[big].view(np.int64))
    some = ~big & (sizes > 1)[group]
    group, node = group[some], node[some]
    for s in range(1, SMALL):
        pair = group[s:] == group[:-s] if len(group) > s else np.zeros(0, bool)
        if not pair.any():
            return
        yield _met(node[:-s][pair], node[s:][pair], pa.nulls(int(pair.sum()), pa.int64()))


def _met(a, b, key) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (a, b, key)], names=["a", "b", "key"])


def _band_pairs(batches: Iterator[pa.RecordBatch], held: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of deal((key, id)) sorted by bucket to _pairs_of; a key over SMALL that fills memory passes on at once."""
    held = held or HELD
    now, keys, nodes, large, size = None, [], [], np.zeros(0, np.uint64), 0
    for bucket, (key, node) in _dealt(batches, (np.uint64, np.int64)):
        if bucket != now:
            if keys:
                yield from _pairs_of(np.concatenate(keys), np.concatenate(nodes))
            now, keys, nodes, large, size = bucket, [], [], np.zeros(0, np.uint64), 0
        if len(large):
            known = np.isin(key, large)
            if known.any():
                yield _met(pa.nulls(int(known.sum()), pa.int64()), node[known], key[known].view(np.int64))
                key, node = key[~known], node[~known]
        keys.append(key)
        nodes.append(node)
        size += len(key)
        if size > held:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            values, group, count = np.unique(key, return_inverse=True, return_counts=True)
            crowd = (count > SMALL)[group]
            if crowd.any():
                yield _met(pa.nulls(int(crowd.sum()), pa.int64()), node[crowd], key[crowd].view(np.int64))
                large = np.concatenate([large, values[count > SMALL]])
            keys, nodes, size = [key[~crowd]], [node[~crowd]], 0
    if keys:
        yield from _pairs_of(np.concatenate(keys), np.concatenate(nodes))


def shingle_arrays(lines: list[str], size: int = SHINGLE, alphabet: np.ndarray | None = None) -> list[np.ndarray]:
    """Each line's distinct shingles as sorted numbers; equal ones alone share a number. Some lines at a time, to stay in cache."""
    alphabet = _alphabet("".join(lines)) if alphabet is None else alphabet
    out: list[np.ndarray] = []
    part: list[str] = []
    held = 0
    if size * int(len(alphabet) + 1).bit_length() > 62:  # numbers do not fit: by rank among all lines
        numbers, starts = shingle_numbers(lines, size, dense=False)
        return [numbers[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    for k, line in enumerate(lines):
        part.append(line)
        held += len(line)
        if held >= CACHED or k + 1 == len(lines):
            numbers, starts = shingle_numbers(part, size, dense=False, alphabet=alphabet)
            out += [numbers[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            part, held = [], 0
    return out


def _alphabet(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    seen[codes] = True
    return np.flatnonzero(seen)


def _verified(pairs: DataFrame, lines: DataFrame, shingle: int) -> DataFrame:
    """pairs(a, b) with their exact Jaccard similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "line_a", CHARS), "line_b", CHARS):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            place = {line: k for k, line in enumerate(dict.fromkeys([*left, *right]))}
            sets = shingle_arrays(list(place), shingle)
            found = []
            for x, y in zip(left, right, strict=True):
                a, b = sets[place[x]], sets[place[y]]
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int(np.count_nonzero(b[at] == a))
                found.append(both / (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    left, right = lines.select(F.col("id").alias("a"), F.col("line").alias("line_a")), lines.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "line_a", "line_b")
    return stage(both.mapInArrow(compare, "a bigint, b bigint, similarity double"), "line-verified")


def shingle_numbers(lines: list[str], size: int = SHINGLE, dense: bool = True, alphabet: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each line's distinct shingles, sorted and numbered so that equal ones alone share a number, and where the lines' start and end.

    dense: the numbers run from 0 without a gap. alphabet: all code points, where numbers of several calls meet.
    """
    text = "".join(lines)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet = _alphabet(text) if alphabet is None else alphabet
    rank = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int32)
    rank[alphabet] = np.arange(1, len(alphabet) + 1)  # 0 stands past a line's end
    full = np.concatenate([rank[codes], np.zeros(size, np.int32)])
    base, lengths = len(alphabet) + 1, np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(lengths)
    count = np.maximum(lengths - size + 1, 1)
    line = np.repeat(np.arange(len(lines), dtype=np.int32), count)
    at = (ends - lengths - np.cumsum(count) + count)[line] + np.arange(len(line))
    numbers, top = np.zeros(len(line), np.int64), 1
    for k in range(size):  # characters past the line's end count as none
        if top > 2**62 // base:
            kinds, numbers = np.unique(numbers, return_inverse=True)
            top = len(kinds)
        numbers, top = numbers * base + np.where(at + k < ends[line], full[at + k], 0), top * base
    if dense:
        kinds, numbers = np.unique(numbers, return_inverse=True)
        top = max(len(kinds), 1)
    if top > 2**62 // max(len(lines), 1):  # lines by themselves
        first = np.cumsum(count) - count
        parts = [np.unique(numbers[x : x + n]) for x, n in zip(first.tolist(), count.tolist(), strict=True)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    numbers += line * np.int64(top)
    numbers.sort()
    both = numbers
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    starts = np.searchsorted(both, np.arange(len(lines) + 1) * top)
    return both - np.repeat(np.arange(len(lines)) * top, np.diff(starts)), starts


def _crowd(ids: list[int], lines: list[str], threshold: float, shingle: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the similar pairs, breadth first.

    A similar line lacks at most 1 - threshold of a line's shingles, so it has one of any more than that: the rarest.
    """
    numbers, starts = shingle_numbers(lines, shingle)
    sizes, count = np.diff(starts), np.bincount(numbers)
    owners, first = np.repeat(np.arange(len(lines)), sizes)[np.argsort(numbers, kind="stable")], np.cumsum(count) - count
    left, mine = np.ones(len(lines), bool), np.zeros(len(count), np.int64)

    def similar(k: int, among: np.ndarray) -> np.ndarray:
        """The nodes of the mask that are similar to node k."""
        own = numbers[starts[k] : starts[k + 1]]
        rare = own[np.argsort(count[own])[: int((1 - threshold) * len(own) + 1e-9) + 1]]
        n = count[rare]
        if int(n.sum()) < len(lines):
            near = np.unique(owners[np.repeat(first[rare] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        else:
            mask = np.zeros(len(lines), bool)
            for s in rare.tolist():
                mask[owners[first[s] : first[s] + count[s]]] = True
            near = np.flatnonzero(mask)
        near = near[among[near]]
        if not len(near):
            return near
        n = sizes[near]
        begin = np.cumsum(n) - n
        mine[own] = 1
        both = np.add.reduceat(mine[numbers[np.repeat(starts[near] - begin, n) + np.arange(int(n.sum()))]], begin)
        mine[own] = 0
        return near[both / (len(own) + n - both) >= threshold]

    n_left, seed, queue, tree = len(lines), 0, [], np.arange(len(lines))
    while n_left:
        if n_left < len(queue):  # asking the nodes not yet reached costs less than asking those to ask
            every = np.ones(len(lines), bool)
            for k in np.flatnonzero(left).tolist():
                hit = similar(k, every)
                others, which = np.unique(tree[hit], return_index=True)
                for i in hit[which[others != tree[k]]].tolist():  # one link to each other tree
                    yield ids[k], ids[i]
                tree[np.isin(tree, others)] = tree[k]
            return
        if not queue:
            seed += int(np.argmax(left[seed:]))
            queue, left[seed], n_left = [seed], False, n_left - 1
        k = queue.pop()
        hit = similar(k, left)
        left[hit], n_left, tree[hit] = False, n_left - len(hit), tree[k]
        for i in hit.tolist():
            yield ids[k], ids[i]
            queue.append(i)


_FOUND = "a bigint, b bigint, key bigint, block int"


def _found(links: list[tuple[int, int]], members: list[tuple[int, int]] | tuple[()] = (), key: int | None = None) -> pa.RecordBatch:
    """Rows (a, b, null, null) of links and (null, id, key, block) of members."""
    none = [None] * len(links)
    columns = [a for a, _ in links] + [None] * len(members), [b for _, b in [*links, *members]], none + [key] * len(members), none + [block for block, _ in members]
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "key", "block"])


def _crowds(batches: Iterator[pa.RecordBatch], threshold: float, shingle: int, limit: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, line) sorted by key: links, and the members of keys over the limits, which are cut into blocks.

    Each block is compared within and with the key's first node.
    """
    now, first, block, nodes, size = None, None, 0, [], 0

    def done(cut: bool) -> pa.RecordBatch:
        group = [first, *nodes] if block else nodes
        links = list(_crowd([i for i, _ in group], [x for _, x in group], threshold, shingle)) if len(group) > 1 else []
        return _found(links, [(block, i) for i, _ in nodes] if cut else (), now)

    for batch in batches:
        for key, node, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if nodes:
                    yield done(block > 0)
                now, first, block, nodes, size = key, (node, line), 0, [], 0
            elif len(nodes) >= limit or size + len(line) > chars:
                yield done(True)
                block, nodes, size = block + 1, [], 0
            nodes.append((node, line))
            size += len(line)
    if nodes:
        yield done(block > 0)


def _block_pairs(batches: Iterator[pa.RecordBatch], threshold: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, id, line) sorted by the first three: the links of each group."""
    now, nodes = None, []

    def compare() -> pa.RecordBatch:
        return _found(list(_crowd([i for i, _ in nodes], [x for _, x in nodes], threshold, shingle)))

    for batch in batches:
        for *group, node, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != now:
                if len(nodes) > 1:
                    yield compare()
                now, nodes = group, []
            nodes.append((node, line))
    if len(nodes) > 1:
        yield compare()


def _large_band_links(members: DataFrame, lines: DataFrame, bands: int, threshold: float, shingle: int, limit: int = LARGE, chars: int = CHARS) -> DataFrame:
    """Links of the bands too large for all pairs: members(key, id), lines(id, line)."""
    lines = lines.select("id", "line")
    ordered = members.join(lines, "id").select("key", "id", "line").repartition("key").sortWithinPartitions("key")
    met = stage(ordered.mapInArrow(lambda batches: _crowds(batches, threshold, shingle, limit, chars), _FOUND), "line-crowds")
    links = met.where("key is null").select("a", "b")
    cut = met.where("key is not null").select("key", "block", F.col("b").alias("id"))
    if cut.isEmpty():
        return links
    roots = connected_components(links).select(F.col("node").alias("id"), "root")
    rooted = cut.join(roots, "id", "left").select("key", "block", "id", F.coalesce("root", "id").alias("root"))
    apart = rooted.groupBy("key").agg(F.max("block").alias("last"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "last")
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    paired = cut.join(apart, "key").select("key", "block", "id", other.alias("other")).where("block <> other")
    group = paired.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id")
    ordered = group.join(lines, "id").select("key", "i", "j", "id", "line").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    across = stage(ordered.mapInArrow(lambda batches: _block_pairs(batches, threshold, shingle), _FOUND), "line-crowds")
    return links.union(across.select("a", "b"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, order: Column | None = None) -> DataFrame:
    """One row per document: doc_id, text (the lines that stay), n_lines, n_removed.

    doc_id may be of any type, such as a struct of all other columns. Of a component the line
    stays that comes first by `order`, a number (an integral doc_id itself by default, null
    last), then in its text; only lines of equal order are taken as they are read.
    """
    key_type = docs.schema["doc_id"].dataType
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("text string, n_lines bigint, n_removed bigint").fields])
    if order is None:
        order = F.col("doc_id") if isinstance(key_type, T.IntegralType) else F.lit(0)
    blocks = stage(make_blocks(docs, BLOCK_BYTES, F.coalesce(order.cast("bigint"), F.lit(2**63 - 1))), "line-blocks")
    light = blocks.select("block", "sizes", "blob", "orders")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(1, n_bytes // BUCKET_BYTES)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for row in batch.to_pylist():
                first: dict[bytes, tuple[int, int]] = {}
                k = 0
                for place, text in zip(row["orders"], block_texts(row["blob"], row["sizes"]), strict=True):
                    for x in text_lines(text):
                        if x not in first or place < first[x][0]:
                            first[x] = place, k
                        k += 1
                if k >= 1 << _INDEX_BITS:
                    raise ValueError(f"a text has over {1 << _INDEX_BITS} lines")
                both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, first)), np.uint64).reshape(-1, 2)
                where = np.array(list(first.values()), np.int64).reshape(-1, 2)
                yield both[:, 0], both[:, 1], where[:, 0], where[:, 1] + (row["block"] << _INDEX_BITS)

    seen = light.mapInArrow(lambda batches: deal(digests(batches), n), "bucket bigint, c0 binary, c1 binary, c2 binary, c3 binary")
    owned = stage(seen.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_first_of_each, "block bigint, part binary"), "line-owners")

    def chosen_lines(row: dict, name: str) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The chosen lines' ids, themselves and their documents' order."""
        at = _numbers(row[name])
        lines, counts = block_lines(row["blob"], row["sizes"], at)
        return at + (row["block"] << _INDEX_BITS), lines, np.repeat(np.array(row["orders"], np.int64), counts)[at]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["owned"]:
                    ids, lines, _ = chosen_lines(row, "owned")
                    yield signatures(lines, bands, rows, shingle).reshape(-1), np.repeat(ids, bands)

    n_owned = owned.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    n_keys = max(1, n_owned // 4 * bands // BUCKET_KEYS)
    banded = _with_lines(light, owned=owned).mapInArrow(lambda batches: deal(keys(batches), n_keys), "bucket bigint, c0 binary, c1 binary")
    met = stage(banded.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _band_pairs(batches), "a bigint, b bigint, key bigint"), "line-bands")
    pairs = stage(met.where("key is null").select("a", "b").distinct(), "line-pairs")
    large = met.where("key is not null").select("key", F.col("b").alias("id"))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["wanted"]:
                    ids, lines, place = chosen_lines(row, "wanted")
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place), pa.array(lines, pa.string())], names=["id", "place", "line"])

    lines = stage(_with_lines(light, wanted=packed_ids(wanted)).mapInArrow(fetch, "id bigint, place bigint, line string"), "line-texts")
    verified = _verified(pairs, lines, shingle)
    links = verified.where(F.col("similarity") >= threshold).select("a", "b")
    components = connected_components(links.union(_large_band_links(large, lines, bands, threshold, shingle)))
    placed = components.join(lines.select(F.col("id").alias("node"), "place"), "node")
    first = placed.groupBy("root").agg(F.min(F.struct("place", "node"))["node"].alias("first"))
    gone = stage(packed_ids(components.join(first, "root").where("node <> first").select(F.col("node").alias("id"))), "line-gone")
    unstage(met, pairs, lines, verified)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(batch.schema.get_field_index("doc_ids")).type.value_type
            for row in batch.to_pylist():
                keep, k = set(np.setdiff1d(_numbers(row["owned"]), _numbers(row["gone"])).tolist()), 0
                texts, counts, removed = [], [], []
                for text in block_texts(row["blob"], row["sizes"]):
                    out, n, gone = [], 0, 0
                    for line in text.split(b"\n"):
                        if not line or line.isspace():
                            out.append(line)
                            continue
                        n += 1
                        if k in keep:
                            out.append(line)
                        else:
                            gone += 1
                        k += 1
                    texts.append(b"\n".join(out))
                    counts.append(n)
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], id_type), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])

    return _with_lines(blocks.drop("n_bytes", "orders"), owned=owned, gone=gone).mapInArrow(finish, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
