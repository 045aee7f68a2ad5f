"""Language identification with hyperdimensional letter n-gram profiles.

Every letter has a random bipolar vector derived from its code point. An n-gram binds its
letters' vectors, each permuted (rolled) by its place, by elementwise product; a text bundles
(sums) the vectors of all its n-grams over lower-cased letters, with runs of other characters
as one blank. A language's prototype bundles the length-normalised vectors of its training
texts. The prediction is the prototype of greatest cosine and the score that cosine, 0 at
least. Ties go to the first language in order.

Null texts and texts without a letter get `und` and score 0. Rows without lang are predicted
but not learned from. With nothing to learn from, every text is `und`. Repeated rows each
count. Texts of any length are read whole, some PIECE characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices

DIMENSIONS, GRAM, SEED = 1024, 3, 20240229
_DENSE = 160  # alphabets up to this size are counted by table
PIECE, CHUNK = 1 << 20, 4096  # characters and grams handled at a time
_REACH = 64  # characters beyond a cut that are looked at for a letter's neighbours


@cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int, dims: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, dims, np.int8) * np.int8(2) - np.int8(1)


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], np.ndarray, np.ndarray]]:
    """Lower-cased texts in packs of about PIECE characters: text numbers, pieces, and which of them follow or precede another.

    A longer text is cut; a piece then has a character of the next and of the one before, whose grams are not its own.
    """
    numbers, parts, after, before, held = [], [], [], [], 0
    for k, t in enumerate(texts):
        t = t.lower().replace("\x00", " ")
        for start in range(0, max(1, len(t)), PIECE):
            stop = min(len(t), start + PIECE)
            first, last = max(0, start - _REACH), min(len(t), stop + _REACH)
            numbers.append(k)
            parts.append(t[first:last])
            after.append(start - first)
            before.append(last - stop)
            held += last - first
            if held >= PIECE:
                yield numbers, parts, np.array(after), np.array(before)
                numbers, parts, after, before, held = [], [], [], [], 0
    if parts:
        yield numbers, parts, np.array(after), np.array(before)


def grams_of(parts: list[str], after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each letter's part, its gram's number, and the grams' code points (grams x GRAM; 0 is blank).

    The first `after` and last `before` characters of a part give its letters' neighbours alone.
    """
    joined = "\x00".join(parts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.ones(len(codes), bool)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    for k in np.flatnonzero((after > 0) | (before > 0)).tolist():
        own[ends[k] - lengths[k] : ends[k] - lengths[k] + after[k]] = False
        own[ends[k] - before[k] : ends[k]] = False
    cut = codes == 0
    letter = _letters()[codes]
    keep = letter | cut
    keep[1:] |= letter[:-1]  # the first other character after a letter stays as a blank
    codes, cut, letter, own = codes[keep], cut[keep], letter[keep], own[keep]
    doc = np.cumsum(cut, dtype=np.int64)
    # Blanks around: a text starts and ends with one (its cut mark serves as both).
    codes = np.where(letter, codes, 0)
    seen = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    seen[codes] = seen[0] = True
    alphabet, size = np.flatnonzero(seen), int(seen.sum())
    index = (np.cumsum(seen) - 1)[codes]
    padded = np.concatenate([[0], index, [0]]).astype(np.int64)
    key = (padded[:-2] * size + padded[1:-1]) * size + padded[2:]
    real = (padded[1:-1] > 0) & own  # one gram for each letter: its neighbours and itself
    key, doc = key[real], doc[real]
    if size <= _DENSE:
        present = np.flatnonzero(np.bincount(key, minlength=size**3))
        slot = np.zeros(size**3, np.int64)
        slot[present] = np.arange(len(present))
        column = slot[key]
    else:
        present, column = np.unique(key, return_inverse=True)
    grams = np.stack([alphabet[present // size**2], alphabet[present // size % size], alphabet[present % size]], axis=1) if len(present) else np.zeros((0, GRAM), np.uint32)
    return doc, column, grams


def encode(texts: list[str], dims: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (texts x dims, float32; zero without letters) and the has-letter mask.

    Grams are bound CHUNK at a time, so memory does not grow with a text's length or its scripts.
    """
    out, has = np.zeros((len(texts), dims), np.float32), np.zeros(len(texts), bool)
    for numbers, parts, after, before in _pieces(texts):
        doc, column, grams = grams_of(parts, after, before)
        if not len(grams):
            continue
        codes, place = np.unique(grams, return_inverse=True)
        place = place.reshape(grams.shape)
        for first in range(0, len(grams), CHUNK):
            some = slice(None) if len(grams) <= CHUNK else np.flatnonzero((column >= first) & (column < first + CHUNK))
            used, at = np.unique(place[first : first + CHUNK], return_inverse=True)
            at = at.reshape(-1, GRAM)
            base = np.stack([letter_vector(int(codes[c]), dims) for c in used])
            bound = np.roll(base, 2, axis=1)[at[:, 0]]
            bound *= np.roll(base, 1, axis=1)[at[:, 1]]
            bound *= base[at[:, 2]]
            counts = np.bincount(doc[some] * len(at) + column[some] - first, minlength=len(parts) * len(at)).reshape(len(parts), -1).astype(np.float32)
            vectors = counts @ bound.astype(np.float32)
            if len(parts) == len(set(numbers)):
                out[numbers] += vectors
            else:
                np.add.at(out, numbers, vectors)
        has[np.array(numbers)[np.unique(doc)]] = True
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), has


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 20):
        for start in range(0, batch.num_rows, 512):
            yield batch.slice(start, 512)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def learn(labelled: DataFrame, dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototypes by language from all rows of labelled(text, lang) with a lang.

    Each task sends one vector per language; they are summed by (lang, dimension), so the
    driver gets languages x dims numbers whatever the corpus.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in _packs(batches):
            vectors, _ = encode(_texts(batch.column(0)), dims)
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        # Rounded to fixed point, the total does not depend on the order of the tasks.
        values = [np.rint(v * 2**20).astype(np.int64).tolist() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(values, pa.list_(pa.int64()))], names=["lang", "bundle"])

    parts = labelled.where("lang is not null").select("text", "lang").mapInArrow(bundle, "lang string, bundle array<bigint>")
    summed = parts.select("lang", F.posexplode("bundle").alias("d", "v")).groupBy("lang", "d").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for lang, d, v in summed.collect():
        found.setdefault(lang, np.zeros(dims))[d] = v
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(found.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dims: int = DIMENSIONS) -> DataFrame:
    """docs with lang_pred and score after its own columns; own ones of these two names are replaced."""
    langs = list(prototypes)
    table = np.stack([prototypes[k] for k in langs]).astype(np.float32) if langs else np.zeros((0, dims), np.float32)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _packs(batches):
            vectors, has = encode(_texts(batch.column(at)), dims)
            cosine = vectors @ table.T
            if langs:
                best = cosine.argmax(axis=1)
                score = np.where(has, np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1), 0.0)
                pred = [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
            else:
                pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(judge, schema)


def is_held_out(doc_id: Column) -> Column:
    """Fold 0 of 5 by crc32 of the id as text; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", is_held_out(F.col("doc_id")).alias("held_out"))
    prototypes = learn(docs.where("not held_out").select("text", "lang"))
    found = predict(docs.select("doc_id", "text", "held_out"), prototypes)
    return found.select("doc_id", "held_out", "lang_pred", "score")
