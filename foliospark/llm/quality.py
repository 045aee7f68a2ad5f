"""Quality rules: base rules plus gradient-boosted trees over document statistics.

The trees are grown on histograms with logistic loss, from a bounded sample of labelled rows,
and flattened into node arrays that numpy walks for a whole batch at once. Chosen features are
monotonic: a split is refused if its children's values contradict the feature's sign, and
children inherit the midpoint as a bound, so a text with more repeated or junk words never
scores higher for it.

Null texts have no words and fail the base rules. Labels that are null, or that belong to no
document, are not learned from; a document labelled twice counts twice. Without both classes
among the labels the model keeps everything the base rules keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, utf8

#: Labelled rows that the model is fitted on at most: those of least hash.
SAMPLE_ROWS = 20_000
#: Score under which a document is dropped.
THRESHOLD = 0.5

FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "line_words", "dup_line_share", "repeat_share", "distinct_share", "stop_share", "punct_word_share", "letter_share")
#: 1: more may only help, -1: more may only harm.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1}

_SYMBOLS = b"#*$%&|<>"
_WINDOW, _MIN_WORDS, _MAX_REPEAT = 5, 10, 20
#: Common function words of the four languages.
STOP_WORDS = frozenset("the of and to in is that for with de la le les et des en el que los del und der die das ist nicht von".encode().split())


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the base columns (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and FEATURES."""
    base = np.zeros((len(texts), 5), np.int64)
    rows = np.zeros((len(texts), len(FEATURES)))
    ids: dict[bytes, int] = {}
    words_of, all_words = [], []
    for k, text in enumerate(texts):
        words = text.split()
        words_of.append(len(words))
        all_words += words
        seen, n_lines, dup = set(), 0, 0
        for line in text.split(b"\n"):
            if line and not line.isspace():
                n_lines += 1
                if line in seen:
                    dup += 1
                seen.add(line)
        raw = np.frombuffer(text, np.uint8)
        hist = np.bincount(raw, minlength=256)
        base[k, 0] = len(words)
        base[k, 1] = len(raw) - hist[0x80:0xC0].sum() - hist[9:14].sum() - hist[32]
        base[k, 2] = hist[list(_SYMBOLS)].sum()
        base[k, 3] = dup
        chars = max(1, base[k, 1])
        upper, digits = hist[65:91].sum(), hist[48:58].sum()
        letters = upper + hist[97:123].sum() + hist[0xC0:].sum()
        n = max(1, len(words))
        rows[k] = (np.log1p(len(words)), base[k, 1] / n, base[k, 2] / chars, upper / chars, digits / chars, len(words) / max(1, n_lines), dup / max(1, n_lines), 0, 0, 0, 0, letters / chars)
    counts = np.array(words_of, np.int64)
    if not all_words:
        return base, rows
    known = dict.fromkeys(all_words)
    ids = dict(zip(known, range(len(known)), strict=True))
    words = np.fromiter(map(ids.__getitem__, all_words), np.int64, len(all_words))
    is_stop = np.fromiter((w.lower() in STOP_WORDS for w in known), np.bool_, len(known))
    has_symbol = np.fromiter((w[-1] in b"#*$%&|<>!" for w in known), np.bool_, len(known))
    doc = np.repeat(np.arange(len(texts)), counts)
    rows[:, 9] = np.bincount(doc, is_stop[words], len(texts)) / np.maximum(1, counts)
    rows[:, 10] = np.bincount(doc, has_symbol[words], len(texts)) / np.maximum(1, counts)
    pair = np.sort(doc * len(known) + words)
    distinct = np.concatenate([[True], pair[1:] != pair[:-1]])
    rows[:, 8] = np.bincount(pair[distinct] // len(known), minlength=len(texts)) / np.maximum(1, counts)
    base[:, 4] = _repeated(words, doc, counts, len(known))
    rows[:, 7] = base[:, 4] / np.maximum(1, counts)
    return base, rows


def _repeated(words: np.ndarray, doc: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Words inside windows of five that occur twice or more in their text, by exact naming."""
    n = len(words)
    if n < _WINDOW:
        return np.zeros(len(counts), np.int64)
    # Name windows of 2, 4 and then 5 words by pairing names, so that equal names mean equal words.
    pairs = words[:-1] * size + words[1:]
    two = np.unique(pairs, return_inverse=True)[1]
    quads = two[:-2] * (two.max() + 1) + two[2:]
    four = np.unique(quads, return_inverse=True)[1]
    five = four[:-1] * size + words[4:]
    inside = doc[:-4] == doc[4:]
    starts = np.flatnonzero(inside)
    names = np.unique(five, return_inverse=True)[1][starts]
    key = doc[starts] * (names.max() + 1 if len(names) else 1) + names
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    again = starts[times[place] > 1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + _WINDOW, -1)
    return np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=len(counts))


@dataclass
class Trees:
    """Gradient-boosted trees as flat node arrays; a leaf points to itself."""

    bias: float = 10.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    depth: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(total + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    if not len(y) or y.min() == y.max():
        return Trees()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    p = y.mean()
    model = Trees(bias=float(np.log(p / (1 - p))), depth=depth)
    nodes: list[list[float]] = []
    roots, raw = [], np.full(len(y), model.bias)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        weight = lambda gs, hs: np.clip(-gs / (hs + ridge), low, high)
        gain_of = lambda gs, hs, w: -(gs * w + 0.5 * (hs + ridge) * w * w)
        value = float(weight(g.sum(), h.sum()))
        me = len(nodes)
        nodes.append([0, 0.0, me, me, value * rate])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-6, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gs, hs, ns = (np.bincount(binned[rows, f], w, len(c) + 1).cumsum()[:-1] for w in (g, h, None))
            wl, wr = weight(gs, hs), weight(g.sum() - gs, h.sum() - hs)
            gain = gain_of(gs, hs, wl) + gain_of(g.sum() - gs, h.sum() - hs, wr) - gain_of(g.sum(), h.sum(), value)
            gain = np.where((ns >= least) & (len(rows) - ns >= least) & (signs[f] * (wr - wl) >= 0), gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(wl[k]), float(wr[k])))
        if best[1] is None:
            return me
        f, k, wl, wr = best[1]
        mid = (wl + wr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[f])]
        go_left = binned[rows, f] <= k
        nodes[me][:2] = [f, float(cuts[f][k])]
        nodes[me][2] = grow(rows[go_left], level + 1, *bounds[0])
        nodes[me][3] = grow(rows[~go_left], level + 1, *bounds[1])
        return me

    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        grad, hess = q - y, q * (1 - q)
        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
        table = np.array(nodes)
        model.feature, model.left, model.right = (table[:, c].astype(np.int32) for c in (0, 2, 3))
        model.cut, model.value, model.roots = table[:, 1], table[:, 4], np.array(roots, np.int32)
        one = Trees(0.0, model.feature, model.cut, model.left, model.right, model.value, model.roots[-1:], depth)
        s = one.score(x)
        raw += np.log(s / (1 - s))
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most `rows` labelled documents, chosen by hash of the id over all labels."""
    chosen = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(utf8(batch.column(0)))[1]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.mapInArrow(measure, "y int, x array<double>").toPandas()
    got = got.assign(key=[tuple(v) for v in got["x"]]).sort_values(["key", "y"])
    x, y = (np.array(got["key"].tolist()), got["y"].to_numpy(float)) if len(got) else (np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(x, (y > 0).astype(float), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judge(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base columns, base_failed, score (the model's) and kept for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, x = statistics(utf8(batch.column(1)))
            failed = (base[:, 0] < _MIN_WORDS) | (100 * base[:, 4] > _MAX_REPEAT * base[:, 0])
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
