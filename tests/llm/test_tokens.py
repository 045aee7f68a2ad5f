import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import tokenizers
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import packing, range_coder, token_counts, token_files, tokens

PATH = tokens.default_path()
SF = Path("/root/testdata/sf0.01/documents.parquet")


def library_ids(text):
    return tokens.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z\n\t .,!'1é中 \x1c😀s"), max_size=25), min_size=1, max_size=4))
def test_memoised_ids_equal_the_librarys(texts):
    ids, counts = tokens.encoder(PATH).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library_ids(t) for t in texts]


def test_memo_can_be_emptied(rows):
    small = tokens.Encoder(PATH, limit=3)
    for _, t in rows[:20]:
        ids, _ = small.encode([t or ""])
        assert ids.tolist() == library_ids(t)


class Spy:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.given += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_reach_the_library_once_wherever_they_stand():
    """Beside line feeds, other marks and letters outside ASCII, in any combination."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgéß", k=8)) for _ in range(200)]
    texts = [" ".join(f"{rng.choice(words)}{rng.choice(['.', '!!', ',', ''])}\n{rng.choice(words)}" for _ in range(40)) for _ in range(100)]
    memo = tokens.Encoder(PATH)
    memo.tokenizer = Spy(memo.tokenizer)
    ids, counts = memo.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library_ids(t) for t in texts]
    assert memo.tokenizer.given < 3 * sum(len(w) + 1 for w in words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Zé", "ß", "×", ".", "!?", "'s", "'", " ", "  ", "\n", "\n\n", "\r", "\0", "\x7f", "\x85", "\u3000", "\u2009", "\u1680", "—", "中", "7", "abcdefghijklmno", "#$-"]), max_size=14).map("".join), min_size=1, max_size=4))
def test_cuts_beside_marks_and_spaces_keep_the_librarys_ids(texts):
    ids, counts = tokens.encoder(PATH).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library_ids(t) for t in texts]


def test_memo_table_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(tokens._Table, "mixed", staticmethod(lambda one, two: np.zeros(len(one), np.uint64)))
    texts = ["a bc def", "bc a def ghij a", "def\0 bc"]
    ids, counts = tokens.Encoder(PATH).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library_ids(t) for t in texts]


def test_coder_holds_the_words_it_writes_alone():
    ids = np.minimum(np.random.default_rng(2).zipf(1.3, 1 << 20), 5000)
    tracemalloc.start()
    data = range_coder.encode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(range_coder.decode(data), ids)
    assert peak < 26 << 20


def test_coder_grows_its_room():
    ids = np.random.default_rng(4).integers(0, range_coder.MAX_ID, 60 * 1024)  # more than a word an id
    assert np.array_equal(range_coder.decode(range_coder.encode(ids)), ids)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 3, 300, 60_000])
def test_coder_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    assert np.array_equal(range_coder.decode(range_coder.encode(ids, 256)), ids)


def test_coder_takes_any_id_below_its_bound():
    ids = np.array([range_coder.MAX_ID - 1, 0, 7])
    assert np.array_equal(range_coder.decode(range_coder.encode(ids)), ids)


def test_coder_compresses_what_repeats():
    ids = np.tile(np.random.default_rng(1).integers(0, 50_000, 50), 80)
    assert len(range_coder.encode(ids)) < 2 * len(ids) / 6


def test_coder_learns_each_order():
    rng = np.random.default_rng(5)
    skewed = np.minimum(rng.zipf(1.2, 400_000), 5000)  # order 0 alone, about as skewed as words
    p = np.bincount(skewed)[np.unique(skewed)] / len(skewed)
    assert 8 * len(range_coder.encode(skewed)) / len(skewed) < 1.1 * -(p * np.log2(p)).sum()
    follows = rng.permutation(3000)
    chain = [0]
    for jump in rng.random(40_000):  # an id foretells the next nine times in ten
        chain.append(int(follows[chain[-1]]) if jump < 0.9 else int(rng.integers(3000)))
    assert 8 * len(range_coder.encode(np.array(chain))) / len(chain) < 0.35 * np.log2(3000)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_real_ids_take_fewer_bytes_than_a_general_compressor():
    texts = pq.read_table(SF)["text"].to_pylist()
    ids = tokens.encoder(PATH).encode([t or "" for t in texts])[0]
    data = range_coder.encode(ids)
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(data) < min(len(zstandard.compress(ids.astype("<u2").tobytes(), 3)), -(p * np.log2(p)).sum() * len(ids) / 8)
    assert np.array_equal(range_coder.decode(data), ids)


def test_coder_finds_damage():
    data = bytearray(range_coder.encode(np.arange(3000) % 700, 512))
    for at in random.Random(2).sample(range(12, len(data)), 40):
        bad = bytearray(data)
        bad[at] ^= 0x41
        with pytest.raises(ValueError):
            range_coder.decode(bytes(bad))
    with pytest.raises(ValueError):
        range_coder.decode(bytes(data[:-2]))
    with pytest.raises(ValueError):
        range_coder.encode(np.array([range_coder.MAX_ID]))


def test_token_files(spark, docs, rows, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, PATH, segment_ids=500)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library_ids(t), 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in got] == want


def test_token_files_empty(spark, no_docs, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(no_docs, path, PATH)
    assert token_files.read_token_files(spark, path).collect() == []


def test_packing(docs, rows):
    got = packing.pack(docs, PATH, size=128, open_bins=4).collect()
    by_doc, sequences = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, tuple(r.ids) if r.piece == 0 and r.length < 128 else None), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for pieces in sequences.values():
        place = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 128
    want = sorted([*library_ids(t), 0] for _, t in rows)
    parts = {}
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        parts.setdefault(r.doc_id, []).append(r)
    whole = []
    for pieces in parts.values():
        copies = sum(r.piece == 0 for r in pieces)
        ids = [x for r in pieces[::copies] for x in r.ids]
        assert all(r.length == 128 for r in pieces if r.piece > 0)
        assert all(r.start == sum(q.length for q in pieces[::copies] if q.piece < r.piece) for r in pieces)
        whole += [ids] * copies
    assert sorted(whole) == want


def test_packing_empty(no_docs):
    assert packing.pack(no_docs, PATH).collect() == []


def test_best_fit_picks_the_fullest_that_fits_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # exact fit closes bin 1
    assert bins.place(5) == (2, 0)
    assert bins.place(8) == (3, 0)  # bin 0 (4 free) is fuller than bin 2 (5 free) and closes
    assert bins.place(4) == (2, 5) and bins.place(10) == (4, 0)


class PlainBestFit:
    """Every open bin looked at: the fullest that fits, else a new one, closing the fullest where there are too many."""

    def __init__(self, size, open_bins):
        self.size, self.open_bins, self.open, self.next = size, open_bins, {}, 0

    def place(self, length):
        if length == self.size:
            self.next += 1
            return self.next - 1, 0
        fits = [(self.size - used, b) for b, used in self.open.items() if self.size - used >= length]
        if fits:
            tightest = min(fits)[0]
            b = next(b for b in reversed(self.open) if self.size - self.open[b] == tightest)
        else:
            if len(self.open) >= self.open_bins:
                most = max(self.open.values())
                del self.open[next(b for b in reversed(self.open) if self.open[b] == most)]
            b, self.open[self.next], self.next = self.next, 0, self.next + 1
        used = self.open.pop(b)
        if used + length < self.size:
            self.open[b] = used + length
        return b, used


@pytest.mark.parametrize(("size", "open_bins"), [(10, 1), (16, 3), (64, 20)])
def test_best_fit_matches_brute_force(size, open_bins):
    rng = random.Random(size)
    fast, plain = packing.BestFit(size, open_bins), PlainBestFit(size, open_bins)
    lengths = [rng.choice([rng.randint(1, size), rng.randint(1, max(1, size // 4))]) for _ in range(3000)]
    assert [fast.place(n) for n in lengths] == [plain.place(n) for n in lengths]


def test_packing_fills_sequences(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join("word" for _ in range(rng.randint(1, 700)))) for k in range(3000)], "doc_id long, text string").repartition(2)
    got = packing.pack(docs, PATH, with_ids=False).selectExpr("sum(length) as n", "count(distinct sequence_id) as sequences").first()
    assert got.sequences <= 1.03 * -(-got.n // 2048)


def brute_count(word, pieces):
    n = at = 0
    longest = max(map(len, pieces), default=1)
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 1)
        at, n = at + size, n + 1
    return n


def test_longest_match_on_random_vocabularies():
    rng = random.Random(4)
    for _ in range(200):
        pieces = {bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))}
        words = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 15))) for _ in range(20)]
        assert token_counts.LongestMatch(pieces).count(words).tolist() == [brute_count(w, pieces) for w in words]


def test_long_words_are_read_alone():
    import time

    rng = random.Random(11)
    pieces = {bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 6))) for _ in range(12)}
    words = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 255, 256, 257, 3000)]
    machine = token_counts.LongestMatch(pieces)
    assert machine.count(words).tolist() == [brute_count(w, pieces) for w in words]
    began = time.perf_counter()
    machine.count([bytes(rng.choices(b"abc", k=1 << 20))])
    assert time.perf_counter() - began < 5


def test_token_counts(docs, rows):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = set(token_counts.vocabulary(path))
    got = token_counts.count_tokens(docs, path).collect()
    want = sorted(((i, len(w := (t or "").encode().split()), sum(brute_count(b" " + x, pieces) for x in w)) for i, t in rows if i != 5000), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_tokens) for r in got if r.doc_id != 5000), key=repr) == want


def test_token_counts_empty(no_docs):
    import public_tokenizers

    assert token_counts.count_tokens(no_docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect() == []
