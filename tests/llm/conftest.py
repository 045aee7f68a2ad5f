import random

import pytest

#: Rows that every operator must take: null, empty, white space, ties, repeats, clashing extra columns.
ODD_TEXTS = [None, "", " \n\t ", "a", "a", "a b c d e f g h i j k l", "Ünïcödé  ­ text\n\nwith  gaps", "\n\n", "123 456 !!!", "zzz"]


def make_rows(seed=1, n=40):
    """(doc_id, text) rows with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "river", "stone", "light", "Über", "café", "x1", "42"]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = sentence(60)
    texts = []
    for i in range(n):
        t = "\n".join(sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 4)))
        if i % 5 == 0:
            t = passage + " " + t
        if i % 7 == 0 and texts:
            t = rng.choice(texts)
        if i % 6 == 0 and texts:
            base = rng.choice(texts).split(" ")
            base[rng.randrange(len(base))] = "changed"
            t = " ".join(base)
        texts.append(t)
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    return rows + [rows[3], rows[3], (None, "a null id"), (5000, "word " * 20000)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns named like the operators' own results."""
    extra = "doc_id long, text string, fp long, fingerprint string, component_id string, n_words string, block string, bits string, node string, root string, kept string, score string, lang string, source string, n_chars long"
    wide = [(i, t, 1, "x", "x", "x", "x", "x", "x", "x", "x", "x", "en", "s", 0 if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(wide, extra).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
