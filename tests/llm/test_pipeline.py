import random
import re

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import common, language_id, line_dedup, tokens

from .test_decontaminate import words_of
from .test_lines import brute as brute_lines
from .test_simhash import brute_fingerprint, components

WORDS = {"en": "the quick brown fox jumps over lazy dog near river bank while children play with stones under bright sun".split(), "de": "der schnelle braune fuchs springt über faulen hund neben fluss während kinder mit steinen unter sonne spielen".split()}
ITEM = "what colour is the deep ocean when the moon is full"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    sentence = lambda lang, k: " ".join(rng.choice(WORDS[lang]) for _ in range(k))
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        text = "\n".join(sentence(lang, rng.randint(8, 40)) for _ in range(rng.randint(1, 4)))
        if i % 9 == 4:
            text = rows[i // 2][1]
        if i % 11 == 5:
            text += "\n" + ITEM
        rows.append((i, text, lang, "s", len(text)))
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "12345 !!!", "en", "s", 9), (103, "the", None, None, 3), (104, " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000)), "en", "s", 1), rows[3], rows[3]]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "over lazy")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return rows, str(path)


def brute(rows):
    vectors, has = language_id.encode([r[1] or "" for r in rows])
    sums = {}
    for r, v in zip(rows, vectors, strict=True):
        if r[2] is not None:
            sums[r[2]] = sums.get(r[2], 0) + v.astype(float)
    protos = np.stack([v / np.linalg.norm(v) for v in sums.values()])
    rows = [(r[0], r[1]) for r, v, h in zip(rows, vectors, has, strict=True) if h and (protos @ v).max() >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    kept = []
    for i, text, n, gone in brute_lines(rows, line_dedup.THRESHOLD):
        if n > gone:
            kept.append((i, text))
    fps = [brute_fingerprint(t, corpus_pipeline.NEAR_SHINGLE) for _, t in kept]
    root, best = components(fps, corpus_pipeline.NEAR_RADIUS), {}
    for (i, t), f in zip(kept, fps, strict=True):
        if root[f] not in best or i < best[root[f]][0]:
            best[root[f]] = (i, t)
    item = words_of(ITEM)
    windows = {tuple(item[k : k + 8]) for k in range(len(item) - 7)}
    clean = []
    for i, t in best.values():
        w = words_of(t)
        if not any(tuple(w[k : k + 8]) in windows for k in range(len(w) - 7)):
            clean.append((i, t))
    library = tokenizers.Tokenizer.from_file(tokens.default_path())
    return {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in clean}


def test_run_matches_brute_force(spark, folder):
    rows, path = folder
    got = {}
    for r in sorted(corpus_pipeline.run(spark, path).collect(), key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == brute(rows)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = common.documents(spark, folder[1])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder[1]).dtypes == docs.dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder[1]).collect() == []


def test_clashing_columns_pass_through(spark, folder):
    """Columns named like the operators' own keep their values through the stages."""
    names = ["score", "lang_pred", "_fp", "_row", "block", "place", "order", "longest", "contaminated", "c0"]
    docs = common.documents(spark, folder[1]).select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder[1])
        assert kept.dtypes == docs.dtypes
        assert all(r[n] == f"{n}{r.doc_id}" for r in kept.select("doc_id", *names).collect() for n in names)


def test_staged_files_go(spark, folder):
    """After a run only what the lazy result reads is left."""
    import os

    before = set(os.listdir(common.shared_dir(spark)))
    corpus_pipeline.run(spark, folder[1]).count()
    left = {x.split("-")[0] for x in set(os.listdir(common.shared_dir(spark))) - before}
    assert left == {"decontaminate"}


CODE = """
from pyspark.sql import SparkSession
from foliospark.llm import common
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = common.stage(spark.range(5), "x")
assert df.count() == 5 and common.shared_dir(spark) == common.shared_dir(spark)
common.unstage(df)
print("staged", flush=True)
"""


def test_a_session_without_a_shared_folder(tmp_path):
    """One machine gets a folder of its own; a cluster is told to name one."""
    import subprocess
    import sys
    from pathlib import Path

    run = subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True)
    assert "staged" in run.stdout, run.stderr[-2000:]

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster)


def test_stages_are_the_five_in_order():
    assert [re.sub("_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["language", "line", "simhash", "decontaminate", "best"]
