import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 45


def test_entry_works_without_the_training_data_subpackage():
    """Imports fail as if the folders were deleted."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("foliospark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not any(k.startswith("op") or k == "pipeline" for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_a_missing_library_is_not_swallowed():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "xxhash":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__
"""
    if (REPO / "foliospark" / "llm").exists():
        assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True).returncode


def test_nothing_else_imports_the_subpackage():
    for path in REPO.glob("foliospark/**/*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text()


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_flagship(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.n > 0 and row.nothing == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith("op")))
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = __spark_entry__.queries()[name](spark, str(SF))
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(float(f"{x:.10g}") if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x for x in r) for r in rows), key=repr)
    assert plain(map(tuple, got.select(columns).collect())) == plain(want)
