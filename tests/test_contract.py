"""The driver's contract, with and without the optional corpus part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("braidgraph.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
import braidgraph.api, braidgraph.cli
assert "growth_sample" in e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
assert set(e.oracle_sql()) == set(e.queries())
"""


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["k", "growth"] and df.count() == 25


def test_sql_only_for_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_part():
    subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, check=True)


def test_nothing_else_imports_the_corpus_part():
    for p in (ROOT / "braidgraph").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
