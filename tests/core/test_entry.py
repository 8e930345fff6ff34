"""The driver's contract, with and without the optional operators."""

import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[2]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_operators():
    """As if their folder and the pipeline were deleted; no Spark session is needed to import."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('glossaflow.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and set(e.queries()) == set(e.oracle_sql())
assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True, timeout=120)


def test_a_broken_dependency_is_an_error():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'public_tokenizers':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__
"""
    if (TOP / "glossaflow" / "llm").is_dir():
        done = subprocess.run([sys.executable, "-c", code], cwd=TOP, capture_output=True, text=True, timeout=120)
        assert done.returncode and "public_tokenizers" in done.stderr


def test_nothing_else_imports_the_optional_operators():
    for path in [*TOP.glob("glossaflow/**/*.py"), *TOP.glob("*.py")]:
        if "llm" not in path.parts and path.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert ".llm" not in path.read_text(), path
