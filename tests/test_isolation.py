"""The corpus operators are an optional part: the rest neither imports nor needs them."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent

BLOCK = """
import sys
class Blocker:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['codeloom', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Blocker())
import __spark_entry__ as e
assert e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']
assert set(e.oracle_sql()) <= set(e.queries())
import codeloom.api, codeloom.streaming.ingest, codeloom.plans.index
print('fine')
"""


def test_entry_without_the_optional_part():
    out = subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr


def test_nothing_else_imports_it():
    for path in ROOT.rglob("*.py"):
        rel = path.relative_to(ROOT).as_posix()
        if not rel.startswith(("codeloom/llm/", "tests/llm/")) and rel not in ("corpus_pipeline.py", "__spark_entry__.py", "tests/test_isolation.py"):
            assert "codeloom.llm" not in path.read_text(), rel


def test_entry_runs(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]


def test_queries_run_from_anywhere(tmp_path):
    """Executors get the package from the driver, wherever it was started."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1').getOrCreate()
import __spark_entry__ as e
print('rows', e.queries()['extract_nodes_go'](s, '').count())
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows 5" in out.stdout, out.stderr[-2000:]
