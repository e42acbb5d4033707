"""Each process that an executor starts counts as a second copy of it for a moment: run tables are written without any."""

import os
import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent.parent

RUN = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
conf = {'spark.master': 'local-cluster[1,2,1024]', 'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '4', 'spark.driver.host': '127.0.0.1', 'spark.checkpoint.dir': 'file://' + sys.argv[2]}
s = SparkSession.builder.config(map=conf).getOrCreate()
import __spark_entry__ as e
print('rows', len(e.queries()[sys.argv[3]](s, '/root/testdata/sf0.001').collect()))
"""


@pytest.mark.parametrize("name", ["op6_ngram_jaccard", "op3_suffix_dedup", "pipeline"])
def test_run_tables_start_no_process(tmp_path, name):
    (tmp_path / "bin").mkdir()
    log, stub = tmp_path / "log", tmp_path / "bin/chmod"
    stub.write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec /bin/chmod "$@"\n')
    stub.chmod(0o755)
    log.touch()
    env = os.environ | {"PATH": f"{stub.parent}:{os.environ['PATH']}", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    out = subprocess.run([sys.executable, "-c", RUN, str(ROOT), str(tmp_path / "shared"), name], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout and "rows 0" not in out.stdout, out.stderr[-2000:]
    # The executors' copies of the shipped package are made executable by Spark itself, so the log is in use.
    lines = log.read_text().splitlines()
    assert lines and not [x for x in lines if "/codeloom-" in x and "/shared/" in x], lines
