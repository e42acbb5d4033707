import os
from pathlib import Path

import pytest

from codeloom.llm.shared import cut


def test_run_tables_are_plain_files_whose_pages_are_verified(spark):
    df = cut(spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string").coalesce(1), "plain")
    assert sorted(map(tuple, df.collect())) == [(i, f"text {i}") for i in range(500)]
    (file,) = (Path(f.removeprefix("file:")) for f in {x.replace("file://", "file:") for x in df.inputFiles()})
    # Of a checksum file or a mark at the end, each would cost processes that copy the executor or driver.
    assert os.listdir(file.parent) == [file.name]
    raw = bytearray(file.read_bytes())
    raw[300] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)checksum"):
        df.collect()
