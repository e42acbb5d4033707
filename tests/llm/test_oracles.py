import pytest

from codeloom.llm.queries import ORACLES, QUERIES

from .. import oracle

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        oracle.compare(df, con, ORACLES[name])
    else:
        assert df.count() == con.execute("SELECT count(*) FROM documents").fetchone()[0]
