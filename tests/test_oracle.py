"""Every registered query with oracle SQL equals DuckDB's result at sf0.001;
queries without one run and return rows."""

import pytest

from intentloom.registry import ORACLE, QUERIES, load_all
from scripts.oracle_check import rows_of
from tests.conftest import SF_SMALL

load_all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL).toPandas()
    if name not in ORACLE:
        assert len(sdf.columns) > 0
        return
    ddf = duck.execute(ORACLE[name]).df()
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
