"""Every registered query of the engine against its SQL on the driver's tables."""

import oracle
import pytest

from tidemark.plans import feed_oracles, feed_queries, page_oracles, pages, store_oracles, store_queries  # noqa: F401
from tidemark.plans.oracles import ORACLE_SQL
from tidemark.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert oracle.differences(df, oracle.connection(sf_dir), ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0
