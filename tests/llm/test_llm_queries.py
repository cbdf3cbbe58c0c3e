import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import assert_same, views  # noqa: E402

from lexgrain.llm import queries  # noqa: E402

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in SQL:
        assert_same(QUERIES[name](spark, data), SQL[name], views(data))
    else:
        assert len(QUERIES[name](spark, data).toPandas()) > 0
