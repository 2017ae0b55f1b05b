from __future__ import annotations

import pytest
from oracle_check import compare, connect

from skuflow.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, connect(sf), QUERIES[name], ORACLE[name], sf) == ""


def test_all_are_registered(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in names
