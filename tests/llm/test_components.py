"""Components that aren't finished are never returned."""

import pytest

from knotwork.llm.components import components


def test_the_bound_is_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="not stable after 1 rounds"):
        components(chain, rounds=1)
    assert {(r["node"], r["root"]) for r in components(chain).collect()} == {(i, 0) for i in range(41)}
