"""The registered queries on training text, as the others are run."""

import pytest

from ripplegraph.llm import queries
from test_queries import SF, agrees, duck, pytestmark  # noqa: F401


def test_every_problem_has_its_query():
    assert {"p4_found", "p5_found", "p6_packed", "p7_found", "p8_found"} <= set(queries.QUERIES) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    agrees(spark, duck, name)
