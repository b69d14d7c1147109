import pytest

from nimbusops.llm.components import components
from nimbusops.session import Staging


@pytest.mark.parametrize("links, expected", [
    ([(i, i + 1) for i in range(60)], {i: 0 for i in range(1, 61)}),  # a long chain
    ([(0, i) for i in range(1, 50)] + [(100, 101), (101, 100), (5, 5)], {**{i: 0 for i in range(1, 50)}, 101: 100}),
    ([(9, 3), (3, 7), (7, 1), (20, 9)], {3: 1, 7: 1, 9: 1, 20: 1}),
    ([], {}),
])
def test_components(spark, links, expected):
    table = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.root for r in components(table, Staging(spark)).collect()} == expected
