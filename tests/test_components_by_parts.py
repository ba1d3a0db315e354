"""Components over a share of the edges first, then over the edges between those, against the plain ones."""

import random

import pytest

from strataline.plans.components import components_by_parts, connected_components


@pytest.mark.parametrize("share", [1, 3, 1_000_000])
def test_components_by_parts(spark, share):
    rng = random.Random(share)
    rows = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(90, 90), (95, 95), (95, 96), (None, 3), (4, None)] + [(k, k + 1) for k in range(100, 140)]
    edges = spark.createDataFrame(rows, "a long, b long")
    got = components_by_parts(edges, "a", "b", share).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, connected_components(edges, "a", "b").collect()))
