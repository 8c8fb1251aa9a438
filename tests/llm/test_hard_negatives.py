"""Hard negatives against a loop over all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinmatch.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, rank int, anchor string, slot int, id long"


def brute(rows, positives=5, negatives=5, low=80):
    live = [
        (i, [math.floor(256 * x) for x in v], l) for i, v, l in rows
        if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, v, l in live:
        if i is None or i % 100:
            continue
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, m) for j, w, m in live]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for top, j, _ in [s for s in scored if s[2] == l and s[1] != i][:positives]:
            found = [s for s in scored if s[2] != l and low * top <= 100 * s[0] <= 100 * top][:negatives]
            out += [(i, j, n + 1, k, top, score) for n, (score, k, _) in enumerate(found)]
    return sorted(out, key=str)


def answers(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA).repartition(7)
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=str)


def some_rows(n, labels, width, chance):
    return [(i, [chance.choice([-0.5, 0.1, 0.25, 0.5, 0.51]) for _ in range(width)], chance.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("low", [0, 50, 80, 100])
def test_windows_with_many_ties(spark, low):
    chance = random.Random(low)
    rows = some_rows(900, 3, 3, chance)
    assert answers(spark, rows, low=low, positives=4, negatives=3) == brute(rows, 4, 3, low)


def test_edges(spark):
    chance = random.Random(1)
    rows = some_rows(400, 2, 4, chance)
    rows += [(100, [0.5] * 4, 1), (7, [0.5] * 4, 0), (7, [0.5] * 4, 0), (7, [0.5] * 4, 1), (None, [0.5] * 4, 0), (None, [0.51] * 4, 1)]
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [math.nan, 1.0], 0), (800, [math.inf], 0), (900, [1.0, 1.0], None)]
    rows += [(1000, [], 1), (1100, [0.5, 0.5], 1), (1200, [0.25] * 9, 0), (-100, [-0.5] * 4, 1), (1300, [1e9, 3e9], 0), (1301, [1e9, 2.5e9], 1), (1302, [1e9, 1e9], 0)]
    rows += [(1400, [1e300, -1e300, 1.0], 1), (1401, [1e30, 0.0, 1.0], 1), (1402, [1e299], 0)]
    assert answers(spark, rows) == brute(rows)
    assert answers(spark, rows[:0]) == []
    assert answers(spark, [(100, [1.0], 1)]) == []


def test_anchors_in_blocks(spark, monkeypatch):
    rows = some_rows(1500, 4, 5, random.Random(3))
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 500)
    assert answers(spark, rows) == brute(rows)
