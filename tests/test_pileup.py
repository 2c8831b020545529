"""Points under spans: pairs, and what a pileup's totals need without them."""

import random
from collections import defaultdict

import pytest

from lociflow import driver_runs, driver_views
from lociflow.operators import pileup as P
from tests.test_driver_views import DATA


def test_depth_equals_the_pairs(spark):
    rng = random.Random(3)
    some = lambda x: None if rng.random() < 0.05 else x
    points = [(some(rng.randrange(3)), some(rng.randrange(-70, 70))) for _ in range(200)]
    spans = [(some(rng.randrange(3)), some(low := rng.randrange(-70, 70)), some(low + rng.randrange(-3, 40)), rng.choice([None, 1, 2])) for _ in range(150)]
    spans += [(9, 0, 8, None), (9, 8, 16, 5)]  # ends and starts at a bin's edge; nulls only
    points += [(9, 7), (9, 8), (9, 8), (9, 16)]
    want: dict = defaultdict(list)
    for k, at in points:
        for key, low, high, line in spans:
            if None not in (k, at, low, high) and k == key and low <= at < high:
                want[k, at].append((low, line))
    here = lambda k, at: sum(p == (k, at) for p in points)
    lines = lambda rows: [x for _, x in rows if x is not None]
    expected = {(k, at): (here(k, at), len(v) // here(k, at), sum(lines(v)) // here(k, at) if lines(v) else None, sum(x for x, _ in v) // here(k, at)) for (k, at), v in want.items()}
    got = P.depth(spark.createDataFrame(points, "k int, at long"), spark.createDataFrame(spans, "k int, low long, high long, line int"), ["k"], "at", "low", "high", ["line", "low"], 8)
    assert {(r.k, r["at"]): (r.n_points, r.n_spans, r.line, r.low) for r in got.collect()} == expected
    assert expected[9, 7][2] is None and (9, 16) not in expected


def test_totals_make_no_pairs(spark):
    plan = driver_views.pileup_range_join(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("name", ["run_records", "run_marks", "support_types"])
def test_reads_are_not_parsed_in_filters(spark, name):
    plan = driver_runs.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter ")]
    assert filters and not any("M2D" in x or "MIDNSHP" in x for x in filters)


def test_empty_and_unplaced_spans_match_nothing(spark):
    points = spark.createDataFrame([(1, 5), (1, 20), (None, 5)], "k int, at long")
    spans = spark.createDataFrame([(1, 5, 5), (1, 9, 2), (1, None, 9), (1, 3, None), (None, 0, 9), (1, 4, 21)], "k int, low long, high long")
    got = P.range_join(points, spans, ["k"], "at", "low", "high", 8).select("k", "at", "low", "high").collect()
    assert sorted(map(tuple, got)) == [(1, 5, 4, 21), (1, 20, 4, 21)]
