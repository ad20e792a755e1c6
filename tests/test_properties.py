"""Random filters against the same conditions in plain Python."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectorlens.functions.predicates import apply_filters, column_predicates
from vectorlens.operators import cascade

ROWS = [
    (i, [None, "a", "B", "ab", ""][i % 5], [None, float("nan"), -1.0, 0.0, 2.5, math.inf][i % 6], ["x", "X%", "xy", None][i % 4])
    for i in range(120)
]

FILTERS = st.fixed_dictionaries(
    {},
    optional={
        "c": st.one_of(st.none(), st.lists(st.sampled_from([None, "a", "B", "zz"]), max_size=3)),
        "v": st.fixed_dictionaries(
            {}, optional={"min": st.sampled_from([None, -1.0, 0.0, 3.0]), "max": st.sampled_from([None, 0.0, 2.5, math.inf])}
        ),
        "t": st.sampled_from(["", "  ", "x", "X%", "y"]),
        "absent": st.just(["q"]),
    },
)


def keeps(row, filters):
    _, c, v, t = row
    listed = filters.get("c")
    if listed and c not in listed:
        return False
    bounds = {k: b for k, b in filters.get("v", {}).items() if b is not None}
    if bounds:
        if v is None or math.isnan(v):
            return False
        if v < bounds.get("min", -math.inf) or v > bounds.get("max", math.inf):
            return False
    text = filters.get("t", "")
    return not text.strip() or (t is not None and text.lower() in t.lower())


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id int, c string, v double, t string").cache()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(filters=FILTERS)
def test_filters_keep_the_same_rows(frame, filters):
    expected = [row[0] for row in ROWS if keeps(row, filters)]
    assert sorted(r["id"] for r in apply_filters(frame, filters).collect()) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(filters=FILTERS)
def test_cascades_offer_what_the_other_filters_leave(frame, filters):
    found = cascade.options_for_all(frame, ["c", "t"], filters).collect()
    for position, target in ((1, "c"), (3, "t")):
        others = {k: f for k, f in filters.items() if k != target}
        expected = {row[position] for row in ROWS if keeps(row, others)} - {None}
        assert {r["value"] for r in found if r["column"] == target} == expected
    assert "absent" not in column_predicates(frame.withColumn("z", F.lit(1)), filters)
