import datetime
import decimal

import pytest
from frames import values
from pyspark.sql import functions as F

from vectorlens.functions.predicates import apply_filters, apply_membership_filters
from vectorlens.operators import cascade, profile


def count(df, filters):
    return apply_filters(df, filters).count()


def test_filter_kinds(mixed):
    assert count(mixed, {"species": ["cat"]}) == 8
    assert count(mixed, {"weight": {"min": 4.0, "max": 30.0}}) == 12
    assert count(mixed, {"notes": "BREED"}) == 4
    assert count(mixed, {"species": ["cat", "dog"], "weight": {"max": 4.0}}) == 4
    assert count(mixed, {"notes": " breed"}) == 4


def test_ineffective_filters_change_nothing(mixed):
    assert count(mixed, {}) == 20
    inert = {"absent": ["x"], "species": [], "notes": "   ", "weight": {"min": None}, "family": None, "uuid": 7}
    assert count(mixed, inert) == 20


def test_text_is_literal(spark):
    df = spark.createDataFrame([("50% off.",), ("500 off",)], "note string")
    assert count(df, {"note": "50%"}) == 1
    assert count(df, {"note": "off."}) == 1


def test_text_filter_needs_a_string_column(mixed):
    with pytest.raises(TypeError):
        apply_filters(mixed, {"weight": "4"})


def test_range_keeps_nan_and_null_out(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,), (inf,), (-inf,)], "v double")
    assert values(apply_filters(df, {"v": {"min": 0}})) == [(1.0,), (5.0,), (inf,)]
    assert values(apply_filters(df, {"v": {"max": 9}})) == [(-inf,), (1.0,), (5.0,)]


def test_listed_none_matches_null(spark):
    df = spark.createDataFrame([("A",), (None,), ("B",)], "c string")
    assert count(df, {"c": ["A", None]}) == 2
    assert count(df, {"c": [None]}) == 1
    assert count(df, {"c": ["A"]}) == 1


def test_membership_filters_are_strict(mixed):
    assert apply_membership_filters(mixed, {"species": ["cat"], "family": [], "_note": "x"}).count() == 8
    with pytest.raises(ValueError):
        apply_membership_filters(mixed, {"absent": ["x"]})


def profiled(df):
    return {r["column"]: r.asDict() for r in profile.profile(df).collect()}


def test_profile_classes(spark):
    rows = [
        (f"u{i}", [1.0], i, decimal.Decimal(i), f"t{i}", "abc"[i % 3], i % 2 == 0, datetime.date(2024, 1, 1 + i % 5),
         None, None, (i, "x"), {"k": i}, [i])
        for i in range(150)
    ]
    schema = (
        "uuid string, Embedding array<float>, n int, d decimal(10,2), many_unique string, cat string, flag boolean, "
        "day date, nothing string, no_list array<int>, pair struct<a:int,b:string>, lookup map<string,int>, items array<int>"
    )
    found = {name: facts["type"] for name, facts in profiled(spark.createDataFrame(rows, schema)).items()}
    assert found == {
        "n": "numeric", "d": "numeric", "many_unique": "text", "cat": "categorical", "flag": "categorical",
        "day": "categorical", "nothing": "empty", "no_list": "empty", "pair": "text", "lookup": "text",
    }


def test_profile_null_share(spark):
    facts = profiled(spark.createDataFrame([(1,), (None,), (3,), (None,), (5,)], "col long"))["col"]
    assert (facts["null_count"], facts["total_count"], facts["null_pct"]) == (2, 5, 40.0)


@pytest.mark.parametrize("distinct, nulls, expected", [(100, 0, "categorical"), (101, 0, "text"), (100, 1, "text"), (99, 1, "categorical")])
def test_category_limit_counts_null(spark, distinct, nulls, expected):
    rows = [(f"v{i % distinct}",) for i in range(3 * distinct)] + [(None,)] * nulls
    facts = profiled(spark.createDataFrame(rows, "c string"))["c"]
    assert facts["type"] == expected
    assert facts["n_unique"] == (distinct if expected == "categorical" else None)


def test_sketch_never_hides_a_category(spark):
    """Many columns of exactly 100 values: no sketch estimate may pass the cutoff."""
    df = spark.range(1000).select(
        "id", *[F.concat(F.lit(f"salt{j}-"), (F.col("id") % 100).cast("string")).alias(f"c{j}") for j in range(60)]
    )
    assert {f.kind for f in profile.column_facts(df) if f.name != "id"} == {"countable"}


def test_value_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "it's string".replace("it's", "`it's`"))
    assert values(profile.value_counts(df)) == [("it's", "a", 2), ("it's", "b", 1)]


def test_cascading_options(mixed):
    def offered(target, filters):
        return [r["value"] for r in cascade.options(mixed, target, filters).collect()]

    assert offered("species", {"family": ["felidae"]}) == ["cat"]
    assert offered("species", {"species": ["cat"], "family": []}) == ["bird", "cat", "dog"]
    assert offered("weight", {}) == []
    assert offered("notes", {"species": ["bird"], "notes": "zzz"}) == ["sparrow"]


def test_all_cascades_agree_with_single_ones(mixed):
    filters = {"species": ["cat", "dog"], "family": ["canidae"], "weight": {"min": 4.0}}
    together = cascade.options_for_all(mixed, ["species", "family", "notes"], filters)
    for target in ("species", "family", "notes"):
        single = [r["value"] for r in cascade.options(mixed, target, filters).collect()]
        assert sorted(r["value"] for r in together.filter(F.col("column") == target).collect()) == single


def test_numeric_range_clamps(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, "a"), (5.0, "a"), (9.0, "b")], "v double, c string")
    row = cascade.numeric_range(df, "v", {"c": ["a"], "v": {"min": -3.0, "max": 7.0}}).first()
    assert tuple(row) == (1.0, 5.0, 1.0, 5.0, True, False)
    row = cascade.numeric_range(df, "v", {"c": ["a"], "v": {"min": 2.0}}).first()
    assert tuple(row) == (1.0, 5.0, 2.0, 5.0, True, True)
    row = cascade.numeric_range(df, "v", {"c": ["b"]}).first()
    assert tuple(row) == (9.0, 9.0, 9.0, 9.0, False, False)


def test_prune_and_preview(mixed):
    filters = {"species": ["dog", "gone", "cat"], "family": ["canidae"]}
    assert values(cascade.prune_selection(mixed, "species", filters)) == [(1, "dog")]
    assert tuple(cascade.preview(mixed, filters).first()) == (8, 20, 40.0)
    assert tuple(cascade.preview(mixed, {}).first()) == (20, 20, 100.0)
    assert tuple(profile.clusters_from_column(mixed, "species", {"family": ["felidae", "canidae"]}).first()) == (2, 2, 8)
