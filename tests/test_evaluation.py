import itertools
import math
import random

import pytest
from frames import values

from vectorlens.operators import evaluation


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "k string, c string")


def metrics(spark, pairs):
    row = evaluation.agreement(frame(spark, pairs), "k", "c").first()
    return row["ari"], row["nmi"]


def brute_ari(pairs):
    same_both = same_k = same_c = total = 0
    for (k1, c1), (k2, c2) in itertools.combinations(pairs, 2):
        total += 1
        same_k += k1 == k2
        same_c += c1 == c2
        same_both += k1 == k2 and c1 == c2
    expected = same_k * same_c / total
    highest = (same_k + same_c) / 2
    return 1.0 if highest == expected else (same_both - expected) / (highest - expected)


def brute_nmi(pairs):
    n = len(pairs)

    def entropy(items):
        items = list(items)
        return -sum(items.count(v) / n * math.log(items.count(v) / n) for v in set(items))

    h_k, h_c = entropy(k for k, _ in pairs), entropy(c for _, c in pairs)
    return (h_k + h_c - entropy(pairs)) / ((h_k + h_c) / 2)


@pytest.mark.parametrize("seed", range(3))
def test_agreement_against_pair_counting(spark, seed):
    chance = random.Random(seed)
    pairs = [(str(chance.randrange(4)), str(chance.randrange(3))) for _ in range(60)]
    ari, nmi = metrics(spark, pairs)
    assert ari == pytest.approx(brute_ari(pairs), abs=1e-12)
    assert nmi == pytest.approx(brute_nmi(pairs), abs=1e-12)


def test_agreement_edges(spark):
    assert metrics(spark, [("0", "a"), ("0", "a"), ("1", "b")]) == pytest.approx((1.0, 1.0))
    assert metrics(spark, [("1", "a"), ("0", "b"), ("1", "a")]) == pytest.approx((1.0, 1.0))
    assert metrics(spark, [("0", "a")] * 4) == (1.0, 1.0)
    assert metrics(spark, [("0", "a"), ("0", "b"), ("0", "c")]) == (0.0, 0.0)
    ari, nmi = metrics(spark, [(k, c) for k in "012" for c in "abcd"] * 3)
    assert nmi == 0.0 and ari < 0


def test_large_groups_do_not_overflow(spark):
    df = spark.range(200_000).selectExpr("cast(id % 2 as string) k", "cast(id % 2 as string) c")
    assert evaluation.agreement(df, "k", "c").first()["ari"] == 1.0


def test_missing_categories(spark):
    pairs = [("0", "a"), ("0", None), ("0", "N/A"), ("1", "b")]
    row = evaluation.agreement(frame(spark, pairs), "k", "c").first()
    assert tuple(row) == (2, 2, pytest.approx(1.0), pytest.approx(1.0))
    shares = {r["cluster"]: r for r in evaluation.purity_entropy(frame(spark, pairs), "k", "c").collect()}
    assert shares["0"]["purity"] == pytest.approx(2 / 3)
    assert shares["0"]["entropy"] == pytest.approx(0.9182958)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("0", 1.0), ("0", float("nan")), ("1", None)], "k string, c double")
    assert tuple(evaluation.row_counts(df, "c").first()) == (1, 2)
    assert values(evaluation.contingency(df, "k", "c")) == [("0", "1.0", 1), ("0", "N/A", 1), ("1", "N/A", 1)]


def test_nothing_to_evaluate(spark):
    row = evaluation.agreement(frame(spark, [("0", None), ("1", "N/A")]), "k", "c").first()
    assert tuple(row) == (0, 2, None, None)


def test_composition_order(spark):
    pairs = [("0", "b"), ("0", "a"), ("0", "c"), ("0", "c")]
    found = values(evaluation.composition(frame(spark, pairs), "k", "c"), "rank", "category", "n", "pct")
    assert found == [(1, "c", 2, 50.0), (2, "a", 1, 25.0), (3, "b", 1, 25.0)]


def test_composition_tree_text(spark):
    pairs = [("2", "cat")] * 3 + [("2", "dog")] + [("10", "dog")] * 12
    tree = evaluation.composition_tree(frame(spark, pairs), "k", "c").sort("line_no")
    assert [r["line"] for r in tree.collect()] == [
        "KMeans Clustering Summary (16 points, 2 clusters)",
        "Compared against: c",
        "",
        "├── Cluster 2  [4 pts]  purity: 75%  entropy: 0.81",
        "│   ├─ cat                     3   75.0%",
        "│   └─ dog                     1   25.0%",
        "└── Cluster 10  [12 pts]  purity: 100%  entropy: 0.00",
        "    └─ dog                    12  100.0%",
    ]
