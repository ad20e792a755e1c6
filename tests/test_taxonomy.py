import pytest
from frames import values
from pyspark.sql import functions as F

from vectorlens.operators import taxonomy

OWL = ("Animalia", "Chordata", "Aves", "Strigiformes", "Strigidae", "Strix", "S. aluco")
FERN = ("Plantae", "Tracheophyta", "Polypodiopsida", "Polypodiales", "Athyriaceae", "Athyrium", "A. filix-femina")
SCHEMA = ", ".join(f"`{level}` string" for level in taxonomy.LEVELS)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def lines(df, **options):
    return [r["line"] for r in taxonomy.tree_lines(df, **options).sort("line_no").collect()]


def test_leaves_fill_unknown(spark):
    rows = [OWL, OWL, (None, *OWL[1:]), ("", "p", None, "", None, None, None)]
    unknown = taxonomy.UNKNOWN
    assert values(taxonomy.leaf_counts(frame(spark, rows))) == [
        (*OWL, 2),
        (unknown, "p", *[unknown] * 5, 1),
    ]


def test_missing_columns(spark):
    df = frame(spark, [OWL]).select("kingdom", "species")
    assert tuple(taxonomy.leaf_counts(df).first())[1:7] == (*[taxonomy.UNKNOWN] * 5, "S. aluco")
    with pytest.raises(ValueError):
        taxonomy.leaf_counts(df.drop("kingdom"))


def test_statistics_count_paths(spark):
    rows = [OWL, FERN, (*FERN[:2], *[None] * 5), (*OWL[:1], *[None] * 6)]
    found = dict(values(taxonomy.statistics(frame(spark, rows))))
    assert found == {
        "total_records": 4, "kingdom": 2, "phylum": 3, "class": 4, "order": 4, "family": 4, "genus": 4, "species": 4,
    }


def test_empty(spark):
    empty = frame(spark, [])
    assert taxonomy.leaf_counts(empty).count() == 0
    assert lines(empty) == []


def test_subtree_totals(spark):
    totals = taxonomy.subtree_totals(frame(spark, [OWL, OWL, FERN]))
    by_path = {tuple(r["path"]): r["n"] for r in totals.collect()}
    assert by_path[()] == 3 and by_path[("Animalia",)] == 2 and by_path[FERN] == 1
    assert len(by_path) == 15


def test_tree_text(spark):
    eagle_owl = (*OWL[:5], "Bubo", "B. bubo")
    barn_owl = (*OWL[:4], "Tytonidae", "Tyto", "T. alba")
    great_grey = (*OWL[:6], "S. nebulosa")
    found = lines(frame(spark, [OWL, OWL, *[great_grey] * 3, eagle_owl, barn_owl, barn_owl, FERN]), min_count=1)
    assert found == [
        "Animalia (8)",
        "└── Chordata (8)",
        "    └── Aves (8)",
        "        └── Strigiformes (8)",
        "            ├── Strigidae (6)",
        "            │   ├── Bubo (1)",
        "            │   │   └── B. bubo (1)",
        "            │   └── Strix (5)",
        "            │       ├── S. nebulosa (3)",
        "            │       └── S. aluco (2)",
        "            └── Tytonidae (2)",
        "                └── Tyto (2)",
        "                    └── T. alba (2)",
        "Plantae (1)",
        "└── Tracheophyta (1)",
        "    └── Polypodiopsida (1)",
        "        └── Polypodiales (1)",
        "            └── Athyriaceae (1)",
        "                └── Athyrium (1)",
        "                    └── A. filix-femina (1)",
    ]


def test_min_count_and_depth(spark):
    df = frame(spark, [*[OWL] * 4, *[FERN] * 3])
    assert [line.split()[-2] for line in lines(df, min_count=4, max_depth=3)] == ["Animalia", "Chordata", "Aves"]
    assert lines(df, min_count=3, max_depth=1) == ["Animalia (4)", "Plantae (3)"]


def test_inner_node_needs_a_large_child(spark):
    """A kingdom of eight in two phyla of four is not shown at six."""
    rows = [OWL] * 4 + [("Animalia", "Mollusca", *OWL[2:])] * 4
    assert lines(frame(spark, rows), min_count=6) == []
    assert lines(frame(spark, rows), min_count=4)[0] == "Animalia (8)"


def test_restrict_to_cluster(spark):
    df = frame(spark, [OWL, FERN]).withColumn("uuid", F.when(F.col("kingdom") == "Plantae", 1).otherwise(0))
    plot = spark.createDataFrame([(0, "10"), (0, "10"), (1, "9")], "uuid int, label string")
    assert taxonomy.restrict_to_cluster(df, plot, "label", "10").count() == 1
    assert taxonomy.restrict_to_cluster(df, plot, "label", "All").count() == 2
    choices = values(taxonomy.cluster_choices(plot, "label"))
    assert choices == [(0, "All"), (1, "9"), (2, "10")]
