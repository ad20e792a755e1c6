import pytest

# Columns that operators use for themselves, put on the input to show that they do not clash.
CLASHING = "node token bucket at size text_key before words n m need prefix shard slot rank target taken part file start comp p q"


@pytest.fixture(scope="session")
def documents(spark):
    """Build documents from ``(doc_id, text, lang, source)`` rows, with extra columns whose names clash."""

    def make(rows):
        full = [(*r, None, None, None)[:4] for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, "
        schema += ", ".join(f"{c} string" for c in CLASHING.split())
        extra = len(CLASHING.split())
        return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * extra) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Invented texts with copies, near copies, a shared line, nulls, empty texts, repeats and one very long text."""
    import random

    random = random.Random(11)
    word = lambda: "".join(random.choice(["ka", "lo", "mi", "ru", "te", "so"]) for _ in range(random.randint(1, 4)))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(random.randint(1, 150))]
        rows.append((i, " ".join(words), "xx", f"s{i % 4}"))
    for i in range(60, 150):  # near copies of one text, some of them with the shared line
        words = list(base)
        for _ in range(random.randint(0, 5)):
            words[random.randrange(len(words))] = word()
        rows.append((i, " ".join(words), "xx", "s0"))
    line = " ".join(word() for _ in range(25))
    rows += [(150 + i, line + "\n" + " ".join(word() for _ in range(40)), "yy", None) for i in range(20)]
    rows += [(170 + i, " ".join(base), "xx", "s0") for i in range(10)]
    rows += [(180, "", "xx", "s1"), (181, None, "xx", "s1"), (182, " \n\t ", None, "s1"), (183, "One", "yy", "s1"), (184, "one", "yy", "s1")]
    rows += [(185, "A b C", "yy", "s2"), (186, "a  B\tc", "yy", "s2"), (187, "é ñ ü 漢字 " * 9, "yy", "s2")]
    rows += [(188, " ".join(word() for _ in range(20_000)), "xx", "s3"), (189, "x" * 50_000, None, "s3")]
    return rows
