import hashlib

import numpy as np
import pytest

from vectorlens.llm import vector_codes


def table(spark, rows):
    full = [(*r, "x", "x", "x", 0) for r in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, part string, entry string, s string, n int")


def brute(rows, rounds=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], dtype=np.float32).tolist()))
    kept = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 1024).astype(np.int64).tolist(), label) for i, v, label in rows]
    width = len(kept[0][1])
    part = -(-width // 4)
    cut = [[(v + [0] * (4 * part - width))[p * part : (p + 1) * part] for p in range(4)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:256]] for p in range(4)]

    def assign(p):
        found = []
        for c in cut:
            gaps = [sum((a - b) ** 2 for a, b in zip(c[p], e)) for e in books[p]]
            best = min(range(len(gaps)), key=lambda k: (gaps[k], k))
            found.append((best, gaps[best]))
        return found

    for _ in range(rounds):
        for p in range(4):
            near = assign(p)
            for e in range(len(books[p])):
                members = [c[p] for c, (n, _) in zip(cut, near) if n == e]
                if members:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    near = [assign(p) for p in range(4)]
    errors = [sum(near[p][i][1] for p in range(4)) for i in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    flat = ",".join(str(x) for b in books for e in b for x in e)
    mark = hashlib.sha256(flat.encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{near[p][i][0]:02x}" for p in range(4)), errors[i], by_label[r[2]], mark) for i, r in enumerate(kept)), key=repr
    )


def found(df, **more):
    out = vector_codes.code_report(df, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, out.collect()), key=repr)


def drawn(n, width, seed=5, labels=4):
    random = np.random.RandomState(seed)
    return [(i, [float(x) for x in random.randn(width)], int(random.randint(labels))) for i in range(n)]


@pytest.mark.parametrize("size", [1, 2, 8, 32])
def test_transform_is_the_matrix_in_sequency_order(size):
    matrix = vector_codes.sequency(size)
    assert ((np.diff(matrix, axis=1) != 0).sum(axis=1) == np.arange(size)).all()
    x = np.random.RandomState(1).randint(-900, 900, (6, size))
    assert (vector_codes.transformed(x) == x @ matrix.T).all()


@pytest.mark.parametrize("width", [1, 3, 16, 21])
def test_search_is_exact_and_ties_go_low(width):
    random = np.random.RandomState(width)
    points, entries = random.randint(-40, 40, (500, width)), random.randint(-40, 40, (256, width))
    entries[100:140] = entries[3:43]
    gaps = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    near, error, taken = vector_codes.nearest_entries(points, entries)
    assert (near == gaps.argmin(axis=1)).all() and (error == gaps.min(axis=1)).all()
    assert taken <= 500 * 256 * vector_codes.transformed(entries).shape[1] * 1.1


def test_elimination_saves_work():
    random = np.random.RandomState(2)
    steps = np.cumsum(random.randn(4000, 16), axis=1)
    points = np.floor(steps * 100).astype(np.int64)
    _, _, taken = vector_codes.nearest_entries(points[256:], points[:256])
    assert taken < 0.5 * (4000 - 256) * 256 * 16


def test_largest_components_stay_exact():
    m = vector_codes.largest_component(16)
    points = np.array([[m] * 16, [-m] * 16], dtype=np.int64)
    near, error, _ = vector_codes.nearest_entries(points, points[1:])
    assert near.tolist() == [0, 0] and error.tolist() == [16 * (2 * m) ** 2, 0]


@pytest.mark.parametrize("n, width", [(320, 8), (300, 10), (40, 4)])
def test_codes_against_brute_force(spark, n, width):
    rows = drawn(n, width)
    rows += [(n, rows[0][1], None), (n, rows[0][1], None), (None, rows[1][1], None)]  # repeated id, null id, null labels
    bad = [(-1, None, 1), (-2, [None] * width, 1), (-3, [float("nan")] * width, 1), (-4, [float("inf")] + [0.0] * (width - 1), 2)]
    assert found(table(spark, bad + rows)) == brute(rows)


def test_other_widths_and_huge_components_take_no_part(spark):
    rows = drawn(20, 8)
    assert found(table(spark, rows + [(50, [1.0], 1), (51, [], 1), (52, [1e30] * 8, 1)])) == brute(rows)


def test_repeated_smallest_id(spark):
    rows = [(0, v, label) for _, v, label in drawn(400, 4)]
    assert found(table(spark, rows), rounds=1) == brute(rows, rounds=1)


def test_empty_table_and_nothing_that_takes_part(spark):
    assert found(table(spark, [])) == [] and found(table(spark, [(1, None, 1)])) == []
