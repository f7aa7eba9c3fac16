import math
import random

import numpy as np

from rulespark.llm.topk import best, products, top_k
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, v string"


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (q, a) in enumerate(good):
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, **options):
    vectors = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in top_k(vectors, F.col("vec_id") % 20 == 0, **options).collect())


def test_equals_brute_force_with_ties_nulls_and_clashing_columns(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(6)], 0, "x") for i in range(700)]
    rows += [(i, [0.5] * 6, 0, "x") for i in range(700, 900)]
    rows += [(900, None, 0, "x"), (920, [None] + [1.0] * 5, 0, "x"), (940, [float("nan")] * 6, 0, "x"), (None, [1.0] * 6, 0, "x"), (960, [float("inf")] * 6, 0, "x")]
    assert found(spark, rows, k=20) == brute(rows, 20)


def test_far_clusters_are_pruned_and_still_exact(spark):
    rnd = random.Random(5)
    rows = [(i, [(10 * (i % 7) if j == i % 4 else 0) + rnd.random() for j in range(4)], 0, "") for i in range(1500)]
    assert found(spark, rows, k=20) == brute(rows, 20)


def test_fewer_candidates_than_k_and_empty_table(spark):
    rows = [(0, [1.0, 2.0], 0, ""), (20, [0.5, 0.5], 0, ""), (3, [1.0, 1.0], 0, "")]
    assert found(spark, rows, k=20) == brute(rows, 20)
    assert found(spark, [], k=20) == []


def test_large_components_use_exact_products():
    a = np.array([[2**28, 2**28 + 1]], np.int64)
    assert products(a, a)[0, 0] == 2**56 + (2**28 + 1) ** 2
    row, ids, score = best(np.array([[5, 7, 7, 1]]), np.array([4, 9, 2, 1]), np.array([1]), 2)
    assert ids.tolist() == [2, 9]
