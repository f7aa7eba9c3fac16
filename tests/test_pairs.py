import random

import pytest
from pyspark.sql import functions as F

from rulespark import pairs
from rulespark.catalog import QUERIES


def brute(rows):
    return sorted({(a, b) for g, a in rows for h, b in rows if g is not None and g == h and a is not None and b is not None and a < b})


@pytest.mark.parametrize("most", [1, 3])
def test_pairs_of_blocks(spark, monkeypatch, most):
    """most: groups of one item."""
    monkeypatch.setattr(pairs, "BLOCK", 3)
    monkeypatch.setattr(pairs, "TASK", 50)
    r = random.Random(most)
    rows = [(r.choice([None, 1, 1, 1, 2, 3]) if most == 1 else r.randrange(4), i) for i in range(40) for _ in range(r.randint(1, most))]
    rows += [*rows[:7], (1, None), (None, None)]
    made = pairs.pairs_within(spark.createDataFrame(rows, "g long, i long"), "g", "i", "a", "b")
    assert sorted(map(tuple, made.collect())) == brute(rows)


def test_nothing_to_pair(spark):
    assert pairs.pairs_within(spark.createDataFrame([], "g long, i string"), "g", "i", "a", "b").collect() == []


def test_tasks_become_more_not_larger(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 50)
    monkeypatch.setattr(pairs, "TASK", 5_000)
    most = []
    for n in (400, 1600):
        made = pairs.pairs_within(spark.range(n).select(F.lit(1).alias("g"), "id"), "g", "id", "a", "b")
        counts = [r[1] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == n * (n - 1) // 2
        most.append(max(counts))
    assert max(most) < 20_000


def test_no_step_holds_the_pairs_of_suppliers(spark):
    plan = QUERIES["q_self_join_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan


def test_suppliers_without_a_nation_are_in_no_pair(spark, tmp_path):
    rows = [(None if i % 9 == 0 else i * i % 11, i % 70) for i in range(120)] + [(3, None)]
    spark.createDataFrame(rows, "s_nationkey int, s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(map(tuple, QUERIES["q_self_join_pairs"](spark, str(tmp_path)).collect())) == brute(rows)
