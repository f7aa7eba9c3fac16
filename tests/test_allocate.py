import pytest

from rulespark.catalog import QUERIES


@pytest.mark.parametrize("n", [0, 2700])
def test_every_supplier_is_allocated_a_number(spark, tmp_path, n):
    """In the order of names, which may repeat or be missing."""
    names = [None if i % 900 == 0 else f"Supplier#{i * 7 % 2000:04}" for i in range(n)]
    spark.createDataFrame([(i, name) for i, name in enumerate(names)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((r["number"], r["name"]) for r in QUERIES["q_allocate"](spark, str(tmp_path)).collect())
    assert got == [(2 * i, name) for i, name in enumerate(sorted(names, key=lambda x: (x is None, x or "")), 1)]
