from pyspark.sql import functions as F

from rulespark import sources, streaming
from rulespark.rules import Atom, GroupBy, Head
from rulespark.session import Session


def test_micro_batches_are_transactions(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "k long, v string")
    for part in range(2):
        rows.where(f"k % 3 {'=' if part else '<>'} 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    session = Session(spark, {"item": ("k long, v string", "set", ())}, lambda p: (p.relation("total", "v", "n", output=True), p.rule(Head("total", v="v", n="n"), Atom("item", k="k", v="v"), GroupBy(("v",), {"n": "count(1)"}))))
    stream = spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streaming.run(stream, session, "item", lambda changes, n: sources.write_changes(changes, out, n), checkpoint=str(tmp_path / "cp")).awaitTermination()
    total = sources.read_changes(spark, out, "total")
    assert sorted(tuple(r) for r in total.df.collect()) == [("a", 3, 1), ("b", 3, 1)]


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "u"), ("2024-01-01 00:50:00", "u"), ("2024-01-01 01:10:00", "u"), ("2024-01-01 09:00:00", "u")], "t string, u string").withColumn("t", F.to_timestamp("t"))
    hours = streaming.tumbling(rows, "t", "1 hour", late="1 hour", n=F.count(F.lit(1))).collect()
    assert sorted((r.start.hour, r.n) for r in hours) == [(0, 2), (1, 1), (9, 1)]
    assert sorted(r.n for r in streaming.sessions(rows, "t", "1 hour", late="1 hour", keys=("u",), n=F.count(F.lit(1))).collect()) == [1, 3]
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    made = streaming.tumbling(stream, "t", "1 hour", late="1 hour", keys=("u",), n=F.count(F.lit(1)))
    q = made.writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start.hour, r.n) for r in spark.table("hours").collect())[:2] == [(0, 2), (1, 1)]


def test_fact_files(spark, tmp_path):
    facts = spark.createDataFrame([(1, "a"), (2, "b c")], "k long, v string")
    sources.write_facts(facts, str(tmp_path / "f"))
    assert sorted(tuple(r) for r in sources.read_facts(spark, str(tmp_path / "f"), "k long, v string").collect()) == [(1, "a"), (2, "b c")]
    (tmp_path / "e.csv").write_text("src,dst\n1,2\n")
    assert [tuple(r) for r in sources.read_edges(spark, str(tmp_path / "e.csv")).collect()] == [(1, 2)]
    assert sources.from_arrow(spark, sources.to_arrow(facts)).count() == 2
    assert sources.read_text(spark, str(tmp_path / "e.csv")) == "src,dst\n1,2\n"
