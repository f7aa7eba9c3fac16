import random

from rulespark.llm.minhash import near_duplicates


def test_links_of_repeated_and_null_ids(spark):
    pick = random.Random(1)
    text = lambda n=60: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    a, b, c, d = text(), text(), text(), text()
    near = lambda words: " ".join([*words[:-1], "changed"])
    rows = [
        (10, " ".join(a)), (10, " ".join(b)),  # one id, two texts
        (20, near(a)), (21, near(b)), (5, near(near(b).split()[:-1] + ["x"])),
        (30, " ".join(c)), (None, " ".join(c)), (None, near(c)), (None, None),
        (40, " ".join(d)), (41, " ".join(d)), (42, None), (41, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs, shingle=2, similarity=(80, 100)).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {
        (10, 5, False), (20, 5, False), (21, 5, False), (5, 5, True),
        (30, 30, True), (None, None, True), (40, 40, True), (41, 40, False), (42, 42, True),
    }
