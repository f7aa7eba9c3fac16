import random

from rulespark.llm import suffix_dedup
from rulespark.llm.suffix_dedup import without_repeats


def brute_force(rows, length):
    owner = {}
    for i, text in rows:
        body = (text or "").encode()
        for p in range(len(body) - length + 1) if i is not None else ():
            s = body[p : p + length]
            owner[s] = min(i, owner.get(s, i))
    out = []
    for i, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1) if i is not None else ():
            if owner[body[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, sum(gone), spans, bytes(b for b, g in zip(body, gone) if not g)))
    return out


def corpus(seed):
    pick = random.Random(seed)
    letters = "ab cdé"
    make = lambda n: "".join(pick.choice(letters) for _ in range(n))
    passages = [make(n) for n in (49, 50, 51, 60, 75, 76, 200)] + ["a" * 120, "ab" * 60]
    rows = [(1, None), (2, ""), (3, "short"), (None, passages[6]), (None, None)]
    for i in range(60):
        text = make(pick.randrange(80))
        for _ in range(pick.randrange(4)):
            p = pick.choice(passages)
            a = pick.randrange(0, 20)
            text += p[a : len(p) - pick.randrange(0, 15)] + make(pick.choice([0, 1, 30]))
        rows.append((pick.randrange(10, 60), text))  # some ids stand twice
    return rows


def agrees(spark, rows, length, files, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(files)
    got = [(r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeats(docs, length=length, **options).collect()]
    expected = brute_force(rows, length)
    assert sum(r[1] for r in expected) > 0
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(expected, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_removes_what_brute_force_removes(spark):
    for seed, files in ((1, 1), (2, 5), (3, 3)):
        agrees(spark, corpus(seed), 50, files)


def test_other_lengths(spark):
    agrees(spark, corpus(4), 20, 3, gram=10)


def test_texts_above_the_block_size(spark, monkeypatch):
    """In this process, as the workers have their own module."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    import numpy as np
    import pyarrow as pa

    body = corpus(5)[-1][1] + "xy" * 200
    ids, texts = np.array([1, 2]), pa.array([body.encode(), (body + "z").encode()], pa.large_binary())
    row, start, end = suffix_dedup._removed(ids, texts, np.empty(0, suffix_dedup.REQUEST), np.empty(0, suffix_dedup.ANSWER), 50, 25)
    assert set(row.tolist()) == {1} and start[0] == 0 and len(body.encode()) - 50 < end[-1] <= len(body.encode())


def test_work_of_a_file_and_of_a_bucket_is_in_proportion(tmp_path, monkeypatch):
    """Sorted rows, sent batches and time follow the rows, and not their
    number times that of blocks, buckets or files."""
    import time

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    pick = random.Random(6)
    texts = ["".join(pick.choice("abcdefgh ") for _ in range(2000)) for _ in range(100)]
    pq.write_table(pa.table({"doc_id": pa.array(range(100), pa.int64()), "text": texts}), tmp_path / "x.parquet")
    file = f"file:{tmp_path}/x.parquet"
    # many blocks
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 300)
    seen, distinct = [], suffix_dedup._distinct
    monkeypatch.setattr(suffix_dedup, "_distinct", lambda rows: seen.append(len(rows)) or distinct(rows))
    rows = suffix_dedup._file_variants(file, 50, 25)
    assert len(rows) > 10_000 and sum(seen) < 4 * len(rows)
    # many buckets
    batches = list(suffix_dedup._step_1(5000, 50, 25)(iter([pa.RecordBatch.from_pydict({"file": [file]})])))
    assert sum(b.num_rows for b in batches) > 1000 and len(batches) < 10

    # many files
    def seconds(files):
        parts = pa.array([p.tobytes() for p in np.array_split(np.concatenate([rows] * 8), files)], pa.binary())
        table = pa.table({"file": [f"f{i}" for i in range(files)], "rows": parts})
        began = time.process_time()
        suffix_dedup._owners((), table)
        return time.process_time() - began

    assert min(seconds(4000) for _ in range(3)) < 20 * max(min(seconds(4) for _ in range(3)), 0.01)
