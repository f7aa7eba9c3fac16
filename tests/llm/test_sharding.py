import random
import zlib

from rulespark.llm.sharding import RoomTree, best_fit_bins, shard


def test_tree_takes_the_tightest():
    rnd, tree, held = random.Random(4), RoomTree(), []
    for step in range(3000):
        if rnd.random() < 0.6:
            key = (rnd.randint(0, 50), step)
            tree.insert(key)
            held.append(key)
        else:
            size = rnd.randint(0, 50)
            want = min((k for k in held if k[0] >= size), default=None)
            assert tree.take(size) == want
            if want:
                held.remove(want)


def test_runs_are_best_fit_decreasing():
    rnd = random.Random(6)
    for _ in range(100):
        sizes = [rnd.randint(1, 40) for _ in range(60)]
        runs = best_fit_bins([(s, sizes.count(s)) for s in set(sizes)], 50)
        ours = {}
        for size, _, n, at in runs:
            ours[at] = ours.get(at, 0) + size * n
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= s]
            if fits:
                rooms[min(fits, key=lambda i: (rooms[i], i))] -= s
            else:
                rooms.append(50 - s)
        assert sorted(50 - x for x in ours.values()) == sorted(rooms)


def test_shards_keep_groups_and_are_near_equal(spark):
    rnd = random.Random(8)
    texts = [None, ""] + ["é" * rnd.randint(0, 400) + str(i) for i in range(3000)] + ["copy"] * 60
    rows = [(i % 3000, t, 5) for i, t in enumerate(texts)] + [(None, "no id", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard(docs, shards=24).collect()
    assert len(got) == len(rows)
    body = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len(body(t)) + 8, zlib.crc32(body(t))) for i, t, _ in rows)
    where = {}
    for r in got:
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    bytes_of, slots = {}, {}
    for r in got:
        bytes_of[r.shard] = bytes_of.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(bytes_of) == set(range(24))
    assert max(bytes_of.values()) - min(bytes_of.values()) < 0.02 * sum(bytes_of.values()) / 24
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_table_and_one_group(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shard(docs).count() == 0
    same = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a")], docs.schema)
    assert sorted((r.shard, r.slot) for r in shard(same).collect()) == [(0, 0), (0, 1), (0, 2)]
