import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rulespark.llm.packing import best_fit, pack
from rulespark.llm.tokens import Encoder, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "it's  we'll\n\n I'D 12½", "<|endoftext|> a<|startoftext|>", "漢字 mixed é̂", "x" * 5000, "repeat me", "repeat me", "word " * 9000]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_ids_are_the_library_s(path, kind):
    rnd = random.Random(2)
    letters = "aZ éßÀ×÷ª¼² 9\n\t\x0b\x1c\x85\xa0'sStreVELLm.,!-_<|>漢٣İıſŉ"
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    ours, library = Encoder(path, kind), Tokenizer.from_file(path)
    assert ours.ids(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_counts_and_cache(spark, tmp_path):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "clash"), (0, "same id", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    library = Tokenizer.from_file(BYTE)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(docs, BYTE, cache=cache).collect())
        assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, _ in rows})
    more = docs.union(spark.createDataFrame([(99, "one more", "x")], docs.schema))
    assert token_counts(more, BYTE, cache=cache).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in rows}) + 1
    assert token_counts(docs.limit(0), BYTE).count() == 0


def one_by_one(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(200):
        window = rnd.choice([7, 16, 50])
        lengths = [rnd.randint(1, window) for _ in range(rnd.randint(0, 80))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs, windows = best_fit(counts, window)
        used = {}
        for n, c in counts.items():
            mine = runs[runs[:, 0] == n]
            for rank in range(c):
                run = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
                i = rank - run[1]
                used.setdefault(int(run[2] + i // run[3]), []).append((int(run[4] + i % run[3] * n), n))
        for spans in used.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= window
        assert len(used) == windows
        assert sorted(window - sum(n for _, n in s) for s in used.values()) == one_by_one(lengths, window)


def test_pieces_cover_every_id_once(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(i, "tail " * (i % 90), 1) for i in range(100, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    pieces = pack(docs, WORD).collect()
    library = Tokenizer.from_file(WORD)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert set(by_doc) == {i for i, *_ in rows}
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert pack(docs.limit(0), WORD).count() == 0
