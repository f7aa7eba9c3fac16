from rulespark.llm.decontamination import decontaminate, without_contaminated


def test_same_rows_for_one_block_and_for_several(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    leak, clean = words("leak", 20), words("clean", 20)
    docs = spark.createDataFrame(
        [(1, leak), (1, clean), (2, clean), (2, clean), (None, leak), (None, clean), (3, None), (4, f"{leak} {words('other', 20)}")], "doc_id long, text string"
    )
    benchmark = spark.createDataFrame([(7, leak), (7, words("leak", 15)), (8, words("other", 16)), (9, "")], "item_id long, text string")
    runs = []
    for block_bytes in (1 << 20, 64):
        found = decontaminate(docs, benchmark, block_bytes=block_bytes).collect()
        runs.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found))
    assert runs[0] == [
        (False, 1, 20, 0, [], False),
        (False, 1, 20, 20, ["7"], True),
        (False, 2, 20, 0, [], False),
        (False, 2, 20, 0, [], False),
        (False, 3, 0, 0, [], False),
        (False, 4, 40, 36, ["7", "8"], True),
        (True, 0, 20, 0, [], False),
        (True, 0, 20, 20, ["7"], True),
    ]
    assert runs[1] == runs[0]


def test_no_document_keeps_a_window_however_long_it_is(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    item, short = words("item", 20), "alpha beta gamma"
    texts = {
        1: f"{words('x', 500)} {item} {words('y', 500)}",  # 20 of 1020 words
        2: f"{words('x', 3000)} {words('item', 13)}",  # one window
        3: f"{words('x', 3000)} {words('item', 12)}",  # less than a window
        4: f"{words('x', 500)} {short}",  # a short item in a long text
        5: f"{words('x', 50)} {short}",  # and in a short one
        6: words("z", 1000),
        7: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    for block_bytes in (1 << 20, 16):
        kept = {r.doc_id: r.text for r in without_contaminated(docs, benchmark, block_bytes=block_bytes).collect()}
        assert kept == {i: texts[i] for i in (3, 4, 6, 7)}
