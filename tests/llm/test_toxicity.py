import random

from rulespark.llm.toxicity import AIMED_INSULT, INSULT, NEGATION, OTHER, REPORT, SYMBOLS, TARGET, WEAK_INSULT, Scorer, after, choose, grammar, toxicity


def test_grammar_marks_clauses():
    run = grammar().run
    assert run([OTHER, INSULT]) == [OTHER, INSULT]
    assert run([TARGET, OTHER, INSULT])[-1] == AIMED_INSULT
    assert run([NEGATION, OTHER, INSULT])[-1] == WEAK_INSULT
    assert run([REPORT, TARGET, OTHER, INSULT])[-1] == WEAK_INSULT
    assert run([NEGATION, OTHER, OTHER, OTHER, INSULT])[-1] == INSULT


def test_composition_is_one_after_the_other():
    rnd = random.Random(1)
    a, b = after(REPORT, {INSULT: WEAK_INSULT}, 4), after(TARGET, {INSULT: AIMED_INSULT}, 2)
    for _ in range(200):
        symbols = [rnd.randrange(SYMBOLS) for _ in range(12)]
        assert a.then(b).run(symbols) == b.run(a.run(symbols))


def test_stems_and_whole_words():
    odds = choose([("vil", 60, 3), ("vile", 60, 3), ("vilex", 30, 1), ("bad$", 40, 1), ("ba", 40, 900), ("rare", 5, 0)], 80, 1000)
    assert set(odds) == {"vile", "bad$"}
    scorer = Scorer(odds)
    assert [[k for k, _ in c] for c in scorer.clauses("A vileness. The badge is fine; bad day, you bad!")] == [[INSULT], [INSULT, AIMED_INSULT]]


def rows(n):
    rnd = random.Random(9)
    words = ["tion", "and", "the", "reth", "ouer", "blend", "inea", "you", "not"]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(10, 80))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(["scumbag", "vilest", "Moronic"]))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = rows(600)
    more = [(9001, None, "x"), (9002, "", "x"), (9003, "word " * 30000, "x"), (None, "you vilest scumbag moronic vilest", "x"), (0, docs[0][1], "x")]
    table = spark.createDataFrame(docs + more, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (labels[1][0], 1, labels[1][2])], "doc_id long, quality int, toxic int")
    got = toxicity(table, marks).collect()
    assert len(got) == len(docs) + len(more)
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (9001, 9002, 9003)} == {9001: 0, 9002: 0, 9003: 0}
    assert [r.predicted for r in got if r.doc_id is None] == [1]


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity(docs, none).collect()] == [0.0]
    assert toxicity(docs.limit(0), none).count() == 0
