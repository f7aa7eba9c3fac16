import random
import zlib

import numpy as np

from rulespark.llm.language import ORDER, Model, grams, identify, letters, train, without_rejected

SYLLABLES = {"aa": "ka lo mi te su".split(), "bb": "straß wun ber ach icht".split(), "cc": "étr eau oui çan lle".split()}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n))


def rows(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        out.append((i, text(rnd, lang, rnd.randint(5, 40)), lang, 1.0))
    return out


def test_grams_stay_inside_their_text():
    symbols, first, n = letters(["Ab, c", "", "é"])
    assert "".join(map(chr, symbols[first[0] : first[1]])) == "   ab c "
    assert n.tolist() == [3, 0, 1]
    keys, row = grams(symbols, first)
    assert np.bincount(row, minlength=3).tolist() == [first[i + 1] - first[i] - ORDER + 1 for i in range(3)]


def brute(samples):
    """Interpolated Kneser-Ney, by dictionaries."""
    from collections import Counter, defaultdict

    counts = [Counter() for _ in range(ORDER + 1)]
    for t in samples:
        symbols, _, _ = letters([t])
        s = "".join(map(chr, symbols))
        counts[ORDER].update(s[i : i + ORDER] for i in range(len(s) - ORDER + 1))
    for o in range(ORDER - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    totals, kinds, discount = [defaultdict(int) for _ in counts], [defaultdict(int) for _ in counts], [0.5] * len(counts)
    for o in range(1, ORDER + 1):
        for g, c in counts[o].items():
            totals[o][g[:-1]] += c
            kinds[o][g[:-1]] += 1
        n1, n2 = (sum(c == k for c in counts[o].values()) for k in (1, 2))
        discount[o] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    floor = 1 / (len(counts[1]) + 1)

    def p(gram):
        if not gram:
            return floor
        o, h = len(gram), gram[:-1]
        if not totals[o][h]:
            return p(gram[1:])
        return max(counts[o][gram] - discount[o], 0) / totals[o][h] + discount[o] * kinds[o][h] / totals[o][h] * p(gram[1:])

    return p


def test_probabilities_are_interpolated_kneser_ney(spark):
    data = rows(60)
    model = train(spark.createDataFrame([(i, t, g) for i, t, g, _ in data], "id long, text string, lang string"))
    for at, lang in enumerate(model.languages):
        p = brute([t for _, t, g, _ in data if g == lang])
        for sample in ("kalo mite", "straßach ou", "zz ǧ 漢 q"):
            symbols, first, _ = letters([sample])
            s = "".join(map(chr, symbols))
            keys, _ = grams(symbols, first)
            want = [np.log(p(s[i : i + ORDER])) for i in range(len(keys))]
            assert np.allclose(model.log_probabilities(keys)[:, at], want, atol=1e-4)


def test_held_out_accuracy_and_edge_cases(spark):
    data = rows(400) + [(1000, None, "aa", 1.0), (1001, "", "aa", 1.0), (1002, "12 -- 34", "bb", 1.0), (1003, "𝒳 漢字", None, 1.0), (None, "kalo mite sulo", "aa", 1.0), (5, "kalo mite sulo", "aa", 1.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score double")
    got = identify(docs).collect()
    assert len(got) == len(data)
    truth = {i: g for i, _, g, _ in data[:400]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    kept = without_rejected(docs).collect()
    assert {r.doc_id for r in kept} >= set(truth)
    assert not {r.doc_id for r in kept} & {1000, 1001, 1002, 1003}


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(docs).collect()] == ["und", "und"]
    assert identify(docs.limit(0)).count() == 0


def test_empty_model():
    assert Model([], [], [], np.empty(0)).predict(["x"])[0] == ["und"]


def test_calibrated_on_all_training_rows(spark):
    """More rows than 2000, of which one is far off."""
    data = [(i, t, g) for i, t, g, _ in rows(2300)]
    frame = spark.createDataFrame(data, "id long, text string, lang string")
    last = frame.selectExpr("id", "xxhash64(id) AS hash").orderBy("hash", "id").tail(1)[0].id
    data[last] = (last, "".join(random.Random(7).choices("kalomitesu", k=400)), "aa")
    model = train(spark.createDataFrame(data, frame.schema))
    h, n = model.cross_entropies([t for _, t, _ in data])
    truth = np.array([model.languages.index(g) for _, _, g in data])
    own = h[np.arange(len(h)), truth]
    middle = np.quantile(own[n >= 100], 0.5, method="lower")
    assert np.isclose(model.limit, middle + 1, atol=1e-9)
    assert model.spread > 1 and np.isclose(model.spread, ((own - middle - 1) * np.sqrt(n)).max() * 1.5)
    assert not model.predict([data[last][1]])[3][0]
    lead = np.partition(h, 1, axis=1)[:, 1] - h.min(axis=1)
    slopes = np.geomspace(0.05, 5, 40)
    p = 1 / (1 + np.exp(-np.minimum(slopes[:, None] * (lead * np.sqrt(n))[None, :], 30)))
    assert np.isclose(model.slope, slopes[np.where(h.argmin(axis=1) == truth, np.log(p), np.log(1 - p)).sum(axis=1).argmax()])


def test_rejection_learns_from_every_labelled_row(spark):
    """Also from those that identify holds out, and those without an id."""
    data = rows(300)
    out = next(i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2)
    data[out] = (out, "zqx jvw kfg " * 40, "aa", 1.0)
    data += [(None, "ỵẅṽ ḧḣḥ " * 40, "bb", 1.0), (5000, "漢字仮名 交文 " * 40, None, 1.0)]
    kept = without_rejected(spark.createDataFrame(data, "doc_id long, text string, lang string, score double")).collect()
    assert {r.doc_id for r in kept} >= {None, *range(300)}


def test_median_is_exact(spark):
    from rulespark.llm.language import _median

    rnd = random.Random(3)
    for values in ([rnd.gauss(0, 1) for _ in range(20_000)], [rnd.gauss(0, 1e-9) for _ in range(9999)] + [1e9], [2.5] * 5000, [1.0, 2.0], [7.0]):
        frame = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
        assert _median(frame, "x") == sorted(values)[(len(values) - 1) // 2]
    assert _median(spark.createDataFrame([], "x double"), "x") is None
