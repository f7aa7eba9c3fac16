import numpy as np

from rulespark.llm.html_blocks import LABELLED, blocks, extract, features, grow, main_text, trained

TREE = trained()


def test_tree_agrees_with_its_table():
    for page, marks in LABELLED:
        assert "".join(str(int(x)) for x in TREE.predict(features(blocks(page)))) == marks


def test_article_without_its_surroundings():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy!</div>"
        "<article><h1>A &amp; B</h1><p><b>One\n  two<br>three<br><p>Caf&eacute; &lt;x&gt;</p><form><p>Mail</p></form><div class='comments'><p>Nice text, thank you for it.</p></div></article><!-- <p>no</p> --><footer>&copy; me</footer>"
    )
    assert main_text(page, TREE) == "A & B\nOne two three\nCafé <x>"


def test_broken_markup_ends():
    for page in ("<article><p>a<b", "<article><p>a", "<p class='x>a", "<!-- open", "<script>open", "<article><p>x</p" + "<i>" * 500, "&#0; <article>&nbsp;y"):
        main_text(page, TREE)
    assert main_text("<article><p>a</p><p>b", TREE) == "a\nb"


def test_pages_of_any_kind(spark):
    long = "<article>" + "".join(f"<p>word {i} and more words to read</p>" for i in range(20000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, long, "x"), (3, None, long, "x"), (None, "u", "<article><p>z</p>", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got if r.page_id != 3) == [("1", 0), ("2", 0), ("None", 1)]
    assert [r.text.count("\n") for r in got if r.page_id == 3] == [19999, 19999]
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_grow_splits_where_impurity_is_least():
    x = np.array([[1, 0], [2, 0], [3, 1], [4, 1]], float)
    tree = grow(x, np.array([0, 0, 1, 1]))
    assert tree.feature[0] == 0 and tree.bar[0] == 2.5
    assert tree.predict(x).tolist() == [False, False, True, True]
