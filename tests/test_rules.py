import pytest

from rulespark.rules import Atom, Expr, FlatMap, GroupBy, Head, Let, Not, Program, RuleError, Where


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def program(spark):
    p = Program(spark)
    p.facts("edge", "a long, b long", [(1, 2), (2, 3), (3, 4), (4, 2), (9, 9)])
    return p


def closure(p):
    p.relation("path", "a", "b", output=True)
    p.rule(Head("path", a="x", b="y"), Atom("edge", a="x", b="y"))
    p.rule(Head("path", a="x", b="z"), Atom("path", a="x", b="y"), Atom("path", a="y", b="z"))


def test_recursion_reaches_the_fixpoint(program):
    closure(program)
    want = {(1, 2), (2, 3), (3, 4), (4, 2), (9, 9)}
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    assert rows(program.results()["path"]) == sorted(want)


def test_negation_follows_recursion(program):
    closure(program)
    program.relation("source", "n")
    program.rule(Head("source", n="x"), Atom("edge", a="x"), Not("path", b="x"))
    assert rows(program.result("source")) == [(1,)]


def test_terms_of_a_body(program):
    program.relation("out", "a", "part", "n")
    program.rule(Head("out", a="a", part="w", n=Expr("n + 1")), Atom("edge", a="a", b="b"), Where("a <> b"), Let("s", "concat(a, '-', b)"), FlatMap("w", "split(s, '-')"), GroupBy(("a", "w"), {"n": "count(1)"}))
    assert rows(program.result("out")) == [(1, "1", 2), (1, "2", 2), (2, "2", 2), (2, "3", 2), (3, "3", 2), (3, "4", 2), (4, "2", 2), (4, "4", 2)]


def test_patterns_match_fields_constants_and_repeats(spark):
    p = Program(spark)
    p.facts("r", "k long, s struct<x:long,y:string>", [(1, (1, "a")), (2, (1, "b")), (3, None)])
    p.relation("same", "k")
    p.rule(Head("same", k="x"), Atom("r", k="x", s={"x": "x", "y": "_"}))
    assert rows(p.result("same")) == [(1,)]
    p.relation("two", "x")
    p.rule(Head("two", x="x"), Atom("r", k=2, s={"x": "x"}))
    assert rows(p.result("two")) == [(1,)]


def test_no_value_equals_no_value(spark):
    p = Program(spark)
    p.facts("a", "x long", [(None,), (1,)])
    p.facts("b", "x long", [(None,), (2,)])
    p.relation("both", "x")
    p.relation("only", "x")
    p.rule(Head("both", x="x"), Atom("a", x="x"), Atom("b", x="x"))
    p.rule(Head("only", x="x"), Atom("a", x="x"), Not("b", x="x"))
    assert rows(p.result("both")) == [(None,)]
    assert rows(p.result("only")) == [(1,)]


def test_group_of_nothing_has_no_row(spark):
    p = Program(spark)
    p.facts("a", "x long", [])
    p.relation("n", "n")
    p.rule(Head("n", n="n"), Atom("a", x="x"), GroupBy((), {"n": "count(1)"}))
    assert rows(p.result("n")) == []


def test_delay_difference_and_lookup(spark):
    p = Program(spark)
    p.facts("a", "x long", [(1,), (2,)])
    p.past("a", [spark.createDataFrame([(1,)], "x long")])
    p.index("by_x", "a", "x")
    p.relation("old", "x")
    p.relation("new", "x", kind="stream")
    p.rule(Head("old", x="x"), Atom("a", x="x", delay=1))
    p.rule(Head("new", x="x"), Atom("a", x="x", diff=True))
    assert rows(p.result("old")) == [(1,)] and rows(p.result("new")) == [(2,)]
    assert rows(p.lookup("by_x", 2)) == [(2,)]


BAD = {
    "twice": lambda p: p.relation("edge", "a"),
    "repeated column": lambda p: p.relation("r", "a", "a"),
    "key of an output": lambda p: p.relation("r", "a", key=["a"]),
    "unknown relation": lambda p: p.rule(Head("out", x="a"), Atom("nothing", a="a")),
    "unknown column": lambda p: p.rule(Head("out", x="a"), Atom("edge", z="a")),
    "unbound head": lambda p: p.rule(Head("out", x="z"), Atom("edge", a="a")),
    "missing head column": lambda p: p.rule(Head("out"), Atom("edge", a="a")),
    "input as head": lambda p: p.rule(Head("edge", a="a", b="a"), Atom("edge", a="a")),
    "new variable in negation": lambda p: p.rule(Head("out", x="a"), Atom("edge", a="a"), Not("edge", a="a", b="c")),
    "bound twice": lambda p: p.rule(Head("out", x="a"), Atom("edge", a="a"), Let("a", "1")),
    "unbound group key": lambda p: p.rule(Head("out", x="n"), Atom("edge", a="a"), GroupBy(("z",), {"n": "count(1)"})),
    "group variable not new": lambda p: p.rule(Head("out", x="a"), Atom("edge", a="a"), GroupBy(("a",), {"a": "count(1)"})),
    "two streams": lambda p: p.rule(Head("flow", x="a"), Atom("s", x="a"), Atom("s", x="a")),
    "negated stream": lambda p: p.rule(Head("out", x="a"), Atom("edge", a="a"), Not("s", x="a")),
    "negation after a stream": lambda p: p.rule(Head("flow", x="a"), Atom("s", x="a"), Not("edge", a="a")),
    "stream into a relation": lambda p: p.rule(Head("out", x="a"), Atom("s", x="a")),
    "relation into a stream": lambda p: p.rule(Head("flow", x="a"), Atom("edge", a="a")),
    "index of a stream": lambda p: p.index("i", "s", "x"),
    "index of no column": lambda p: p.index("i", "edge", "z"),
    "transformer into an input": lambda p: p.apply(lambda e: e, ["edge"], ["edge"]),
    "negative delay": lambda p: p.rule(Head("out", x="a"), Atom("edge", a="a", delay=-1)),
}


@pytest.mark.parametrize("case", BAD)
def test_static_rules(program, case):
    program.input("s", program.spark.createDataFrame([(1,)], "x long"), kind="stream")
    program.relation("out", "x")
    program.relation("flow", "x", kind="stream")
    with pytest.raises(RuleError):
        BAD[case](program)


def test_key_of_a_multiset(program):
    with pytest.raises(RuleError):
        program.input("m", program.spark.createDataFrame([(1,)], "x long"), kind="multiset", key=["x"])


def test_unstratified_programs(program):
    program.relation("p", "x")
    program.relation("q", "x")
    program.rule(Head("p", x="x"), Atom("edge", a="x"), Not("q", x="x"))
    program.rule(Head("q", x="x"), Atom("p", x="x"))
    with pytest.raises(RuleError, match="negation"):
        program.strata()


def test_group_inside_recursion(program):
    program.relation("p", "x")
    program.rule(Head("p", x="x"), Atom("edge", a="x"))
    program.rule(Head("p", x="n"), Atom("p", x="x"), GroupBy((), {"n": "max(x)"}))
    with pytest.raises(RuleError, match="group"):
        program.strata()


def test_second_producer_of_a_transformer(program):
    program.relation("t", "a", "b")
    program.apply(lambda e: e, ["edge"], ["t"])
    with pytest.raises(RuleError):
        program.rule(Head("t", a="a", b="b"), Atom("edge", a="a", b="b"))
