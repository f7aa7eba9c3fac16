from rulespark.rules import Atom, Expr, Program
from rulespark.statements import For, If, Insert, Match, Skip, Var, rules


def test_every_way_is_a_rule(spark):
    p = Program(spark)
    p.facts("item", "k long, v string", [(1, "a"), (2, "b"), (3, None), (14, "c")])
    p.facts("seen", "k long", [(1,), (2,), (3,)])
    p.relation("out", "k", "tag")
    rules(
        p,
        For(
            Atom("item", k="k", v="v"),
            If("v = 'a'", Insert("out", k="k", tag=Expr("'first'")), Insert("out", k="k", tag=Expr("'rest'"))),
            Var("big", "k * 10", Match("v", [("'b'", Insert("out", k="big", tag="v")), ("'a'", Skip()), (None, Insert("out", k="big", tag=Expr("'other'")))])),
            For(Atom("seen", k="k"), Insert("out", k="k", tag=Expr("'seen'")), where="k > 1"),
        ),
    )
    got = sorted(tuple(r) for r in p.result("out").collect())
    assert got == [(1, "first"), (2, "rest"), (2, "seen"), (3, "rest"), (3, "seen"), (14, "rest"), (20, "b"), (30, "other"), (140, "other")]
