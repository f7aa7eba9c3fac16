import random

import pytest

from rulespark.rules import Atom, GroupBy, Head, Not
from rulespark.session import Session, UpdateError, parse_commands
from rulespark.sources import database_schema, table_updates, transaction
from rulespark.zset import WEIGHT

INPUTS = {"item": ("k long, v string", "set", ()), "price": ("k long, p long, tags array<string>, notes map<string,string>", "set", ("k",)), "bag": ("x long", "multiset", ()), "seen": ("k long", "stream", ())}


def build(p):
    p.relation("total", "v", "n", output=True)
    p.rule(Head("total", v="v", n="n"), Atom("item", k="k", v="v"), GroupBy(("v",), {"n": "count(1)"}))
    p.relation("free", "k", output=True)
    p.rule(Head("free", k="k"), Atom("item", k="k"), Not("price", k="k"))
    p.relation("mass", "x", output=True)
    p.rule(Head("mass", x="x"), Atom("bag", x="x"))
    p.index("price_of", "price", "k")


@pytest.fixture
def session(spark):
    return Session(spark, INPUTS, build)


def change(z):
    return sorted((*tuple(r)[:-1], r[WEIGHT]) for r in z.df.collect())


def test_changes_of_commits(session):
    session.start()
    session.insert("item", [(1, "a"), (2, "a"), (2, "a"), (3, "b")])
    changes = session.commit()
    assert change(changes["total"]) == [("a", 2, 1), ("b", 1, 1)]
    session.start()
    session.delete("item", [(1, "a"), (7, "z")])
    session.insert("price", [(3, 10, [], {})])
    changes = session.commit()
    assert change(changes["total"]) == [("a", 1, 1), ("a", 2, -1)]
    assert change(changes["free"]) == [(1, -1), (3, -1)]
    session.start()
    session.insert("item", [(8, "c")])
    session.rollback()
    assert sorted(tuple(r) for r in session.dump("total").collect()) == [("a", 1), ("b", 1)]
    assert [tuple(r)[:2] for r in session.query_index("price_of", 3).collect()] == [(3, 10)]


def test_keyed_updates(session):
    session.start()
    session.insert("price", [(1, 5, ["x", "y"], {"a": "1", "b": "2"})])
    for bad in (lambda: session.insert("price", [(1, 6, [], {})]), lambda: session.delete_key("price", [4]), lambda: session.delete("price", [(1, 6, [], {})]), lambda: session.modify("price", 9, p=1), lambda: session.insert_or_update("item", [(1, "x")])):
        with pytest.raises(UpdateError):
            bad()
    session.modify("price", 1, p=7, tags={"y", "z"}, notes={"a": None, "c": "3"})
    session.insert_or_update("price", [(2, 1, [], {}), ])
    session.insert_or_update("price", [(2, 2, [], {})])
    session.commit()
    got = {r.k: r for r in session.dump("price").collect()}
    assert got[1].p == 7 and got[1].tags == ["x", "z"] and got[1].notes == {"b": "2", "c": "3"} and got[2].p == 2
    session.start()
    session.delete_key("price", [1, 2])
    session.clear("item")
    session.commit()
    assert session.dump("price").count() == 0


def test_multisets_and_streams(session):
    session.start()
    session.insert("bag", [(1,), (1,), (2,)])
    session.delete("bag", [(2,), (3,)])
    session.insert("seen", [(1,)])
    assert change(session.commit()["mass"]) == [(1, 1), (3, 1)]
    assert sorted(tuple(r) for r in session.dump("bag").collect()) == [(1, 2), (3, -1)]
    assert session.dump("seen").count() == 0


def test_transactions_are_guarded(session):
    with pytest.raises(UpdateError):
        session.commit()
    session.start()
    with pytest.raises(UpdateError):
        session.start()


def test_incremental_equals_recomputed(session, spark):
    rnd = random.Random(3)
    held, total = set(), {}
    for _ in range(3):
        session.start()
        fresh, gone = {(rnd.randint(0, 9), rnd.choice("ab")) for _ in range(6)}, set(rnd.sample(sorted(held), min(2, len(held))))
        session.apply_updates([("insert", "item", r) for r in fresh] + [("delete", "item", r) for r in gone])
        held = (held | fresh) - gone
        for v, n, w in change(session.commit()["total"]):
            total[v, n] = total.get((v, n), 0) + w
        want = {(v, sum(1 for _, x in held if x == v)) for v in {x for _, x in held}}
        assert {k for k, w in total.items() if w} == want and set(total.values()) <= {0, 1}


def test_replay_and_snapshot(session, spark):
    session.start()
    session.insert("item", [(1, "a")])
    session.weigh("bag", [(4,)], 2)
    session.commit()
    other = Session(spark, INPUTS, build)
    assert change(other.replay(session.snapshot())[0]["total"]) == [("a", 1, 1)]


def test_text_commands(session):
    out = session.run('start; insert item(1, "a"), insert item{.k = 2, .v = "a"}; # note\n commit dump_changes; echo "mid"; dump total;')
    assert out == ["free[1]: +1", "free[2]: +1", 'total["a", 2]: +1', "mid", 'total["a", 2]']
    assert parse_commands("modify price 1 <- price{.p = 3}; delete_key price 1; query_index i(1, true);")[2] == ("query_index", "i", [1, True])
    with pytest.raises(ValueError):
        parse_commands("jump;")


def test_switch_database_documents(spark):
    schema = database_schema('{"tables": {"Port": {"columns": {"name": {"type": "string"}, "tag": {"type": {"key": "integer", "min": 0, "max": 1}}, "ids": {"type": {"key": "uuid", "min": 0, "max": "unlimited"}}, "ext": {"type": {"key": "string", "value": "string"}}}}}}')
    s = Session(spark, {"Port": (schema["Port"].simpleString()[7:-1].replace(":", " "), "set", ("_uuid",))}, lambda p: (p.relation("out", "_uuid", "name", output=True), p.rule(Head("out", _uuid="u", name="n"), Atom("Port", _uuid="u", name="n"))))
    s.start()
    s.apply_updates(table_updates('{"Port": {"u1": {"new": {"name": "p", "tag": ["set", []], "ids": ["set", [["uuid", "b"], ["uuid", "a"]]], "ext": ["map", [["k", "v"]]]}}}}', schema))
    changes = s.commit()
    row = s.dump("Port").first()
    assert (row.name, row.tag, row.ids, row.ext) == ("p", None, ["a", "b"], {"k": "v"})
    assert transaction(changes, "db") == ["db", {"op": "insert", "table": "out", "row": {"name": "p"}, "uuid-name": "u1"}]
