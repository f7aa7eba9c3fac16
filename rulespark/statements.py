"""Rules written as statements: for each row of a relation, if, match, insert.

``rules`` turns a statement into rules: every way to an insertion becomes one
rule, whose body is what stands on that way. An ``If`` puts its condition on one
way and the opposite on the other, so a condition that is null takes the second.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from rulespark.rules import Atom, Head, Let, Program, Where


class For:
    """For each match of the atom, and of the condition if there is one."""

    def __init__(self, atom: Atom, *body, where: str | None = None):
        self.atom, self.body, self.where = atom, body, where


class If:
    def __init__(self, condition: str, then, otherwise=None):
        self.condition, self.then, self.otherwise = condition, then, otherwise


class Match:
    """The first case whose value the expression equals; None matches all."""

    def __init__(self, sql: str, cases: Iterable[tuple[str | None, object]]):
        self.sql, self.cases = sql, list(cases)


class Var:
    """A variable for the statements in it."""

    def __init__(self, name: str, sql: str, *body):
        self.name, self.sql, self.body = name, sql, body


class Insert:
    def __init__(self, relation: str, **columns):
        self.head = Head(relation, **columns)


class Skip:
    """Nothing."""


def _ways(statement, before: tuple) -> Iterator[tuple[Head, tuple]]:
    if isinstance(statement, Insert):
        yield statement.head, before
    elif isinstance(statement, For):
        here = (*before, statement.atom, *([Where(statement.where)] if statement.where else []))
        for s in statement.body:
            yield from _ways(s, here)
    elif isinstance(statement, Var):
        for s in statement.body:
            yield from _ways(s, (*before, Let(statement.name, statement.sql)))
    elif isinstance(statement, If):
        yield from _ways(statement.then, (*before, Where(statement.condition)))
        yield from _ways(statement.otherwise, (*before, Where(f"not coalesce({statement.condition}, false)")))
    elif isinstance(statement, Match):
        other: list[str] = []
        for value, s in statement.cases:
            tests = [Where(f"not ({statement.sql} <=> {v})") for v in other]
            if value is not None:
                tests.append(Where(f"{statement.sql} <=> {value}"))
                other.append(value)
            yield from _ways(s, (*before, *tests))
            if value is None:
                return
    elif isinstance(statement, (list, tuple)):
        for s in statement:
            yield from _ways(s, before)
    elif statement is not None and not isinstance(statement, Skip):
        raise TypeError(f"not a statement: {statement!r}")


def rules(program: Program, *statements) -> None:
    """Add the rules of the statements to a program."""
    for head, body in _ways(statements, ()):
        program.rule(head, *body)
