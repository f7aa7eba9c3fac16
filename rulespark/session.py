"""Transactions on a program: staged updates, commits with changes, replay.

Input relations are versions of DataFrames. A transaction stages updates; commit
makes the next version of the inputs, derives the outputs again and gives the
signed difference of each. Rollback drops what is staged. Updates of one kind
that follow each other are one DataFrame, so a batch of any size is one plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespark.rules import Program
from rulespark.storage import stored
from rulespark.zset import WEIGHT, ZSet


class UpdateError(ValueError):
    """An update that its relation does not allow."""


def _same(a: DataFrame, b: DataFrame, columns: Iterable[str]) -> Column:
    """Equality of columns; maps are compared as their sorted entries."""
    value = lambda df, c: F.array_sort(F.map_entries(df[c])) if isinstance(df.schema[c].dataType, T.MapType) else df[c]
    return reduce(Column.__and__, (value(a, c).eqNullSafe(value(b, c)) for c in columns))


def _without(keys: list) -> Callable[[Column, Column], Column]:
    return lambda k, _: ~k.isin(keys)


class Session:
    """``build`` makes the program from the inputs' current DataFrames."""

    def __init__(self, spark: SparkSession, inputs: dict[str, tuple], build: Callable[[Program], None], *, keep: int = 4):
        """inputs: name -> (schema, kind, key columns); kind is "set",
        "multiset" or "stream"."""
        self.spark, self.build, self.keep = spark, build, keep
        self.schema: dict[str, T.StructType] = {}
        self.kind: dict[str, str] = {}
        self.key: dict[str, tuple[str, ...]] = {}
        self.now: dict[str, DataFrame] = {}
        for name, (schema, kind, key) in inputs.items():
            made = spark.createDataFrame([], schema)
            self.schema[name], self.kind[name], self.key[name] = made.schema, kind, tuple(key)
            self.now[name] = made if kind != "multiset" else made.withColumn(WEIGHT, F.lit(0).cast("long"))
        self.before: dict[str, list[DataFrame]] = {}
        self.outputs: dict[str, DataFrame] = {}
        self.staged: dict[str, DataFrame] | None = None
        self.log: list[tuple] = []
        self.handlers: list[Callable[[str, Row, int], None]] = []
        self.program: Program | None = None

    # -- transactions ----------------------------------------------------
    def start(self) -> None:
        if self.staged is not None:
            raise UpdateError("a transaction is active")
        self.staged = dict(self.now)
        self.log.append(("start",))

    def _active(self) -> dict[str, DataFrame]:
        if self.staged is None:
            raise UpdateError("no transaction is active")
        return self.staged

    def rollback(self) -> None:
        self._active()
        self.staged = None
        self.log.append(("rollback",))

    def commit(self) -> dict[str, ZSet]:
        """The signed changes of all outputs."""
        staged = self._active()
        kept = {n: stored(df, n) for n, df in staged.items()}
        program = Program(self.spark)
        for name, df in kept.items():
            if self.kind[name] == "multiset":
                df = df.where(f"{WEIGHT} <> 0").drop(WEIGHT)
            program.input(name, df, kind=self.kind[name], key=self.key[name])
        self.build(program)
        for name, versions in self.before.items():
            program.past(name, versions)
        fresh = {n: stored(df, n) for n, df in program.results().items()}
        changes = {}
        for name, df in fresh.items():
            old = self.outputs.get(name)
            change = ZSet.of(df) if old is None else ZSet.of(df).minus(ZSet.of(old))
            changes[name] = ZSet(stored(change.consolidate().df, "change"))
        history = {n: df for n, df in kept.items()} | fresh
        for name, df in history.items():
            self.before[name] = [df, *self.before.get(name, [])][: self.keep]
        self.now = {n: df.limit(0) if self.kind[n] == "stream" else df for n, df in kept.items()}
        self.outputs, self.staged, self.program = fresh, None, program
        self.log.append(("commit",))
        for handler in self.handlers:
            for name, change in changes.items():
                for row in change.df.toLocalIterator():
                    handler(name, Row(**{k: v for k, v in row.asDict().items() if k != WEIGHT}), row[WEIGHT])
        return changes

    def on_change(self, handler: Callable[[str, Row, int], None]) -> None:
        self.handlers.append(handler)

    # -- updates ---------------------------------------------------------
    def _rows(self, name: str, rows) -> DataFrame:
        if name not in self.schema:
            raise UpdateError(f"{name} is not an input relation")
        if isinstance(rows, DataFrame):
            return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema[name]))
        return self.spark.createDataFrame(list(rows), self.schema[name])

    def _note(self, op: str, name: str, rows) -> None:
        self.log.append((op, name, [tuple(r) for r in rows] if not isinstance(rows, DataFrame) else rows))

    def insert(self, name: str, rows) -> None:
        """Sets: no effect for present rows; multisets: one more; keyed
        relations: an error for a present key."""
        staged, new = self._active(), self._rows(name, rows)
        if self.kind[name] == "multiset":
            staged[name] = self._weighted(name, new, 1)
        elif self.key[name]:
            key = list(self.key[name])
            if not new.groupBy(*key).count().where("count > 1").isEmpty() or not new.join(staged[name], _same(new, staged[name], key), "left_semi").isEmpty():
                raise UpdateError(f"{name}: a row with this key exists")
            staged[name] = staged[name].unionByName(new)
        elif self.kind[name] == "stream":
            staged[name] = staged[name].unionByName(new)
        else:
            staged[name] = staged[name].unionByName(new).distinct()
        self._note("insert", name, rows)

    def _weighted(self, name: str, rows: DataFrame, weight: int) -> DataFrame:
        return ZSet(self._active()[name]).add(ZSet.of(rows, weight)).df

    def weigh(self, name: str, rows, weight: int) -> None:
        """Add a weight to rows of a multiset; sums may become negative."""
        if self.kind[name] != "multiset":
            raise UpdateError(f"{name} is not a multiset")
        self._active()[name] = self._weighted(name, self._rows(name, rows), weight)
        self._note("weigh", name, rows)

    def insert_or_update(self, name: str, rows) -> None:
        staged, new, key = self._active(), self._rows(name, rows), self._keyed(name)
        staged[name] = staged[name].join(new, _same(staged[name], new, key), "left_anti").unionByName(new)
        self._note("insert_or_update", name, rows)

    def _keyed(self, name: str) -> list[str]:
        if not self.key.get(name):
            raise UpdateError(f"{name} has no primary key")
        return list(self.key[name])

    def delete(self, name: str, rows) -> None:
        """Sets: no effect for absent rows; keyed relations: an error."""
        staged, old = self._active(), self._rows(name, rows)
        if self.kind[name] == "multiset":
            staged[name] = self._weighted(name, old, -1)
        else:
            if self.key[name] and not old.join(staged[name], _same(old, staged[name], old.columns), "left_anti").isEmpty():
                raise UpdateError(f"{name}: no such row")
            staged[name] = staged[name].join(old, _same(staged[name], old, old.columns), "left_anti")
        self._note("delete", name, rows)

    def delete_key(self, name: str, keys) -> None:
        staged, key = self._active(), self._keyed(name)
        schema = T.StructType([self.schema[name][k] for k in key])
        gone = keys.select(*key) if isinstance(keys, DataFrame) else self.spark.createDataFrame([k if isinstance(k, (tuple, list)) else (k,) for k in keys], schema)
        if not gone.join(staged[name], _same(gone, staged[name], key), "left_anti").isEmpty():
            raise UpdateError(f"{name}: no row with this key")
        staged[name] = staged[name].join(gone, _same(staged[name], gone, key), "left_anti")
        self.log.append(("delete_key", name, keys if isinstance(keys, DataFrame) else list(keys)))

    def modify(self, name: str, key, **fields) -> None:
        """Change fields of the row with this key: scalars and arrays are
        overwritten; for a set (given as a Python set) elements are toggled;
        for a map entries are overwritten, and those given as None removed."""
        staged, columns = self._active(), self._keyed(name)
        values = key if isinstance(key, tuple) else (key,)
        here = reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, values, strict=True)))
        if staged[name].where(here).isEmpty():
            raise UpdateError(f"{name}: no row with this key")
        made = {}
        for field, value in fields.items():
            kind = self.schema[name][field].dataType
            old = F.col(field)
            if isinstance(value, (set, frozenset)):
                other = F.array(*map(F.lit, sorted(value))).cast(kind)
                new = F.array_sort(F.array_union(F.array_except(old, other), F.array_except(other, old)))
            elif isinstance(kind, T.MapType):
                new = F.map_filter(old, _without(list(value)))
                for k, v in value.items():
                    if v is not None:
                        new = F.map_concat(new, F.create_map(F.lit(k), F.lit(v)).cast(kind))
            else:
                new = F.lit(value).cast(kind)
            made[field] = F.when(here, new).otherwise(old).alias(field)
        staged[name] = staged[name].select(*(made.get(c, F.col(c)) for c in staged[name].columns))
        self.log.append(("modify", name, key, fields))

    def clear(self, name: str) -> None:
        staged = self._active()
        staged[name] = staged[name].limit(0)
        self.log.append(("clear", name))

    def apply_updates(self, updates: Iterable[tuple]) -> None:
        """(operation, relation, row) in order; runs of one operation on one
        relation are applied at once."""
        run: list = []
        last: tuple[str, str] | None = None
        for op, name, row in [*updates, ("", "", None)]:
            if (op, name) != last and run:
                getattr(self, last[0])(last[1], run)
                run = []
            last = (op, name)
            run.append(row)

    # -- reading ---------------------------------------------------------
    def dump(self, name: str) -> DataFrame:
        return self.outputs[name] if name in self.outputs else self.now[name]

    def snapshot(self) -> list[tuple]:
        """Commands that make the current inputs."""
        out: list[tuple] = [("start",)]
        for name, df in self.now.items():
            if self.kind[name] == "multiset":
                out += [("weigh", name, [tuple(r)[:-1]], r[WEIGHT]) for r in df.collect()]
            else:
                rows = [tuple(r) for r in df.collect()]
                if rows:
                    out.append(("insert", name, rows))
        return [*out, ("commit",)]

    def query_index(self, index: str, *values) -> DataFrame:
        if self.program is None:
            raise UpdateError("nothing is committed")
        return self.program.lookup(index, *values)

    def replay(self, log: Iterable[tuple]) -> list[dict[str, ZSet]]:
        """Run recorded commands; the changes of each commit."""
        out = []
        for op, *rest in list(log):
            if op == "modify":
                self.modify(rest[0], rest[1], **rest[2])
            elif op == "commit":
                out.append(self.commit())
            else:
                getattr(self, op)(*rest)
        return out

    def run(self, text: str) -> list[str]:
        """Run commands given as text; what they print."""
        out: list[str] = []
        for command in parse_commands(text):
            op, *rest = command
            if op == "echo":
                out.append(rest[0])
            elif op == "commit":
                changes = self.commit()
                if rest[0]:
                    for name in sorted(changes):
                        rows = sorted((tuple(r)[:-1], r[WEIGHT]) for r in changes[name].df.collect())
                        out += [f"{name}{json.dumps(list(v), default=str)}: {w:+d}" for v, w in rows]
            elif op == "dump":
                for name in [rest[0]] if rest[0] else sorted(self.outputs):
                    out += [f"{name}{json.dumps(list(v), default=str)}" for v in sorted(tuple(r) for r in self.dump(name).collect())]
            elif op == "query_index":
                out += [json.dumps(list(v), default=str) for v in sorted(tuple(r) for r in self.query_index(rest[0], *rest[1]).collect())]
            elif op == "update":
                run = [self._positional(u) for u in rest[0]]
                for name, *args in run:
                    if name == "modify":
                        self.modify(args[0], args[1], **args[2])
                    else:
                        getattr(self, name)(*args)
            else:
                getattr(self, op)(*rest)
        return out

    def _positional(self, update: tuple) -> tuple:
        op, name, *rest = update
        if op in ("insert", "delete", "insert_or_update"):
            (values,) = rest
            if isinstance(values, dict):
                values = [values.get(f.name) for f in self.schema[name]]
            return op, name, [tuple(values)]
        if op == "delete_key":
            return op, name, rest[0]
        return update


TOKENS = re.compile(r'\s+|#[^\n]*|"(?:[^"\\]|\\.)*"|-?\d+\.\d+|-?\d+|<-|\.?[A-Za-z_][\w.:]*|[()\[\]{},;=+%@]')


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = TOKENS.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {text[at : at + 20]!r}")
        at = m.end()
        if not m[0][0].isspace() and m[0][0] != "#":
            out.append(m[0])
    return out


class _Reader:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if not got or wanted is not None and got != wanted:
            raise ValueError(f"expected {wanted or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def value(self):
        t = self.take()
        if t == "@":
            return json.loads(json.loads(self.take()[4:] if self.peek() != "json" else self.take() and self.take()))
        if t == "%":
            with open(json.loads(self.take()), encoding="utf-8") as f:
                return f.read()
        if t[0] == '"':
            return json.loads(t)
        if t[0].isdigit() or t[0] == "-" and len(t) > 1:
            return float(t) if "." in t else int(t)
        if t in ("true", "false"):
            return t == "true"
        if t == "[":
            return self.list("]")
        if t == "(":
            return tuple(self.list(")"))
        if t == "None" or t.endswith("::None"):
            if self.peek() == "{":
                self.take()
                self.take("}")
            return None
        if self.peek() in ("{", "("):  # a constructor
            fields = self.arguments()
            if t == "Some" or t.endswith("::Some"):
                return fields[0] if isinstance(fields, list) else next(iter(fields.values()))
            return fields if isinstance(fields, dict) else tuple(fields)
        raise ValueError(f"not a value: {t}")

    def list(self, end: str) -> list:
        out = []
        while self.peek() != end:
            out.append(self.value())
            if self.peek() == ",":
                self.take()
        self.take(end)
        return out

    def arguments(self):
        """(1, 2), {1, 2} or {a = 1}, (.a = 1)."""
        end = {"(": ")", "{": "}"}[self.take()]
        named, listed = {}, []
        while self.peek() != end:
            name = self.peek().lstrip(".")
            if self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == "=":
                self.take()
                self.take("=")
                named[name] = self.value()
            else:
                listed.append(self.value())
            if self.peek() == ",":
                self.take()
        self.take(end)
        return named if named else listed


def parse_commands(text: str) -> list[tuple]:
    """Commands of the text form: start; insert R(..), delete R(..); commit
    dump_changes; dump R; query_index I(k); clear R; rollback; echo "..."."""
    r, out = _Reader(_tokens(text)), []
    while r.peek():
        word = r.take()
        if word in ("start", "rollback"):
            out.append((word,))
        elif word == "commit":
            out.append(("commit", r.peek() == "dump_changes" and bool(r.take())))
        elif word == "dump":
            out.append(("dump", r.take() if r.peek() != ";" else None))
        elif word == "clear":
            out.append(("clear", r.take()))
        elif word == "echo":
            out.append(("echo", json.loads(r.take())))
        elif word == "query_index":
            name = r.take()
            values = r.arguments()
            out.append(("query_index", name, list(values.values()) if isinstance(values, dict) else values))
        elif word in ("insert", "delete", "insert_or_update", "delete_key", "modify"):
            updates = []
            while True:
                name = r.take()
                if word == "delete_key":
                    updates.append((word, name, [r.value()]))
                elif word == "modify":
                    key = r.value()
                    r.take("<-")
                    if r.peek() not in ("{", "("):
                        r.take()
                    updates.append((word, name, key, r.arguments()))
                else:
                    updates.append((word, name, r.arguments()))
                if r.peek() != ",":
                    break
                r.take()
                word = r.take()
            out.append(("update", updates))
        else:
            raise ValueError(f"unknown command {word}")
        r.take(";")
    return out
