"""Rules: heads and bodies over named relations, planned as DataFrames.

A body is read from left to right. Atoms become joins on the variables they
share with what stands before them; an atom that brings no new variable becomes
a semi-join, a negated one an anti-join. Conditions, assignments, flat-maps and
groups act on the variables bound so far. Expressions are Spark SQL over
variable names, so that the whole body is one logical plan.

Relations are sets unless declared as multisets or streams: the rules of one
head are united and made distinct, except where the plan shows that rows cannot
repeat. Mutually recursive relations are one stratum, evaluated semi-naively.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.storage import stored


class RuleError(ValueError):
    """A program that breaks one of the static rules."""


@dataclass(frozen=True)
class Lit:
    """A constant in a pattern or a head."""

    value: object


@dataclass(frozen=True)
class Expr:
    """A Spark SQL expression over bound variables, in a pattern or a head."""

    sql: str


class _Atom:
    """A relation with patterns: ``column=pattern``. A string is a variable, "_"
    matches anything, other values are constants; a dictionary matches the
    fields of a struct."""

    def __init__(self, relation: str, *, bind: str | None = None, delay: int = 0, diff: bool = False, **patterns):
        self.relation, self.bind, self.delay, self.diff, self.patterns = relation, bind, delay, diff, patterns

    def variables(self) -> set[str]:
        return set(_pattern_variables(self.patterns.values())) | ({self.bind} if self.bind else set())


class Atom(_Atom):
    pass


class Not(_Atom):
    pass


def _pattern_variables(patterns: Iterable) -> Iterable[str]:
    for p in patterns:
        if isinstance(p, str) and p != "_":
            yield p
        elif isinstance(p, dict):
            yield from _pattern_variables(p.values())


@dataclass(frozen=True)
class Where:
    """A condition on bound variables."""

    sql: str


@dataclass(frozen=True)
class Let:
    """``name = sql``; with ``keep_null`` false, a null (no value) drops the row."""

    name: str
    sql: str
    keep_null: bool = True


@dataclass(frozen=True)
class FlatMap:
    """One row for each element of an array or entry of a map; none for null."""

    name: str
    sql: str


@dataclass(frozen=True)
class GroupBy:
    """Groups by the variables ``keys``; ``aggregates`` names Spark SQL
    aggregates over the bound variables. Groups have distinct rows of keys and
    ``of`` (all bound variables by default) unless ``distinct`` is false."""

    keys: tuple[str, ...]
    aggregates: dict[str, str]
    of: tuple[str, ...] | None = None
    distinct: bool = True
    having: str | None = None


@dataclass(frozen=True)
class Inspect:
    """Passes rows through; what ``observe`` names is measured on the way."""

    name: str
    measures: dict[str, str]


class Head:
    def __init__(self, relation: str, **columns):
        self.relation, self.columns = relation, columns


@dataclass
class Relation:
    name: str
    columns: tuple[str, ...]
    kind: str = "set"
    key: tuple[str, ...] = ()
    data: DataFrame | None = None
    output: bool = False
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def is_input(self) -> bool:
        return self.data is not None


@dataclass
class Rule:
    heads: tuple[Head, ...]
    body: tuple


class Program:
    """Relations and rules; ``result(name)`` is a relation's DataFrame."""

    def __init__(self, spark: SparkSession, *, most_rounds: int = 10_000):
        self.spark, self.most_rounds = spark, most_rounds
        self.relations: dict[str, Relation] = {}
        self.rules: list[Rule] = []
        self.transformers: list[tuple[Callable, tuple[str, ...], tuple[str, ...]]] = []
        self.observations: dict[str, object] = {}
        self._done: dict[str, DataFrame] = {}
        self._past: dict[str, list[DataFrame]] = {}

    # -- declarations ----------------------------------------------------
    def _declare(self, name: str, columns: Iterable[str], **options) -> Relation:
        if name in self.relations:
            raise RuleError(f"relation {name} is declared twice")
        columns = tuple(columns)
        if len(set(columns)) != len(columns):
            raise RuleError(f"relation {name} repeats a column")
        self.relations[name] = Relation(name, columns, **options)
        return self.relations[name]

    def input(self, name: str, data: DataFrame, *, kind: str = "set", key: Iterable[str] = ()) -> Relation:
        key = tuple(key)
        if key and kind != "set":
            raise RuleError(f"{name}: only sets have primary keys")
        if not set(key) <= set(data.columns):
            raise RuleError(f"{name}: a key column is not declared")
        return self._declare(name, data.columns, kind=kind, key=key, data=data)

    def facts(self, name: str, schema: str, rows: list[tuple]) -> Relation:
        return self.input(name, self.spark.createDataFrame(rows, schema))

    def relation(self, name: str, *columns: str, kind: str = "set", output: bool = False, key: Iterable[str] = ()) -> Relation:
        if tuple(key):
            raise RuleError(f"{name}: only input relations have primary keys")
        return self._declare(name, columns, kind=kind, output=output)

    def index(self, name: str, relation: str, *columns: str) -> None:
        r = self._known(relation)
        if r.kind == "stream":
            raise RuleError(f"index {name}: streams have no indexes")
        if not columns or not set(columns) <= set(r.columns):
            raise RuleError(f"index {name}: its columns must be columns of {relation}")
        r.indexes[name] = columns

    def rule(self, heads: Head | tuple[Head, ...], *body) -> None:
        heads = (heads,) if isinstance(heads, Head) else tuple(heads)
        rule = Rule(heads, body)
        self._check(rule)
        self.rules.append(rule)
        self._done.clear()

    def apply(self, function: Callable[..., DataFrame | tuple[DataFrame, ...]], inputs: Iterable[str], outputs: Iterable[str]) -> None:
        """A transformer: a function of whole relations."""
        inputs, outputs = tuple(inputs), tuple(outputs)
        for name in (*inputs, *outputs):
            self._known(name)
        for name in outputs:
            if self.relations[name].is_input:
                raise RuleError(f"{name}: a transformer cannot produce an input relation")
            if any(h.relation == name for r in self.rules for h in r.heads) or any(name in o for _, _, o in self.transformers):
                raise RuleError(f"{name}: a transformer must be the only producer of its output")
        self.transformers.append((function, inputs, outputs))

    def _known(self, name: str) -> Relation:
        if name not in self.relations:
            raise RuleError(f"relation {name} is not declared")
        return self.relations[name]

    # -- static rules ----------------------------------------------------
    def _check(self, rule: Rule) -> None:
        bound: set[str] = set()
        streams, seen_stream = 0, False
        for term in rule.body:
            if isinstance(term, _Atom):
                relation = self._known(term.relation)
                unknown = set(term.patterns) - set(relation.columns)
                if unknown:
                    raise RuleError(f"{relation.name} has no column {sorted(unknown)[0]}")
                if term.delay < 0:
                    raise RuleError("a delay is a positive number of transactions")
                if term.diff and relation.kind == "stream":
                    raise RuleError(f"{relation.name}: a stream cannot be differentiated")
                is_stream = relation.kind == "stream" and not term.delay or term.diff
                if isinstance(term, Not):
                    if is_stream:
                        raise RuleError(f"stream {relation.name} cannot be negated")
                    if seen_stream:
                        raise RuleError("a negated relation cannot follow a stream")
                    if term.bind or term.variables() - bound:
                        raise RuleError("a negated relation introduces no variables")
                else:
                    streams += is_stream
                    seen_stream |= is_stream
                    if streams > 1:
                        raise RuleError("a rule has at most one stream")
                    bound |= term.variables()
            elif isinstance(term, (Let, FlatMap)):
                if term.name in bound:
                    raise RuleError(f"variable {term.name} is bound twice")
                bound.add(term.name)
            elif isinstance(term, GroupBy):
                if not set(term.keys) <= bound:
                    raise RuleError("a group's key must be bound variables")
                if set(term.aggregates) & bound:
                    raise RuleError("a group's variable must be new")
                bound = set(term.keys) | set(term.aggregates)
        for head in rule.heads:
            relation = self._known(head.relation)
            if relation.is_input:
                raise RuleError(f"input relation {relation.name} cannot be the head of a rule")
            if set(head.columns) != set(relation.columns):
                raise RuleError(f"the head must give all columns of {relation.name}")
            for value in head.columns.values():
                if isinstance(value, str) and value not in bound:
                    raise RuleError(f"head variable {value} is not bound")
            if rule.body and (relation.kind == "stream") != seen_stream and not any(isinstance(t, GroupBy) for t in rule.body):
                raise RuleError(f"{relation.name}: a stream in the body and a stream as head go together")
            if any(head.relation in o for _, _, o in self.transformers):
                raise RuleError(f"{relation.name}: a transformer must be its only producer")

    def strata(self) -> list[list[str]]:
        """Relations in the order of evaluation; those of one list are mutually
        recursive."""
        needs: dict[str, list[tuple[str, str]]] = {name: [] for name in self.relations}
        for rule in self.rules:
            grouped = any(isinstance(t, GroupBy) for t in rule.body)
            for head in rule.heads:
                for term in rule.body:
                    if isinstance(term, _Atom) and not term.delay:
                        kind = "negation" if isinstance(term, Not) else "group" if grouped else "difference" if term.diff else ""
                        needs[head.relation].append((term.relation, kind))
        for _, inputs, outputs in self.transformers:
            for o in outputs:
                needs[o] += [(i, "transformer") for i in inputs]
        components = _components({n: [m for m, _ in ms] for n, ms in needs.items()})
        for component in components:
            inside = set(component)
            for name in component:
                for other, kind in needs[name]:
                    if kind and other in inside and (len(inside) > 1 or other == name):
                        raise RuleError(f"{kind} of {other} inside its own recursion")
                if self.relations[name].kind == "stream" and any(m in inside for m, _ in needs[name]):
                    raise RuleError(f"stream {name} cannot be recursive")
        return components

    # -- evaluation ------------------------------------------------------
    def result(self, name: str) -> DataFrame:
        self._known(name)
        if name not in self._done:
            wanted = self._needed(name)
            for component in self.strata():
                if wanted & set(component) and not set(component) <= set(self._done):
                    self._evaluate(component)
        return self._done[name]

    def results(self) -> dict[str, DataFrame]:
        return {n: self.result(n) for n, r in self.relations.items() if r.output}

    def every(self, mirror: str | None = None) -> dict[str, DataFrame]:
        """All relations, for debugging; inputs under a prefix if one is given."""
        return {(mirror or "") + n if r.is_input else n: self.result(n) for n, r in self.relations.items() if mirror is not None or not r.is_input}

    def lookup(self, index: str, *values) -> DataFrame:
        """The rows of an index with these key values."""
        for r in self.relations.values():
            if index in r.indexes:
                return self.result(r.name).where(reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(r.indexes[index], values, strict=True))))
        raise RuleError(f"index {index} is not declared")

    def _needed(self, name: str) -> set[str]:
        out, todo = set(), [name]
        while todo:
            n = todo.pop()
            if n in out:
                continue
            out.add(n)
            for rule in self.rules:
                if any(h.relation == n for h in rule.heads):
                    todo += [t.relation for t in rule.body if isinstance(t, _Atom)]
            for _, inputs, outputs in self.transformers:
                if n in outputs:
                    todo += inputs
        return out

    def _evaluate(self, component: list[str]) -> None:
        for function, inputs, outputs in self.transformers:
            if set(outputs) & set(component):
                made = function(*(self.result(i) for i in inputs))
                made = (made,) if isinstance(made, DataFrame) else made
                for name, df in zip(outputs, made, strict=True):
                    self._done[name] = df.toDF(*self.relations[name].columns)
        inside = set(component)
        for name in component:
            if self.relations[name].is_input and name not in self._done:
                r = self.relations[name]
                self._done[name] = r.data
        todo = [n for n in component if n not in self._done]
        if not todo:
            return
        rules = [(r, h) for r in self.rules for h in r.heads if h.relation in inside]
        recursive = any(isinstance(t, _Atom) and not t.delay and t.relation in inside for r, _ in rules for t in r.body)
        if not recursive:
            for name in todo:
                own = [(r, h) for r, h in rules if h.relation == name]
                if not own:
                    raise RuleError(f"relation {name} has no rules")
                parts = [self._project(self._body(r, {}), h) for r, h in own]
                df = reduce(DataFrame.unionByName, parts)
                if self.relations[name].kind == "set" and not (len(own) == 1 and self._distinct_already(*own[0])):
                    df = df.distinct()
                self._done[name] = df
            return
        self._fixpoint(todo, rules)

    def _fixpoint(self, names: list[str], rules: list[tuple[Rule, Head]]) -> None:
        """Semi-naive: each round joins only what the last one found."""
        inside = set(names)
        uses = lambda r: [i for i, t in enumerate(r.body) if isinstance(t, Atom) and t.relation in inside and not t.delay]
        start = {n: [self._project(self._body(r, {}), h) for r, h in rules if h.relation == n and not uses(r)] for n in names}
        total: dict[str, list[DataFrame]] = {}
        delta: dict[str, DataFrame | None] = {}
        empty: dict[str, DataFrame] = {}
        for n in names:
            if not start[n]:
                delta[n], total[n] = None, []
                continue
            first = stored(reduce(DataFrame.unionByName, start[n]).distinct(), n)
            delta[n], total[n], empty[n] = first, [first], first
        for _ in range(self.most_rounds):
            found: dict[str, DataFrame] = {}
            for n in names:
                parts = []
                for rule, head in rules:
                    if head.relation != n:
                        continue
                    for i in uses(rule):
                        own = rule.body[i].relation
                        if delta[own] is None:
                            continue
                        replaced: dict[int, DataFrame] = {i: delta[own]}
                        others = [j for j in uses(rule) if j != i]
                        if any(not total[rule.body[j].relation] for j in others):
                            continue
                        replaced |= {j: reduce(DataFrame.unionByName, total[rule.body[j].relation]) for j in others}
                        parts.append(self._project(self._body(rule, replaced), head))
                if not parts:
                    continue
                fresh = reduce(DataFrame.unionByName, parts).distinct()
                if total[n]:
                    seen = reduce(DataFrame.unionByName, total[n])
                    same = reduce(Column.__and__, (fresh[c].eqNullSafe(seen[c]) for c in fresh.columns))
                    fresh = fresh.join(seen, same, "left_anti")
                found[n] = stored(fresh, n)
            delta = {n: found[n] if n in found and not found[n].isEmpty() else None for n in names}
            if all(d is None for d in delta.values()):
                break
            for n, d in delta.items():
                if d is not None:
                    total[n].append(d)
                    if len(total[n]) % 16 == 0:  # few long parts rather than many short ones
                        total[n] = [stored(reduce(DataFrame.unionByName, total[n]), n)]
        else:
            raise RuntimeError(f"no fixpoint after {self.most_rounds} rounds: {', '.join(names)}")
        for n in names:
            if not total[n]:
                raise RuleError(f"relation {n} has only recursive rules")
            self._done[n] = reduce(DataFrame.unionByName, total[n])

    def past(self, name: str, versions: list[DataFrame]) -> None:
        """Earlier versions of a relation, the latest first, for delays."""
        self._past[name] = versions

    def _source(self, term: _Atom) -> DataFrame:
        if term.delay:
            versions = self._past.get(term.relation, [])
            if len(versions) < term.delay:
                return self.result(term.relation).limit(0)
            return versions[term.delay - 1]
        now = self.result(term.relation)
        if term.diff:
            before = self._past.get(term.relation, [])
            return now.subtract(before[0]) if before else now
        return now

    def _body(self, rule: Rule, replaced: dict[int, DataFrame]) -> DataFrame:
        df: DataFrame | None = None
        for i, term in enumerate(rule.body):
            if isinstance(term, _Atom):
                df = self._join(df, term, replaced.get(i) if i in replaced else self._source(term))
            elif df is None:
                df = self._step(self.spark.range(1).select(), term)
            else:
                df = self._step(df, term)
        return self.spark.range(1).select() if df is None else df

    def _join(self, df: DataFrame | None, term: _Atom, source: DataFrame) -> DataFrame:
        bound = set(df.columns) if df is not None else set()
        conditions: list[Column] = []
        columns: dict[str, Column] = {}
        computed: list[tuple[str, str]] = []

        def match(value: Column, pattern, path: str) -> None:
            if isinstance(pattern, dict):
                for name, inner in pattern.items():
                    match(value.getField(name), inner, f"{path}.{name}")
            elif isinstance(pattern, Expr) and not bound & set(re.findall(r"\w+", re.sub(r"'[^']*'", "", pattern.sql))):
                conditions.append(value.eqNullSafe(F.expr(pattern.sql)))
            elif isinstance(pattern, Expr):
                name = f"__p{len(computed)}"
                computed.append((name, pattern.sql))
                columns[name] = value
            elif isinstance(pattern, str):
                if pattern == "_":
                    return
                if pattern in columns:
                    conditions.append(value.eqNullSafe(columns[pattern]))
                else:
                    columns[pattern] = value
            else:
                conditions.append(value.eqNullSafe(F.lit(pattern.value if isinstance(pattern, Lit) else pattern)))

        for name, pattern in term.patterns.items():
            match(source[name], pattern, name)
        if conditions:
            source = source.where(reduce(Column.__and__, conditions))
        if term.bind:
            columns[term.bind] = F.struct(*(source[c] for c in source.columns))
        right = source.select(*(c.alias(n) for n, c in columns.items()))
        if df is None:
            if isinstance(term, Not):
                df = self.spark.range(1).select(F.lit(1).alias("__one"))
                return df.join(right, F.lit(True), "left_anti").drop("__one")
            return right
        left = df
        for name, sql in computed:
            left = left.withColumn(name, F.expr(sql))
        shared = [c for c in right.columns if c in bound or c.startswith("__p")]
        new = [c for c in right.columns if c not in shared]
        renamed = right.select(*(F.col(c).alias(f"__r_{c}") if c in shared else F.col(c) for c in right.columns))
        how = "left_anti" if isinstance(term, Not) else "inner" if new else "left_semi"
        if not shared:
            if how == "inner":
                return left.crossJoin(renamed)
            return left.join(renamed, F.lit(True), how)
        on = reduce(Column.__and__, (left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in shared))
        return left.join(renamed, on, how).drop(*(f"__r_{c}" for c in shared), *(n for n, _ in computed))

    def _step(self, df: DataFrame, term) -> DataFrame:
        if isinstance(term, Where):
            return df.where(F.expr(term.sql))
        if isinstance(term, Let):
            df = df.withColumn(term.name, F.expr(term.sql))
            return df if term.keep_null else df.where(F.col(term.name).isNotNull())
        if isinstance(term, FlatMap):
            kind = df.select(F.expr(term.sql).alias("x")).schema["x"].dataType.typeName()
            source = F.map_entries(F.expr(term.sql)) if kind == "map" else F.expr(term.sql)
            return df.select("*", F.explode(source).alias(term.name))
        if isinstance(term, GroupBy):
            used = list(dict.fromkeys([*term.keys, *(term.of if term.of is not None else df.columns)]))
            rows = df.select(*used)
            if term.distinct:
                rows = rows.distinct()
            out = rows.groupBy(*term.keys).agg(*(F.expr(sql).alias(name) for name, sql in term.aggregates.items()))
            if not term.keys:  # an empty relation has no groups
                out = rows.agg(F.count(F.lit(1)).alias("__n"), *(F.expr(sql).alias(name) for name, sql in term.aggregates.items())).where("__n > 0").drop("__n")
            return out.where(F.expr(term.having)) if term.having else out
        if isinstance(term, Inspect):
            from pyspark.sql import Observation

            seen = Observation(term.name)
            self.observations[term.name] = seen
            return df.observe(seen, *(F.expr(sql).alias(name) for name, sql in term.measures.items()))
        raise RuleError(f"not a term of a body: {term!r}")

    def _project(self, df: DataFrame, head: Head) -> DataFrame:
        def value(v) -> Column:
            if isinstance(v, Expr):
                return F.expr(v.sql)
            if isinstance(v, str):
                return F.col(v)
            return F.lit(v.value if isinstance(v, Lit) else v)

        return df.select(*(value(head.columns[c]).alias(c) for c in self.relations[head.relation].columns))

    def _distinct_already(self, rule: Rule, head: Head) -> bool:
        """Whether the rows of a head cannot repeat: they hold the key of the
        last group, or all columns of one set that nothing multiplies."""
        plain = {v for v in head.columns.values() if isinstance(v, str)}
        groups = [i for i, t in enumerate(rule.body) if isinstance(t, GroupBy)]
        rest = rule.body[groups[-1] + 1 :] if groups else rule.body[1:]
        if any(isinstance(t, (FlatMap, GroupBy)) or isinstance(t, Atom) for t in rest):
            return False
        if groups:
            return set(rule.body[groups[-1]].keys) <= plain
        first = rule.body[0] if rule.body else None
        if not isinstance(first, Atom):
            return not rule.body
        relation = self.relations[first.relation]
        known = relation.kind == "set" and (not relation.is_input or relation.key)
        needed = relation.key or relation.columns
        return bool(known) and all(isinstance(p := first.patterns.get(c), (Lit, int, float)) or isinstance(p, str) and p in plain for c in needed)


def _components(graph: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, each after those it needs (Tarjan)."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for root in graph:
        if root in number:
            continue
        work = [(root, iter(graph[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            step = next(rest, None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    component = []
                    while True:
                        n = stack.pop()
                        on.discard(n)
                        component.append(n)
                        if n == node:
                            break
                    out.append(component)
            elif step not in number:
                number[step] = low[step] = len(number)
                stack.append(step)
                on.add(step)
                work.append((step, iter(graph[step])))
            elif step in on:
                low[node] = min(low[node], number[step])
    return out
