"""Weighted relations (Z-sets), streams of them, and circuits of stream operators.

A Z-set is a DataFrame with a BIGINT weight column. Sums of equal rows make one
row, and rows of weight zero are gone, once it is consolidated. A stream is a
sequence of Z-sets, one for each tick; operators on streams are functions of
sequences, and plans stay lazy until a tick is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHT = "__w"


class ZSet:
    def __init__(self, df: DataFrame, weight: str = WEIGHT):
        if weight != WEIGHT:
            df = df.withColumnRenamed(weight, WEIGHT)
        self.df = df
        self.columns = [c for c in df.columns if c != WEIGHT]

    @classmethod
    def of(cls, df: DataFrame, weight: int | Column = 1) -> ZSet:
        """Every row of ``df`` with one weight."""
        w = weight if isinstance(weight, Column) else F.lit(weight)
        return cls(df.withColumn(WEIGHT, w.cast("long")))

    def consolidate(self) -> ZSet:
        if not self.columns:
            return ZSet(self.df.agg(F.sum(WEIGHT).alias(WEIGHT)).where(f"{WEIGHT} <> 0"))
        return ZSet(self.df.groupBy(*self.columns).agg(F.sum(WEIGHT).cast("long").alias(WEIGHT)).where(f"{WEIGHT} <> 0").select(*self.columns, WEIGHT))

    def add(self, other: ZSet) -> ZSet:
        return ZSet(self.df.unionByName(other.df)).consolidate()

    def negate(self) -> ZSet:
        return ZSet(self.df.withColumn(WEIGHT, -F.col(WEIGHT)))

    def minus(self, other: ZSet) -> ZSet:
        return self.add(other.negate())

    __add__, __neg__, __sub__ = add, negate, minus

    def distinct(self) -> ZSet:
        """The positive part, each row with weight 1."""
        return ZSet(self.consolidate().df.where(f"{WEIGHT} > 0").withColumn(WEIGHT, F.lit(1).cast("long")))

    def is_set(self) -> bool:
        return self.consolidate().df.where(f"{WEIGHT} <> 1").isEmpty()

    def is_empty(self) -> bool:
        return self.consolidate().df.isEmpty()

    def same(self, other: ZSet) -> bool:
        return self.minus(other).is_empty()

    def support(self) -> DataFrame:
        """The rows, without weights."""
        return self.consolidate().df.drop(WEIGHT)

    def weight(self, **row) -> int:
        """The weight of one row."""
        where = reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in row.items()))
        return self.df.where(where).agg(F.coalesce(F.sum(WEIGHT), F.lit(0))).first()[0]

    def map(self, **columns: Column | str) -> ZSet:
        made = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
        return ZSet(self.df.select(*made, WEIGHT)).consolidate()

    def filter(self, condition: Column | str) -> ZSet:
        return ZSet(self.df.where(condition))

    def flat_map(self, name: str, array: Column | str) -> ZSet:
        source = F.expr(array) if isinstance(array, str) else array
        return ZSet(self.df.select(F.explode(source).alias(name), WEIGHT)).consolidate()

    def join(self, other: ZSet, on: list[str]) -> ZSet:
        """Weights multiply; columns of both sides, the key once."""
        right = other.df.withColumnRenamed(WEIGHT, "__v")
        joined = self.df.join(right, on).withColumn(WEIGHT, F.col(WEIGHT) * F.col("__v")).drop("__v")
        return ZSet(joined).consolidate()

    def product(self, other: ZSet) -> ZSet:
        right = other.df.withColumnRenamed(WEIGHT, "__v")
        return ZSet(self.df.crossJoin(right).withColumn(WEIGHT, F.col(WEIGHT) * F.col("__v")).drop("__v")).consolidate()

    def group_by(self, *keys: str) -> Grouping:
        return Grouping(self, keys)


class Grouping:
    def __init__(self, zset: ZSet, keys: tuple[str, ...]):
        self.zset, self.keys = zset.consolidate(), keys

    def count(self, name: str = "count") -> ZSet:
        """Sum of weights in each group."""
        return ZSet.of(self.zset.df.groupBy(*self.keys).agg(F.sum(WEIGHT).cast("long").alias(name)))

    def distinct_count(self, name: str = "count") -> ZSet:
        return ZSet.of(self.zset.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(name)))

    def sum(self, column: str, name: str = "sum") -> ZSet:
        return ZSet.of(self.zset.df.groupBy(*self.keys).agg(F.sum(F.col(column) * F.col(WEIGHT)).alias(name)))

    def aggregate(self, **aggregates: Column | str) -> ZSet:
        """Spark aggregates, which may use the weight column."""
        made = [(F.expr(a) if isinstance(a, str) else a).alias(n) for n, a in aggregates.items()]
        return ZSet.of(self.zset.df.groupBy(*self.keys).agg(*made))


class Stream:
    """Z-sets (or numbers, with ``zero``) for the ticks 0, 1, ..."""

    def __init__(self, ticks: Iterable, zero):
        self.ticks, self.zero = list(ticks), zero

    def __getitem__(self, t: int):
        return self.ticks[t] if t < len(self.ticks) else self.zero

    def __len__(self) -> int:
        return len(self.ticks)

    def apply(self, f: Callable) -> Stream:
        """``f`` at each tick (lifting)."""
        return Stream([f(x) for x in self.ticks], f(self.zero))

    lift = apply

    def apply2(self, other: Stream, f: Callable) -> Stream:
        n = max(len(self), len(other))
        return Stream([f(self[t], other[t]) for t in range(n)], f(self.zero, other.zero))

    def add(self, other: Stream) -> Stream:
        return self.apply2(other, lambda a, b: a + b)

    def negate(self) -> Stream:
        return self.apply(lambda a: -a)

    def delay(self) -> Stream:
        return Stream([self.zero, *self.ticks[:-1]], self.zero) if self.ticks else self

    def differentiate(self) -> Stream:
        return Stream([self[t] - (self[t - 1] if t else self.zero) for t in range(len(self))], self.zero)

    def integrate(self) -> Stream:
        out, total = [], self.zero
        for x in self.ticks:
            total = total + x
            out.append(total)
        return Stream(out, self.zero)

    def cut(self, at: int) -> Stream:
        """The first ``at`` ticks, then zeros."""
        return Stream(self.ticks[:at], self.zero)

    def compose(self, *functions: Callable[[Stream], Stream]) -> Stream:
        return reduce(lambda s, f: f(s), functions, self)

    def incremental(self, f: Callable) -> Stream:
        """D(f(I(s))): a function of whole relations, on changes."""
        return self.integrate().apply(f).differentiate()


def delta0(value, zero, length: int = 1) -> Stream:
    """``value`` at tick 0, then zeros."""
    return Stream([value, *[zero] * (length - 1)], zero)


def incremental_join(left: Stream, right: Stream, on: list[str]) -> Stream:
    """The change of a join, from the changes of its sides and what was before."""
    a, b = left.integrate().delay(), right.integrate().delay()
    parts = [left.apply2(b, lambda x, y: x.join(y, on)), a.apply2(right, lambda x, y: x.join(y, on)), left.apply2(right, lambda x, y: x.join(y, on))]
    return reduce(Stream.add, parts)


def fixpoint(step: Callable, start, same: Callable, most: int = 1000):
    """The value that ``step`` no longer changes."""
    value = start
    for _ in range(most):
        fresh = step(value)
        if same(value, fresh):
            return fresh
        value = fresh
    raise RuntimeError(f"no fixpoint after {most} steps")


class Operator:
    """A node of a circuit: consumes the values on its inputs at each tick."""

    def __init__(self, function: Callable, *inputs: Operator, name: str = ""):
        self.function, self.inputs, self.name = function, list(inputs), name or type(self).__name__
        self.value = None

    def tick(self) -> None:
        self.value = self.function(*(i.value for i in self.inputs))

    def end(self) -> None:
        """After all operators have had their tick."""


class Source(Operator):
    def __init__(self):
        super().__init__(lambda: None)

    def put(self, value) -> None:
        self.value = value

    def tick(self) -> None:
        pass


class Identity(Operator):
    def __init__(self, source: Operator):
        super().__init__(lambda x: x, source)


class Plus(Operator):
    def __init__(self, a: Operator, b: Operator):
        super().__init__(lambda x, y: x + y, a, b)


class Negate(Operator):
    def __init__(self, source: Operator):
        super().__init__(lambda x: -x, source)


class Delay(Operator):
    """The value of the tick before; may be connected later, for feedback."""

    def __init__(self, zero, source: Operator | None = None):
        super().__init__(lambda *_: None, *([source] if source else []))
        self.zero, self.held = zero, zero

    def connect(self, source: Operator) -> None:
        self.inputs = [source]

    def tick(self) -> None:
        self.value = self.held

    def end(self) -> None:
        self.held = self.inputs[0].value

    def reset(self) -> None:
        self.held = self.zero


class Integral(Operator):
    def __init__(self, zero, source: Operator):
        super().__init__(lambda x: x, source)
        self.zero = self.total = zero

    def tick(self) -> None:
        self.total = self.value = self.total + self.inputs[0].value

    def reset(self) -> None:
        self.total = self.zero


class Derivative(Operator):
    def __init__(self, zero, source: Operator):
        super().__init__(lambda x: x, source)
        self.zero = self.before = zero

    def tick(self) -> None:
        self.value = self.inputs[0].value - self.before

    def end(self) -> None:
        self.before = self.inputs[0].value

    def reset(self) -> None:
        self.before = self.zero


class Sink(Operator):
    def __init__(self, source: Operator, consumer: Callable | None = None):
        super().__init__(lambda x: x, source)
        self.seen: list = []
        self.consumer = consumer or self.seen.append

    def end(self) -> None:
        self.consumer(self.inputs[0].value)


class Circuit:
    """Operators in an order in which inputs come before their users; only
    delays may close a cycle."""

    def __init__(self):
        self.operators: list[Operator] = []

    def add(self, operator: Operator) -> Operator:
        self.operators.append(operator)
        return operator

    def step(self) -> None:
        for o in self.operators:
            o.tick()
        for o in self.operators:
            o.end()

    def reset(self) -> None:
        for o in self.operators:
            getattr(o, "reset", lambda: None)()

    def bracket(self, source: Source, value, zero, out: Operator, stop: Callable, most: int = 1000):
        """Nested time: ``value`` at its first tick and zeros after it, until
        ``out`` is a change of nothing; the sum of all its values."""
        self.reset()
        total = zero
        for t in range(most):
            source.put(value if t == 0 else zero)
            self.step()
            total = total + out.value
            if stop(out.value):
                return total
        raise RuntimeError(f"no fixpoint after {most} ticks")


def empty(spark: SparkSession, schema: str) -> ZSet:
    return ZSet.of(spark.createDataFrame([], schema))


class Changes:
    """Signed changes of several relations, summed as they come."""

    def __init__(self, parts: dict[str, ZSet] | None = None):
        self.parts = dict(parts or {})

    def add(self, name: str, change: ZSet) -> None:
        self.parts[name] = self.parts[name].add(change) if name in self.parts else change.consolidate()

    def union(self, other: Changes) -> Changes:
        out = Changes(self.parts)
        for name, change in other.parts.items():
            out.add(name, change)
        return out

    def get(self, name: str) -> ZSet | None:
        return self.parts.get(name)

    def clear(self, name: str | None = None) -> None:
        if name is None:
            self.parts.clear()
        else:
            self.parts.pop(name, None)
