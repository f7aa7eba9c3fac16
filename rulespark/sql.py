"""The SQL front end: a database of tables and views in one session.

Tables are versions of DataFrames, changed by INSERT, UPDATE and DELETE; views
are Spark's, so that a view of a view is one plan. A primary key, given as a
column property or a table constraint, is held on INSERT. Type names of several
dialects are understood. Everything else is Spark SQL, which has more than the
dialect needs: ORDER BY, WITH, UNION ALL, window frames.

Averages of integers are Spark's; the truncated ones are
``rulespark.functions.sql.agg_avg_signed_N``.

A negated IN of a subquery is written with a plain one, so that the subquery is
shuffled: Spark broadcasts all its rows for NOT IN.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.storage import stored

TYPES = [(r"character varying|varchar|char|text|clob", "string"), (r"integer|int4", "int"), (r"int8|long", "bigint"), (r"real|float4", "float"), (r"double precision|float8", "double"), (r"bool", "boolean"), (r"timestamp", "timestamp_ntz"), (r"time", "bigint")]


class SqlError(ValueError):
    """A statement that the front end does not accept."""


def spark_type(name: str) -> str:
    """The Spark type for a type of another dialect."""
    name = re.sub(r"\s+", " ", name.strip().lower())
    array = re.fullmatch(r"array\s*[(<]\s*(.*?)\s*[)>]|(.*?)\s*(?:array|\[\])", name)
    if array:
        return f"array<{spark_type(array[1] or array[2])}>"
    base = re.sub(r"\(\s*\d+\s*\)", "", name).strip() if not name.startswith("decimal") else name
    for pattern, kind in TYPES:
        if re.fullmatch(pattern, base):
            return kind
    return base


def split_list(text: str) -> list[str]:
    """At commas outside brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([<":
            depth += 1
        elif c in ")]>":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()] if text[start:].strip() else out


TOKEN = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|\s+|[<>=!]+|.""", re.DOTALL)
#: What an operand of IN cannot reach beyond.
BOUNDS = {"select", "distinct", "all", "where", "and", "or", "not", "!", "on", "having", "when", "then", "else", "case", "by", ",", ";"}


def without_not_in(text: str, alone: Callable[[str], bool]) -> str:
    """``text`` with each negated ``x IN (subquery)`` as a plain one and a look
    at the subquery's nulls: it is unknown if x, or some value, is null and
    nothing equals, and true or false otherwise. alone: whether a subquery is
    the same for every row and each time it is run; others stay, as do pairs."""
    tokens = TOKEN.findall(text)
    word = lambda i: tokens[i].lower() if 0 <= i < len(tokens) else ""
    blank = lambda i: tokens[i].isspace() or tokens[i].startswith(("--", "/*"))

    def step(i: int, by: int) -> int:
        i += by
        while 0 <= i < len(tokens) and blank(i):
            i += by
        return i

    for i in range(len(tokens) - 1, -1, -1):
        opening = step(i, 1)
        if word(i) != "in" or word(opening) != "(" or word(step(opening, 1)) not in ("select", "with"):
            continue
        closing, depth = opening, 1
        while depth and (closing := closing + 1) < len(tokens):
            depth += {"(": 1, ")": -1}.get(tokens[closing], 0)
        own = word(step(i, -1)) == "not"
        last = first = step(step(i, -1) if own else i, -1)
        depth = cases = 0
        while first >= 0 and not (depth == cases == 0 and (word(first) in BOUNDS or word(first) == "(")):
            depth += {")": 1, "(": -1}.get(word(first), 0)
            cases += {"end": 1, "case": -1}.get(word(first), 0) if not depth else 0
            first -= 1
        outer, depth, negated = first, 0, own or word(step(first + 1, -1)) in ("not", "!")
        while outer >= 0 and not negated:
            depth += {")": 1, "(": -1}.get(word(outer), 0)
            if depth < 0:
                depth, negated = 0, word(step(outer, -1)) in ("not", "!")
            outer -= 1
        x, query = "".join(tokens[first + 1 : last + 1]).strip(), "".join(tokens[opening + 1 : closing])
        if not negated or not x or closing >= len(tokens) or x.startswith("(") and len(split_list(x[1:-1])) > 1 or not alone(query):
            continue
        nulls = f"(SELECT CASE WHEN count(*) = 0 THEN 0 WHEN count(__v) = count(*) THEN 1 ELSE 2 END FROM ({query}\n) AS __s(__v))"
        yes, no = ("FALSE", "TRUE") if own else ("TRUE", "FALSE")
        tokens[first + 1 : closing + 1] = [f" (CASE WHEN ({x}) IN ({query}) THEN {yes} WHEN {nulls} > CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END THEN CAST(NULL AS BOOLEAN) ELSE {no} END)"]
    return "".join(tokens)


class Database:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        #: another prefix for each database, so that their views do not meet
        self.prefix = "db" + uuid.uuid4().hex[:8] + "_"
        self.tables: dict[str, DataFrame] = {}
        self.keys: dict[str, list[str]] = {}
        self.views: dict[str, str] = {}
        self.indexes: dict[str, tuple[str, list[str]]] = {}

    def register(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        self.tables[name] = df
        self.keys[name] = key or []
        df.createOrReplaceTempView(self.prefix + name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.prefix + name.lower())

    def _named(self, text: str) -> str:
        """The text with the database's own names for relations."""
        names = sorted([*self.tables, *self.views], key=len, reverse=True)
        if not names:
            return text
        pattern = re.compile(r"('(?:[^']|'')*')|(?<![\w.])(" + "|".join(map(re.escape, names)) + r")(?![\w(])(?=(\.\w)?)", re.IGNORECASE)

        def swap(m: re.Match) -> str:
            if m[1]:
                return m[1]
            before = text[: m.start()].rstrip()
            relation = re.search(r"(?:\bfrom|\bjoin|,)$", before, re.IGNORECASE)
            if m[3] or relation and not (before.endswith(",") and not self._in_from(before)):
                return self.prefix + m[2].lower()
            return m[2]

        return pattern.sub(swap, text)

    @staticmethod
    def _in_from(before: str) -> bool:
        """Whether a comma continues a FROM list: the last keyword is FROM."""
        words = re.findall(r"\b(select|from|where|group|order|having|on|using|values|set)\b", re.sub(r"\([^()]*\)", "", before), re.IGNORECASE)
        return bool(words) and words[-1].lower() == "from"

    def execute(self, statement: str) -> DataFrame:
        text = statement.strip().rstrip(";").strip()
        for pattern, act in (
            (r"create\s+table\s+(?:if\s+not\s+exists\s+)?(\w+)\s*\((.*)\)(?:\s+with\s*\(.*\))?", self._create_table),
            (r"create\s+(?:or\s+replace\s+)?view\s+(\w+)\s+as\s+(.*)", self._create_view),
            (r"create\s+index\s+(\w+)\s+on\s+(\w+)\s*\((.*)\)", self._create_index),
            (r"insert\s+into\s+(\w+)\s*(?:\(([^()]*)\)\s*)?((?:values|select)\b.*)", self._insert),
            (r"update\s+(\w+)\s+set\s+(.*?)(?:\s+where\s+(.*))?", self._update),
            (r"delete\s+from\s+(\w+)(?:\s+where\s+(.*))?", self._delete),
        ):
            m = re.fullmatch(pattern, text, re.IGNORECASE | re.DOTALL)
            if m:
                return act(*m.groups()) or self.spark.range(0).select()
        return self._query(text)

    def _query(self, text: str) -> DataFrame:
        text = self._named(text)
        made = self.spark.sql(text)
        common = self._common(text)
        if common is None:
            return made

        def alone(query: str) -> bool:
            if re.search(r"\b(?:limit|offset|tablesample)\b", query, re.IGNORECASE):
                return False
            try:
                return self._repeatable(self.spark.sql(common + query))
            except PySparkException:  # it has columns of the query around it
                return False

        plain = without_not_in(text, alone)
        if plain == text or not self._repeatable(made):
            return made
        try:
            better = self.spark.sql(plain).toDF(*made.columns)
            better._jdf.queryExecution().optimizedPlan()
        except PySparkException:
            return made
        return better

    @staticmethod
    def _repeatable(df: DataFrame) -> bool:
        return df._jdf.queryExecution().analyzed().deterministic()

    @staticmethod
    def _common(text: str) -> str | None:
        """The WITH part of a query, which may be empty; None if the text is
        another statement, which must not be run twice."""
        depth, out = 0, []
        for t in TOKEN.findall(text):
            if (not depth or not out) and re.fullmatch(r"\w+", t):
                if t.lower() == "select" or depth and t.lower() == "with":
                    return "".join(out)
                if not out and t.lower() != "with" or t.lower() in ("insert", "from", "update", "delete", "merge"):
                    return None
            depth += {"(": 1, ")": -1}.get(t, 0)
            if out or re.fullmatch(r"\w+", t):
                out.append(t)
        return None

    def _create_table(self, name: str, body: str) -> None:
        name, columns, key = name.lower(), [], []
        if name in self.tables or name in self.views:
            raise SqlError(f"{name} exists")
        for part in split_list(body):
            constraint = re.fullmatch(r"primary\s+key\s*\((.*)\)", part, re.IGNORECASE)
            if constraint:
                key = [c.strip().lower() for c in split_list(constraint[1])]
                continue
            m = re.fullmatch(r"(\w+)\s+(.*?)((?:\s+not)?\s+null)?(\s+primary\s+key)?(\s+with\s*\(\s*primary_key\s*=\s*true\s*\))?(?:\s+not\s+null)?", part, re.IGNORECASE | re.DOTALL)
            if not m:
                raise SqlError(f"not a column: {part}")
            columns.append(f"`{m[1].lower()}` {spark_type(m[2])}" + (" not null" if m[3] and "not" in m[3].lower() else ""))
            if m[4] or m[5]:
                key.append(m[1].lower())
        self.register(name, self.spark.createDataFrame([], ", ".join(columns)), key)

    def _create_view(self, name: str, body: str) -> None:
        name = name.lower()
        if name in self.tables or name in self.views:
            raise SqlError(f"{name} exists")
        made = self._query(body)
        made.createOrReplaceTempView(self.prefix + name)
        self.views[name] = body

    def _create_index(self, name: str, relation: str, columns: str) -> None:
        relation = relation.lower()
        if relation not in self.tables and relation not in self.views:
            raise SqlError(f"no relation {relation}")
        self.indexes[name.lower()] = (relation, [c.strip() for c in split_list(columns)])

    def lookup(self, index: str, *values) -> DataFrame:
        relation, columns = self.indexes[index.lower()]
        df = self.table(relation)
        for c, v in zip(columns, values, strict=True):
            df = df.where(F.col(c).eqNullSafe(F.lit(v)))
        return df

    def _own(self, name: str) -> str:
        if name.lower() not in self.tables:
            raise SqlError(f"{name} is not a table")
        return name.lower()

    def _refresh(self, name: str, df: DataFrame) -> None:
        self.register(name, stored(df, name), self.keys[name])
        for view, body in self.views.items():  # a temporary view keeps the plan it was made with
            self._query(body).createOrReplaceTempView(self.prefix + view)

    def _insert(self, name: str, columns: str | None, source: str) -> None:
        name = self._own(name)
        old = self.tables[name]
        names = [c.strip().lower() for c in split_list(columns)] if columns else old.columns
        new = self._query(source)
        if len(new.columns) != len(names):
            raise SqlError(f"{len(new.columns)} values for {len(names)} columns")
        new = new.toDF(*names)
        types = dict(old.dtypes)
        new = new.select(*((F.col(c) if c in names else F.lit(None)).cast(types[c]).alias(c) for c in old.columns))
        key = self.keys[name]
        if key and not (new.groupBy(*key).count().where("count > 1").isEmpty() and new.join(old, key, "left_semi").isEmpty()):
            raise SqlError(f"{name}: a row with this key exists")
        self._refresh(name, old.unionByName(new))

    def _update(self, name: str, changes: str, where: str | None) -> None:
        name = self._own(name)
        old, types = self.tables[name], dict(self.tables[name].dtypes)
        made = {c.split("=", 1)[0].strip().lower(): c.split("=", 1)[1].strip() for c in split_list(changes)}
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        self._refresh(name, old.select(*(F.when(hit, F.expr(made[c])).otherwise(F.col(c)).cast(types[c]).alias(c) if c in made else F.col(c) for c in old.columns)))

    def _delete(self, name: str, where: str | None) -> None:
        name = self._own(name)
        old = self.tables[name]
        self._refresh(name, old.where(~F.coalesce(F.expr(where), F.lit(False))) if where else old.limit(0))
