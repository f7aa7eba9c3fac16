"""Sources and sinks: fact files, archives of edges, switch-database updates, Arrow."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespark.zset import WEIGHT, ZSet


def read_facts(spark: SparkSession, path: str, schema: str, separator: str = "\t") -> DataFrame:
    """Delimited facts without a header; ``.gz`` files are read as they are."""
    return spark.read.schema(schema).option("sep", separator).option("mode", "FAILFAST").csv(path)


def write_facts(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.option("sep", separator).mode("overwrite").csv(path)


def read_edges(spark: SparkSession, path: str, *, src: str = "src", dst: str = "dst", header: bool = True) -> DataFrame:
    """Edges of a graph, as pairs of BIGINT, from CSV that may be compressed."""
    return spark.read.schema(f"{src} bigint, {dst} bigint").option("header", header).option("comment", "#").csv(path)


def read_text(spark: SparkSession, path: str) -> str:
    """The whole content of one text file."""
    return spark.read.text(path, wholetext=True).first()[0]


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def write_changes(changes: dict[str, ZSet], path: str, batch: int) -> None:
    """Signed changes as Parquet, one folder for each relation and batch, so that
    a batch that is run again replaces its own."""
    for name, z in changes.items():
        z.df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def read_changes(spark: SparkSession, path: str, name: str) -> ZSet:
    """The sum of all changes written so far."""
    return ZSet(spark.read.parquet(f"{path}/{name}").drop("batch")).consolidate()


# -- switch databases ----------------------------------------------------------
ATOMS = {"integer": "bigint", "real": "double", "boolean": "boolean", "string": "string", "uuid": "string"}


def _column(kind) -> str:
    if isinstance(kind, str):
        return ATOMS[kind]
    name = lambda x: ATOMS[x if isinstance(x, str) else x["type"]]
    if "value" in kind:
        return f"map<{name(kind['key'])},{name(kind['value'])}>"
    if kind.get("max", 1) != 1:
        return f"array<{name(kind['key'])}>"
    return name(kind["key"])


def database_schema(document: str) -> dict[str, T.StructType]:
    """A schema for each table of a database's JSON schema; sets are arrays,
    optional values are nullable, and ``_uuid`` is the key."""
    tables = json.loads(document)["tables"]
    return {t: T.StructType.fromDDL(", ".join(["_uuid string", *(f"`{c}` {_column(d['type'])}" for c, d in spec["columns"].items())])) for t, spec in tables.items()}


def _value(x, kind: T.DataType):
    """A value in the protocol's notation, as Python's."""
    if isinstance(x, list) and len(x) == 2 and x[0] in ("uuid", "named-uuid"):
        return x[1]
    if isinstance(x, list) and len(x) == 2 and x[0] == "set":
        items = [_value(y, kind.elementType if isinstance(kind, T.ArrayType) else kind) for y in x[1]]
        return sorted(items) if isinstance(kind, T.ArrayType) else (items[0] if items else None)
    if isinstance(x, list) and len(x) == 2 and x[0] == "map":
        return {_value(k, kind.keyType): _value(v, kind.valueType) for k, v in x[1]}
    if isinstance(kind, T.ArrayType) and not isinstance(x, list):
        return [x]
    return float(x) if isinstance(kind, T.DoubleType) else x


def table_updates(document: str, schemas: dict[str, T.StructType]) -> Iterable[tuple]:
    """(operation, table, row or key) for each row of an update document."""
    for table, rows in json.loads(document).items():
        schema = schemas[table]
        for uuid, change in rows.items():
            row = lambda x, u=uuid, s=schema: tuple(u if f.name == "_uuid" else _value(x[f.name], f.dataType) if f.name in x else None for f in s)
            if "new" in change and change["new"] is not None:
                yield "insert_or_update", table, row(change["new"])
            else:
                yield "delete_key", table, uuid


def transaction(changes: dict[str, ZSet], database: str) -> list:
    """The operations that make the changes: deletes, then inserts."""
    out: list = [database]
    for table, z in sorted(changes.items()):
        text = z.df.select(F.col(WEIGHT), F.to_json(F.struct(*z.columns)).alias("row"))
        for r in sorted(text.toLocalIterator(), key=lambda r: (r[WEIGHT], r["row"])):
            row = json.loads(r["row"])
            uuid = row.pop("_uuid", None)
            if r[WEIGHT] < 0:
                where = [["_uuid", "==", ["uuid", uuid]]] if uuid else [[k, "==", v] for k, v in row.items()]
                out.append({"op": "delete", "table": table, "where": where})
            else:
                out.append({"op": "insert", "table": table, "row": row} | ({"uuid-name": uuid} if uuid else {}))
    return out
