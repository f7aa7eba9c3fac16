"""Exact top-k by inner product, through a pivot-distance index.

One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, turns the order
by inner product into the order by distance: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.
Vectors are keyed by their nearest pivot and the ring of their distance from it,
and each ring is stored in blocks. A query first reads the ring that it lies in
itself, which gives it a k-th best score; then rings are expanded in the order
of their bounds, and a ring whose bound is strictly below that score is left
out: the triangle inequality allows no x' of it within the distance needed.

Pivots are a bounded sample (``pivots`` rows); every vector is in the index.
There are at most ``pivots * RINGS`` rings, so their bounds may be broadcast.
Rings are split by a hash of the id, so repeated vectors don't meet in one task.
Components are floor(scale * x); sums are exact in 64 bits, and checked to be.
Nulls, and vectors with null or non-finite components or another number of them
than most have, take no part. Ties go to smaller ids. Rows with equal ids are
separate candidates, but a query's own id is no candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.shared import written

RINGS = 16
BLOCK_ROWS = 4096
QUERY_ROWS = 512


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products; in doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    raise ValueError("inner products do not fit into 64 bits")


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best of each row, ties to smaller ids."""
    n = scores.shape[1]
    allowed = ids[None, :] != own[:, None]
    if n > k:
        least = np.iinfo(np.int64).min
        masked = np.where(allowed, scores, least)
        bar = np.partition(masked, n - k, axis=1)[:, n - k]
        allowed &= masked >= bar[:, None]
    row, at = np.nonzero(allowed)
    order = np.lexsort((ids[at], -scores[row, at], row))
    row, at = row[order], at[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, at = row[keep], at[keep]
    return row, ids[at], scores[row, at]


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    norms = (x.astype(np.float64) ** 2).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(top - norms, 0))])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def _keyed(pivots: np.ndarray, dims: int, top: float, width: float):
    """vec_id, v, pivot, ring, radius of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_lifted(_matrix(batch.column("v"), dims), top), pivots)
            near = d.argmin(axis=1)
            radius = d[np.arange(len(d)), near]
            ring = np.minimum(radius // width, RINGS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(ring), pa.array(radius)], names=["vec_id", "v", "pivot", "ring", "radius"])

    return run


def _packed(matrix: np.ndarray) -> bytes:
    """A matrix in the narrowest integers that hold it, after their width."""
    most = np.abs(matrix).max(initial=0)
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    return kind.encode() + matrix.astype(kind).tobytes()


def _unpacked(body, dims: int) -> np.ndarray:
    body = memoryview(body)
    return np.frombuffer(body[3:], bytes(body[:3]).decode()).reshape(-1, dims).astype(np.int64)


def _block(key: tuple, table: pa.Table) -> pa.Table:
    ids = table["vec_id"].to_numpy()
    flat = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return pa.table({"cell": [key[0]], "sub": [key[1]], "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "body": pa.array([_packed(flat)], pa.binary())})


def _query_block(key: tuple, table: pa.Table) -> pa.Table:
    flat = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    column = lambda c: pa.array([table[c].to_numpy().astype("<i8").tobytes()], pa.binary())
    return pa.table({"q": [key[0]], "own_cell": [key[1]], "q_ids": column("vec_id"), "q_body": pa.array([_packed(flat)], pa.binary()), "tau": column("tau")})


def _reached(cells: np.ndarray, pivots: np.ndarray, dims: int, top: float):
    """(query block, ring) pairs that some query of the block has to read.
    cells: cell, pivot, least and largest radius of each ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = _unpacked(batch.column("q_body")[i].as_buffer(), dims)
                tau = np.frombuffer(batch.column("tau")[i].as_buffer(), "<i8").astype(np.float64)
                lifted = np.column_stack([v, np.zeros(len(v))])
                d = _distances(lifted, pivots)[:, cells[:, 1].astype(int)]
                gap = np.maximum(np.maximum(d - cells[:, 3], cells[:, 2] - d), 0)
                bound = ((v.astype(np.float64) ** 2).sum(axis=1)[:, None] + top - gap**2) / 2
                slack = 1e-6 * (np.abs(bound) + top + 1)
                need = (bound + slack >= tau[:, None]).any(axis=0)
                need &= cells[:, 0] != batch.column("own_cell")[i].as_py()
                order = np.flatnonzero(need)
                order = order[np.argsort(gap.min(axis=0)[order], kind="stable")]
                chosen = cells[order, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("q")[i].as_py()] * len(chosen), pa.string()), pa.array(chosen)], names=["q", "cell"])

    return run


def _searched(dims: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: np.frombuffer(batch.column(c)[i].as_buffer(), "<i8")  # noqa: B023, E731
                own, ids = get("q_ids"), get("ids")
                row, found, score = best(products(*(_unpacked(batch.column(c)[i].as_buffer(), dims) for c in ("q_body", "body"))), ids, own, k)
                good = score >= get("tau")[row]
                yield pa.RecordBatch.from_arrays([pa.array(own[row][good]), pa.array(found[good]), pa.array(score[good])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, *, k: int = 20, scale: int = 64, pivots: int = 16, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every row for which
    the condition ``is_query`` (on the column vec_id) holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    rows = rows.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # floor gives a decimal only for decimals; for doubles it gives a long
    rows = rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    rows = written(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not sizes or not sizes[0]["n"]:
        return spark.createDataFrame([], schema)
    dims = sizes[0]["n"]
    rows = rows.where(F.size("v") == dims)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(norm)).first()[0]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").toArrow()
    centres = _lifted(_matrix(sample["v"], dims), top)
    width = max(2 * top**0.5 / RINGS, 1e-9)
    keyed = written(rows.mapInArrow(_keyed(centres, dims, top, width), "vec_id long, v array<long>, pivot int, ring int, radius double"), "keyed").withColumn("cell", F.col("pivot") * RINGS + F.col("ring"))
    rings = keyed.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("radius").alias("low"), F.max("radius").alias("high"), F.count("*").alias("n")).orderBy("cell").collect()
    cells = np.array([(r["cell"], r["pivot"], r["low"], r["high"]) for r in rings], np.float64)
    subs = F.create_map(*[F.lit(x) for r in rings for x in (r["cell"], -(-r["n"] // BLOCK_ROWS))])
    blocks = keyed.withColumn("sub", F.pmod(F.xxhash64("vec_id"), subs[F.col("cell")].cast("long")).cast("int"))
    blocks = written(blocks.select("cell", "sub", "vec_id", "v").groupBy("cell", "sub").applyInArrow(_block, "cell int, sub int, ids binary, body binary"), "blocks")

    queries = keyed.where(is_query)
    asked = queries.count()
    parts = max(1, -(-asked // (QUERY_ROWS * len(centres))))
    block_schema = "q string, own_cell int, q_ids binary, q_body binary, tau binary"
    # first round: the ring that a query lies in; queries of one ring share blocks
    many = -(-keyed.count() // BLOCK_ROWS)
    salt = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts))
    first = queries.withColumn("tau", F.lit(-(2**63)).cast("long")).withColumn("q", F.concat_ws("-", "cell", salt))
    first = written(first.select("q", F.col("cell").alias("own_cell"), "vec_id", "v", "tau").groupBy("q", "own_cell").applyInArrow(_query_block, block_schema), "queries")
    found = first.join(blocks, F.col("own_cell") == F.col("cell")).repartition(max(8, min(many, 4096))).mapInArrow(_searched(dims, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = written(found.withColumn("r", F.row_number().over(order)).where(f"r <= {k}"), "first-round")
    bars = found.where(f"r = {k}").select(F.col("query_id").alias("vec_id"), F.col("score").alias("tau"))
    # second round: all other rings that the bounds allow, for blocks of queries
    second = queries.join(bars, "vec_id", "left").withColumn("tau", F.coalesce("tau", F.lit(-(2**63)).cast("long")))
    second = second.withColumn("q", F.concat_ws("-", "pivot", salt))
    second = written(second.select("q", F.lit(-1).alias("own_cell"), "vec_id", "v", "tau").groupBy("q", "own_cell").applyInArrow(_query_block, block_schema), "queries")
    pairs = second.mapInArrow(_reached(cells, centres, dims, top), "q string, cell int")
    pairs = pairs.join(second.drop("own_cell"), "q").join(blocks.drop("sub"), "cell").repartition(max(8, min(4 * many, 4096)))
    rest = pairs.mapInArrow(_searched(dims, k), "query_id long, vec_id long, score long")
    # a query's own ring reaches its own k-th score, so it is read again here
    return rest.withColumn("rank", F.row_number().over(order).cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
