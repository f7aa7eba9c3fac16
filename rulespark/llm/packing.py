"""Packing of tokenised texts into windows of a fixed size, best fit decreasing.

Every document becomes its token ids and an end id; a document longer than a
window is first cut into full windows and a rest. Pieces go by falling length
into the open window with the least room that still holds them; a segment tree
over the remaining capacities finds it.

Pieces of one length are alike, so the plan is made for lengths, not for pieces:
``best_fit`` reads how many pieces each length has (at most ``window`` numbers,
whatever the input) and answers with runs "pieces number r and following of
this length go to windows w and following". That is what one-by-one best fit
does: while the tightest window holds another piece of the same length, it is
the tightest one again. Pieces find their number from counts per stored
partition, so no length, however many pieces it has, meets in one task.

Null and empty texts have the end id alone. Repeated rows are packed as often as
they occur; rows without an id are packed too; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.shared import slices, text_or_empty, written
from rulespark.llm.tokens import encoder

PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, local long"


class CapacityTree:
    """Segment tree over 0..top: how many windows have each remaining room."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.total[i] += n
            i >>= 1

    def tightest(self, size: int) -> int | None:
        """The least room of at least ``size`` that some window has."""
        i = size + self.leaves
        if self.total[i]:
            return size
        while i > 1:
            if not i & 1 and self.total[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.total[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(lengths: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """(runs, windows used). A run (length, rank, first window, per window,
    offset): piece number rank + i of that length lies in window first + i //
    per at offset + (i % per) * length."""
    tree = CapacityTree(window)
    open_runs: dict[int, list[tuple[int, int]]] = {}
    windows, runs = 0, []

    def push(room: int, first: int, n: int) -> None:
        if room and n:
            open_runs.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                n = -(-left // (window // length))
                push(window, windows, n)
                windows += n
                continue
            first, n = open_runs[room].pop()
            tree.add(room, -n)
            per = room // length
            used = min(n, -(-left // per))
            push(room, first + used, n - used)
            full = min(used, left // per)
            placed = full * per
            push(room - per * length, first, full)
            if used > full:
                rest = left - placed
                push(room - rest * length, first + full, 1)
                placed = left
            runs.append((length, rank, first, per, window - room))
            rank += placed
            left -= placed
    return np.array(runs, np.int64).reshape(-1, 5), windows


def _pieces(path: str, kind: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, kind)
        seen = np.zeros(window + 1, dtype=np.int64)
        own = TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text"):
                columns: list[list] = [[] for _ in range(6)]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode.ids(part.column("text").to_pylist())):
                    body = memoryview(ids + end)
                    n = len(body) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        row = (doc, start, length, zlib.crc32(body[4 * start : 4 * (start + length)]), n, int(seen[length]))
                        seen[length] += 1
                        for column, x in zip(columns, row):
                            column.append(x)
                doc, start, length, crc, n, local = columns
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, long), pa.array(start, long), pa.array(length, pa.int32()), pa.array(crc, long), pa.array(n, long), pa.array([own] * len(doc), pa.int32()), pa.array(local, long)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local"],
                )

    return run


def _placed(runs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (runs[:, 0] << 48) + runs[:, 1]
        order = np.argsort(key)
        key, plan = key[order], runs[order]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            mine = plan[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            i = rank - mine[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(length), pa.array(mine[:, 2] + i // mine[:, 3]), pa.array(mine[:, 4] + i % mine[:, 3] * length)],
                names=["doc_id", "start", "ids_crc32", "doc_tokens", "length", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, *, kind: str = "word", window: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32 (of the piece's ids), doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    pieces = written(rows.mapInArrow(_pieces(tokenizer, kind, window, end_id), PIECE), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = written(counts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")), "piece-counts")
    lengths = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit(lengths, window)
    ranked = pieces.join(before.drop("n"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    schema = "doc_id long, start long, ids_crc32 long, doc_tokens long, length long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_placed(runs), schema).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
