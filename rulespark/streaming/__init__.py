"""Structured Streaming: transactions of a session as micro-batches.

A micro-batch is one transaction: its rows are staged, committed, and the signed
changes go on. ``run`` is exactly-once as far as its sink is, since a batch has
a number that a sink can remember. Windows with watermarks need no session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulespark.session import Session
from rulespark.zset import ZSet


def run(stream: DataFrame, session: Session, relation: str, sink: Callable[[dict[str, ZSet], int], None], *, checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Feed a stream of rows to an input relation, one transaction per batch."""

    def batch(rows: DataFrame, number: int) -> None:
        session.start()
        try:
            session.insert(relation, rows)
            changes = session.commit()
        except Exception:
            if session.staged is not None:
                session.rollback()
            raise
        sink(changes, number)

    writer = stream.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(stream: DataFrame, time: str, width: str, *, late: str, keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Aggregates per window; a window is final once the watermark has passed."""
    return sliding(stream, time, width, width, late=late, keys=keys, **aggregates)


def sliding(stream: DataFrame, time: str, width: str, step: str, *, late: str, keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    made = [a.alias(n) for n, a in aggregates.items()]
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, width, step).alias("window"), *keys).agg(*made)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, *, late: str, keys: tuple[str, ...], **aggregates: Column) -> DataFrame:
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)
