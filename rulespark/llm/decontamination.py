"""Benchmark decontamination by winnowing.

The hash of every k-gram of words is computed; of each ``window`` consecutive
k-grams the smallest hash is kept as a fingerprint. With
``k + window - 1 == span``, any ``span`` words that a document shares with a
benchmark item hold a fingerprint that both sides keep, so joining the
fingerprints and extending each hit in both directions finds every shared
span. Items of fewer than ``span`` words count as one window each and are
looked up by the hash of all their words.

The benchmark side is held in memory block by block: a block has about
``block_bytes`` of item text, whatever the size of the table, and every block
is matched against all documents, one after the other. The join of the
fingerprints is a look-up in the block's sorted hashes, so documents are not
shuffled. A hit counts only where the words' bytes are equal.

Nulls, empty texts and texts without words have no words: never contaminated,
and as items they match nothing. Rows are never merged: with several blocks,
every row has a stored key, and what the blocks found is joined on it alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rulespark.llm import textscan as ts
from rulespark.llm.shared import slices, text_or_empty, written

GRAM = 8
FILTER_BITS = 20


class WinnowIndex:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, ids: list[str], texts: list[str | None], span: int = 13, gram: int = GRAM):
        self.span, self.gram, self.window = span, gram, span - gram + 1
        if self.window < 1:
            raise ValueError("span must be at least the k-gram length")
        data, offsets = ts.flat(pa.array(texts, pa.large_string()))
        self.data = ts.LOWER[data]
        hashes, self.starts, self.ends, first = ts.words_and_ends(self.data, offsets, ts.WORD_ALNUM)
        self.ids, self.words, self.first = ids, hashes, first
        counts = np.diff(first)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        grams = gram_hashes(hashes, span)
        for n in sorted({int(c) for c in counts if 0 < c < span}):
            at = first[:-1][counts == n]
            self._add(-n, grams[n][at], at)
        at = selected(grams[gram], first, gram, self.window) if gram in grams else np.empty(0, np.int64)
        if len(at):
            at = at[counts[ts.row_of(at, first)] >= span]
        if len(at):
            self._add(gram, grams[gram][at], at)

    def _add(self, key: int, hashes: np.ndarray, at: np.ndarray) -> None:
        """key: -n for whole items of n words, the gram length for fingerprints."""
        order = np.argsort(hashes, kind="stable")
        present = np.zeros(1 << FILTER_BITS, dtype=bool)
        present[(hashes & ts.U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        self.tables[key] = (hashes[order], at[order], present)

    def lookup(self, key: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``hashes``, word of the benchmark) of all equal pairs."""
        known, at, present = self.tables[key]
        maybe = np.flatnonzero(present[(hashes & ts.U((1 << FILTER_BITS) - 1)).astype(np.int64)])
        low = np.searchsorted(known, hashes[maybe], side="left")
        high = np.searchsorted(known, hashes[maybe], side="right")
        n = high - low
        where = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(maybe, n), at[where]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list], dict[int, set]]:
        """(words of each row, row -> hit spans of words, row -> items)."""
        data = ts.LOWER[data]
        hashes, starts, ends, first = ts.words_and_ends(data, offsets, ts.WORD_ALNUM)
        counts = np.diff(first)

        def same(p: int, q: int, n: int) -> bool:
            """Whether n words from p and from the benchmark's q on are equal in
            their bytes, and not only in their hashes."""
            ours = [data[a:b].tobytes() for a, b in zip(starts[p : p + n].tolist(), ends[p : p + n].tolist())]
            return ours == [self.data[a:b].tobytes() for a, b in zip(self.starts[q : q + n].tolist(), self.ends[q : q + n].tolist())]

        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        if not len(hashes) or not self.tables:
            return counts, spans, items
        grams = gram_hashes(hashes, max(abs(k) for k in self.tables))
        rows_of_words = np.repeat(np.arange(len(counts)), counts)
        for key in self.tables:
            n = abs(key)
            if n not in grams:
                continue
            if key < 0:
                fits = np.flatnonzero(rows_of_words[: len(grams[n])] == rows_of_words[n - 1 :])
            else:
                fits = selected(grams[n], first, n, self.window)
            found, ours = self.lookup(key, grams[n][fits])
            at = fits[found]
            rows = rows_of_words[at]
            item_rows = ts.row_of(ours, self.first)
            if key < 0:
                for p, q, row, item in zip(at.tolist(), ours.tolist(), rows.tolist(), item_rows.tolist()):
                    if np.array_equal(hashes[p : p + n], self.words[q : q + n]) and same(p, q, n):
                        spans.setdefault(row, []).append((p - first[row], p - first[row] + n))
                        items.setdefault(row, set()).add(item)
                continue
            reached: dict[tuple[int, int, int], int] = {}
            for p, q, row, item in zip(at.tolist(), ours.tolist(), rows.tolist(), item_rows.tolist()):
                diagonal = (row, item, p - q)
                if p < reached.get(diagonal, -1):
                    continue
                back = min(p - first[row], q - self.first[item])
                ahead = min(first[row + 1] - p, self.first[item + 1] - q)
                left = _equal(hashes[p - back : p][::-1], self.words[q - back : q][::-1])
                right = _equal(hashes[p : p + ahead], self.words[q : q + ahead])
                reached[diagonal] = p + max(right, 1)
                if left + right < self.span:
                    continue
                if same(p - left, q - left, left + right):
                    pieces = [(p - left, p + right)]
                else:  # some hashes lie: only the windows that are equal in full
                    pieces = [(p - left + t, p - left + t + self.span) for t in range(left + right - self.span + 1) if same(p - left + t, q - left + t, self.span)]
                for a, b in pieces:
                    spans.setdefault(row, []).append((a - first[row], b - first[row]))
                    items.setdefault(row, set()).add(item)
        return counts, spans, items


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    differ = a != b
    return int(differ.argmax()) if differ.any() else len(a)


def gram_hashes(hashes: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """n -> hash of the n words from each position on, for n up to ``longest``."""
    out, total = {}, None
    base = ts.U(ts.BASE_2)
    for n in range(1, min(longest, len(hashes)) + 1):
        total = hashes.copy() if n == 1 else total[:-1] * base + hashes[n - 1 :]
        out[n] = ts.mix(total)
    return out


def selected(grams: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions that hold the minimum of a window lying inside one row."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = grams[:n].copy()
    for t in range(1, window):
        np.minimum(least, grams[t : n + t], out=least)
    inside = np.zeros(n, dtype=bool)
    lengths = np.diff(first) - (k + window - 2)
    keep = lengths > 0
    starts = first[:-1][keep]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths[keep], -1)
    inside = np.cumsum(edge[:-1]) > 0
    chosen = np.zeros(len(grams), dtype=bool)
    for t in range(window):
        chosen[t : n + t] |= inside & (grams[t : n + t] == least)
    return np.flatnonzero(chosen)


def _match(index: WinnowIndex, passed: list[str], text: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                counts, spans, items = index.scan(*ts.flat(part.column(text)))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in passed),
                        pa.array(counts, pa.int64()),
                        pa.array([[{"a": a, "b": b} for a, b in dict.fromkeys(spans.get(i, ()))] for i in range(n)], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        pa.array([list(dict.fromkeys(index.ids[j] for j in sorted(items.get(i, ())))) for i in range(n)], pa.list_(pa.string())),
                    ],
                    names=[*passed, "n_words", "spans", "items"],
                )

    return run


def contamination_spans(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 13, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_words, spans, items): the word spans [a, b) of each document
    inside benchmark windows, and the ids of the items they come from."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return marked(rows, benchmark, item_id=item_id, item_text=item_text, span=span, block_bytes=block_bytes).drop("text")


def marked(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 13, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows with all their columns and n_words, spans and items."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), text_or_empty(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    found = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"
    every = None
    if blocks > 1:
        docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        block = block.toArrow()
        index = WinnowIndex(block["id"].to_pylist(), block["text"].to_pylist(), span)
        if blocks == 1:
            schema = StructType([*docs.schema, *StructType.fromDDL(found)])
            return docs.mapInArrow(_match(index, docs.columns, text), schema)
        part = docs.select("_row", text).mapInArrow(_match(index, ["_row"], text), f"_row long, {found}")
        # written block by block, so that one index is alive at a time; rows without hits count once
        part = written(part if b == 0 else part.where("size(spans) > 0"), "hits")
        every = part if every is None else every.unionAll(part)
    merged = every.groupBy("_row").agg(
        F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return docs.join(merged, "_row").drop("_row")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", span: int = 13, part: int = 20, **options) -> DataFrame:
    """The rows, with all their columns, that hold no ``span`` words of an item
    in a row, however long they are, and of whose words less than one in
    ``part`` lies in benchmark windows. Items of fewer words than ``span``,
    which long texts hold by chance, count in the second law only."""
    found = marked(docs, benchmark, text=text, span=span, **options)
    n_hit = covered()
    whole = F.exists("spans", lambda s: s["b"] - s["a"] >= span)
    return found.where(~(whole | ((n_hit > 0) & (part * n_hit >= F.col("n_words"))))).select(docs.columns)


def covered(spans: str = "spans"):
    """How many positions a column of [a, b) spans covers."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).cast("long").alias("n")
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, part: int = 20, **options) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated: whether at least one in
    ``part`` of the document's words lies inside benchmark windows."""
    found = contamination_spans(docs, benchmark, **options)
    n_hit = covered()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (part * F.col("n_hit") >= F.col("n_words"))
    )
