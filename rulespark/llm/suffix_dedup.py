"""Removal of byte strings that an earlier document also has.

Each byte covered by a ``length``-byte string that also starts in a document
with a smaller id is removed. All strings are judged on the input.

Anchors bring equal strings together: of the k-byte windows inside every
``length``-byte string the one with the smallest hash is its anchor, so equal
strings have equal anchors. All strings with the same anchor position form a
*span*. Stored texts are scanned three times, file by file:

1. Each file yields its distinct (anchor hash, span hash, smallest id). Equal
   spans need no further look: all their strings belong to the smallest id.
2. Where one anchor hash has several different spans, these may share only some
   strings. The files are asked for the bytes of these spans (fewer than
   ``2 * length`` each); every string in them is hashed, and the smallest id
   that has a string owns it.
3. Each file removes what the others found and what it knows itself.

Nulls and empty texts have no bytes and lose none. Rows with null ids lose none
and cause no removals. Rows with equal ids never cause removals in each other.
Hashes have 128 bits (anchor and span, or anchor and string).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from rulespark.llm import textscan as ts
from rulespark.llm.shared import arrow_path, text_or_empty, written

GRAM = 25
BLOCK = 3 << 19
FLUSH = 1 << 21
BUCKET_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
ROWS_OUT = 1000
VARIANT = np.dtype([("gram", "<u8"), ("span", "<u8"), ("id", "<i8")])
REQUEST = np.dtype([("gram", "<u8"), ("span", "<u8")])
ANSWER = np.dtype([("gram", "<u8"), ("span", "<u8"), ("bits", "<u8")])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, span hash, first string, last string, row) of every anchor.

    Strings ``first..last`` (start positions) all have this anchor.
    """
    window = length - gram + 1
    n = len(data) - length + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty.view(ts.U), empty.view(ts.U), empty, empty, empty
    hashes = ts.window_hashes(data, gram, ts.BASE_2)
    low = ts.U((1 << 22) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=ts.U)
    size, total = 1, least
    while size * 2 <= window:
        total = np.minimum(total[:-size], total[size:])
        size *= 2
    if size < window:
        total = np.minimum(total[: n], total[window - size : window - size + n])
    position = (total[:n] & low).astype(np.int64)
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(position[1:], position[:-1], out=change[1:])
    valid = np.zeros(n + 1, dtype=np.int8)
    has = np.diff(offsets) >= length
    valid[offsets[:-1][has]] += 1
    valid[offsets[1:][has] - length + 1] -= 1
    valid = np.cumsum(valid[:n], dtype=np.int8) > 0
    change &= valid
    change[offsets[:-1][has]] = True
    first = np.flatnonzero(change)
    stops = np.flatnonzero(valid & ~np.append(valid[1:], False) | np.append(change[1:], True) & valid)
    last = stops
    at = position[first]
    spans = ts.span_hashes(data, first, last + length, ts.BASE, ts.BASE_INVERSE)
    return hashes[at], spans, first, last, ts.row_of(first, offsets)


def _blocks(ids: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of consecutive rows of about ``BLOCK`` bytes; a
    longer text is a block of its own only as far as ``BLOCK`` allows: it is
    cut with an overlap by ``_pieces``."""
    data, offsets = ts.flat(texts)
    start = 0
    while start < len(ids):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, side="right")) - 1)
        yield ids[start:stop], data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def _scan(ids: np.ndarray, texts: pa.Array, length: int, gram: int):
    """Anchors of all rows, block by block: (gram, span, id, first, last,
    block's bytes, block's offsets, rows). Texts above ``BLOCK`` bytes are cut
    into overlapping parts: each string lies in exactly one part, and spans
    that a cut divides are divided alike wherever the same text is cut alike;
    elsewhere step 2 compares them string by string."""
    row0 = 0
    for own, data, offsets in _blocks(ids, texts):
        if len(data) <= 2 * BLOCK:
            g, s, a, b, r = anchors(data, offsets, length, gram)
            yield g, s, own[r], a, b, data, r + row0, offsets[r]
        else:
            for at in range(0, max(1, len(data) - length + 1), BLOCK):
                part = data[at : at + BLOCK + length - 1]
                g, s, a, b, r = anchors(part, np.array([0, len(part)]), length, gram)
                yield g, s, own[r], a, b, part, r + row0, np.full(len(r), -at)
        row0 += len(own)


def _read(uri: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(ids, texts as they are searched, texts) of a file: a row without an id
    is searched as if it had no text."""
    import pyarrow.parquet as pq

    system, path = arrow_path(uri)
    table = pq.read_table(path, filesystem=system, columns=["doc_id", "text"])
    ids, texts = table["doc_id"].combine_chunks(), table["text"].cast(pa.large_binary()).combine_chunks()
    searched = pa.compute.if_else(pa.compute.is_valid(ids), texts, pa.scalar(b"", pa.large_binary())) if ids.null_count else texts
    return pa.compute.fill_null(ids, 0).to_numpy(), searched, texts


def _grouped(grams: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): an order by hash in which equal (gram, hash) are
    neighbours, and where in it each group begins. What is equal in its hash
    nearly always is in its anchor, so one key is sorted."""
    order = np.argsort(hashes)
    new = _changes(hashes[order])
    other = _changes(grams[order])
    if (other & ~new).any():  # equal hashes, other anchors
        order = np.lexsort((grams, hashes))
        new = _changes(hashes[order]) | _changes(grams[order])
    return order, new


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    out = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _least(values: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The smallest value of each group of ``_grouped``."""
    return np.minimum.reduceat(values[order], np.flatnonzero(new)) if len(order) else values


def _distinct(rows: np.ndarray) -> np.ndarray:
    """One row for each (gram, span), with its smallest id, by span."""
    order, new = _grouped(rows["gram"], rows["span"])
    out = rows[order[new]]
    out["id"] = _least(rows["id"], order, new)
    return out


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams % ts.U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def _scattered(rows: np.ndarray, buckets: int):
    """(bucket, rows) by the anchor hash."""
    bucket = _bucket(rows["gram"], buckets)
    order = np.argsort(bucket, kind="stable")
    rows = rows[order]
    edges = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, rows[edges[b] : edges[b + 1]]


def _file_variants(file: str, length: int, gram: int) -> np.ndarray:
    """The distinct anchors of a file. What is held is sorted again only when
    it has doubled, so a file takes time in proportion to its size."""
    parts, held, limit = [], 0, FLUSH
    for g, s, i, *_ in _scan(*_read(file)[:2], length, gram):
        rows = np.empty(len(g), VARIANT)
        rows["gram"], rows["span"], rows["id"] = g, s, i
        parts.append(rows)
        held += len(g)
        if held > limit:
            parts = [_distinct(np.concatenate(parts))]
            held = len(parts[0])
            limit = max(FLUSH, 2 * held)
    if not parts:
        return np.empty(0, VARIANT)
    rows = np.concatenate(parts)
    parts.clear()
    return _distinct(rows)


def _step_1(buckets: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                numbers, parts, held = [], [], 0
                for b, rows in _scattered(_file_variants(file, length, gram), buckets):
                    numbers.append(b)
                    parts.append(rows.tobytes())
                    held += rows.nbytes
                    if held > BATCH_BYTES:
                        yield _variants(numbers, file, parts)
                        numbers, parts, held = [], [], 0
                if parts:
                    yield _variants(numbers, file, parts)

    return run


def _variants(numbers: list[int], file: str, parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([file] * len(parts)), pa.array(parts, pa.binary())], names=["bucket", "file", "rows"])


def _one(file: str, kind: str, rows: np.ndarray) -> dict:
    return {"file": file, "kind": kind, "rows": rows.tobytes()}


MESSAGES = pa.schema([("file", pa.string()), ("kind", pa.string()), ("rows", pa.binary())])


def _owners(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: for each file, the spans that a smaller id outside it
    has (kind ``all``), and the spans of which it has the smallest id that have
    to be compared string by string (kind ``ask``)."""
    files = table["file"].to_pylist()
    parts = [np.frombuffer(x, VARIANT) for x in table["rows"].to_pylist()]
    rows = np.concatenate(parts)
    order, new = _grouped(rows["gram"], rows["span"])
    span_no = np.empty(len(rows), np.int64)
    span_no[order] = np.cumsum(new) - 1
    owner = _least(rows["id"], order, new)
    # the spans of each anchor
    grams = rows["gram"][order[new]]
    by_gram = np.argsort(grams)
    new_gram = np.ones(len(grams), dtype=bool)
    new_gram[1:] = grams[by_gram[1:]] != grams[by_gram[:-1]]
    starts, gram_no = np.flatnonzero(new_gram), np.cumsum(new_gram) - 1
    several = np.minimum.reduceat(owner[by_gram], starts) != np.maximum.reduceat(owner[by_gram], starts)
    compared = np.empty(len(grams), dtype=bool)
    compared[by_gram] = several[gram_no]
    taken = rows["id"] > owner[span_no]
    ask = ~taken & compared[span_no]
    # the rows of a file are neighbours
    out, edges = [], np.cumsum([0, *(len(p) for p in parts)])
    for f, own in enumerate(parts):
        for kind, which in (("all", taken), ("ask", ask)):
            mine = own[which[edges[f] : edges[f + 1]]]
            if len(mine):
                message = np.empty(len(mine), REQUEST)
                message["gram"], message["span"] = mine["gram"], mine["span"]
                out.append(_one(files[f], kind, message))
    return pa.Table.from_pylist(out, MESSAGES)


def _merged(table: pa.Table, kind: str, dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(r, dtype) for k, r in zip(table["kind"].to_pylist(), table["rows"].to_pylist()) if k == kind]
    rows = np.concatenate(parts) if parts else np.empty(0, dtype)
    return rows[np.argsort(rows["span"], kind="stable")]


def _find(known: np.ndarray, gram: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Index into ``known`` (sorted by span) of each (gram, span), or -1."""
    if not len(known):
        return np.full(len(gram), -1)
    at = np.searchsorted(known["span"], span)
    at[at == len(known)] = 0
    out = np.where((known["span"][at] == span) & (known["gram"][at] == gram), at, -1)
    for i in np.flatnonzero((known["span"][at] == span) & (out < 0)).tolist():  # equal span hashes, other anchors
        j = at[i]
        while j < len(known) and known["span"][j] == span[i]:
            if known["gram"][j] == gram[i]:
                out[i] = j
            j += 1
    return out


def _cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


ANSWERS = pa.schema([("bucket", pa.int32()), ("file", pa.string()), ("rows", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("bodies", pa.binary())])


def _step_2(buckets: int, length: int, gram: int):
    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """The bytes of the spans that a file was asked for, by bucket."""
        file = key[0].as_py()
        asked = _merged(table, "ask", REQUEST)
        out = []
        if len(asked):
            ids, texts, _ = _read(file)
            data, offsets = ts.flat(texts)
            found = []
            for g, s, i, a, b, _, row, base in _scan(ids, texts, length, gram):
                at = _find(asked, g, s)
                k = np.flatnonzero(at >= 0)
                found.append((at[k], i[k], offsets[row[k]] + a[k] - base[k], b[k] - a[k] + length))
            which, docs, starts, sizes = (np.concatenate(x) for x in zip(*found))
            # of equal spans that of the smallest id, bucket by bucket
            order = np.lexsort((docs, which))
            first = order[np.flatnonzero(np.diff(which[order], prepend=-1))]
            bucket = _bucket(asked["gram"][which[first]], buckets)
            first = first[np.argsort(bucket, kind="stable")]
            edges = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
            for b in np.flatnonzero(np.diff(edges)).tolist():
                mine = first[edges[b] : edges[b + 1]]
                out.append({"bucket": b, "file": file, "rows": asked[which[mine]].tobytes(), "ids": docs[mine].astype("<i8").tobytes(), "sizes": sizes[mine].astype("<i4").tobytes(), "bodies": _cut(data, starts[mine], sizes[mine]).tobytes()})
        return pa.Table.from_pylist(out, ANSWERS)

    return answer


def _step_2_owners(length: int):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        """Of one bucket: which strings of the spans belong to a smaller id
        (kind ``some``; bit t stands for the span's string t)."""
        files = table["file"].to_pylist()
        parts = [np.frombuffer(x, REQUEST) for x in table["rows"].to_pylist()]
        asked = np.concatenate(parts)
        ids = np.concatenate([np.frombuffer(x, "<i8") for x in table["ids"].to_pylist()])
        sizes = np.concatenate([np.frombuffer(x, "<i4") for x in table["sizes"].to_pylist()]).astype(np.int64)
        bodies = np.frombuffer(b"".join(table["bodies"].to_pylist()), np.uint8)
        strings = sizes - length + 1
        entry = np.repeat(np.arange(len(sizes)), strings)
        t = np.arange(len(entry)) - np.repeat(np.cumsum(strings) - strings, strings)
        hashes = ts.window_hashes(bodies, length, ts.BASE)[(np.cumsum(sizes) - sizes)[entry] + t]
        order, new = _grouped(asked["gram"][entry], hashes)
        owner = np.empty(len(entry), np.int64)
        owner[order] = _least(ids[entry], order, new)[np.cumsum(new) - 1]
        taken = ids[entry] > owner
        bits = np.zeros(len(sizes), dtype=ts.U)
        np.bitwise_or.at(bits, entry[taken], ts.U(1) << t[taken].astype(ts.U))
        out, edges = [], np.cumsum([0, *(len(p) for p in parts)])
        for f, own in enumerate(parts):
            found = bits[edges[f] : edges[f + 1]]
            mine = found > 0
            if mine.any():
                message = np.empty(int(mine.sum()), ANSWER)
                message["gram"], message["span"], message["bits"] = own["gram"][mine], own["span"][mine], found[mine]
                out.append(_one(files[f], "some", message))
        return pa.Table.from_pylist(out, MESSAGES)

    return compare


def _removed(ids: np.ndarray, texts: pa.Array, taken: np.ndarray, some: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of bytes to remove, by row and start."""
    parts: list[tuple[np.ndarray, ...]] = []
    for g, s, _, a, b, _, r, base in _scan(ids, texts, length, gram):
        parts.append((g, s, r.astype(np.int32), (a - base).astype(np.int32), (b - a).astype(np.int8)))
    if not parts:
        return (np.empty(0, np.int64),) * 3
    columns = [list(x) for x in zip(*parts)]
    del parts
    grams, spans, rows, first, more = (np.concatenate(columns.pop(0)) for _ in range(5))
    order, new = _grouped(grams, spans)
    # each kind of span is looked up once, in the order of the messages
    kinds = grams[order[new]], spans[order[new]]
    del grams, spans
    found, partial = _find(taken, *kinds) >= 0, _find(some, *kinds).astype(np.int32)
    del kinds
    group = np.cumsum(new, dtype=np.int32) - np.int32(1)
    mine = ids[rows[order]]
    whole = np.empty(len(order), dtype=bool)
    whole[order] = (mine > np.minimum.reduceat(mine, np.flatnonzero(new))[group]) | found[group]
    at = np.empty(len(order), dtype=np.int32)
    at[order] = partial[group]
    del order, new, group, mine, found, partial
    partly = np.flatnonzero((at >= 0) & ~whole)
    starts, ends, of = [first[whole].astype(np.int64)], [(first[whole].astype(np.int64) + more[whole] + length)], [rows[whole]]
    if len(partly):
        bits = some["bits"][at[partly]]
        for t in range(length - gram + 1):
            hit = partly[(bits >> ts.U(t)) & ts.U(1) == 1]
            starts.append(first[hit].astype(np.int64) + t)
            ends.append(first[hit].astype(np.int64) + t + length)
            of.append(rows[hit])
    start, end, row = np.concatenate(starts), np.concatenate(ends), np.concatenate(of).astype(np.int64)
    order = np.lexsort((start, row))
    start, end, row = start[order], end[order], row[order]
    if not len(row):
        return row, start, end
    # no string goes beyond its row, so ends can be compared along all rows
    far = np.int64(1) << np.int64(32)
    reach = np.maximum.accumulate(row * far + end)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (row[1:] * far + start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
    return row[new], start[new], reach[last] - row[last] * far


RESULT = StructType().add("doc_id", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")


def _step_3(length: int, gram: int, carry: list[str], result: pa.Schema):
    def remove(key: tuple, table: pa.Table) -> pa.Table:
        """All rows of a file, without the bytes that others or it found."""
        import pyarrow.parquet as pq

        file = key[0].as_py()
        ids, searched, texts = _read(file)
        row, start, end = _removed(ids, searched, _merged(table, "all", REQUEST), _merged(table, "some", ANSWER), length, gram)
        del searched
        edges = np.searchsorted(row, np.arange(len(ids) + 1))
        n_spans = np.diff(edges)
        n_removed = np.zeros(len(ids), dtype=np.int64)
        np.add.at(n_removed, row, end - start)
        system, path = arrow_path(file)
        own = pq.read_table(path, filesystem=system, columns=["doc_id", *carry]).combine_chunks()
        out = []
        for low in range(0, len(ids), ROWS_OUT):
            high = min(low + ROWS_OUT, len(ids))
            kept = []
            for i, body in zip(range(low, high), texts.slice(low, high - low).to_pylist()):
                if n_spans[i]:
                    cut = slice(edges[i], edges[i + 1])
                    froms, tos = [0, *end[cut].tolist()], [*start[cut].tolist(), len(body)]
                    body = b"".join(body[x:y] for x, y in zip(froms, tos))
                kept.append(body)
            here = own.slice(low, high - low)
            columns = [here["doc_id"].combine_chunks(), pa.array(n_removed[low:high]), pa.array(n_spans[low:high]), pa.array(kept, pa.binary()), *(here[c].combine_chunks().cast(result.field(c).type) for c in carry)]
            out.append(pa.RecordBatch.from_arrays(columns, schema=result))
        return pa.Table.from_batches(out, result)

    return remove


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_removed (bytes), n_spans (runs of removed bytes), kept (the
    bytes that are left) and the columns ``carry`` of every row."""
    if not 1 <= length - gram + 1 <= 64:
        raise ValueError("a string must have 1 to 64 anchor windows")
    spark = docs.sparkSession
    store = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), *carry), "texts")
    total = store.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # two anchors of 24 bytes in each length - gram + 2 bytes
    buckets = max(1, -(-total * 2 * VARIANT.itemsize // (length - gram + 2) // BUCKET_BYTES))
    names = store.inputFiles()
    # one file a task; a shuffle of so few rows would leave tasks without any, and others with several
    files = spark.range(0, len(names), 1, max(1, len(names))).select(F.element_at(F.split(F.lit("\n".join(names)), "\n"), (F.col("id") + 1).cast("int")).alias("file"))
    message, asked = "file string, kind string, rows binary", "bucket int, file string, rows binary, ids binary, sizes binary, bodies binary"
    variants = files.mapInArrow(_step_1(buckets, length, gram), "bucket int, file string, rows binary")
    found = written(variants.groupBy("bucket").applyInArrow(_owners, message), "owners")
    bodies = found.where("kind = 'ask'").groupBy("file").applyInArrow(_step_2(buckets, length, gram), asked)
    some = bodies.groupBy("bucket").applyInArrow(_step_2_owners(length), message)
    every = files.select("file", F.lit("none").alias("kind"), F.lit(b"").alias("rows"))
    messages = found.where("kind = 'all'").unionAll(some).unionAll(every)
    result = to_arrow_schema(StructType([*RESULT, *(docs.schema[c] for c in carry)]))
    return messages.groupBy("file").applyInArrow(_step_3(length, gram, list(carry), result), from_arrow_schema(result))
