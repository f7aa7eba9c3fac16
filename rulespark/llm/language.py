"""Language identification by interpolated Kneser-Ney character models.

Texts become runs of lower-case letters with one blank between them; a character
is 16 bits (those beyond the basic plane share one symbol), so a 4-gram is an
exact 64-bit key. The counts of all 4-grams of all training rows are one
distributed group-by per language; the lower orders have continuation counts
(in how many contexts a gram occurs), derived from the table of grams with
DataFrame operations. Probabilities are interpolated with one absolute discount
n1 / (n1 + 2 n2) per language and order.

For scoring, grams are stored in arrays sorted by a hash of ``HASH_BITS`` bits:
a row has the log probability in every language, so a text costs one lookup for
each character. That bounds the model by 3 * 2**HASH_BITS * (4 + 4 * languages)
bytes whatever the corpus; grams that share a hash share a row (the likelier
one's). The language with the lowest cross-entropy per character wins.

Rejection is calibrated on all training rows: a text is rejected whose
cross-entropy is beyond what any of them has, by a margin, for its length. The
score is a logistic of the lead over the second language, scaled on the same
rows. Their figures (some numbers a row) are stored; what comes to the driver is
counts of bins around the median, and sums of each partition.

Texts that are null or without letters are ``und`` with score 0 and rejected;
those of other rows are whole, of any length. Rows without language are
predicted but not learned from; ``identify`` learns from no row that is held out
or without id either. With no training rows all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.llm.shared import crc_bucket, slices, text_or_empty, written

ORDER = 4
HASH_BITS = 21
BLANK = ord(" ")
FLUSH = 1 << 20
LONG = 100
BINS = 4096
SLOPES = np.geomspace(0.05, 5, 40)
U = np.uint64


def _symbols() -> np.ndarray:
    """For each 16-bit code: the lower-case letter, or the blank."""
    table = np.full(1 << 16, BLANK, dtype=np.uint16)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


_table: list[np.ndarray] = []


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, first symbol of each text as n + 1 offsets, letters
    of each text). Each text starts with ``ORDER - 1`` blanks and ends with one."""
    if not _table:
        _table.append(_symbols())
    pad = " " * (ORDER - 1)
    body = (pad + (" " + pad).join(texts) + " ").encode("utf-32-le", "replace")
    codes = np.frombuffer(body, "<u4")
    far = codes > 0xFFFF
    out = _table[0][np.where(far, 0, codes)]
    if far.any():
        out = np.where(far & _far_letters(codes, far), np.uint16(0xFFFF), out)
    sizes = np.array([len(t) for t in texts], np.int64) + ORDER
    starts = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != BLANK) | (out[:-1] != BLANK)
    for t in range(ORDER - 1):
        keep[starts[:-1] + t] = True
    # what was blank at the start of a text is part of its padding
    new = np.concatenate([[0], np.cumsum(keep)])
    counts = np.concatenate([[0], np.cumsum(out != BLANK)])
    return out[keep], new[starts], counts[starts[1:]] - counts[starts[:-1]]


def _far_letters(codes: np.ndarray, far: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), dtype=bool)
    for c in np.unique(codes[far]).tolist():
        if chr(c).isalpha():
            out |= codes == c
    return out


def grams(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram keys, row of each key's text). A key is at its last symbol."""
    n = len(symbols) - ORDER + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    s = symbols.astype(U)
    key = s[:n].copy()
    for t in range(1, ORDER):
        key <<= U(16)
        key |= s[t : n + t]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) + ORDER <= first[1:][row]
    return key[inside], row[inside]


def mixed(key: np.ndarray) -> np.ndarray:
    """A hash of ``HASH_BITS`` bits."""
    x = key * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    return (x >> U(64 - HASH_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, counts).astype(np.int64)

    def flush():
        for lang, parts in held.items():
            keys, counts = merged(parts)
            for a in range(0, len(keys), 1 << 16):
                k = keys[a : a + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(counts[a : a + len(k)])], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            texts = part.column("text").to_pylist()
            for lang in sorted(set(langs.tolist())):
                own = [t for t, x in zip(texts, langs) if x == lang]
                keys, counts = np.unique(grams(*letters(own)[:2])[0], return_counts=True)
                held.setdefault(lang, []).append((keys, counts))
                size += len(keys)
        if size > FLUSH:
            for lang in list(held):
                held[lang] = [merged(held[lang])]
            size = sum(len(p[0][0]) for p in held.values())
            if size > FLUSH // 2:
                yield from flush()
                size = 0
    yield from flush()


class Model:
    """What scoring needs: sorted hash arrays of log probabilities."""

    def __init__(self, languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]], backoff: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray):
        self.languages, self.tables, self.backoff, self.floor = languages, tables, backoff, floor
        self.limit, self.slope, self.spread = np.inf, 1.0, 0.0
        self._index: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    def _rows(self, which: list, i: int, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in a sorted array, or -1. The first table, which
        every character is looked up in, has an index by hash; the others, for
        what it does not know, are searched."""
        keys = which[i][0]
        if which is self.tables and i == 0:
            if self._index is None:
                self._index = np.full(1 << HASH_BITS, -1, np.int32)
                self._index[keys] = np.arange(len(keys), dtype=np.int32)
            return self._index[hashes]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """(keys, languages): the longest known gram's, with the weights of the
        longer contexts that are known."""
        at = self._rows(self.tables, 0, mixed(keys))
        values = self.tables[0][1]
        if not len(values):
            return np.broadcast_to(self.floor, (len(keys), len(self.languages))).copy()
        out = values[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            out[missing] = 0
            todo, known = missing, keys[missing]
            for i in range(1, len(self.tables) + 1):
                # the context of the gram that is not known weighs what follows
                width = ORDER - i + 1
                context = (known & U((1 << 16 * width) - 1 if width < 4 else 2**64 - 1)) >> U(16)
                b = self._rows(self.backoff, i - 1, mixed(context))
                out[todo[b >= 0]] += self.backoff[i - 1][1][b[b >= 0]]
                if i == len(self.tables):
                    out[todo] += self.floor
                    break
                shorter = known & U((1 << 16 * (width - 1)) - 1)
                at = self._rows(self.tables, i, mixed(shorter))
                out[todo[at >= 0]] += self.tables[i][1][at[at >= 0]]
                todo, known = todo[at < 0], known[at < 0]
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """((texts, languages) nats per character, letters of each text)."""
        symbols, first, n = letters(texts)
        keys, row = grams(symbols, first)
        total = np.zeros((len(texts), len(self.languages)))
        if len(keys):
            new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total[row[new]] = np.add.reduceat(self.log_probabilities(keys), new, axis=0, dtype=np.float64)
        size = np.bincount(row, minlength=len(texts))
        return -total / np.maximum(size, 1)[:, None], n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.languages:
            zero = np.zeros(len(texts))
            return ["und"] * len(texts), zero, zero, np.ones(len(texts), dtype=bool)
        h, n = self.cross_entropies(texts)
        best, least, lead = _ranked(h)
        score = np.where(n > 0, 1 / (1 + np.exp(-np.minimum(self.slope * lead * np.sqrt(n), 50))), 0)
        none = n == 0
        rejected = none | (least > self.limit + self.spread / np.sqrt(np.maximum(n, 1)))
        return ["und" if x else self.languages[b] for x, b in zip(none, best)], score, least, rejected


def _ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its cross-entropy, how far the second's is from it)."""
    best = h.argmin(axis=1)
    least = h[np.arange(len(h)), best]
    return best, least, np.partition(h, 1, axis=1)[:, 1] - least if h.shape[1] > 1 else np.full(len(h), 5.0)


def _probabilities(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Interpolated probabilities, from the highest order (lang, gram, p); the
    weights of contexts (lang, gram, weight); what an unknown symbol gets."""
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1))
        tables.append(written(tables[-1].select("lang", suffix.alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")), "continuations"))
    lower = None
    probabilities, weights = [], []
    sizes = tables[-1].groupBy("lang").agg((F.count("*") + 1).alias("symbols"))
    floor = sizes.select("lang", (1 / F.col("symbols")).alias("p"))
    for table in reversed(tables):
        order = len(probabilities) + 1
        few = table.groupBy("lang").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("n") == 2, 1).otherwise(0)).alias("n2"))
        discount = few.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))
        with_context = table.withColumn("context", F.shiftrightunsigned("gram", 16))
        contexts = with_context.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(discount, "lang")
        contexts = contexts.select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight"))
        joined = with_context.join(contexts, ["lang", "context"])
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if lower is None:
            joined = joined.join(floor.withColumnRenamed("p", "q"), "lang")
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
            joined = joined.withColumn("suffix", suffix).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
        lower = written(joined.select("lang", "gram", (own + F.col("weight") * F.col("q")).alias("p")), "probabilities")
        probabilities.append(lower)
        weights.append(written(contexts.select("lang", F.col("context").alias("gram"), "weight"), "weights"))
    return probabilities[::-1], weights[::-1], floor


def _rows_of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        keys = batch.column("gram").to_numpy().view(U)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("gram"), pa.array(mixed(keys).astype(np.int32)), batch.column("value")], names=["lang", "gram", "hash", "value"])


def _stored(table: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A table (lang, gram, value) as a sorted hash array and its matrix; of the
    grams that share a hash the largest value stands. At most 2**HASH_BITS rows
    come to the driver, which is the bound of the model."""
    hashed = table.mapInArrow(_rows_of, "lang string, gram long, hash int, value double")
    wide = hashed.groupBy("hash").agg(*[F.max(F.when(F.col("lang") == x, F.col("value"))).cast("float").alias(f"v{i}") for i, x in enumerate(languages)])
    got = wide.toArrow()
    keys = got["hash"].to_numpy()
    order = np.argsort(keys)
    matrix = np.column_stack([got[f"v{i}"].to_numpy() for i in range(len(languages))]) if len(keys) else np.empty((0, len(languages)), np.float32)
    return keys[order], matrix[order].astype(np.float32)


def train(rows: DataFrame) -> Model:
    """A model of the rows (text, lang), none of them null."""
    counts = rows.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long")
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return Model([], [], [], np.empty(0))
    probabilities, weights, floor = _probabilities(counts)
    base = np.zeros(len(languages))
    for r in floor.collect():
        base[languages.index(r["lang"])] = np.log(r["p"])
    tables, backoff = [], []
    for p, w in zip(probabilities, weights):
        tables.append(_stored(p.select("lang", "gram", F.log("p").alias("value")), languages))
        keys, matrix = _stored(w.select("lang", "gram", F.log("weight").alias("value")), languages)
        backoff.append((keys, np.nan_to_num(matrix, nan=0.0)))
    model = Model(languages, tables, backoff, base)
    # rows of grams known in one language only: fill the others from the lower orders
    for i in range(len(tables) - 1, -1, -1):
        _fill(model, i, probabilities[i])
    if len(languages) > 1:
        _calibrate(model, rows)
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Set the limit of the cross-entropy and the slope of the score, from all
    labelled rows that have letters."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    measured = written(rows.select("text", "lang").mapInArrow(_measured(sent), "n long, own double, lead double, right boolean"), "measures")
    sent.destroy()
    middle = _median(measured.where(F.col("n") >= LONG), "own")
    if middle is None:
        middle = _median(measured, "own")
    if middle is None:
        return
    got = measured.mapInArrow(_fitted(middle), "beyond double, fit array<double>").toArrow()
    # one nat above the usual entropy, and more for short texts, as far as the rows go
    model.spread = max(0.0, *got["beyond"].to_pylist()) * 1.5
    model.limit = middle + 1
    model.slope = float(SLOPES[np.sum(got["fit"].to_pylist(), axis=0).argmax()])


def _measured(sent):
    """Letters, cross-entropy in the row's own language, lead of the best one
    and whether that is the row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        number = {x: i for i, x in enumerate(model.languages)}
        for batch in batches:
            for part in slices(batch, "text"):
                h, n = model.cross_entropies(part.column("text").to_pylist())
                truth = np.array([number.get(x, -1) for x in part.column("lang").to_pylist()])
                best, _, lead = _ranked(h)
                use = (truth >= 0) & (n > 0)
                own = h[np.arange(len(h)), truth]
                yield pa.RecordBatch.from_arrays([pa.array(n[use], pa.int64()), pa.array(own[use]), pa.array(lead[use]), pa.array((best == truth)[use])], names=["n", "own", "lead", "right"])

    return run


def _median(values: DataFrame, column: str) -> float | None:
    """The median (of two the lower one), exact: the bin that holds it is
    divided into ``BINS`` until at most as many values are in it."""
    x = F.col(column)
    low, high, count = values.agg(F.min(x), F.max(x), F.count(x)).first()
    rank = (count - 1) // 2
    while count > BINS and low < high:
        number = F.floor((x - F.lit(low)) / F.lit((high - low) / BINS))
        bins = values.where(x.between(low, high)).groupBy(number.alias("bin")).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n"))
        for r in bins.orderBy("bin").collect():
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high, count = r["low"], r["high"], r["n"]
    if not count or low == high:
        return low
    return sorted(values.where(x.between(low, high)).select(x).toArrow()[column].to_pylist())[rank]


def _fitted(middle: float):
    """Of a partition: how far a row is beyond the limit, by the root of its
    letters, and the log likelihood of its rows for each slope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beyond, fit = 0.0, np.zeros(len(SLOPES))
        for batch in batches:
            if not batch.num_rows:
                continue
            root = np.sqrt(batch.column("n").to_numpy())
            beyond = max(beyond, float(((batch.column("own").to_numpy() - middle - 1) * root).max()))
            p = 1 / (1 + np.exp(-np.minimum(SLOPES[:, None] * (batch.column("lead").to_numpy() * root)[None, :], 30)))
            fit += np.where(batch.column("right").to_numpy(zero_copy_only=False), np.log(p), np.log(1 - p)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([beyond]), pa.array([fit.tolist()], pa.list_(pa.float64()))], names=["beyond", "fit"])

    return run


def _fill(model: Model, i: int, known: DataFrame) -> None:
    """Where a language lacks a gram that another has, its weight of the context
    times the next shorter gram's probability."""
    keys, matrix = model.tables[i]
    hashed = known.select("lang", "gram", F.lit(0.0).alias("value")).mapInArrow(_rows_of, "lang string, gram long, hash int, value double")
    one = hashed.groupBy("hash").agg(F.min("gram").alias("gram")).toArrow()
    order = np.argsort(one["hash"].to_numpy())
    gram = one["gram"].to_numpy()[order].view(U)
    width = ORDER - i
    at = np.searchsorted(model.backoff[i][0], mixed(gram >> U(16)))
    at = np.minimum(at, max(len(model.backoff[i][0]) - 1, 0))
    same = model.backoff[i][0][at] == mixed(gram >> U(16)) if len(model.backoff[i][0]) else np.zeros(len(gram), bool)
    value = np.where(same[:, None], model.backoff[i][1][at], 0)
    if i + 1 < len(model.tables):
        shorter = mixed(gram & U((1 << 16 * (width - 1)) - 1))
        low_keys, low = model.tables[i + 1]
        at = np.minimum(np.searchsorted(low_keys, shorter), len(low_keys) - 1)
        value = value + np.where((low_keys[at] == shorter)[:, None], low[at], model.floor)
    else:
        value = value + model.floor
    model.tables[i] = (keys, np.where(np.isnan(matrix), value, matrix).astype(np.float32))


def _predicted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                langs, score, entropy, rejected = model.predict(part.column("text").to_pylist())
                others = [part.column(c) for c in part.schema.names if c != "text"]
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*others, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected)], names=[*names, "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def _kept(sent, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, text):
                rejected = model.predict([t or "" for t in part.column(text).to_pylist()])[3]
                yield part.filter(pa.array(~rejected))

    return run


def without_rejected(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows, with all their columns, that a model learned from all those
    with a language accepts."""
    model = train(docs.select(text_or_empty(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null"))
    return docs.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(model), text), docs.schema)


def held_out(doc_id: str, part: int = 2, of: int = 4) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false for null ids."""
    return F.coalesce(crc_bucket(doc_id, of) == part, F.lit(False))


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", part: int = 2, of: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of every
    row; learned from the rows that are not held out and have a language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    model = train(rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id", part, of)))
    sent = spark.sparkContext.broadcast(model)
    out = rows.select("id", held_out("id", part, of).alias("held_out"), "text").mapInArrow(_predicted(sent), "id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("id", "doc_id")
