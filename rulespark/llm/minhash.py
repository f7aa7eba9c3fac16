"""MinHash near-duplicate detection.

Every document's set of shingles gets ``bands * rows`` universal hash minima.
Rows with equal sets are one class, stood for by one of its rows; the classes
of one id are linked from the start. Classes
that agree in all minima of a band share a bucket; each bucket links its
members to one pivot, never to one another. Pairs pass the signature test (the
share of equal minima) and are then confirmed on the full shingle sets;
confirmed links go through alternating large-star and small-star steps.

Only links inside one component are implied by others. So pairs of one bucket
whose ends are still in different components after the pivots were tried are
compared as well: they are all that a star can miss.

A pair of similarity 0.8 shares no band with probability
``(1 - 0.8**rows)**bands``: 5e-6 with the defaults.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm import textscan as ts
from rulespark.llm.shared import arrow_path, shared_folder, slices, text_or_empty, written

BANDS, ROWS = 40, 6
FEATURES = "row long, doc_id long, file string, n_shingles long, digest binary, bands array<long>, signature binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row with fewer words
    than ``size``, but not none, has all its words as its only shingle."""
    hashes, _, first = ts.words(ts.LOWER[data], offsets, ts.WORD_NONSPACE)
    grams = hashes
    for n in range(2, size + 1):
        grams = grams[: max(0, len(hashes) - n + 1)] * ts.U(ts.BASE_2) + hashes[n - 1 :] if len(hashes) >= n else hashes[:0]
    grams = ts.mix(grams ^ ts.U(size))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            total = 0
            for h in hashes[a:b].tolist():
                total = (total * ts.BASE + h + 1) & ts.MASK
            out.append(np.array([total], dtype=ts.U))
        else:
            out.append(hashes[:0])
    return out


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(20240229))
    return random.integers(1, 1 << 63, n, dtype=ts.U) * ts.U(2) + ts.U(1), random.integers(0, 1 << 63, n, dtype=ts.U)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(sets, count) minima of the multiply-shift functions
    ``(a * x + b) mod 2**64 >> 32``; rows of empty sets are zero."""
    a, b = coefficients(count)
    out = np.zeros((len(sets), count), dtype=np.uint32)
    block: list[int] = []
    held = 0
    for i, s in enumerate([*sets, None]):
        if s is None or held > 40_000:
            if block:
                x = np.concatenate([sets[j] for j in block]) >> ts.U(32)
                at = np.concatenate([[0], np.cumsum([len(sets[j]) for j in block])[:-1]])
                for f in range(count):
                    out[block, f] = np.minimum.reduceat(x * a[f] + b[f], at) >> ts.U(32)
            block, held = [], 0
        if s is not None and len(s):
            block.append(i)
            held += len(s)
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(minima), bands), dtype=ts.U)
    for r in range(rows):
        keys = (keys + minima[:, r::rows][:, :bands].astype(ts.U) + ts.U(1)) * ts.U(ts.BASE)
    return ts.mix(keys + np.arange(bands, dtype=ts.U) * ts.U(ts.BASE_2)).view(np.int64)


def _features(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*ts.flat(part.column("text")), size)
                minima = signatures(sets, bands * rows)
                keys = band_keys(minima, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        part.column("file"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([k.tolist() if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                        pa.array([m.astype(np.uint8).tobytes() for m in minima], pa.binary()),
                    ],
                    names=["row", "doc_id", "file", "n_shingles", "digest", "bands", "signature"],
                )

    return run


def _fetch(key: tuple, table: pa.Table) -> pa.Table:
    """The texts of the wanted rows, out of the one file that holds them."""
    import pyarrow.parquet as pq

    system, path = arrow_path(key[0].as_py())
    have = pq.read_table(path, filesystem=system, columns=["row", "text"])
    have = have.filter(pa.compute.is_in(have["row"], value_set=table["row"].combine_chunks()))
    return pa.table({"id": have["row"], "body": have["text"].cast(pa.string()).combine_chunks()}, schema=pa.schema([("id", pa.int64()), ("body", pa.string())]))


def _confirm(size: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20):
                left = shingle_sets(*ts.flat(part.column("text_a")), size)
                right = shingle_sets(*ts.flat(part.column("text_b")), size)
                keep = []
                for x, y in zip(left, right):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(denominator * both >= numerator * (len(x) + len(y) - both) and both > 0)
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return run


def _similar(threshold: float):
    """Signature test: five standard deviations of slack below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            n = x.shape[1]
            keep = pa.array((x == y).mean(axis=1) >= threshold - 5 * (threshold * (1 - threshold) / n) ** 0.5, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every node that occurs in ``links``, by alternating
    large-star and small-star until nothing changes. Each step is written to
    the shared folder."""
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        # large-star: every larger neighbour of a node goes to its smallest neighbour
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: every smaller neighbour, and the node itself, goes to the smallest
        large = large.where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(
        roots.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )


class _Job:
    """One run: the stored texts, their features and the links so far."""

    def __init__(self, docs: DataFrame, size: int, numerator: int, denominator: int, bands: int, rows: int):
        self.spark: SparkSession = docs.sparkSession
        self.size, self.numerator, self.denominator = size, numerator, denominator
        store = written(docs.withColumn("row", F.monotonically_increasing_id()), "texts").select("row", "doc_id", "text", F.col("_metadata.file_path").alias("file"))
        features = written(store.mapInArrow(_features(size, bands, rows), FEATURES), "features")
        linked = features.where("n_shingles > 0 and doc_id is not null")
        least = linked.groupBy("digest").agg(F.min("row").alias("class_id"))
        self.documents = features.select("doc_id", "n_shingles")
        self.members = written(linked.select("doc_id", "digest").join(least, "digest").select("doc_id", "class_id").distinct(), "classes")
        classes = features.join(least.select(F.col("class_id").alias("row")), "row", "left_semi")
        keys = classes.select(F.col("row").alias("id"), F.posexplode("bands").alias("band", "key"))
        buckets = keys.groupBy("band", "key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("members")).where("members > 1")
        self.buckets = written(keys.join(buckets, ["band", "key"]), "buckets")
        used = self.buckets.select(F.col("id").alias("row")).distinct()
        self.classes = written(classes.join(used, "row", "left_semi").select(F.col("row").alias("id"), "file", "n_shingles", "signature"), "signatures")
        # all classes of one id are one node
        least_class = self.members.groupBy("doc_id").agg(F.min("class_id").alias("a"))
        self.links = written(self.members.join(least_class, "doc_id").where("a <> class_id").select("a", F.col("class_id").alias("b")), "links")
        self.components: DataFrame | None = None

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose set sizes and signatures allow a link."""
        side = lambda x: self.classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"sig_{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        sized = sized.where(self.denominator * F.least("n_a", "n_b") >= self.numerator * F.greatest("n_a", "n_b"))
        return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_similar(self.numerator / self.denominator), "a long, b long")

    def confirm(self, pairs: DataFrame) -> None:
        """Add those of ``pairs`` that hold on the full sets to the links."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = self.classes.join(ids, "id", "left_semi").select(F.col("id").alias("row"), "file")
        texts = written(wanted.groupBy("file").applyInArrow(_fetch, "id long, body string"), "bodies")
        side = lambda x: texts.select(F.col("id").alias(x), F.col("body").alias(f"text_{x}"))
        found = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirm(self.size, self.numerator, self.denominator), "a long, b long")
        found = written(found, "links")
        self.links = self.links.unionAll(found)
        self.components = written(connected_components(self.links), "components")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that the links so far don't connect."""
        of = lambda x: self.components.select(F.col("id").alias(x), F.col("component_id").alias(f"c_{x}"))
        joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return joined.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) and
    kept (whether the id is its own component's).

    Null and empty texts, and those without words, have no shingles and no
    links. Rows with equal ids are merged to one node of the links, whatever
    their texts, but all returned. Rows with null ids have no links and no
    component and are kept. ``similarity`` is a fraction, so that its test is exact.
    """
    numerator, denominator = similarity
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    job = _Job(docs, shingle, numerator, denominator, bands, rows)
    # every member with the smallest and the largest id of each of its buckets
    stars = job.buckets.select("id", F.explode(F.array("low", "high")).alias("pivot")).where("id <> pivot")
    stars = stars.groupBy(F.greatest("id", "pivot").alias("b"), F.least("id", "pivot").alias("a")).agg(F.count("*").alias("shared"))
    stars = written(job.candidates(stars.select("a", "b")), "stars")
    # first each document's link to the smallest pivot, which mostly settles the rest
    job.confirm(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    rest = written(job.apart(stars), "rest")
    if not rest.isEmpty():
        job.confirm(rest)
    # what no star decided: members of one bucket in different components. Each
    # pair of components of a bucket brings its members together, those of sizes
    # that allow a link; no two members of one component meet
    labelled = job.buckets.where("members > 2").join(job.components, "id", "left").select("band", "key", "id", "low", "high", F.coalesce("component_id", "id").alias("c"))
    mixed = labelled.groupBy("band", "key").agg(F.min("c").alias("c_low"), F.max("c").alias("c_high")).where("c_low <> c_high").select("band", "key")
    labelled = labelled.join(mixed, ["band", "key"]).where("id <> low and id <> high")
    ratio = F.lit(1.0001 * math.log(denominator / numerator) if numerator < denominator else 1.0)
    labelled = written(labelled.join(job.classes.select("id", F.floor(F.log("n_shingles") / ratio).alias("size")), "id").select("band", "key", "id", "c", "size"), "mixed")
    parts = labelled.select("band", "key", "c").distinct()
    others = parts.withColumnRenamed("c", "c_b")
    meet = parts.withColumnRenamed("c", "c_a").join(others, ["band", "key"]).where("c_a < c_b")
    left = labelled.select("band", "key", F.col("id").alias("a"), F.col("c").alias("c_a"), "size")
    right = labelled.select("band", "key", F.col("id").alias("b"), F.col("c").alias("c_b"), F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    crossing = meet.join(left, ["band", "key", "c_a"]).join(right, ["band", "key", "c_b", "size"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    crossing = written(job.candidates(crossing).join(stars, ["a", "b"], "left_anti"), "crossing")
    if not crossing.isEmpty():
        job.confirm(crossing)
    root = F.coalesce("component_id", "class_id").alias("root")
    nodes = job.members.join(job.components.withColumnRenamed("id", "class_id"), "class_id", "left").select("doc_id", root).distinct()
    smallest = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    nodes = nodes.join(smallest, "root").select("doc_id", "component_id")
    component = F.coalesce("component_id", "doc_id")
    result = job.documents.join(nodes, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of its group,
    and those without an id. Rows of one id stay or go together."""
    found = near_duplicates(docs, doc_id=doc_id, **options)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("_gone"), "left_anti")
