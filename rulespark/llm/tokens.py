"""Token counts and ids of whole texts, by public tokenizer files.

A text is split into words by the tokenizer's own pattern and every distinct
word is encoded by the library and remembered; ids of a text are those of its
words one after another. That holds for these two files because neither merges
across words. Texts with characters beyond U+017F, or with what may be a special
token, go through the library as a whole, so that its own tables decide.

``token_counts`` is a digest cache: the digest of a text's bytes and that of the
tokenizer (file and library version) are joined to stored counts, only distinct
misses are encoded, and these are appended to the store. Null and empty texts
have no tokens; a text is never cut; equal texts have one entry.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.shared import shared_folder, slices, text_or_empty

LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼½¾"
SPACE = "\\t-\\r \\x85\\xa0"
BEYOND = re.compile("[^\x00-įı-ſ]|<\\|")
SPLIT = {
    "byte": re.compile(f" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
    "word": re.compile(f"[{LETTER}]+|[{NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{LETTER}{NUMBER}]+"),
}
#: a worker's memory of words: so many recent ones, and as many older ones
REMEMBERED = 500_000
LONG_WORD = 80


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    kind: ``byte`` for byte_bpe files, ``word`` for word_bpe files (which lower
    the case of what they read). A single word goes straight to the library's
    model, past the normalizer and the split that are done already.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), kind
        self.letters = _byte_letters()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _little(self.library.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.letters)
        return _little([t.id for t in self.library.model.tokenize(shown)])

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts of one call share their new words."""
        split, lower = SPLIT[self.kind].findall, self.kind == "word"
        words = [None if BEYOND.search(t) else split(t.lower() if lower else t) for t in texts]
        fresh = set().union(*(w for w in words if w is not None)).difference(self.recent)
        if len(self.recent) + len(fresh) > REMEMBERED:
            self.older, self.recent = self.recent, {}
            fresh = set().union(*(w for w in words if w is not None))
        recent, older = self.recent, self.older
        for w in fresh:
            recent[w] = older.get(w) or self.word(w)
        out = [self.whole(t) if w is None else b"".join(map(recent.__getitem__, w)) for t, w in zip(texts, words)]
        for w in fresh:
            if len(w) > LONG_WORD:
                del recent[w]
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def tokenizer_digest(path: str) -> str:
    """Stands for the file's content and the version of the library."""
    import tokenizers

    digest = hashlib.sha256(tokenizers.__version__.encode())
    with open(path, "rb") as f:
        digest.update(f.read())
    return digest.hexdigest()


def _counts(path: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, kind)
        for batch in batches:
            for part in slices(batch, "text"):
                n = [len(x) // 4 for x in encode.ids(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, *, kind: str = "byte", doc_id: str = "doc_id", text: str = "text", cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row.

    cache: folder of the stored counts, in storage that all executors share;
    without one, a new folder under the shared one serves this call alone.
    Repeated rows stay repeated; rows without an id are counted as others are;
    other columns of ``docs`` are not looked at. Joins are on digests, so a text
    that a third of the rows have is a hot key: its rows are merged before the
    texts are shuffled, and the last join has narrow rows that adaptive
    execution splits.
    """
    spark = docs.sparkSession
    body = text_or_empty(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("digest"))
    version = tokenizer_digest(tokenizer)
    texts = docs.select(F.sha2(body.cast("binary"), 256).alias("digest"), body.alias("text"))
    folder = cache or shared_folder(spark, "token-counts")
    schema = "digest string, n_tokens long, tokenizer string"
    stored = None
    if cache:
        path = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
            texts = texts.join(stored.select("digest"), "digest", "left_anti")
    misses = texts.dropDuplicates(["digest"]).mapInArrow(_counts(tokenizer, kind), "digest string, n_tokens long")
    misses.withColumn("tokenizer", F.lit(version)).write.mode("append").option("compression", "zstd").parquet(folder)
    counts = spark.read.schema(schema).parquet(folder).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    if cache:
        counts = counts.dropDuplicates(["digest"])  # two runs may have appended the same miss
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
