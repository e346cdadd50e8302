"""Operator 10: token counts through a digest cache.

The cache is a Parquet table of (version, digest, n_tokens): digest is the SHA-256 of the
normalised content (null becomes the empty text; the models here take text as it is),
version the SHA-256 of the tokenizer file, its library's release and the options. Digests
are compared with the cache, each missing one is encoded once from one of its documents,
the counts are appended, and all documents read their count from the cache.

Digests are grouped with map-side partial sums, so a text that is a third of all rows is
one row per task; the final join is by digest, where adaptive execution splits hot keys.
Appending the same count twice (two jobs at once, a retried write) is harmless.

Cases: null and empty texts count 0; repeated rows each get the count; ids may repeat or
be null; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import slices
from cohortlab.llm.sentencepiece_codec import KEPT_WORDS, MARK, words

CACHE = "version string, digest binary, n_tokens bigint"


def version_of(tokenizer_path: str) -> str:
    """Digest of all that decides the counts."""
    library = tokenizers if tokenizer_path.endswith(".json") else sentencepiece
    what = hashlib.sha256(Path(tokenizer_path).read_bytes())
    what.update(f"{library.__name__} {library.__version__} plain".encode())
    return what.hexdigest()


class Counter:
    """Counts with the tokenizer's own library, without begin, end or added special ids."""

    def __init__(self, path: str):
        self.kept: dict[str, int] = {}
        self.model = self.batch = None
        if path.endswith(".json"):
            self.batch = tokenizers.Tokenizer.from_file(path)
            self.batch.no_padding()
            self.batch.no_truncation()
            return
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # where no piece spans two words, a text's count is the sum over its words
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces)
        # a blank without a word: alone it would be an empty text to the library
        self.blank = {"": 1 if self.model.piece_to_id(MARK) != self.model.unk_id() else len(MARK.encode())}

    def __call__(self, texts: list[str]) -> list[int]:
        if self.batch is not None:
            return [len(x.ids) for x in self.batch.encode_batch(texts, add_special_tokens=False)]
        if not self.by_word:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        out, kept = [], self.kept
        for text in texts:
            split = words(text)
            if new := list({w for w in split if w not in kept}):
                if len(kept) + len(new) > KEPT_WORDS:
                    kept.clear()
                    new = list(set(split))
                kept.update(self.blank)
                new = [w for w in new if w]
                kept.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
            out.append(sum(map(kept.__getitem__, split)))
        return out


_LOADED: dict[str, Counter] = {}


def _count(path: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Counter(path)
        for batch in slices(batches):
            counts = _LOADED[path]([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the digest of the normalised content."""
    return docs.withColumn("digest", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def opened(spark, cache: str) -> DataFrame:
    """The cache table, made when it is not there yet."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    return spark.read.schema(CACHE).parquet(cache)


def fill(docs: DataFrame, cache: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode the distinct contents that the cache lacks and append their counts."""
    spark, version = docs.sparkSession, version_of(tokenizer_path)
    keyed = digests(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    known = opened(spark, cache).where(F.col("version") == version).select("digest")
    missing = keyed.groupBy("digest").agg(F.min("id").alias("from_id")).join(known, "digest", "left_anti")
    missing = missing.withColumnRenamed("digest", "wanted")
    # one document per content; of rows with the same id and text one count is stored
    same = (F.col("digest") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("from_id"))
    texts = keyed.join(missing.hint("shuffle_hash"), same).select("digest", "text")
    counted = texts.mapInArrow(_count(tokenizer_path), "digest binary, n_tokens bigint")
    counted = counted.dropDuplicates(["digest"])
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` in place of the text column.

    ``cache`` is a folder that all executors reach; it is filled first.
    """
    fill(docs, cache, tokenizer_path, doc_id, text)
    version = version_of(tokenizer_path)
    counts = (
        docs.sparkSession.read.schema(CACHE)
        .parquet(cache)
        .where(F.col("version") == version)
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    keyed = digests(docs.drop("digest", "n_tokens", "n_bytes"), text).withColumn("n_bytes", size).drop(text)
    return keyed.join(counts, "digest").drop("digest")
