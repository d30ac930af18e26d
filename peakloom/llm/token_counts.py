"""Operator 10: token counts through a cache of digests.

A count belongs to a pair of digests: of the normalised content, and of the tokenizer's file with the library's
version. Known pairs are joined; each other content is encoded once, wherever its copies lie, and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, staged
from .tokens import encoder

SCHEMA = "digest binary, version string, n_tokens long"
_MODELS: dict = {}


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer file and the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def counter(path: str):
    """A function from a list of texts to their numbers of tokens, kept by each Python worker."""
    if path not in _MODELS:
        if path.endswith(".json"):
            own = encoder(path)
            _MODELS[path] = lambda texts: own.encode(pa.array(texts, pa.string()))[1].tolist()
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _MODELS[path] = lambda texts: [len(model.encode(t)) for t in texts]
    return _MODELS[path]


def content(text: str = "text"):
    """The normalised content: null becomes empty. Nothing else is changed, as the count hangs on every byte."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def count_misses(rows: DataFrame, path: str) -> DataFrame:
    """digest, version, n_tokens of each distinct digest of (digest, content) rows.

    Copies within a task's input are dropped before the shuffle, so a digest that holds a third of all rows sends
    one row for each task. The digests that a task remembers for this are bounded; what is past the bound is sent.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keep = []
            for i, d in enumerate(b.column("digest").to_pylist()):
                if d not in seen:
                    keep.append(i)
                    if len(seen) < 1 << 20:
                        seen.add(d)
            yield b.take(pa.array(keep, pa.int64()))

    version = tokenizer_version(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(path), set()
        for batch in batches:
            for b in slices(batch, "content", 1 << 20):
                digests, keep = b.column("digest").to_pylist(), []
                for i, d in enumerate(digests):
                    if d not in seen:
                        seen.add(d)
                        keep.append(i)
                texts = b.column("content").take(pa.array(keep, pa.int64())).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in keep], pa.binary()), pa.array([version] * len(keep), pa.string()), pa.array(count(texts), pa.int64())], names=["digest", "version", "n_tokens"])

    once = rows.mapInArrow(distinct, rows.schema)
    return once.repartition(partitions(rows.sparkSession), "digest").mapInArrow(run, SCHEMA)


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; new counts are appended to the table ``cache``.

    Null texts are empty, repeated and null doc_ids keep their rows. The cache is any folder Spark can read; one
    that is not there yet is begun. A failed run appends nothing, as Spark commits the files at the end.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    two = docs.select(F.col("doc_id").cast("long"), content().alias("content"))
    two = two.withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(cache)
    misses = two.select("digest", "content")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        stored = spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == version)
        misses = misses.join(stored.select("digest"), "digest", "left_anti")
    count_misses(misses, path).write.mode("append").parquet(cache)
    known = spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == version)
    # Two runs at once may both have appended a digest. Staged, so that the join below can split a hot digest.
    known = staged(known.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")), "token-counts")
    sizes = two.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return sizes.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


