"""Token counts of texts through a cache of counts by content and tokenizer."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.tables import filled
from blockloom.session import is_bounded, materialized, scratch_path
from blockloom.sinks.append import path_exists

CACHE = "digest binary, n_tokens long, tokenizer string"
BATCH_BYTES = 1 << 20
CUT_CHARS = 1 << 16
BETWEEN_WORDS = re.compile("(?<=[a-z]) (?=[a-z])")


class TokenCounter:
    """Counts of one tokenizer file as its library gives them, without added special tokens.

    Special strings inside a text are handled as the library does by default; there is no
    truncation or padding. One thread is used. A long text is cut where the tokenizer itself
    starts a token: between a letter and a space before a letter, if the tokenizer works on
    bytes, splits by its own pattern and has no normaliser. Else it is encoded whole.
    """

    def __init__(self, path: str):
        self.cuts = False
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            processor = SentencePieceProcessor(model_file=path)
            self._lengths = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        spec = json.loads(tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        special = [t for t in spec["added_tokens"] if " " in t["content"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        self.cuts = bool(plain and spec["normalizer"] is None and not special)
        self._lengths = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        """``text`` cut where cutting changes no token; one piece if it is short."""
        out, at = [], 0
        while self.cuts and len(text) - at > CUT_CHARS:
            place = BETWEEN_WORDS.search(text, at + CUT_CHARS)
            if place is None:
                break
            out.append(text[at : place.start()])
            at = place.start()
        return [*out, text[at:]]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of every text; a bounded number of bytes is encoded at once."""
        found, batch, owners, size = [0] * len(texts), [], [], 0

        def flush() -> None:
            for owner, length in zip(owners, self._lengths(batch) if batch else []):
                found[owner] += length
            batch.clear()
            owners.clear()

        for owner, text in enumerate(texts):
            for piece in self.pieces(text):
                batch.append(piece)
                owners.append(owner)
                size += len(piece)
                if size >= BATCH_BYTES // 4:
                    flush()
                    size = 0
        flush()
        return found


_COUNTERS: dict[str, TokenCounter] = {}


def counter_of(path: str) -> TokenCounter:
    """The counter of this worker process, which serves one task after the other."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer file, its library's version and the options of counting."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    seen = hashlib.sha256(f"{library.__name__} {library.__version__} whole texts, nothing added\n".encode())
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            seen.update(block)
    return seen.hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of a text that is not null; said to be never null, so that no join tests it."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` stored for one version of a tokenizer, each digest once.

    A digest that an interrupted or replayed run stored again has the same count each time.
    """
    if not path_exists(spark, cache_path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    stored = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    limit: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] = filled,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, for the tokenizer of a file.

    Normalised texts and the tokenizer's version are joined by digest to the counts stored
    under ``cache_path``; only texts without a stored count are encoded, each distinct one
    once, and their counts are appended there. Without a path the cache is a new folder of
    the shared one. ``normalise`` must give a text of equal count, not null; ``n_bytes`` is
    of its result. A changed file, library or way of counting is another version with counts
    of its own.

    Null counts as empty, of 0 tokens. Repeated rows, ids and null ids are answered row by
    row. An empty table gives no rows and stores nothing; other columns are ignored.

    Rows become narrow digests first. Few missing texts are picked out of the scan by a
    broadcast of their digests; if they are many, copies combine inside each task and a
    distinct text is shuffled once. A group of copies never meets in one task: rows find
    their count by a join whose hot keys Spark splits.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-counts")
    tokenizer = tokenizer_version(tokenizer_path)
    texts = docs.select(F.col(id_column).alias("doc_id"), normalise(F.col(text_column)).alias("text"))
    texts = texts.withColumn("digest", content_digest(F.col("text")))
    rows = texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    rows = materialized(rows, "digests")
    known = read_cache(spark, cache_path, tokenizer)
    misses = rows.select("digest").distinct().join(known, "digest", "left_anti")
    misses = materialized(misses, "misses")
    texts = texts.select("digest", "text")
    few = is_bounded(misses)
    if few:
        texts = texts.join(F.broadcast(misses), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
    if not few:
        texts = texts.join(misses, "digest", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_path)
        for batch in batches:
            found = pa.array(counter.counts(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), found], ["digest", "n_tokens"])

    counted = texts.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    stored = read_cache(spark, cache_path, tokenizer)
    found = rows.join(stored, "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
