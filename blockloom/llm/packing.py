"""Packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from blockloom.llm.pieces import parts_by_bytes
from blockloom.session import materialized

# A mark alone after a letter and before white space is a token of its own either way.
AFTER_LETTER = [(f" {mark}", re.compile(rf"{re.escape(mark)}(?<=[a-z].)(?=[ \n])")) for mark in ".,"]
SPECIAL = "<|"
# With some marks only one of both letters is one code point, so these are lowered after they are composed.
# What is left out here are ranges without combining marks, as of quotes and ideographs.
ONE_COMPOSED = re.compile("[HIJTWY][^\x00-\u02ff\u2000-\u20cf\u3400-\u9fff]")
END = b"\0\0\0\0"
CACHED_WORDS = 800_000
CACHED_LENGTH = 40
TEXT_BYTES = 1 << 20  # of texts whose words a task holds at once
NEW_WORDS = 1000  # of one call of the tokenizer
SHARD_ITEMS = 40_000
PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def lowered(text: str) -> str:
    """The text with a-z for A-Z and marks apart from words, or as it is where its case matters."""
    if SPECIAL in text or not text.isascii() and ONE_COMPOSED.search(text):
        return text
    text = text.encode().lower().decode()
    for apart, mark in AFTER_LETTER:
        text = mark.sub(apart, text)
    return text


class WordIds:
    """Little-endian ids of words, each encoded once by a tokenizer that splits at white space.

    A tokenizer that drops white space and case encodes a text as it encodes its words, so
    ids of a text are joined from those of its words. Words are told apart and joined where
    Arrow holds them; new ones are encoded together and told apart by the place where a token
    starts. The store starts anew when it is full.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.known: dict[str, bytes] = {}

    def learned(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        tokens = np.fromiter((start for start, _ in found.offsets), np.int64, len(ids) // 4)
        # A token may take the space before its word along.
        spaces = np.fromiter(accumulate((len(word) + 1 for word in words), initial=-1), np.int64, len(words) + 1)
        cuts = (4 * np.searchsorted(tokens, spaces)).tolist()
        return [ids[begin:end] for begin, end in zip(cuts, cuts[1:])]

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each of these distinct words, from the store or learned."""
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        found = list(map(self.known.get, words))
        new = [place for place, ids in enumerate(found) if ids is None]
        for at in range(0, len(new), NEW_WORDS):
            places = new[at : at + NEW_WORDS]
            for place, ids in zip(places, self.learned([words[place] for place in places])):
                found[place] = ids
                if len(words[place]) <= CACHED_LENGTH:
                    self.known[words[place]] = ids
        return found

    def encode_all(self, texts: list[str | None]) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        plain = pa.array([lowered(text or "") for text in texts], pa.large_string())
        # Other white space is left to the tokenizer, which finds it inside a word.
        words = pc.ascii_split_whitespace(plain)
        each = words.values.dictionary_encode()
        ids = pa.array(self.ids(each.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        joined = pa.ListArray.from_arrays(words.offsets, ids.take(each.indices))
        return pc.binary_join(joined, pa.scalar(b"", pa.large_binary()))

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0].as_py()


_STORES: dict[str, WordIds] = {}


def word_ids(tokenizer_path: str) -> WordIds:
    """The store of this worker process, which serves one task after the other."""
    if tokenizer_path not in _STORES:
        _STORES[tokenizer_path] = WordIds(tokenizer_path)
    return _STORES[tokenizer_path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: texts as ids with an end id 0, cut at ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = word_ids(tokenizer_path)
        for batch in batches:
            for part in parts_by_bytes(batch, "text", TEXT_BYTES):
                out = []
                encoded = store.encode_all(part.column("text").to_pylist())
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded):
                    ids = ids.as_py() + END
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut_ids = ids[at : at + 4 * capacity]
                        out.append((doc_id, piece, at // 4, len(cut_ids) // 4, zlib.crc32(cut_ids)))
                columns = [pa.array(v, t) for v, t in zip(zip(*out), PIECE.types)]
                yield pa.RecordBatch.from_arrays(columns, names=PIECE.names)

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; items are placed in the given order.

    An item goes into the open bin for which the sum over gaps of the squared number of
    open bins with that gap becomes smallest; ties take the smallest gap left. A new bin is
    opened only when no open bin has room, since the aim is few bins. Full bins are closed.
    There are at most ``capacity`` gaps, so an item costs one vector step whatever the
    number of bins.
    """
    count, never = np.zeros(capacity + 1, np.int64), np.iinfo(np.int64).max
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        old, left = count[size:], count[: capacity - size + 1]
        # (old - 1)**2 - old**2 + (left + 1)**2 - left**2; a full bin leaves no gap.
        change = np.where(old > 0, 2 - 2 * old + 2 * left, never)
        if old[0]:
            change[0] = 1 - 2 * old[0]
        at = int(change.argmin())
        if change[at] < never:
            gap = at + size
            bin_ = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_, made = capacity, made, made + 1
        bins[i], offsets[i] = bin_, capacity - gap
        if gap > size:
            stacks[gap - size].append(bin_)
            count[gap - size] += 1
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Place of every piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Full pieces are sequences of their own. The others are dealt by a hash of the number they
    get when they are written into shards of about ``shard_items``, whose number grows with the input, and each shard
    is packed by the sum-of-squares rule, longest first. A shard holds lengths only. Null
    text is empty and has the end id alone; rows that repeat an id or have none are packed
    like others. An empty table gives no rows; other columns are ignored.
    """
    made = token_pieces(docs, tokenizer_path, capacity, id_column, text_column)
    # The number a piece gets when it is written deals it, so that rows alike are spread too.
    pieces = materialized(made.withColumn("_deal", F.monotonically_increasing_id()), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    shards = max(1, round(short.count() / shard_items))
    schema = StructType([*made.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(key: tuple, shard: pa.Table) -> pa.Table:
        order = [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")]]
        shard = shard.drop_columns(["_shard", "_deal"]).sort_by(order)
        bins, offsets = sum_of_squares(shard["length"].to_numpy(), capacity)
        shard = shard.append_column("sequence_id", pa.array(bins * shards + key[0].as_py()))
        return shard.append_column("offset", pa.array(offsets))

    shard = F.pmod(F.xxhash64("_deal"), F.lit(shards))
    packed = short.withColumn("_shard", shard).groupBy("_shard").applyInArrow(place, schema)
    # Full pieces take negative numbers, which no shard uses.
    alone = -F.monotonically_increasing_id() - 1
    full = pieces.filter(F.col("length") == capacity)
    full = full.drop("_deal").withColumn("sequence_id", alone).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
