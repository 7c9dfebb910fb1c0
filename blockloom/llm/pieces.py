"""Subword encoding with source offsets, and decoding, as column operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from blockloom.llm.piece_model import PieceModel

BYTES_AT_ONCE = 1 << 20  # of texts whose encoded rows a task holds; these are several times as large

_MODELS: dict[str, PieceModel] = {}
_DECODERS: dict[str, Callable[[list[int]], str]] = {}


def model_of(path: str) -> PieceModel:
    """The model of this worker process, which serves one task after the other."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def decoder_of(path: str) -> Callable[[list[int]], str]:
    """The library's decoder, kept by this worker process like the model."""
    if path not in _DECODERS:
        from sentencepiece import SentencePieceProcessor

        _DECODERS[path] = SentencePieceProcessor(model_file=path).decode
    return _DECODERS[path]


def parts_by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose values hold at most ``most`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right"))
        stop = max(at + 1, full)
        yield batch.slice(at, stop - at)
        at = stop


def encode_pieces(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``starts`` and ``ends``: packed little-endian unsigned 32-bit integers.

    The ids are those of the model's own library with begin and end ids. ``starts`` and
    ``ends`` are the source bytes of each piece in the UTF-8 text, ends exclusive; the
    spans follow each other and cover every byte that the normalisation keeps. Whole texts
    are encoded one at a time; null counts as empty and has the begin and end ids alone.
    Columns of these names are replaced, all others travel along; ``encode_and_decode`` is
    for those who need only the results.
    """
    names = ("ids", "starts", "ends")
    plain = docs.select(*[c for c in docs.columns if c.lower() not in names])
    schema = StructType([*plain.schema, *[StructField(name, BinaryType()) for name in names]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in batches:
            for part in parts_by_bytes(batch, text_column, BYTES_AT_ONCE):
                found = zip(*[model.encode(text) for text in part.column(text_column).to_pylist()])
                columns = [*part.columns, *[pa.array(values, pa.binary()) for values in found]]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *names])

    return plain.mapInArrow(encode, schema)


def decode_pieces(frame: DataFrame, model_path: str, ids_column: str = "ids", to: str = "decoded") -> DataFrame:
    """``frame`` with the text that the model's library decodes from packed ids; null stays null."""

    @F.pandas_udf("string")
    def decode_all(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = decoder_of(model_path)
        for batch in packed:
            yield pd.Series([None if ids is None else decode(np.frombuffer(ids, "<u4").tolist()) for ids in batch])

    return frame.withColumn(to, decode_all(F.col(ids_column)))


ROUND_TRIP = "doc_id long, ids binary, starts binary, ends binary, decoded string"


def encode_and_decode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids, starts, ends, decoded`` of every row, as ``encode_pieces`` and ``decode_pieces`` give them.

    One pass over the texts in one worker per task: a text is encoded, its ids are decoded by
    the model's library, and the text itself does not come back. A task holds the results
    of ``BYTES_AT_ONCE`` of text, or of one longer text. Null text counts as empty; null and
    repeated ids stay as they are; other columns are ignored; an empty table gives no rows.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, decode = model_of(model_path), decoder_of(model_path)
        for batch in batches:
            for part in parts_by_bytes(batch, "text", BYTES_AT_ONCE):
                encoded = [model.encode(text.as_py()) for text in part.column("text")]
                decoded = pa.array([decode(np.frombuffer(ids, "<u4").tolist()) for ids, _, _ in encoded], pa.string())
                columns = [pa.array(values, pa.binary()) for values in zip(*encoded)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns, decoded], ["doc_id", "ids", "starts", "ends", "decoded"]
                )

    return plain.mapInArrow(work, ROUND_TRIP)
