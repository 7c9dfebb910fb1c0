"""Documents gathered into chunks, and packed arrays that travel between chunks and key parts.

Operators that look up keys of every text position use this: a chunk of texts sends one row
of packed keys to each part of the key space, a part answers with one row of packed values
for each chunk, and the chunk reads its texts once more beside the answers. Rows are few and
the work on their arrays is vectorised; a key is sent once per chunk, so no key is heavier
than the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import materialized

CHUNK_BYTES = 8 << 20
PART_BYTES = 32 << 20
ROWS = "kind int, chunk long, part int, ids array<long>, sizes binary, content binary"
ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("chunk", pa.int64()),
        ("part", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.binary()),
        ("content", pa.binary()),
    ]
)
TEXTS, KEYS = 0, 1


@dataclass
class Chunk:
    """Whole texts with their ids; a null id stays null."""

    ids: list[int | None]
    texts: list[bytes]

    def row(self, number: int) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in self.texts], "<u8").tobytes()
        content = zstandard.ZstdCompressor(level=3).compress(b"".join(self.texts))
        return _batch(TEXTS, number, None, self.ids, sizes, content)

    @staticmethod
    def of(table: pa.Table) -> Chunk:
        sizes = np.frombuffer(table["sizes"][0].as_py(), "<u8")
        joined = zstandard.ZstdDecompressor().decompress(table["content"][0].as_py(), max_output_size=int(sizes.sum()) + 1)
        stops = np.cumsum(sizes).tolist()
        texts = [joined[a:b] for a, b in zip([0, *stops], stops)]
        return Chunk(table["ids"][0].as_py(), texts)


def _batch(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, ARROW.types)], names=ARROW.names)


def key_rows(number: int, parts: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for part, content in parts:
        yield _batch(KEYS, number, part, None, None, content)


def number_of_parts(docs: DataFrame, text_column: str, part_bytes: int = PART_BYTES) -> int:
    """Parts of the key space, in proportion to the bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text_column).cast("long"))).first()[0]
    return max(1, -(-(total or 0) // part_bytes))


def chunked(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    keys_of: Callable[[Chunk], Iterable[tuple[int, bytes]]],
    chunk_bytes: int = CHUNK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Chunks and their packed keys by part, both written once to the shared folder.

    A chunk holds neighbours of one scan task, so no text is shuffled here; a text larger
    than ``chunk_bytes`` has a chunk of its own. Numbers of chunks come from the task and
    a count; they are settled when the rows are written.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk, size = (TaskContext.get().partitionId() << 32) - 1, Chunk([], []), 0

        def finish() -> Iterator[pa.RecordBatch]:
            yield chunk.row(number)
            yield from key_rows(number, keys_of(chunk))

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                content = (text.as_py() or "").encode()
                if chunk.ids and size + len(content) > chunk_bytes:
                    number += 1
                    yield from finish()
                    chunk, size = Chunk([], []), 0
                chunk.ids.append(doc_id)
                chunk.texts.append(content)
                size += len(content)
        if chunk.ids:
            number += 1
            yield from finish()

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    made = materialized(plain.mapInArrow(gather, ROWS), "chunks")
    return made.filter(F.col("kind") == TEXTS).select("chunk", "ids", "sizes", "content"), made.filter(F.col("kind") == KEYS)


def answered(keys: DataFrame, answer: Callable[[list[bytes]], list[bytes]], parts: int) -> DataFrame:
    """``chunk, part, content``: ``answer`` of all packed keys of a part, one for each chunk.

    There are as many partitions as ``parts``, so that a task's share does not depend on the
    size of the input.
    """

    def reply(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        return pa.table({"chunk": table["chunk"], "part": table["part"], "content": pa.array(answer(table["content"].to_pylist()), pa.binary())})

    rows = keys.select("chunk", "part", "content").repartition(parts, "part")
    return rows.groupBy("part").applyInArrow(reply, "chunk long, part int, content binary")


def with_answers(
    texts: DataFrame, answers: DataFrame, work: Callable[[int, Chunk, dict], pa.Table], schema: str, partitions: int
) -> DataFrame:
    """``work(number, chunk, answers by kind and part)`` for every chunk.

    ``answers`` has ``kind, chunk, part, content``; kinds and parts without a row are absent.
    Both sides are dealt to ``partitions``, a number that should follow the bytes of text.
    """

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        found = {
            (kind, part): content
            for kind, part, content in zip(*(answers[name].to_pylist() for name in ("kind", "part", "content")))
        }
        return work(key[0].as_py(), Chunk.of(texts), found)

    left = texts.repartition(partitions, "chunk").groupBy("chunk")
    right = answers.select("chunk", "kind", "part", "content").repartition(partitions, "chunk").groupBy("chunk")
    return left.cogroup(right).applyInArrow(run, schema)
