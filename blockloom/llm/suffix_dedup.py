"""Removal of long repeated byte strings by refining buckets of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.chunks import Chunk, answered, chunked, number_of_parts, with_answers
from blockloom.session import materialized

GRAM = 64  # bytes of the initial buckets
SEGMENT = 1 << 22  # string starts handled at once, so that a huge text needs bounded arrays
PLACE_BITS = 24
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_DRAW = np.random.default_rng(41).integers(0, 1 << 63, 256, np.uint64)
BYTE_BUCKETS = _DRAW * np.uint64(2) + np.uint64(1)
REPEATED, SPREAD = 1, 2
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def refined(here: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket of the longer string from its bucket here and the bucket at a later offset."""
    mixed = (here * ONE) ^ (later + (later >> np.uint64(31)) * TWO)
    mixed ^= mixed >> np.uint64(29)
    mixed *= TWO
    mixed ^= mixed >> np.uint64(32)
    return mixed


class Buckets:
    """Buckets of one stretch of text: of its grams, and of its strings of ``length`` bytes.

    A bucket is named by a 64-bit identifier that only depends on its bytes. Buckets of twice
    the length come from the identifiers here and at a later offset, which are used again at
    every doubling. Each string belongs to its anchor, the first of its grams with the
    smallest identifier, so equal strings have equal anchors at equal offsets; neighbouring
    strings share an anchor, and only anchors have to be sorted into buckets.
    """

    def __init__(self, content: np.ndarray, length: int):
        level, size = BYTE_BUCKETS[content], 1
        grams = level
        while 2 * size <= length:
            level = refined(level[:-size], level[size:])
            size *= 2
            if size == GRAM:
                grams = level
        starts = len(content) - length + 1
        self.strings = refined(level[:starts], level[length - size : length - size + starts])
        # A second identifier, from other offsets: together they have 128 bits.
        self.checks = refined(self.strings, grams[(length - GRAM) // 2 :][:starts])
        places = np.arange(len(grams), dtype=np.uint64)
        least = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
        width, span = length - GRAM + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:starts], least[width - span : width - span + starts])
        anchor = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        self.first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        self.last = np.append(self.first[1:], starts) - 1
        at = anchor[self.first]
        self.grams = grams[at]
        # All strings of an anchor together: the first and the last cover the others.
        self.whole = refined(
            refined(self.strings[self.first], self.strings[self.last]),
            ((self.last - self.first) * 65536 + (at - self.first)).astype(np.uint64),
        )


def _segments(text: bytes, length: int) -> Iterator[tuple[int, Buckets]]:
    content = np.frombuffer(text, np.uint8)
    for start in range(0, len(content) - length + 1, SEGMENT):
        yield start, Buckets(content[start : start + SEGMENT + length - 1], length)


def _sorted_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, the index of one occurrence, how often, and the pair of each entry."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(a)))
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    return a[starts], b[starts], counts, (order[starts] if len(a) else order), group


def _parts(one: np.ndarray, two: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Packed pairs of every part, pairs in order; one byte says whether a pair occurs twice."""
    part = (one % np.uint64(parts)).astype(np.int64)
    for p in np.unique(part).tolist():
        mine = part == p
        yield p, one[mine].tobytes() + two[mine].tobytes() + np.minimum(counts[mine], 2).astype(np.uint8).tobytes()


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    sizes = [len(p) // 17 for p in packed]
    one = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(packed, sizes)])
    two = np.concatenate([np.frombuffer(p, np.uint64, n, 8 * n) for p, n in zip(packed, sizes)])
    counts = np.concatenate([np.frombuffer(p, np.uint8, n, 16 * n) for p, n in zip(packed, sizes)])
    return one, two, counts, np.cumsum(sizes)[:-1].tolist()


def _anchor_answers(packed: list[bytes]) -> list[bytes]:
    """For each anchor whether all its strings repeat, and whether its strings must be compared.

    An anchor whose gram is nowhere else has no repeated string. If all anchors of a gram
    are alike, all their strings repeat. Else the bucket is refined: one anchor of each kind
    has its strings compared.
    """
    grams, wholes, counts, cuts = _unpacked(packed)
    kinds, _, _, sample, kind = _sorted_pairs(grams, wholes)
    total = np.bincount(kind, counts)
    gram_of_kind = np.concatenate(([0], np.cumsum(kinds[1:] != kinds[:-1]))) if len(kinds) else np.zeros(0, np.int64)
    mixed = (np.bincount(gram_of_kind) > 1)[gram_of_kind]
    status = np.where(total > 1, REPEATED, 0)[kind].astype(np.uint8)
    status[sample[mixed]] |= SPREAD
    return [part.tobytes() for part in np.split(status, cuts)]


def _string_answers(packed: list[bytes]) -> list[bytes]:
    strings, checks, counts, cuts = _unpacked(packed)
    _, _, _, _, kind = _sorted_pairs(strings, checks)
    repeated = (np.bincount(kind, counts) > 1)[kind]
    return [np.packbits(part).tobytes() for part in np.split(repeated, cuts)]


class _Anchors:
    """Anchors of a chunk's texts, joined, and their distinct pairs of buckets.

    Buckets of all strings are let go at once; where they are needed they are made again.
    """

    def __init__(self, chunk: Chunk, length: int):
        self.chunk, self.length, self.found = chunk, length, []
        grams, wholes = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for i, text in enumerate(chunk.texts):
            for start, buckets in _segments(text, length):
                self.found.append((i, start, buckets.first, buckets.last))
                grams.append(buckets.grams)
                wholes.append(buckets.whole)
        pairs = _sorted_pairs(np.concatenate(grams), np.concatenate(wholes))
        self.grams, self.wholes, self.counts, self.sample, self.kind = pairs

    def each(self, values: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Text, start, first and last string of the anchors of a segment, and their values."""
        at = 0
        for i, start, first, last in self.found:
            yield i, start, first, last, values[at : at + len(first)]
            at += len(first)

    def strings(self, i: int, start: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        content = np.frombuffer(self.chunk.texts[i], np.uint8)
        buckets = Buckets(content[start : start + SEGMENT + self.length - 1], self.length)
        return buckets.strings[at], buckets.checks[at]


def _read(one: np.ndarray, parts: int, answers: dict, kind: int, unpack) -> np.ndarray:
    """Answers put back in the order of the chunk's pairs."""
    out, part = np.zeros(len(one), np.uint8), (one % np.uint64(parts)).astype(np.int64)
    for p in np.unique(part).tolist():
        mine = np.flatnonzero(part == p)
        out[mine] = unpack(np.frombuffer(answers[kind, p], np.uint8), len(mine))
    return out


def _plain(values: np.ndarray, count: int) -> np.ndarray:
    return values[:count]


def _bits(values: np.ndarray, count: int) -> np.ndarray:
    return np.unpackbits(values, count=count)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the closed ranges, one after the other."""
    sizes = last - first + 1
    before = np.cumsum(sizes) - sizes
    return np.repeat(first - before, sizes) + np.arange(sizes.sum())


def _spread(anchors: _Anchors, status: np.ndarray):
    """Strings of the anchors to be compared: text, start in the text, and both buckets."""
    chosen = np.zeros(len(anchors.kind), bool)
    chosen[anchors.sample[(status & SPREAD) > 0]] = True
    texts, starts, strings, checks = [], [], [], []
    for i, start, first, last, mine in anchors.each(chosen):
        if mine.any():
            at = _ranges(first[mine], last[mine])
            one, two = anchors.strings(i, start, at)
            texts.append(np.full(len(at), i))
            starts.append(at + start)
            strings.append(one)
            checks.append(two)
    if not texts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    return tuple(map(np.concatenate, (texts, starts, strings, checks)))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 200) -> DataFrame:
    """What stays of every text: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    Every byte is removed that a string of ``length`` bytes covers which also starts anywhere
    else in the table, in the same text or another. ``spans`` are first and past-the-last
    bytes of the removed runs, packed as little-endian unsigned 64-bit integers. Texts are
    UTF-8; null counts as empty; repeated rows, ids and null ids are texts like others.

    Buckets are refined in three rounds over chunks of texts: by grams, by all strings of an
    anchor at once, and by single strings where these differ. Identifiers have 128 bits
    where they decide. A bucket of one is dropped in the round in which it arises; inner
    parts of long copies are settled in the second, so the last sees the ends of copies.
    Only identifiers travel, once per chunk, so a passage in most documents is no hot key;
    each text is read three times and shuffled twice, compressed.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings must have at least {2 * GRAM} bytes")
    parts = number_of_parts(docs, text_column)

    def anchor_keys(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        anchors = _Anchors(chunk, length)
        yield from _parts(anchors.grams, anchors.wholes, anchors.counts, parts)

    def string_keys(number: int, chunk: Chunk, answers: dict) -> pa.Table:
        anchors = _Anchors(chunk, length)
        _, _, strings, checks = _spread(anchors, _read(anchors.grams, parts, answers, 0, _plain))
        strings, checks, counts, _, _ = _sorted_pairs(strings, checks)
        rows = list(_parts(strings, checks, counts, parts))
        columns = zip(*rows) if rows else ((), ())
        part, content = (pa.array(list(v), t) for v, t in zip(columns, (pa.int32(), pa.binary())))
        return pa.table({"chunk": pa.array([number] * len(rows), pa.int64()), "part": part, "content": content})

    def remove(number: int, chunk: Chunk, answers: dict) -> pa.Table:
        anchors = _Anchors(chunk, length)
        status = _read(anchors.grams, parts, answers, 0, _plain)
        texts, starts, strings, checks = _spread(anchors, status)
        one, _, _, _, kind = _sorted_pairs(strings, checks)
        repeated = _read(one, parts, answers, 1, _bits).astype(bool)[kind]
        marks = [np.zeros(len(text) + 1, np.int64) for text in chunk.texts]

        def mark(i: int, at: np.ndarray, till: np.ndarray) -> None:
            np.add.at(marks[i], at, 1)
            np.add.at(marks[i], till, -1)

        for i, start, first, last, full in anchors.each(((status & REPEATED) > 0)[anchors.kind]):
            mark(i, first[full] + start, last[full] + start + length)
        hit_texts, hit_starts = texts[repeated], starts[repeated]
        bounds = np.flatnonzero(np.diff(hit_texts)) + 1
        for group_texts, group_starts in zip(np.split(hit_texts, bounds), np.split(hit_starts, bounds)):
            if len(group_texts):
                mark(int(group_texts[0]), group_starts, group_starts + length)
        rows = []
        for doc_id, text, change in zip(chunk.ids, chunk.texts, marks):
            gone = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edges) else text
            digest = hashlib.sha256(kept).hexdigest()
            rows.append((doc_id, len(text), int(gone.sum()), len(edges) // 2, digest, edges.astype("<u8").tobytes()))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
        types = (*[pa.int64()] * 4, pa.string(), pa.binary())
        return pa.table([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=list(names))

    texts, keys = chunked(docs, id_column, text_column, anchor_keys)
    anchors = materialized(answered(keys, _anchor_answers, parts).withColumn("kind", F.lit(0)), "anchors")
    # A chunk without keys, of short texts, still has to meet its texts.
    nothing = texts.select("chunk", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("content"), F.lit(-1).alias("kind"))
    strings = with_answers(texts, anchors, string_keys, "chunk long, part int, content binary", parts)
    strings = answered(strings, _string_answers, parts).withColumn("kind", F.lit(1))
    everything = anchors.unionByName(strings).unionByName(nothing)
    return with_answers(texts, everything, remove, RESULT, parts)
