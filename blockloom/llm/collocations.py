"""Phrases that occur together more often than their parts, from counts of all word n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.tables import filled
from blockloom.session import materialized

CHUNK_TOKENS = 1_000_000
OPEN_TOKENS = 2_000_000  # of all languages that a task gathers at once
SLICE_BYTES = 1 << 20
PART_TOKENS = 5_000_000  # of the corpus for each part of the fingerprints
SPARE_BITS = 6  # of short fingerprints, over those that number all tokens
#: Odd bases of the fingerprints and of the second ones that check them.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(BASES[0])
BREAK = 0  # number of the token that ends a piece
# One byte for each kind of separator; words hold neither spaces nor line ends after it.
MARKS = b".,;:!?\x0b\x0c\r"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + MARKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(MARKS))
CONTENT, PHRASES, TEXTS, CLASH = range(4)
ROWS = "kind int, chunk long, lang string, size long, words binary, tokens binary, phrases array<string>, numbers array<long>"
ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("chunk", pa.int64()),
        ("lang", pa.string()),
        ("size", pa.int64()),
        ("words", pa.binary()),
        ("tokens", pa.binary()),
        ("phrases", pa.list_(pa.string())),
        ("numbers", pa.list_(pa.int64())),
    ]
)
KEYS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("content", pa.binary())])


def _shrunk(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as planes of bytes, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _grown(content: bytes, *types: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(content), 0, []
    kinds = [np.dtype(t) for t in types]
    count = len(data) // sum(k.itemsize for k in kinds)
    for kind in kinds:
        planes = np.frombuffer(data, np.uint8, count * kind.itemsize, at).reshape(kind.itemsize, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(count))
        at += count * kind.itemsize
    return out


class Vocabulary(dict):
    """Numbers of words in the order they are met; the break is the first."""

    def __init__(self):
        super().__init__({b"\n": BREAK})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Stretch:
    """Consecutive tokens of one language as numbers of words; breaks end the pieces."""

    def __init__(self, lang: str, words: list[bytes], tokens: np.ndarray):
        self.lang, self.words, self.tokens = lang, words, tokens

    def row(self, chunk: int) -> list:
        """As a row; words are numbered by how often they occur, which shrinks the tokens."""
        times = np.bincount(self.tokens, minlength=len(self.words))
        order = np.concatenate(([BREAK], 1 + np.argsort(-times[1:], kind="stable")))
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        words = zstandard.ZstdCompressor(level=3).compress(b"\n".join([self.words[i] for i in order[1:].tolist()]))
        size = int(len(self.tokens) - times[BREAK])
        return [CONTENT, chunk, self.lang, size, words, _shrunk(place[self.tokens]), None, None]

    @staticmethod
    def of(row: dict) -> Stretch:
        words = zstandard.ZstdDecompressor().decompress(row["words"])
        (tokens,) = _grown(row["tokens"], "<u4")
        return Stretch(row["lang"], [b"\n", *(words.split(b"\n") if words else [])], tokens.astype(np.int32))

    def fingerprints(self, sizes: list[int], bits: int = 64, second: bool = False) -> list[np.ndarray]:
        """For each size the fingerprint of the n-gram that starts at every token.

        Prefix sums of ``hash(word) * base**place`` give the polynomial of any window as one
        difference, divided by the power of its first place. All is modulo 2**64, where the
        base has an inverse; hashes of words hold the language. Only the highest ``bits`` are
        kept. ``second`` gives fingerprints from other hashes and another base.
        """
        seed, base = xxhash.xxh3_64_intdigest(self.lang.encode(), int(second)), BASES[second]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        count = len(self.tokens)
        powers = np.full(count, np.uint64(base))
        back = np.full(count, np.uint64(pow(base, -1, 1 << 64)))
        if count:
            powers[0] = back[0] = 1
        np.cumprod(powers, out=powers)
        np.cumprod(back, out=back)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[self.tokens] * powers, dtype=np.uint64)))
        out = []
        for size in sizes:
            starts = max(0, count + 1 - size)
            value = (sums[size:] - sums[:starts]) * back[:starts] + np.uint64(size)
            value = (value ^ (value >> np.uint64(32))) * MIX
            value ^= value >> np.uint64(29)
            out.append(value >> np.uint64(64 - bits) << np.uint64(64 - bits))
        return out

    def linked(self, links: np.ndarray) -> Stretch:
        """The tokens that are joined to a neighbour; a break stands where a link is missing.

        ``links[i]`` joins token i to the next one.
        """
        after = np.append(links, False)[: len(self.tokens)]
        before = np.append(False, after[:-1])[: len(self.tokens)]
        at = np.flatnonzero(after | before)
        used, numbers = np.unique(self.tokens[at], return_inverse=True)
        both = np.empty((len(at), 2), np.int32)
        both[:, 0], both[:, 1] = numbers + 1, np.where(after[at], -1, BREAK)
        flat = both.ravel()
        return Stretch(self.lang, [b"\n", *[self.words[i] for i in used.tolist()]], flat[flat >= 0])

    def texts(self, starts: np.ndarray, size: int) -> list[str]:
        """The phrases of ``size`` words that begin at ``starts``."""
        windows = np.stack([self.tokens[starts + k] for k in range(size)], axis=1).tolist()
        return [b" ".join([self.words[i] for i in window]).decode() for window in windows]

    def counted(self, at: np.ndarray, size: int) -> tuple[list[str], list[int]]:
        """Distinct phrases at the places ``at``, told apart by their words, and how often each is there."""
        windows = np.stack([self.tokens[at + k] for k in range(size)], axis=1)
        _, first, times = np.unique(windows, axis=0, return_index=True, return_counts=True)
        return self.texts(at[first], size), times.tolist()

    def agree(self, at: np.ndarray, size: int, starts: np.ndarray) -> bool:
        """Whether the words at each place are those at the place of ``starts`` beside it."""
        return not any((self.tokens[at + k] != self.tokens[starts + k]).any() for k in range(size))


def slices(text: str) -> Iterator[bytes]:
    """The plain form of a text with a break after it, in parts of bounded size.

    A part ends after a separator if one is near, else before a space, so that no word is cut.
    """
    plain, at = text.encode().translate(PLAIN) + b"\n", 0
    while at < len(plain):
        stop = plain.find(b"\n", at + SLICE_BYTES, at + 2 * SLICE_BYTES) + 1
        if not stop:
            stop = plain.find(b" ", at + SLICE_BYTES)
        if stop <= 0:
            stop = len(plain)
        yield plain[at:stop]
        at = stop


def tokens_of(plain: bytes, numbers: Vocabulary) -> np.ndarray:
    """Numbers of the words and breaks of a plain text."""
    parts = [w for w in plain.replace(b"\n", b" \n ").split(b" ") if w]
    return np.fromiter(map(numbers.__getitem__, parts), np.int32, len(parts))


def _batch(row: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, ARROW.types)], names=ARROW.names)


def _runs(good: np.ndarray, size: int) -> np.ndarray:
    """Places where ``size`` values in a row are true."""
    out = good[: max(0, len(good) + 1 - size)].copy()
    for k in range(1, size):
        out &= good[k : k + len(out)]
    return out


def _edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted keys; a part owns a range of the 64-bit numbers."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


class Keys:
    """Distinct fingerprints of a stretch's n-grams of some sizes, sorted, with their counts.

    ``checked`` ones carry a second fingerprint, of the first place where each occurs.
    """

    def __init__(self, stretch: Stretch, sizes: list[int], bits: int, checked: bool):
        self.stretch, self.sizes, self.bits, self.checked = stretch, sizes, bits, checked
        words = stretch.tokens != BREAK
        self.places = [np.flatnonzero(_runs(words, size)) for size in sizes]
        prints = [p[at] for p, at in zip(stretch.fingerprints(sizes, bits), self.places)]
        self.keys, self.first, owner, self.times = np.unique(
            np.concatenate(prints), return_index=True, return_inverse=True, return_counts=True
        )
        self.owners = np.split(owner.ravel(), np.cumsum([len(p) for p in prints])[:-1])

    def messages(self, chunk: int, parts: int) -> Iterator[pa.RecordBatch]:
        """For each part its keys as steps, their counts and checks."""
        checks = np.zeros(len(self.keys), np.uint64)
        if self.checked:
            second = self.stretch.fingerprints(self.sizes, second=True)
            checks = np.concatenate([p[at] for p, at in zip(second, self.places)])[self.first]
        edges, shift = _edges(self.keys, parts).tolist(), np.uint64(64 - self.bits)
        for part, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                steps = np.diff(self.keys[a:b] >> shift, prepend=np.uint64(0))
                arrays = [steps, self.times[a:b].astype("<u4"), *([checks[a:b]] if self.checked else [])]
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "part": [part], "content": [_shrunk(*arrays)]}, KEYS)

    def answered(self, parts: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are frequent, and which this stretch is to name, from the parts' answers."""
        edges = _edges(self.keys, parts).tolist()
        found = [
            np.unpackbits(np.frombuffer(answers[part], np.uint8)).reshape(2, -1)[:, : b - a].astype(bool)
            for part, (a, b) in enumerate(zip(edges, edges[1:]))
            if a < b
        ]
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), bool)
        return both[0], both[1]


def _answers(made: DataFrame, sizes: list[int], parts: int, min_count: int, bits: int, checked: bool) -> DataFrame:
    """``chunk, part, content, keys, totals, clashes``: for each stretch and part the frequent and
    the owned keys as bits, in the order in which they were sent.

    Stretches of ``made`` send their keys to the parts; only the answers are written. The
    first stretch with a frequent key owns it: it will name the phrase. The row of the first
    stretch of a part has all its frequent keys, their totals, and the number of those whose
    checks differ between stretches.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                yield from Keys(Stretch.of(row), sizes, bits, checked).messages(row["chunk"], parts)

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        types = ("<u8", "<u4", "<u8") if checked else ("<u8", "<u4")
        found = [_grown(content, *types) for content in table["content"].to_pylist()]
        sent = [len(steps) for steps, *_ in found]
        keys = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, *_ in found])
        order = np.argsort(keys, kind="stable")  # so the first of equal keys is of the first stretch
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        lengths = np.diff(np.append(first, len(keys)))
        totals = np.add.reduceat(np.concatenate([f[1] for f in found])[order].astype(np.int64), first)
        enough = totals >= min_count
        clashes = 0
        if checked:
            checks = np.concatenate([f[2] for f in found])[order]
            clashes = int((enough & np.logical_or.reduceat(checks != np.repeat(checks[first], lengths), first)).sum())
        flags = np.zeros((2, len(keys)), bool)
        flags[0, order] = np.repeat(enough, lengths)
        flags[1, order[first[enough]]] = True
        ends, bits_of = np.cumsum(sent).tolist(), []
        for a, b in zip([0, *ends], ends):
            room = np.zeros((2, -(-(b - a) // 8) * 8), bool)
            room[:, : b - a] = flags[:, a:b]
            bits_of.append(np.packbits(room).tobytes())
        rest = [None] * (len(sent) - 1)
        named = [(keys[first[enough]] << np.uint64(64 - bits)).view(np.int64), totals[enough]] if checked else [None, None]
        return pa.table(
            {
                "chunk": table["chunk"],
                "part": table["part"],
                "content": pa.array(bits_of, pa.binary()),
                "keys": pa.array([named[0], *rest], pa.list_(pa.int64())),
                "totals": pa.array([named[1], *rest], pa.list_(pa.int64())),
                "clashes": pa.array([clashes, *rest], pa.int64()),
            }
        )

    rows = made.filter(F.col("kind") == CONTENT).select("chunk", "lang", "words", "tokens")
    sent = rows.mapInArrow(send, "chunk long, part int, content binary").repartition(parts, "part")
    schema = "chunk long, part int, content binary, keys array<long>, totals array<long>, clashes long"
    return materialized(sent.groupBy("part").applyInArrow(answer, schema), "answers")


def _stretches(docs: DataFrame, lang_column: str, text_column: str) -> DataFrame:
    """Rows of stretches of one language each, written once to the shared folder."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_, total = (TaskContext.get().partitionId() << 32) - 1, {}, 0

        def finish(lang: str) -> pa.RecordBatch:
            nonlocal number, total
            numbers, pieces, size = open_.pop(lang)
            total -= size
            number += 1
            return _batch(Stretch(lang, list(numbers), np.concatenate(pieces)).row(number))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for plain in slices(text.as_py()):
                    own = open_.setdefault(lang, [Vocabulary(), [], 0])
                    own[1].append(tokens_of(plain, own[0]))
                    own[2] += len(own[1][-1])
                    total += len(own[1][-1])
                    if own[2] > CHUNK_TOKENS and plain.endswith(b"\n"):
                        yield finish(lang)
                while total > OPEN_TOKENS:
                    yield finish(max(open_, key=lambda name: open_[name][2]))
        for lang in list(open_):
            yield finish(lang)

    plain = docs.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), filled(text_column).alias("text"))
    return materialized(plain.mapInArrow(gather, ROWS), "stretches")


def _next_round(made: DataFrame, answers: DataFrame, parts: int, work: Callable, name: str) -> DataFrame:
    """``work(chunk, stretch, answers by part)`` gives the rows of the next round."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found = dict(zip(answers["part"].to_pylist(), answers["content"].to_pylist()))
        rows = [row for text in texts.to_pylist() for row in work(text["chunk"], Stretch.of(text), found)]
        return pa.Table.from_batches(map(_batch, rows), ARROW)

    texts = made.filter(F.col("kind") == CONTENT).select("chunk", "lang", "words", "tokens")
    left = texts.repartition(parts, "chunk").groupBy("chunk")
    right = answers.select("chunk", "part", "content").repartition(parts, "chunk").groupBy("chunk")
    return materialized(left.cogroup(right).applyInArrow(run, ROWS), name)


class Rounds:
    """What a stretch does with the answers of each round."""

    def __init__(self, parts: int, longest: int, bits: int, pair_bits: int, by_text: bool):
        self.parts, self.bits, self.pair_bits, self.by_text = parts, bits, pair_bits, by_text
        self.long = list(range(2, longest + 1))

    def _named(self, chunk: int, keys: Keys, answers: dict[int, bytes]) -> tuple[np.ndarray, list]:
        """Frequent places, of the last size, and the rows that name the phrases this stretch owns."""
        frequent, owned = keys.answered(self.parts, answers)
        stretch, at, rows = keys.stretch, np.zeros(0, np.int64), []
        for size, places, owner in zip(keys.sizes, keys.places, keys.owners):
            good = frequent[owner]
            at = places[good]
            if not len(at):
                continue
            if self.by_text:
                rows.append([TEXTS, chunk, stretch.lang, size, None, None, *stretch.counted(at, size)])
                continue
            numbers, first, inverse = np.unique(owner[good], return_index=True, return_inverse=True)
            starts = at[first]
            if not stretch.agree(at, size, starts[inverse.ravel()]):
                rows.append([CLASH, chunk, None, size, None, None, None, None])
            mine = owned[numbers]
            if mine.any():
                names = keys.keys[numbers[mine]].view(np.int64).tolist()
                rows.append([PHRASES, chunk, stretch.lang, size, None, None, stretch.texts(starts[mine], size), names])
        return at, rows

    def after_words(self, chunk: int, stretch: Stretch, answers: dict[int, bytes]) -> Iterator[list]:
        at, rows = self._named(chunk, Keys(stretch, [1], self.bits, True), answers)
        yield from rows
        yield from self._rest(chunk, stretch, at, 2)

    def after_pairs(self, chunk: int, stretch: Stretch, answers: dict[int, bytes]) -> Iterator[list]:
        keys = Keys(stretch, [2], self.pair_bits, False)
        frequent, _ = keys.answered(self.parts, answers)
        yield from self._rest(chunk, stretch, keys.places[0][frequent[keys.owners[0]]], 1)

    def _rest(self, chunk: int, stretch: Stretch, at: np.ndarray, size: int) -> Iterator[list]:
        """The tokens between which frequent places lie, ``size`` of them in a row, if any."""
        good = np.zeros(len(stretch.tokens), bool)
        good[at] = True
        rest = stretch.linked(_runs(good, size))
        if self.long and len(rest.tokens):
            yield rest.row(chunk)

    def after_long(self, chunk: int, stretch: Stretch, answers: dict[int, bytes]) -> Iterator[list]:
        yield from self._named(chunk, Keys(stretch, self.long, self.bits, True), answers)[1]


def phrase_counts(
    docs: DataFrame,
    min_count: int = 100,
    longest: int = 5,
    lang_column: str = "lang",
    text_column: str = "text",
    bits: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, a`` of every phrase of up to ``longest`` words that occurs ``min_count``
    times in its language, words joined by spaces, and ``lang, n`` of all words.

    Stretches of tokens send each distinct n-gram fingerprint once, with its count, to the
    part that owns it; the part answers whether all stretches together have enough, and
    which stretch is to name the phrase. Words go first, then pairs of frequent words under
    short fingerprints, which only thin the text, then all n-grams whose pairs were left. A
    fingerprint never counts less than a phrase that has it, so nothing frequent is lost.

    Frequent fingerprints are verified: all places within a stretch by their words, places of
    different stretches by second fingerprints of their words. Should any collide, stretches
    hand over all their frequent phrases as texts, which are summed as such.
    """
    first = _stretches(docs, lang_column, text_column)
    totals = first.filter(F.col("kind") == CONTENT).groupBy("lang").agg(F.sum("size").alias("n"))
    tokens = first.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-tokens // PART_TOKENS))
    pair_bits = min(bits, tokens.bit_length() + SPARE_BITS)
    long = list(range(2, longest + 1))
    asked = [([1], bits, True), ([2], pair_bits, False), (long, bits, True)][: 3 if long else 1]
    answers: list[DataFrame] = []

    def run(by_text: bool) -> list[DataFrame]:
        work = Rounds(parts, longest, bits, pair_bits, by_text)
        steps, made = [("words", work.after_words), ("pairs", work.after_pairs), ("phrases", work.after_long)], [first]
        for k, (sizes, width, checked) in enumerate(asked):
            if k == len(answers):
                answers.append(_answers(made[-1], sizes, parts, min_count, width, checked))
            made.append(_next_round(made[-1], answers[k], parts, steps[k][1], steps[k][0]))
        return made[1:]

    def listed(made: list[DataFrame], kind: int) -> DataFrame:
        return reduce(DataFrame.unionByName, [m.filter(F.col("kind") == kind).select("lang", "size", "phrases", "numbers") for m in made])

    made = run(by_text=False)
    clashes = reduce(DataFrame.unionByName, [a.select("clashes") for a in answers]).agg(F.sum("clashes")).first()[0]
    if not clashes and listed(made, CLASH).isEmpty():
        named = listed(made, PHRASES).select("lang", (F.col("size") > 1).alias("long"), F.explode(F.arrays_zip("phrases", "numbers")).alias("p"))
        named = named.select("lang", "long", F.col("p.phrases").alias("phrase"), F.col("p.numbers").alias("key"))
        sums = [a.select(F.lit(k > 0).alias("long"), F.explode(F.arrays_zip("keys", "totals")).alias("p")) for k, a in enumerate(answers)]
        sums = reduce(DataFrame.unionByName, sums).select("long", F.col("p.keys").alias("key"), F.col("p.totals").alias("a"))
        return materialized(named.join(sums, ["long", "key"]).select("lang", "phrase", "a"), "frequent"), totals
    texts = listed(run(by_text=True), TEXTS).select("lang", F.explode(F.arrays_zip("phrases", "numbers")).alias("p"))
    summed = texts.groupBy("lang", F.col("p.phrases").alias("phrase")).agg(F.sum("p.numbers").alias("a"))
    return materialized(summed.filter(F.col("a") >= min_count), "frequent"), totals


def score() -> Column:
    """``1000 * a * n div (l * r)`` of the columns named so, exact where products pass 64 bits."""
    a, n, l, r = (f"CAST({name} AS DECIMAL(19,0))" for name in ("a", "n", "l", "r"))
    return F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {a} * {n}) div ({l} * {r})")


def collocations(
    docs: DataFrame,
    min_count: int = 100,
    longest: int = 5,
    top: int | None = 2000,
    covered_percent: int = 100,
    lang_column: str = "lang",
    text_column: str = "text",
    bits: int = 64,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of phrases of two to ``longest`` words.

    Texts are lower-cased in A-Z and split at ``. , ; : ! ?`` and line ends into pieces, these
    at spaces and tabs into words; phrases never leave a piece. Per language, ``a`` is how often
    the phrase occurs, overlaps included, and at least ``min_count``; the cut into first and
    rest with the smallest ``1000 * a * n div (l * r)`` counts, of equal ones the earliest.
    Phrases inside a longer one with ``covered_percent`` of their count are dropped. The first
    ``top`` of each language come by score and count descending, then by phrase in byte order;
    null gives all.

    Null texts count as empty, null languages as ``und``; a language without frequent phrases
    gives no rows, nor does an empty table. Repeated rows count as often as they occur; ids are
    not read. A text may be of any length: it is read in slices, and a
    stretch may end at any break of it. Sums and products are decimals of 38 digits, so they are exact.
    """
    frequent, totals = phrase_counts(docs, min_count, longest, lang_column, text_column, bits)
    words = F.split("phrase", " ")
    listed = frequent.withColumn("w", words).withColumn("size", F.size("w"))
    cuts = (
        listed.filter("size > 1")
        .select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .select(
            "lang",
            "phrase",
            "a",
            "k",
            F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
            F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"),
        )
    )
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = frequent.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    scored = scored.withColumn("score", score())
    chosen = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
    chosen = chosen.select("lang", "phrase", "c.*").drop("k")
    inside = (
        listed.filter("size > 2")
        .withColumn("s", F.explode(F.expr("sequence(2, size - 1)")))
        .withColumn("i", F.explode(F.expr("sequence(1, size - s + 1)")))
        .select("lang", F.array_join(F.slice("w", F.col("i"), F.col("s")), " ").alias("phrase"), "a")
    )
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = chosen.join(covered, ["lang", "phrase"], "left")
    left = left.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < covered_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= top).drop("_place")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
