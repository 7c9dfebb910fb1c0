"""Hierarchical Pitman-Yor language model over a corpus, and scores of whole texts.

A context is the word before. Every context has a restaurant whose parent is one restaurant
of words, shared by all, whose base is uniform. Pairs of context and word live in parts of
the pair space, words in parts of the word space; parts are groups of rows of one DataFrame
``kind, chunk, part, content`` whose packed arrays are handled at once. A sweep is: parts of
words draw the seats of their words and answer the probabilities that parts of pairs asked
for; parts of pairs draw the seats of their pairs and ask anew with their new tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.chunks import Chunk, chunked, number_of_parts
from blockloom.llm.seating import draw_tables
from blockloom.session import materialized

CHUNK_BYTES = 8 << 20
PART_BYTES = 16 << 20
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
SHORT = np.uint64(24)  # bits dropped from a word's hash where it is part of a pair
MIX = np.uint64(0x9E3779B97F4A7C15)
MESSAGES = "kind string, chunk long, part int, content binary"
SCHEMA = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("part", pa.int32()), ("content", pa.binary())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
Message = tuple[str, int, int, bytes]


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as byte planes, compressed; sorted ones should be given as steps."""
    out = []
    for array in arrays:
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.dtype.itemsize).T
        out += [np.array([len(array)], "<u8").tobytes(), array.dtype.str.encode().ljust(4), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(content: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(content), 0, []
    while at < len(data):
        count, kind = int(np.frombuffer(data, "<u8", 1, at)[0]), np.dtype(data[at + 8 : at + 12].decode().strip())
        planes = np.frombuffer(data, np.uint8, count * kind.itemsize, at + 12).reshape(kind.itemsize, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(count))
        at += 12 + count * kind.itemsize
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def smallest(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them all."""
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


class Tokens:
    """Words of a chunk's texts, with an end after each text, and their distinct pairs."""

    def __init__(self, chunk: Chunk, parts: int):
        pieces, sizes = [], []
        for text in chunk.texts:
            words = text.lower().split()
            hashes = np.empty(len(words) + 1, np.uint64)
            hashes[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            hashes[-1] = END
            pieces.append(hashes)
            sizes.append(len(hashes))
        self.sizes = np.array(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        stream = np.concatenate(pieces)
        self.words, word = np.unique(np.append(stream, BEGIN), return_inverse=True)
        begin, word = word[-1], word[:-1]
        context = np.append(begin, word[:-1])
        context[self.starts] = begin
        self.held = np.array([is_held_out(i) for i in chunk.ids])
        learn = np.repeat(~self.held, self.sizes)
        self.counts = np.bincount(word[learn], minlength=len(self.words))
        self.counts[begin] = (~self.held).sum()  # as a context; it is no token
        self.word, n = word, len(self.words)
        pairs, pair = np.unique(context.astype(np.int64) * n + word, return_inverse=True)
        counts = np.bincount(pair[learn], minlength=len(pairs))
        one, two = (self.words >> SHORT)[pairs // n], (self.words >> SHORT)[pairs % n]
        part = pair_part(one, two, parts)
        order = np.lexsort((two, one, part))
        self.context_of, self.word_of, self.pair_counts = (pairs // n)[order], (pairs % n)[order], counts[order]
        self.pair_part = part[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[pair]
        self.word_part = ((self.words >> SHORT) % np.uint64(parts)).astype(np.int64)

    def keys(self, number: int, parts: int) -> Iterator[Message]:
        short = self.words >> SHORT
        for p in np.unique(self.pair_part).tolist():
            mine = slice(*np.searchsorted(self.pair_part, (p, p + 1)))
            one, two = short[self.context_of[mine]], short[self.word_of[mine]]
            yield "pairs", number, p, pack(steps(one), two, smallest(self.pair_counts[mine]))
        for p in np.unique(self.word_part).tolist():
            mine = self.word_part == p
            yield "words", number, parts + p, pack(self.words[mine], smallest(self.counts[mine]))


def pair_part(one: np.ndarray, two: np.ndarray, parts: int) -> np.ndarray:
    mixed = (one * MIX) ^ two
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, values, len(distinct)).astype(np.int64)


def _to_word_parts(kind: str, sender: int, words: np.ndarray, sums: np.ndarray, parts: int) -> Iterator[Message]:
    part = (words % np.uint64(parts)).astype(np.int64)
    for p in np.unique(part).tolist():
        mine = part == p
        yield kind, sender, parts + p, pack(steps(words[mine]), smallest(sums[mine]))


def _ask(sender: int, one: np.ndarray, two: np.ndarray, tables: np.ndarray, parts: int) -> Iterator[Message]:
    """Tables of the pairs that are seated here, by word and by context; total as a number."""
    yield from _to_word_parts("ask_word", sender, *_sums(two, tables), parts)
    yield from _to_word_parts("ask_context", sender, *_sums(one, tables), parts)
    yield "n_tables", int(tables.sum()), sender, b""


def merge_pairs(part: int, rows: list[Message], parts: int) -> Iterator[Message]:
    """Counts of a part's pairs over all chunks.

    A chunk learns of each of its pairs whether training has it never, once or more often,
    and for the last its place in the part's list; only those have seats to draw.
    """
    chunks, found = [], []
    for kind, chunk, _, content in rows:
        one, two, counts = unpack(content)
        chunks.append(chunk)
        found.append((np.cumsum(one), two, counts.astype(np.int64)))
    sizes = [len(f[0]) for f in found]
    one, two, counts = (np.concatenate(x) for x in zip(*found))
    del found
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    total = np.bincount(place, counts).astype(np.int64)
    one, two = one[new], two[new]
    del order, counts, new
    many, single = total > 1, total == 1
    seat = np.cumsum(many) - 1
    code = np.minimum(total, 2).astype(np.uint8)
    for chunk, mine in zip(chunks, np.split(place, np.cumsum(sizes)[:-1])):
        yield "codes", chunk, part, pack(code[mine])
        yield "seats", chunk, part, pack(smallest(seat[mine][many[mine]]))
    yield "pair_keys", 0, part, pack(steps(one[many]), two[many])
    yield "pair_counts", 0, part, pack(smallest(total[many]))
    yield from _to_word_parts("single_word", part, *_sums(two[single], np.ones(single.sum())), parts)
    yield from _to_word_parts("single_context", part, *_sums(one[single], np.ones(single.sum())), parts)
    yield from _ask(part, one[many], two[many], np.ones(many.sum(), np.int64), parts)
    yield "n_single", int(single.sum()), part, b""
    yield "n_double", int((total == 2).sum()), part, b""


def merge_words(part: int, rows: list[Message], parts: int) -> Iterator[Message]:
    """Counts of a part's words over all chunks, and the answer to each chunk."""
    found = [unpack(content) for _, _, _, content in rows]
    words, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    total = np.bincount(place, np.concatenate([f[1] for f in found])).astype(np.int64)
    short, short_place = np.unique(words >> SHORT, return_inverse=True)
    cuts = np.cumsum([len(f[0]) for f in found])[:-1]
    for (_, chunk, _, _), mine in zip(rows, np.split(place, cuts)):
        yield "counts", chunk, part, pack(smallest(total[mine]))
        yield "word_places", chunk, part, pack(smallest(short_place[mine]))
    yield "words_here", 0, part, pack(steps(short))
    token = words != BEGIN
    yield "n_train", int(total[token].sum()), part, b""
    yield "n_words", int((total[token] > 0).sum()), part, b""


def settle_words(part: int, rows: list[Message]) -> Iterator[Message]:
    """Tables that never change, those of pairs seen once, by word and by context."""
    words = np.cumsum(unpack(next(content for kind, _, _, content in rows if kind == "words_here"))[0])
    sums = {kind: np.zeros(len(words), np.int64) for kind in ("single_word", "single_context")}
    for kind, _, _, content in rows:
        if kind in sums:
            keys, counts = unpack(content)
            sums[kind][np.searchsorted(words, np.cumsum(keys))] += counts.astype(np.int64)
    yield "word_state", 0, part, pack(steps(words), *map(smallest, sums.values()))


def seat_words(part: int, rows: list[Message], fixed: dict, sweep: int) -> Iterator[Message]:
    """Draw the seats of a part's words in the shared restaurant and answer those who asked."""
    state = next(content for kind, _, _, content in rows if kind == "word_state")
    words, as_word, as_context = (values.astype(np.int64) for values in unpack(state))
    words = np.cumsum(words.astype(np.uint64))
    asked = []
    for kind, sender, _, content in sorted(r for r in rows if r[0] != "word_state"):
        keys, sums = unpack(content)
        place = np.searchsorted(words, np.cumsum(keys))
        (as_word if kind.endswith("word") else as_context)[place] += sums.astype(np.int64)
        if kind.startswith("ask"):
            asked.append((kind, sender, place))
    rng = np.random.default_rng([fixed["seed"], sweep, part])
    seen, base = as_word > 0, 1 / (fixed["n_words"] + 1)
    tables = np.zeros(len(words), np.int64)
    rest = np.full(seen.sum(), max(0, fixed["root_tables"] - 1), np.float64)
    tables[seen] = draw_tables(as_word[seen], np.full(len(rest), base), rest, fixed["root_discount"], fixed["strength"], rng)
    fresh = (fixed["strength"] + fixed["root_discount"] * fixed["root_tables"]) * base
    chance = (as_word - fixed["root_discount"] * tables + fresh) / (fixed["strength"] + fixed["n_tables"])
    for kind, sender, place in asked:
        values = chance[place] if kind == "ask_word" else as_context[place].astype(np.float64)
        yield kind.replace("ask", "told"), part, sender, pack(values.astype(np.float32))
    yield "word_values", sweep, part, pack(chance.astype(np.float32), smallest(as_context))
    yield "n_root", int(tables.sum()), part, b""


def seat_pairs(part: int, rows: list[Message], fixed: dict, sweep: int, parts: int) -> Iterator[Message]:
    """Draw the seats of a part's pairs, given the answers of the parts of words.

    Keys and counts stay as they are in every sweep; before the first, every pair has one table.
    """
    held = {kind: unpack(content) for kind, _, _, content in rows if kind.startswith("pair_")}
    one, two = np.cumsum(held["pair_keys"][0]), held["pair_keys"][1]
    counts = held["pair_counts"][0].astype(np.int64)
    tables = held["pair_tables"][0] if "pair_tables" in held else np.ones(len(one), np.int64)

    def told(kind: str, keys: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(keys, return_inverse=True)
        of_part, values = (distinct % np.uint64(parts)).astype(np.int64), np.zeros(len(distinct), np.float64)
        for name, sender, _, content in rows:
            if name == kind:
                values[of_part == sender - parts] = unpack(content)[0]
        return values[place]

    rng = np.random.default_rng([fixed["seed"], sweep, part])
    if len(one):
        rest = np.maximum(told("told_context", one) - tables, 0)
        tables = draw_tables(counts, told("told_word", two), rest, fixed["discount"], fixed["strength"], rng)
    tables = tables.astype(np.int64)
    yield "pair_tables", sweep, part, pack(smallest(tables))
    yield from _ask(part, one, two, tables, parts)


def _by_part(messages: DataFrame, work, parts: int) -> DataFrame:
    """``work(part, messages)`` for every part; partitions are as many as there are parts."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[name].to_pylist() for name in SCHEMA.names)))
        return _table(work(rows[0][2], rows))

    return messages.repartition(2 * parts, "part").groupBy("part").applyInArrow(run, MESSAGES)


def _table(rows) -> pa.Table:
    columns = zip(*rows)
    made = [pa.array(list(v), t) for v, t in zip(columns, SCHEMA.types)]
    return pa.table(made or [pa.array([], t) for t in SCHEMA.types], schema=SCHEMA)


def _numbers(messages: DataFrame) -> dict[str, int]:
    """Sums of the numbers that parts report, as one row per kind."""
    found = messages.filter(F.col("kind").startswith("n_")).groupBy("kind").agg(F.sum("chunk").alias("n"))
    return {row.kind: row.n for row in found.collect()}


def score_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    burn_in: int = 1,
    samples: int = 2,
    strength: float = 1.0,
    seed: int = 7,
) -> DataFrame:
    """Scores of every text under a model of those that are not held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.
    Letters A-Z count in lower case; words end at ASCII white space, and every text has one
    end token. ``score`` is the base-10 logarithm of the text's probability, token by token
    the mean over ``samples`` sweeps after ``burn_in``; ``base_score`` is add-one smoothing
    of single tokens. Held out is a text whose crc32 of its id as text, modulo 7, is 2.

    Discounts come from the numbers of pairs and words seen once and twice. Null text is
    empty and has its end alone; repeated rows are texts of their own; null ids are learned
    from. Words are told apart by 64-bit hashes in counts and by 40 bits in pairs. Counts of
    pairs and words are sent once per chunk and kept in as many parts as the input needs.
    """
    parts = number_of_parts(docs, text_column, PART_BYTES)
    texts, _ = chunked(docs, id_column, text_column, lambda chunk: (), CHUNK_BYTES)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(at, 1)])
                number = row["chunk"][0].as_py()
                for message in Tokens(Chunk.of(row), parts).keys(number, parts):
                    yield from _table([message]).to_batches()

    def merge(part: int, rows: list[Message]) -> Iterator[Message]:
        return merge_pairs(part, rows, parts) if part < parts else merge_words(part, rows, parts)

    first = materialized(_by_part(texts.mapInArrow(keys, MESSAGES), merge, parts), "model")
    numbers = {"n_single": 0, "n_double": 0, "n_tables": 0, "n_train": 0, "n_words": 0, **_numbers(first)}
    fixed = {
        "seed": seed,
        "strength": strength,
        "discount": _discount(numbers["n_single"], numbers["n_double"]),
        "root_discount": 0.5,
        "n_words": numbers["n_words"],
        "root_tables": numbers["n_words"],
        "n_tables": numbers["n_tables"] + numbers["n_single"],
    }
    kinds = F.col("kind")
    lasting = first.filter(kinds.isin("words_here", "single_word", "single_context"))
    lasting = materialized(_by_part(lasting, settle_words, parts), "words")
    pairs, asks, kept = first.filter(kinds.startswith("pair_")), first.filter(kinds.startswith("ask_")), []
    state = pairs
    for sweep in range(burn_in + samples):
        now = dict(fixed)
        told = state.unionByName(_told(lasting, asks, now, sweep, parts))
        seats = _by_part(told, lambda p, r: seat_pairs(p, r, now, sweep, parts), parts)
        seats = materialized(seats, "pair_seats")
        tables, asks = seats.filter(kinds == "pair_tables"), seats.filter(kinds.startswith("ask_"))
        state = pairs.unionByName(tables)
        fixed["n_tables"] = _numbers(seats).get("n_tables", 0) + numbers["n_single"]
        if sweep >= burn_in:
            then = dict(fixed)
            words = _by_part(lasting.unionByName(asks), lambda p, r: seat_words(p, r, then, sweep + 100), parts)
            words = materialized(words.filter(~kinds.startswith("told_")), "word_seats")
            fixed["root_tables"] = _numbers(words).get("n_root", 0)
            kept.append((sweep + 100, then, tables, words))
    return _scored(texts, first, kept, parts, numbers)


def _told(lasting: DataFrame, asks: DataFrame, fixed: dict, sweep: int, parts: int) -> DataFrame:
    told = _by_part(lasting.unionByName(asks), lambda p, r: seat_words(p, r, fixed, sweep), parts)
    return told.filter(F.col("kind").startswith("told_"))


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def _scored(texts: DataFrame, first: DataFrame, kept: list, parts: int, numbers: dict) -> DataFrame:
    """Scores of all texts from the kept sweeps."""
    kinds = F.col("kind")
    sweeps = {sweep: fixed for sweep, fixed, _, _ in kept}
    values = first.filter(kinds.isin("seats", "word_places", "pair_counts"))
    for sweep, _, tables, words in kept:
        values = values.unionByName(tables.withColumn("chunk", F.lit(sweep).cast("long")))
        values = values.unionByName(words.filter(kinds == "word_values"))

    def tell(part: int, rows: list[Message]) -> Iterator[Message]:
        """The kept values of a part in the order of each chunk's keys."""
        found = []
        for kind, _, _, content in rows:  # in order: counts, then tables by sweep; or values by sweep
            if kind in ("pair_counts", "pair_tables", "word_values"):
                found += unpack(content)
        for kind, chunk, _, content in rows:
            if kind in ("seats", "word_places"):
                place = unpack(content)[0].astype(np.int64)
                shrunk = [v[place].astype(np.float32) if v.dtype.kind == "f" else smallest(v[place]) for v in found]
                yield f"{kind}_told", chunk, part, pack(*shrunk)

    told = _by_part(values, tell, parts).unionByName(first.filter(kinds.isin("codes", "counts")))

    def score(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk.of(texts)
        tokens = Tokens(chunk, parts)
        messages = {(kind, part): content for kind, part, content in zip(*(told[n].to_pylist() for n in ("kind", "part", "content")))}
        counts, codes = np.zeros(len(tokens.words), np.int64), np.zeros(len(tokens.pair_counts), np.uint8)
        chance, tables = ([np.zeros(len(tokens.words)) for _ in sweeps] for _ in range(2))
        above = [np.zeros(len(codes)) for _ in sweeps]
        for p in np.unique(tokens.word_part).tolist():
            mine = tokens.word_part == p
            counts[mine] = unpack(messages["counts", parts + p])[0]
            got = unpack(messages["word_places_told", parts + p])
            for s in range(len(sweeps)):
                chance[s][mine], tables[s][mine] = got[2 * s], got[2 * s + 1]
        for p in np.unique(tokens.pair_part).tolist():
            mine = np.flatnonzero(tokens.pair_part == p)
            codes[mine] = unpack(messages["codes", p])[0]
            many = mine[codes[mine] == 2]
            held, *seated = unpack(messages["seats_told", p])
            for s, (fixed, tables_held) in enumerate(zip(sweeps.values(), seated)):
                above[s][many] = held - fixed["discount"] * tables_held
        context_count = counts[tokens.context_of]
        probability = np.zeros(len(codes))
        for s, fixed in enumerate(sweeps.values()):
            above[s][codes == 1] = 1 - fixed["discount"]
            back = fixed["strength"] + fixed["discount"] * tables[s][tokens.context_of]
            chances = (above[s] + back * chance[s][tokens.word_of]) / (fixed["strength"] + context_count)
            probability += chances / len(sweeps)
        known = counts[tokens.word]
        base = np.log10((known + 1) / (numbers["n_train"] + numbers["n_words"] + 1))
        total = [np.add.reduceat(v, tokens.starts) for v in (np.log10(probability)[tokens.pair], base, (known > 0).astype(np.int64))]
        return pa.table(
            {
                "doc_id": pa.array(chunk.ids, pa.int64()),
                "held_out": pa.array(tokens.held),
                "n_tokens": pa.array(tokens.sizes.astype(np.int64)),
                "n_known": pa.array(total[2]),
                "train_tokens": pa.array(np.full(len(chunk.ids), numbers["n_train"], np.int64)),
                "base_score": pa.array(total[1]),
                "score": pa.array(total[0]),
            }
        )

    dealt = told.repartition(parts, "chunk").groupBy("chunk")
    scored = texts.repartition(parts, "chunk").groupBy("chunk").cogroup(dealt).applyInArrow(score, SCORES)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
