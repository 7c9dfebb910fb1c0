"""Order MinHash fingerprints with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.tables import SPACE, filled, unused_name

PLACE_BITS = 27  # of a packed long, for the place in the text
HASH_BITS = 36  # later places count as the last one, so order among them alone is lost
PLACES = (1 << PLACE_BITS) - 1
HASHES = (1 << HASH_BITS) - 1
MAX_BUCKETS = 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(value: Column, place: Column) -> Column:
    """The upper hash bits of a 64-bit value above a place; order is that of the hash."""
    high = F.shiftleft(F.shiftrightunsigned(value, 64 - HASH_BITS), PLACE_BITS)
    return high.bitwiseOR(F.least(place.cast("long"), F.lit(PLACES).cast("long")))


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(PLACES))


def kmers(text: Column, k: int) -> Column:
    """Hashes of ``k`` words in a row, in text order; a text with fewer words is one of its own."""

    def joined(words: Column) -> Column:
        count = F.size(words) - (k - 1)
        value = F.slice(words, 1, F.greatest(count, F.lit(0)))
        for step in range(1, k):
            value = F.zip_with(value, F.slice(words, step + 1, F.greatest(count, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        whole = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.when(count > 0, value).otherwise(whole)

    words = F.filter(F.split(text, SPACE), lambda word: word != "")
    return let(F.transform(words, lambda word: F.xxhash64(word)), joined)


def _run_starts(ordered: Column) -> Column:
    """For each entry of a sorted array the index where its run of equal hashes begins.

    Entries that are not first look back 1, 2, 4, ... entries, until all have a start; a
    step is only taken while some entry has none, so texts without repeats take no step.
    """

    def state(starts: Column) -> Column:
        return let(starts, lambda s: F.struct(s.alias("starts"), F.exists(s, lambda v: v < 0).alias("open")))

    def follow(now: Column, step: Column) -> Column:
        starts, back = now["starts"], F.pow(F.lit(2), step).cast("int")
        stepped = F.transform(starts, lambda s, i: F.when(s < 0, F.get(starts, i - back)).otherwise(s))
        return F.when(now["open"], state(stepped)).otherwise(now)

    def first(entry: Column, i: Column) -> Column:
        same = _hash_of(entry) == _hash_of(F.get(ordered, i - 1))
        return F.when((i > 0) & F.coalesce(same, F.lit(False)), F.lit(-1)).otherwise(i)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))
    return F.aggregate(steps, state(F.transform(ordered, first)), follow)["starts"]


def order_minhash(text: Column, k: int = 2, tuple_size: int = 2, coordinates: int = 64) -> Column:
    """Array of ``coordinates`` 16-bit integers; the share of equal ones is a likeness.

    Every k-mer is numbered by its occurrence in the text, and k-mer and number are hashed
    onto a ring of ``coordinates`` parts, a power of two. Coordinate ``j`` goes through the
    parts from the ``j``-th on in strides of its own, an odd number of parts, which is a hash
    order of its own; it takes the ``tuple_size`` first entries, puts them back in text order
    and hashes the tuple. A short text leaves most parts empty; strides then lead the
    coordinates to entries that hardly depend on each other. Both what a text says and in which order it says it must agree,
    so the likeness follows the edit distance rather than the set of words. Texts without
    words share one fingerprint.
    """
    parts_bits = (coordinates - 1).bit_length()

    def part(entry: Column) -> Column:
        return F.shiftright(entry, PLACE_BITS + HASH_BITS - parts_bits)

    def numbered(ordered: Column) -> Column:
        def entry(at: Column, i: Column, starts: Column) -> Column:
            return _packed(F.xxhash64(_hash_of(at), i - F.get(starts, i)), _place_of(at))

        return let(_run_starts(ordered), lambda starts: F.transform(ordered, lambda at, i: entry(at, i, starts)))

    def thinned(ring: Column) -> Column:
        """The first entries of every part; no coordinate asks for more."""
        return F.filter(
            ring, lambda e, i: (i < tuple_size) | F.coalesce(part(F.get(ring, i - tuple_size)) != part(e), F.lit(True))
        )

    low_bits = PLACE_BITS + HASH_BITS - parts_bits
    rest = F.lit((1 << low_bits) - 1)

    def signed(ring: Column) -> Column:
        def turned(entries: Column, j: Column) -> Column:
            """Entries with their part told as steps of the coordinate's stride."""
            stride = (j * 29 + 7).bitwiseAND(F.lit(coordinates // 2 - 1)) * 2 + 1 if coordinates > 1 else F.lit(1)
            steps = lambda e: ((part(e) - j) * stride).cast("long").bitwiseAND(F.lit(coordinates - 1).cast("long"))
            return F.transform(entries, lambda e: F.shiftleft(steps(e), low_bits).bitwiseOR(e.bitwiseAND(rest)))

        def coordinate(ring: Column, parts: Column, j: Column) -> Column:
            found = F.array_position(parts, j.cast("long")).cast("int")
            enough = (found > 0) & (F.get(parts, found + tuple_size - 2) == j)
            first = F.when(F.coalesce(enough, F.lit(False)), F.slice(ring, F.greatest(found, F.lit(1)), F.lit(tuple_size)))
            taken = F.slice(F.array_sort(turned(F.coalesce(first, ring), j)), 1, tuple_size)
            placed = F.array_sort(
                F.transform(taken, lambda e: F.shiftleft(_place_of(e), HASH_BITS).bitwiseOR(_hash_of(e)))
            )
            return F.xxhash64(F.transform(placed, lambda e: e.bitwiseAND(F.lit(HASHES)))).bitwiseAND(F.lit(0xFFFF)).cast("int")

        numbers = F.sequence(F.lit(0), F.lit(coordinates - 1))
        return let(F.transform(ring, part), lambda parts: F.transform(numbers, lambda j: coordinate(ring, parts, j)))

    ordered = F.array_sort(F.transform(kmers(text, k), lambda value, i: _packed(value, i)))
    ring = let(ordered, lambda s: F.array_sort(numbered(s)))
    return let(let(ring, thinned), signed)


def likeness(one: Column, two: Column) -> Column:
    """Share of equal coordinates of two fingerprints."""
    equal = F.aggregate(F.zip_with(one, two, lambda a, b: (a == b).cast("int")), F.lit(0), lambda total, e: total + e)
    return equal / F.size(one)


def as_text(fingerprint: Column) -> Column:
    """Four hex digits for every coordinate."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda c: F.lpad(F.hex(c), 4, "0")), ""))


def with_next(docs: DataFrame, id_column: str, columns: list[str], rows_per_bucket: int = 2000) -> DataFrame:
    """``docs`` with ``next_<column>``: values of the row with the next id, after the last the first.

    Ids are cut at approximate quantiles, which are ids of the table, so the first row of a
    bucket is the row with that id: it also goes to the bucket before, behind all others,
    and the window of a bucket needs no other. The number of cuts grows with the table, up
    to 65,536, which 131 million rows reach; beyond, buckets grow and their sorts spill. The cuts
    are all that the driver sees. Equal ids go by their columns, null
    ids come first.
    """
    key, guard, bucket = (unused_name(docs, name) for name in ("_key", "_guard", "_bucket"))
    rows = docs.withColumn(key, F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))))
    wanted = max(1, min(MAX_BUCKETS, rows.count() // rows_per_bucket))
    shares = [i / wanted for i in range(wanted)]
    low, cuts = rows.agg(F.min(key), F.percentile_approx(key, shares, 10 * MAX_BUCKETS)).first()
    cuts = sorted({low, *(cuts or [])} - {None})
    places = F.lit(cuts or [0]).cast("array<bigint>")
    # The last cut at or under the key, by halving; the first cut is the smallest key.
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(cuts)).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(places, at + step) <= F.col(key), F.lit(False)), at + step).otherwise(at)

    own = F.aggregate(halves, F.lit(0), further)
    before = F.when(F.get(places, own) == F.col(key), F.pmod(own - 1, F.lit(max(1, len(cuts)))))
    copies = F.array_compact(F.array(F.struct(own.alias("b"), F.lit(0).alias("g")), F.when(before.isNotNull(), F.struct(before.alias("b"), F.lit(1).alias("g")))))
    spread = rows.withColumn(bucket, F.explode(copies)).withColumn(guard, F.col(f"{bucket}.g")).withColumn(bucket, F.col(f"{bucket}.b"))
    order = Window.partitionBy(bucket).orderBy(guard, key, *columns)
    following = {f"next_{name}": F.lead(name).over(order) for name in columns}
    return spread.withColumns(following).filter(F.col(guard) == 0).drop(key, guard, bucket)


def edit_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last half, rounded down, replaced by as many first code points
    of the next document's text. Null text counts as empty; a table of one row follows
    itself, an empty one gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), filled(F.col(text_column)).alias("text"))
    rows = with_next(rows.withColumn("print", order_minhash(F.col("text"))), "doc_id", ["text", "print"])
    count = F.length("text")
    half = F.floor(count / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), count - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", count.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    rows = rows.withColumn("edited_print", order_minhash(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
