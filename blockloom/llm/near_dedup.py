"""Near-duplicate classes: universal-hash minima, banding, verification, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.components import connected_components
from blockloom.session import broadcast_if_bounded, materialized

MIX = np.uint64(0x9E3779B97F4A7C15)
ROWS_AT_ONCE = 256  # whose sets a task holds
BLOCK = 256  # shingles hashed at once, so that a very long text needs no large matrix
PAIRS = "a long, b long"
PAIRED_BUCKET = 16  # larger buckets are compared block by block instead of pair by pair
BLOCK_MEMBERS = 256
HUBS_TRIED = 3  # per document; what they leave open is compared in full


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    ASCII letters count in lower case; words end at ASCII white space, which is what
    ``bytes.lower`` and ``bytes.split`` do. A text with fewer words is one shingle; one
    without words has none.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    mixed = np.full(len(parts) - size + 1, np.uint64(size))
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + len(mixed)]) * MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def universal_hashes(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``count`` multiply-add hashes modulo 2**64."""
    draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, count), np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1] * np.uint64(2)


def minima(values: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest value of every hash function over a non-empty set."""
    factor, offset = hashes[0][:, None], hashes[1][:, None]
    least = np.full(len(hashes[0]), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), BLOCK):
        np.minimum(least, (values[None, at : at + BLOCK] * factor + offset).min(axis=1), out=least)
    return least


def bands_needed(similarity: float, rows: int, miss: float = 1e-5) -> int:
    """Bands with which a pair at the threshold shares none with at most ``miss`` chance."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def signatures(docs: DataFrame, id_column: str, text_column: str, words: int, rows: int, bands: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands, signature``; a row without words has null keys.

    ``set_key`` is a 128-bit hash of the whole set, ``signature`` the lowest byte of every
    minimum: the highest is 0 for most minima of a long text, whatever the text.
    """
    hashes = universal_hashes(rows * bands)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                values = shingle_set(text.as_py(), words)
                if not len(values):
                    out.append((0, None, None, None))
                    continue
                least = minima(values, hashes)
                band = np.full(bands, MIX)
                for column in least.reshape(bands, rows).T:
                    band = (band ^ column) * MIX
                    band ^= band >> np.uint64(31)
                band += np.arange(bands, dtype=np.uint64)
                key = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                out.append((len(values), key, band.view(np.int64), least.astype(np.uint8).tobytes()))
            columns = zip(*out) if out else [()] * 4
            made = [pa.array(list(v), t) for v, t in zip(columns, (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_shingles", "set_key", "bands", "signature"])

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 5,
    percent: int = 80,
    rows: int = 8,
) -> DataFrame:
    """Class of every row: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when ``100 * intersection >= percent * union`` holds for their
    sets of word shingles; a class is a connected component of the links and takes its
    smallest id. Rows without words are alone. Rows that share an id count as one document;
    a row without an id is left alone: its class is null and it is kept.

    Candidates come from banding, so a pair at the threshold is missed with a chance of
    1e-5, and must agree on its signatures, which fails with some 1e-8. Equal sets collapse first. Every document is compared with the smallest ids of its
    buckets; then members of a bucket that are not in its largest class are compared with all
    its members of other classes: pair by pair in small buckets, block by block in large
    ones, where only links leave a task. Every pair of a bucket is thus either compared or
    already in one class.
    """
    signed = materialized(
        signatures(docs, id_column, text_column, words, rows, bands_needed(percent / 100, rows)), "signatures"
    )
    named = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    firsts = named.join(classes.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"]).dropDuplicates(["set_key"])
    firsts = materialized(firsts.select(F.col("doc_id").alias("rep"), "set_key", "n_shingles", "bands", "signature"), "firsts")
    banded = firsts.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last")
    members = materialized(banded.join(shared.select("key", "hub"), "key"), "members")
    labels = _linked_labels(docs, firsts, members, id_column, text_column, words, percent, rows)
    merged = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id")
    )
    found = signed.join(merged, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _linked_labels(docs, firsts, members, id_column, text_column, words, percent, rows) -> DataFrame:
    """``node, component`` of the representatives that have links."""
    verify = (docs, firsts, id_column, text_column, words, percent)
    pairs = materialized(_to_hubs(members.filter("rep <> hub")), "pairs")
    links = materialized(_verified(pairs, *verify), "links")
    labels = _relabelled(docs.sparkSession.createDataFrame([], "node long, component long"), links)
    current = members.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    current = current.select("key", "rep", F.coalesce("component", "rep").alias("label"))
    groups = current.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_keys = groups.groupBy("key").agg(
        F.count("*").alias("k"), F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("top")
    )
    outside = current.join(open_keys.filter("k > 1").drop("k"), "key").filter("label <> top")
    outside = materialized(outside.select("key", "rep", "label", "size"), "outside")
    if outside.isEmpty():
        return labels
    other = current.select("key", F.col("rep").alias("x"), F.col("label").alias("other"))
    across = outside.filter(F.col("size") <= PAIRED_BUCKET).join(other, "key").filter("label <> other")
    across = _ordered(across.select("x", F.col("rep").alias("y"))).distinct().join(pairs, ["a", "b"], "left_anti")
    found = _verified(materialized(across, "pairs"), *verify)
    large = outside.filter(F.col("size") > PAIRED_BUCKET)
    found = found.unionByName(_block_links(large, current, *verify))
    return _relabelled(labels, materialized(found, "links"))


def _to_hubs(rows: DataFrame) -> DataFrame:
    """Every document with the hubs of most of its buckets; others are left to the full round."""
    met = rows.groupBy("rep", "hub").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("n"), "hub"))
    chosen = met.withColumn("nth", nth).filter(F.col("nth") <= HUBS_TRIED)
    return _ordered(chosen.select(F.col("hub").alias("x"), F.col("rep").alias("y")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after ``links(a, b)``: components of the old classes, then of their members."""
    if links.isEmpty():
        return labels
    ends = links
    for end in ("a", "b"):
        renamed = labels.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        ends = ends.join(renamed, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    merged = connected_components(ends.select(F.col("a").alias("u"), F.col("b").alias("v")))
    moved = labels.join(merged.toDF("component", "_to"), "component", "left").select(
        "node", F.coalesce("_to", "component").alias("component")
    )
    new = merged.join(labels.select("node"), "node", "left_anti")
    return materialized(moved.unionByName(new), "labels")


def _full_sets(docs, firsts, involved, id_column, text_column, words) -> DataFrame:
    """``id, value``: the sorted set of every representative in ``involved(id)``, as bytes."""

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                values = [shingle_set(text.as_py(), words).tobytes() for text in part.column("text")]
                sizes = pa.array([len(v) // 8 for v in values], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, pa.array(values, pa.binary())], ["id", "n", "value"])

    involved = broadcast_if_bounded(materialized(involved.distinct(), "involved"))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sets = texts.join(involved, "id", "left_semi").mapInArrow(as_sets, "id long, n long, value binary")
    # Rows may repeat an id; the representative's own set is the one of its signature row.
    sets = sets.join(firsts.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n")), ["id", "n"])
    return materialized(sets.dropDuplicates(["id"]).select("id", "value"), "sets")


def _least_agreement(percent: int, minima_count: int) -> float:
    """Share of equal signature bytes, six deviations under that of a pair at the threshold.

    Such a pair is under it with a chance of some 1e-8.
    """
    share = percent / 100 + (1 - percent / 100) / 256
    return share - 6 * math.sqrt(share * (1 - share) / minima_count)


def _holds(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _block_links(outside, current, docs, firsts, id_column, text_column, words, percent) -> DataFrame:
    """Links between ``outside`` and members of other classes in the same large bucket.

    Both sides are cut into blocks of about ``BLOCK_MEMBERS`` and every block of one meets
    every block of the other as one group of bounded size. Inside it signatures are compared
    at once, full sets only where these allow a link and the classes have none yet, and only
    links leave it. A pair is looked at in its first common bucket alone, the first by the keys
    of its bands.
    """
    if outside.isEmpty():
        return docs.sparkSession.createDataFrame([], PAIRS)
    sizes = outside.groupBy("key").agg(
        F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("left"), F.ceil(F.max("size") / BLOCK_MEMBERS).cast("int").alias("right")
    )
    members = current.join(sizes, "key")
    sets = _full_sets(docs, firsts, members.select(F.col("rep").alias("id")), id_column, text_column, words)
    data = sets.withColumnRenamed("id", "rep").join(firsts.select("rep", "bands", "signature"), "rep")

    def side(part: DataFrame, number: int, own: str, other: str) -> DataFrame:
        blocks = part.withColumn(own + "_", F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"))
        blocks = blocks.withColumn(other + "_", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return blocks.select("key", "left_", "right_", "rep", "label", F.lit(number).alias("side"))

    both = side(outside.join(sizes, "key"), 0, "left", "right").unionByName(side(members, 1, "right", "left"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ones, twos = group[group["side"] == 0], group[group["side"] == 1]
        out = []
        if len(ones) and len(twos):
            key, keys = group["key"].iloc[0], np.stack(twos["bands"].to_list())
            signs = np.frombuffer(b"".join(twos["signature"]), np.uint8).reshape(len(twos), -1)
            ids, labels = twos["rep"].to_numpy(), twos["label"].to_numpy()
            values = [np.frombuffer(v, np.uint64) for v in twos["value"]]
            least = _least_agreement(percent, signs.shape[1])
            for rep, label, bands, sign, value in zip(*(ones[c] for c in ("rep", "label", "bands", "signature", "value"))):
                same = signs == np.frombuffer(sign, np.uint8)
                first = bands[(keys == bands).argmax(axis=1)] == key
                near = np.flatnonzero((same.mean(axis=1) >= least) & first & (labels != label))
                joined = set()
                for k in near.tolist():
                    if labels[k] not in joined and _holds(np.frombuffer(value, np.uint64), values[k], percent):
                        joined.add(labels[k])
                        out.append((min(rep, ids[k]), max(rep, ids[k])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return both.join(data, "rep").groupBy("key", "left_", "right_").applyInPandas(compare, PAIRS).distinct()


def _verified(pairs, docs, firsts, id_column, text_column, words, percent) -> DataFrame:
    """Pairs that hold on their signatures, within six deviations, and on their full sets."""

    def alike(one: np.ndarray, two: np.ndarray) -> bool:
        return (one == two).mean() >= _least_agreement(percent, len(one))

    def kept(first: str, second: str, kind: type, test: Callable[[np.ndarray, np.ndarray], bool]):
        """Keeps the pairs whose two packed arrays pass; they are read where Arrow holds them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sides = zip(batch.column(first), batch.column(second))
                keep = [test(*(np.frombuffer(value.as_buffer(), kind) for value in pair)) for pair in sides]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return run

    likely = kept("sa", "sb", np.uint8, alike)
    exact = kept("va", "vb", np.uint64, lambda x, y: _holds(x, y, percent))

    sized = firsts.select("rep", "n_shingles", "signature")
    first, second = sized.toDF("a", "na", "sa"), sized.toDF("b", "nb", "sb")
    near_size = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    held = pairs.join(second, "b").join(first, "a").filter(near_size).select("a", "b", "sa", "sb")
    held = materialized(held.mapInArrow(likely, PAIRS), "likely")
    if held.isEmpty():
        return held
    sets = _full_sets(docs, firsts, held.select(F.explode(F.array("a", "b")).alias("id")), id_column, text_column, words)
    held = held.join(sets.toDF("b", "vb"), "b").join(sets.toDF("a", "va"), "a").select("a", "b", "va", "vb")
    return held.mapInArrow(exact, PAIRS)
