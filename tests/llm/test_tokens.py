"""Subword encoding, packing and fingerprints, against the libraries and brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from llm_rows import SF_DIR, no_docs, odd_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from blockloom.llm import order_minhash as omh
from blockloom.llm import packing
from blockloom.llm.packing import WordIds, pack, sum_of_squares, word_ids
from blockloom.llm.piece_model import CharacterMap, PieceModel
from blockloom.llm import piece_model, pieces
from blockloom.llm.pieces import decode_pieces, encode_and_decode, encode_pieces
from blockloom.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "e", "th", " ", "  ", "\n", "▁", "é", "😀", "\x00", "́", "ﬁ", "<s>", "<0x41>", "\t", "1", "中", "x" * 60]
PARTS += ["the ", "it's", "don't.", "\x1c", "\x85", "　", "ΑΣ ", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "a.b", "..."]


def random_texts(count, seed, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(count)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_and_spans_equal_the_library(library):
    model = PieceModel(PIECES)
    for text in [*random_texts(1500, 3), "x" * 30000, None, ""]:
        ids, starts, ends = (np.frombuffer(v, "<u4").tolist() for v in model.encode(text))
        source = (text or "").encode()
        assert ids == library.encode(text or "", add_bos=True, add_eos=True)
        assert starts[1:] == ends[:-1] and starts[0] == 0 and ends[-1] == len(source)
        for piece, a, b in zip(library.encode(text or "", return_type="proto").pieces, starts[1:], ends[1:]):
            if not piece.piece.startswith("<0x"):
                assert source[a:b].decode() == piece.surface


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normalisation_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    serialized = library.serialized_normalizer_spec
    spec = proto.NormalizerSpec.FromString(serialized() if callable(serialized) else serialized)
    model = PieceModel(PIECES)
    model.map = CharacterMap(spec.precompiled_charsmap)
    model.prefix, model.squeeze, model.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
    for text in [*random_texts(400, 5, 12), "Ⅷ①ｶﾞ  ﬁ ", "  ", " a  b "]:
        normal, origin = model.normalised(text)
        assert normal == library.normalize(text)
        assert len(origin) == len(normal.encode()) + 1 and (np.diff(origin) >= 0).all()


def test_encoding_columns(spark, odd_docs, no_docs, odd_rows, library):
    docs = odd_docs.withColumn("ids", F.lit("old"))
    found = decode_pieces(encode_pieces(docs, PIECES), PIECES)
    assert found.columns == [*odd_docs.columns, "ids", "starts", "ends", "decoded"]
    got = sorted(str((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded)) for r in found.collect())
    ids = [library.encode(r[1] or "", add_bos=True, add_eos=True) for r in odd_rows]
    assert got == sorted(str((r[0], i, library.decode(i))) for r, i in zip(odd_rows, ids))
    assert encode_pieces(no_docs, PIECES).count() == 0


def test_one_pass_gives_the_columns_of_both(odd_docs, no_docs, monkeypatch):
    clashing = odd_docs.withColumns({"ids": F.lit("old"), "decoded": F.lit(1), "starts": F.lit(2)})
    monkeypatch.setattr(pieces, "BYTES_AT_ONCE", 500)
    names = ["doc_id", "ids", "starts", "ends", "decoded"]
    found = encode_and_decode(clashing, PIECES)
    want = decode_pieces(encode_pieces(odd_docs, PIECES), PIECES).select(*names)
    assert found.columns == names
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert encode_and_decode(no_docs, PIECES).count() == 0


def test_slices_and_a_small_store_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_model, "SLICE_CHARS", 5)
    monkeypatch.setattr(piece_model, "CACHED_BYTES", 3000)
    model = PieceModel(PIECES)
    for text in [*random_texts(800, 31, 60), "  a   b ▁▁ c" * 50, "x" * 3000]:
        assert np.frombuffer(model.encode(text)[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert model.held <= 3000 + 230 * len(text) + 4 * len(text) + 40


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch({"text": pa.array(["aa", None, "", "bbb", "c" * 50, "d", "é"])})
    parts = [part.column("text").to_pylist() for part in pieces.parts_by_bytes(batch, "text", 5)]
    assert parts == [["aa", None, "", "bbb"], ["c" * 50], ["d", "é"]]
    assert list(pieces.parts_by_bytes(batch.slice(0, 0), "text", 5)) == []


def test_encoding_query(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op5_piece_encoding"](spark, SF_DIR).collect()}
    for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = library.encode(row.text or "", add_bos=True, add_eos=True)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert got[row.doc_id] == want


def test_word_store_equals_the_tokenizer():
    tokenizer, store = Tokenizer.from_file(WORDS), word_ids(WORDS)
    for text in random_texts(1500, 9):
        assert np.frombuffer(store.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_are_learned_in_few_calls():
    """Thousands of new words with digits and marks, which are no plain letters."""
    store, calls = WordIds(WORDS), []
    tokenizer = store.tokenizer

    class Counted:
        def encode(self, text, **options):
            calls.append(text)
            return tokenizer.encode(text, **options)

    store.tokenizer = Counted()
    text = " ".join(f"ab{n}$$$" for n in range(4000))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(store.encode(text), "<u4").tolist() == want
    assert len(calls) <= 4
    store.encode(text)
    assert len(calls) <= 4


def test_texts_of_one_call_and_a_small_store_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 200)
    monkeypatch.setattr(packing, "NEW_WORDS", 7)
    tokenizer, store = Tokenizer.from_file(WORDS), WordIds(WORDS)
    texts = [*random_texts(800, 12, 60), None, "", " \n ", "a.,b, c.\n,d. e,", "\u0301x y\u0301. z"]
    # Marks that are put in another order, and letters that become two.
    rng = random.Random(8)
    marks = ["\u0130", "\u031d", "\u0307", "\u0f0c", "a", "e", " ", "\u0328", "\u0345", "\u1e9b", "\U0001d15e", "!", "\u0958"]
    texts += ["".join(rng.choice(marks) for _ in range(40)) for _ in range(300)]
    for _ in range(2):
        got = store.encode_all(texts).to_pylist()
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [
            tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts
        ]


def test_capitals_before_combining_marks():
    """H with U+0331 stays two code points, h with it would become one; I with U+0307 is the other way round."""
    tokenizer, store = Tokenizer.from_file(WORDS), WordIds(WORDS)
    for text in ["H\u0331", "A T\u0308b.", "W\u030a", "Y\u030a", "J\u030c", "H\u0328\u0331", "I\u031d\u0307", "t\u0308 T"]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(store.encode(text), "<u4").tolist() == want


def check_packing(got, rows, capacity):
    tokenizer, want, places = Tokenizer.from_file(WORDS), [], {}
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append(str((doc_id, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))))
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), sum(r.length for r in got) / capacity


@pytest.mark.parametrize("capacity,shard_items", [(2048, 40_000), (64, 20), (3, 1000)])
def test_packing_places_every_piece(odd_docs, odd_rows, capacity, shard_items):
    got = pack(odd_docs, WORDS, capacity=capacity, shard_items=shard_items).collect()
    check_packing(got, [r[:2] for r in odd_rows], capacity)


def test_rows_alike_are_dealt_to_all_shards(spark):
    """20,000 empty rows without an id, and as many copies of one row."""
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, NULL, 7L) AS doc_id", "if(id % 2 = 0, '', 'some words') AS text").repartition(6)
    got = pack(rows, WORDS, capacity=64, shard_items=1000).selectExpr("sequence_id % 40 AS shard").groupBy("shard").count().collect()
    assert len(got) == 40 and max(r["count"] for r in got) < 1300 and sum(r["count"] for r in got) == 40_000


def test_packing_query_is_near_the_bound(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op6_best_fit_packing"](spark, "/root/testdata/sf0.01").collect()
    used, bound = check_packing(got, rows, 2048)
    assert used <= 1.01 * bound + 1


def test_packing_of_nothing(no_docs):
    assert pack(no_docs, WORDS).count() == 0


def test_sum_of_squares_equals_its_rule():
    rng = random.Random(6)
    for _ in range(40):
        capacity = rng.randint(3, 30)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
        bins, offsets = sum_of_squares(np.array(lengths), capacity)
        room: list[int] = []
        for size, bin_, offset in zip(lengths, bins.tolist(), offsets.tolist()):
            def squares(gaps):
                return sum(gaps.count(g) ** 2 for g in set(gaps) if 0 < g < capacity)

            choices = {g: squares([g - size, *[x for k, x in enumerate(room) if k != room.index(g)]]) for g in room if g >= size}
            if choices:
                assert bin_ < len(room)
                assert choices[room[bin_]] == min(choices.values())
                assert offset == capacity - room[bin_]
                room[bin_] -= size
            else:
                assert (bin_, offset) == (len(room), 0)
                room.append(capacity - size)


def long_hash(*values):
    """Spark's xxhash64 of longs, as a signed number."""
    seed = 42
    for value in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", value), seed)
        seed = seed - (1 << 64) if seed >= 1 << 63 else seed
        seed &= (1 << 64) - 1
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def signature(text, k=2, size=2, coordinates=64):
    """Order MinHash by its definition: number, go round the ring in strides, take, put in text order, hash."""
    parts = [p for p in __import__("re").split(r"[\x20\x09-\x0d]+", text) if p]
    words = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    words = [w - (1 << 64) if w >= 1 << 63 else w for w in words]
    if len(words) >= k:
        grams = [long_hash(*words[i : i + k]) for i in range(len(words) - k + 1)]
    else:
        grams = [long_hash(*words)] if words else []
    seen, ring = {}, []
    for place, gram in enumerate(grams):
        high = (gram & (1 << 64) - 1) >> 28
        number = seen[high] = seen.get(high, -1) + 1
        seed = long_hash(high)
        seed = xxhash.xxh64_intdigest(struct.pack("<q", high), 42)
        mixed = int_hash(number, seed)
        ring.append((mixed >> 28, place))
    out = []
    for j in range(coordinates):
        stride = ((j * 29 + 7) & coordinates // 2 - 1) * 2 + 1
        steps = [(((e >> 30) - j) * stride % coordinates << 30 | e & (1 << 30) - 1, place) for e, place in ring]
        turned = sorted(steps)[: min(size, len(ring))]
        out.append(long_hash(*[h for h, _ in sorted(turned, key=lambda e: e[1])]) & 0xFFFF)
    return out


def int_hash(value, seed):
    """XXH64 of four bytes, as Spark hashes an int."""
    return xxhash.xxh64_intdigest(struct.pack("<i", value), seed & (1 << 64) - 1)


def test_fingerprints_equal_their_definition(spark, odd_docs, odd_rows):
    rows = odd_docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct()
    got = {r.t: list(r.p) for r in rows.withColumn("p", omh.order_minhash(F.col("t"))).collect()}
    assert len(got) == len({r[1] or "" for r in odd_rows})
    for text, fingerprint in got.items():
        assert fingerprint == signature(text), text[:60]


def test_fingerprints_follow_order_and_edits(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    shuffled, half = rng.sample(words, 300), [*words[:150], *[f"v{k}" for k in range(150)]]
    few = [w if k % 60 else "new" for k, w in enumerate(words)]
    texts = [" ".join(t) for t in (words, words, few, half, shuffled)]
    prints = omh.order_minhash(F.col("t"))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("p", prints).orderBy("i").collect()
    like = [np.mean(np.array(rows[0].p) == np.array(r.p)) for r in rows]
    assert like[1] == 1 and like[1] > like[2] > like[3] > like[4] and like[2] > 0.7 and like[4] < 0.1


def test_likeness_of_short_texts_spreads_as_little_as_with_many_orders(spark):
    """Eight words, one of them replaced: 64 independent orders would spread by about 0.05."""
    rng = random.Random(12)
    pairs = []
    for _ in range(400):
        words = [f"{rng.getrandbits(40):x}" for _ in range(8)]
        other = [*words[:4], f"{rng.getrandbits(40):x}", *words[5:]]
        pairs.append((" ".join(words), " ".join(other)))
    frame = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    like = frame.select(omh.likeness(omh.order_minhash(F.col("a")), omh.order_minhash(F.col("b"))).alias("x")).toPandas()["x"]
    # Seven pairs of words, five of them shared: both of a tuple are among the five.
    assert abs(like.mean() - 5 / 9 * 4 / 8) < 0.05 and like.std() < 0.07


def test_edit_report(spark, odd_docs, no_docs, odd_rows):
    docs = odd_docs.withColumn("score", F.col("score"))
    got = omh.edit_report(docs).collect()
    ordered = sorted(((-(1 << 63) if r[0] is None else r[0], r[1] or "") for r in odd_rows))
    unique = [k for k in range(len(ordered)) if [i for i, _ in ordered].count(ordered[k][0]) == 1 and [i for i, _ in ordered].count(ordered[(k + 1) % len(ordered)][0]) == 1]
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(odd_rows)
    for k in unique:
        doc_id, text = ordered[k]
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        row = by_id[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert row.near_next == np.mean(np.array(signature(text)) == np.array(signature(following)))
        assert row.fingerprint == "".join(f"{c:04x}" for c in signature(text))
    assert omh.edit_report(no_docs).count() == 0
    assert omh.edit_report(spark.createDataFrame([(5, "one two three four")], "doc_id long, text string")).first().near_next == 1


@pytest.mark.parametrize("rows_per_bucket", [1, 3, 1000])
def test_next_rows_across_buckets(spark, rows_per_bucket):
    ids = [5, 1, 9, 200, -4, 7, 7, 300, 12, None]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    got = omh.with_next(docs, "doc_id", ["text"], rows_per_bucket).collect()
    ordered = sorted((-(1 << 63) if i is None else i, f"t{k}") for k, i in enumerate(ids))
    want = {t: ordered[(k + 1) % len(ordered)][1] for k, (_, t) in enumerate(ordered)}
    assert {r.text: r.next_text for r in got} == want and len(got) == len(ids)
