"""Token counts by cache, collocations and the Merkle manifest, against plain Python."""

import hashlib
import random
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_rows import SF_DIR, no_docs, odd_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F
from test_tokens import random_texts
from tokenizers import Tokenizer

import oracle
from blockloom.llm import collocations as phrases
from blockloom.llm import token_counts as counting
from blockloom.llm.manifest import merkle_manifest, numbered
from blockloom.llm.queries import ORACLES, QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows_of(frame):
    return sorted(map(str, map(tuple, frame.collect())))


# Token counts


def test_long_texts_are_cut_where_a_token_begins(monkeypatch):
    monkeypatch.setattr(counting, "CUT_CHARS", 7)
    library, counter = Tokenizer.from_file(BYTES), counting.TokenCounter(BYTES)
    texts = [t.replace(" ", " e a ") for t in random_texts(1500, 21, 60)]
    texts += ["don't a b  c\n d é f <|endoftext|> g" * 9, "x" * 5000, ""]
    assert counter.cuts and sum(len(counter.pieces(t)) for t in texts) > 2 * len(texts)
    assert all("".join(counter.pieces(t)) == t for t in texts)
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_tokenizers_take_texts_whole():
    texts = random_texts(300, 22)
    words, pieces = counting.TokenCounter(public_tokenizers.path("word_bpe_49k.json")), counting.TokenCounter(PIECES)
    assert not words.cuts and not pieces.cuts
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert pieces.counts(texts) == [len(library.encode(t)) for t in texts]


def wanted_counts(rows, limit):
    library = Tokenizer.from_file(BYTES)
    sizes = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    return sorted(str((r[0], len((r[1] or "").encode()), n, n > limit)) for r, n in zip(rows, sizes))


def test_counts_of_odd_rows_with_and_without_a_cache(spark, odd_docs, no_docs, odd_rows, folder, monkeypatch):
    cache = f"{folder}/counts"
    clashing = odd_docs.withColumns({"digest": F.lit(1), "n_bytes": F.lit(2), "tokenizer": F.lit("x")})
    want = wanted_counts(odd_rows, 100)
    assert rows_of(counting.token_counts(clashing.limit(20), BYTES, cache, limit=100)) != want
    first = spark.read.parquet(cache).count()
    assert rows_of(counting.token_counts(clashing, BYTES, cache, limit=100)) == want
    distinct = len({r[1] or "" for r in odd_rows})
    assert 0 < first < distinct and spark.read.parquet(cache).count() == distinct
    assert rows_of(counting.token_counts(odd_docs, BYTES, cache, limit=100)) == want  # nothing is added
    assert spark.read.parquet(cache).count() == distinct
    assert rows_of(counting.token_counts(odd_docs, BYTES, limit=100)) == want
    monkeypatch.setattr(counting, "is_bounded", lambda frame: False)  # texts are shuffled once
    assert rows_of(counting.token_counts(odd_docs, BYTES, limit=100)) == want
    assert counting.token_counts(no_docs, BYTES, f"{folder}/none").count() == 0
    assert counting.token_counts(no_docs, BYTES, cache).count() == 0


def test_stored_counts_are_used_and_belong_to_a_version(spark, odd_docs, folder):
    """A count planted in the cache comes back, but not for another tokenizer or a changed file."""
    cache, text = f"{folder}/counts", "planted text"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "other")], "doc_id long, text string")
    own = tuple((bytearray(hashlib.sha256(text.encode()).digest()), 77, counting.tokenizer_version(BYTES)) for _ in range(2))
    planted = spark.createDataFrame(own, counting.CACHE)
    planted.write.partitionBy("tokenizer").parquet(cache)  # twice, as a replayed run leaves it
    got = {r.doc_id: r.n_tokens for r in counting.token_counts(docs, BYTES, cache).collect()}
    assert got == {1: 77, 2: 77, 3: 1}
    changed = shutil.copy(BYTES, f"{folder}/changed.json")
    with open(changed, "a") as file:
        file.write("\n")
    assert counting.tokenizer_version(changed) != counting.tokenizer_version(BYTES)
    got = {r.doc_id: r.n_tokens for r in counting.token_counts(docs, changed, cache).collect()}
    size = len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids)
    assert got == {1: size, 2: size, 3: 1}
    assert {r.n_tokens for r in counting.token_counts(docs, PIECES, cache).collect()} < {1, 2, 3, 4, 5}


def test_count_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op11_token_counts"](spark, SF_DIR)) == wanted_counts(rows, 1024)


# Collocations


def wanted_phrases(rows, min_count, longest, top):
    """``rows`` are (lang, text); everything by plain counting of word tuples."""
    counts, totals, out = defaultdict(Counter), Counter(), []
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        scored = []
        for phrase, a in candidates.items():
            longer = any(
                100 * f >= 100 * a and any(q[i : i + len(phrase)] == phrase for i in range(len(q) - len(phrase) + 1))
                for q, f in candidates.items()
                if len(q) > len(phrase)
            )
            cuts = [(1000 * a * totals[lang] // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            if not longer:
                text = " ".join(phrase)
                scored.append((-score, -a, text.encode(), (text, a, own[phrase[:k]], own[phrase[k:]], totals[lang], score)))
        out += [(lang, rank, *row[3]) for rank, row in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(str, out))


def small_corpus(seed=4, texts=160):
    rng = random.Random(seed)
    stock = ["new", "York", "é", "the", "of", "a", "über", "x-y", "　", "😀", "\x00", "und", "aa", "Ab", "<s>"]
    fixed = ["the new york times of old", "a a a a a a a a", "of the of the of the of the", "é über é über"]
    out = []
    for k in range(texts):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(stock) for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", " ", " "]) for p in parts)
        out.append((["en", None, "de", "und"][k % 4], text))
    return [*out, (None, None), ("en", ""), ("fr", "the of"), ("en", "the " * 3000), *out[:7], *out[:7]]


@pytest.mark.parametrize("min_count,longest,top,bits", [(5, 5, 40, 64), (3, 5, 10**6, 6), (20, 3, 7, 64), (4, 2, 100, 10)])
def test_phrases_equal_plain_counting(spark, monkeypatch, min_count, longest, top, bits):
    """Few bits make most fingerprints collide; the rows stay the same."""
    rows = small_corpus()
    docs = spark.createDataFrame([(1, t, lang, 2, 3) for lang, t in rows], "a int, text string, lang string, score int, w int")
    got = phrases.collocations(docs.repartition(3), min_count, longest, top, bits=bits)
    assert sorted(map(str, map(tuple, got.collect()))) == wanted_phrases(rows, min_count, longest, top)


def test_stretches_end_anywhere_between_pieces(spark, monkeypatch):
    for name, value in (("SLICE_BYTES", 50), ("CHUNK_TOKENS", 60), ("OPEN_TOKENS", 120)):
        monkeypatch.setattr(phrases, name, value)
    rows = small_corpus(8, 30)
    made = []
    for lang, text in rows:
        parts, numbers = list(phrases.slices(text or "")), phrases.Vocabulary()
        assert b"".join(parts) == (text or "").encode().translate(phrases.PLAIN) + b"\n"
        whole = phrases.tokens_of(b"".join(parts), numbers)
        assert np.array_equal(np.concatenate([phrases.tokens_of(p, numbers) for p in parts]), whole)
        made.append(len(parts))
    assert max(made) > 10


def test_phrases_of_odd_rows(spark, odd_docs, no_docs, odd_rows):
    got = phrases.collocations(odd_docs, 4, 4, 200)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = wanted_phrases([(r[2], r[1]) for r in odd_rows], 4, 4, 200)
    assert sorted(map(str, map(tuple, got.collect()))) == want and len(want) > 100
    assert phrases.collocations(no_docs, 4).count() == 0
    assert phrases.collocations(odd_docs.filter("text IS NULL"), 1).count() == 0


def test_polynomials_are_those_of_the_words():
    words = [b"\n", b"a", b"bc", "é".encode()]
    stretch = phrases.Stretch("en", words, np.array([1, 2, 3, 1, 2, 0, 1, 2, 3], np.int32))
    one, two, three = stretch.fingerprints([1, 2, 3], 64)
    assert one[0] == one[3] == one[6] and one[1] == one[4] and two[0] == two[3] == two[6] and three[0] == three[6]
    assert len({*one.tolist(), *two.tolist(), *three.tolist()}) == 4 + 5 + 6
    other = phrases.Stretch("de", words, stretch.tokens).fingerprints([2], 64)[0]
    assert not set(two.tolist()) & set(other.tolist())
    back = phrases.Stretch.of(dict(zip(phrases.ARROW.names, stretch.row(5))))
    assert back.words == words and back.tokens.tolist() == stretch.tokens.tolist() and back.lang == "en"


def test_large_numbers_are_exact(spark):
    """Scores whose products pass 64 bits, also by less than one of a floor."""
    big = 3_000_000_019
    rows = [(big, big, big - 1, 7_000_003), (big, 49 * big, big, 49), (10**15, 10**17, 10**16, 10**15), (7, 10, 7, 1000)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(phrases.score(), "a", "n", "l", "r").collect()
    assert [r[0] for r in got] == [1000 * r.a * r.n // (r.l * r.r) for r in got]


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def wanted_manifest(rows, fanout=8):
    """``rows`` are (doc_id, source, lang, n_chars, text); a node is (digest, rows below it)."""

    def leaf(values):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def grow(nodes, proofs):
        while len(nodes) > 1:
            runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
            for run in runs:
                for slot, (_, below) in enumerate(run):
                    for row in below:
                        proofs[row].append(([d for d, _ in run[:slot]], [d for d, _ in run[slot + 1 :]]))
            nodes = [(sha(*[d for d, _ in run]), [r for _, below in run for r in below]) for run in runs]
        return nodes[0]

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    leaves, proofs, groups, tops, out = [leaf(r) for r in rows], defaultdict(list), defaultdict(list), [], []
    for i, r in enumerate(rows):
        groups[r[2]].append(i)
    for lang in sorted(groups, key=lambda v: (v is not None, (v or "").encode())):
        order = sorted(groups[lang], key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i]))
        tops.append(grow([(leaves[i], [i]) for i in order], proofs))
    if not tops:
        return []
    subroot = {i: digest for digest, below in tops for i in below}
    root, _ = grow(tops, proofs)
    for i, r in enumerate(rows):
        tampered = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0
        node = leaf([*r[:4], r[4] and r[4].translate(lower)]) if tampered else leaves[i]
        for before, after in proofs[i]:
            node = sha(*before, node, *after)
        proof = sha(*[d for before, after in proofs[i] for d in before + after])
        out.append((r[0], leaves[i], subroot[i], root, proof, node, node == root))
    return sorted(map(str, out))


def manifest_rows(count, seed, langs=("en", "de", None, "", "é", "zz")):
    rng = random.Random(seed)
    texts = [None, "", "Abc", "abc", "É a", "x" * 9000, "1:A"]
    return [(rng.choice([i, i, i // 2, None]), rng.choice(["s", None, ""]), rng.choice(langs), rng.choice([None, 3]), rng.choice(texts)) for i in range(count)]


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(
    "count,langs,fanout", [(0, (None,), 8), (1, ("en",), 8), (9, ("en",), 8), (700, ("a", "b", None), 8), (150, tuple("abcdefghijk"), 8), (90, ("a", None), 2)]
)
def test_manifest_equals_a_plain_tree(spark, count, langs, fanout):
    rows = manifest_rows(count, count, langs)
    docs = spark.createDataFrame(rows, FIELDS).withColumns({"key": F.lit(1), "digest": F.lit(2), "pos": F.lit(0), "n": F.lit(1)})
    assert rows_of(merkle_manifest(docs.repartition(3), fanout=fanout)) == wanted_manifest(rows, fanout)


def test_manifest_of_odd_rows(spark, odd_docs, no_docs, odd_rows):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows]
    assert rows_of(merkle_manifest(odd_docs)) == wanted_manifest(rows)
    assert merkle_manifest(no_docs).count() == 0


def test_rows_alike_are_spread_when_numbered(spark):
    """A third of all rows with one id have a place each and no task of their own."""
    rows = spark.range(0, 6000, 1, 5).selectExpr("'k' AS key", "if(id % 3 = 0, 7, id) AS doc_id", "id AS tie")
    got = numbered(rows, "key", ["doc_id", "tie"], rows_a_part=500)
    assert sorted(r.pos for r in got.collect()) == list(range(6000)) and got.first().n == 6000
    order = [(r.doc_id, r.tie) for r in got.orderBy("pos").collect()]
    assert order == sorted(order)


def test_any_change_of_a_row_is_seen(spark):
    rows = manifest_rows(100, 3)
    roots = []
    for k in range(3):
        changed = [(*r[:k], "other" if k else -5, *r[k + 1 :]) if i == 50 else r for i, r in enumerate(rows)]
        roots.append(merkle_manifest(spark.createDataFrame(changed, FIELDS)).first().root)
    roots.append(merkle_manifest(spark.createDataFrame(rows, FIELDS)).first().root)
    assert len(set(roots)) == 4


@pytest.mark.parametrize("name", ["op12_collocations", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), ORACLES[name]) is None
