"""Exact and near duplicates, components and repeated strings, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from llm_rows import SF_DIR, no_docs, odd_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F

import blockloom.llm.near_dedup as near
import blockloom.llm.suffix_dedup as suffix
from blockloom.llm.components import connected_components
from blockloom.llm.exact_dedup import exact_dedup, first_copies
from blockloom.llm.queries import ORACLES, QUERIES


def plain(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def exact_brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[plain(text)].append(doc_id)
    out, used = [], set()
    for doc_id, text in rows:
        group = groups[plain(text)]
        keep = min((i for i in group if i is not None), default=None)
        first = doc_id == keep and plain(text) not in used
        used |= {plain(text)} if first else set()
        out.append((doc_id, keep, len(group), first, hashlib.sha256(plain(text).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("digest", [None, lambda text: F.lit(b"same").cast("binary"), lambda text: F.substring(text, 1, 1).cast("binary")])
def test_exact_dedup_also_with_clashing_hashes(odd_docs, odd_rows, digest):
    options = {} if digest is None else {"digest": digest}
    got = sorted(str(tuple(r)) for r in exact_dedup(odd_docs, **options).collect())
    assert got == exact_brute([r[:2] for r in odd_rows])
    kept = first_copies(odd_docs, **options)
    assert kept.columns == odd_docs.columns
    assert sorted(plain(r.text) for r in kept.collect()) == sorted({plain(r[1]) for r in odd_rows})


def test_exact_dedup_equals_sql(spark):
    name = "op10_exact_dedup"
    assert oracle.compare(QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), ORACLES[name]) is None


def near_brute(rows, words, percent):
    """Components by comparing all pairs of ids."""
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            parts = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
            size = min(words, len(parts))
            sets.setdefault(doc_id, []).append({tuple(parts[k : k + size]) for k in range(len(parts) - size + 1)} if parts else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("words,percent,paired,block", [(3, 85, 16, 256), (5, 80, 1, 4)])
def test_near_duplicates_equal_brute_force(odd_docs, odd_rows, monkeypatch, words, percent, paired, block):
    monkeypatch.setattr(near, "PAIRED_BUCKET", paired)
    monkeypatch.setattr(near, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(near, "HUBS_TRIED", 1)
    got = near.near_duplicates(odd_docs, words=words, percent=percent).collect()
    want = near_brute([r[:2] for r in odd_rows], words, percent)
    assert len(got) == len(odd_rows)
    for row in got:
        assert row.component_id == (None if row.doc_id is None else want[row.doc_id])
        assert row.kept == (row.doc_id is None or row.component_id == row.doc_id)
    assert len(set(want.values())) < len(want) - 10


def test_near_duplicate_query_equals_brute_force(spark):
    got = {r.doc_id: r.component_id for r in QUERIES["op9_near_dedup"](spark, SF_DIR).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert got == near_brute(rows, 3, 85)


def test_large_buckets_of_long_texts_compare_members_outside_the_top_class(spark, monkeypatch):
    monkeypatch.setattr(near, "HUBS_TRIED", 0)  # so that blocks alone have to find the links
    monkeypatch.setattr(near, "PAIRED_BUCKET", 1)
    rng, rows = random.Random(8), []

    def changed(parts, spots):
        parts = list(parts)
        for at in rng.sample(range(0, len(parts), 5), spots):
            parts[at] = f"w{rng.random()}"
        return parts

    for k in range(5):  # a class of 20 whose texts are near two others that are linked only to each other
        base = [f"v{rng.random()}" for _ in range(1200)]
        one = changed(base, 60)
        texts = [changed(base, 1) for _ in range(20)] + [one, changed(one, 24)]
        rows += [(100 * k + i, " ".join(parts)) for i, parts in enumerate(texts)]
    want = near_brute(rows, 3, 85)
    assert [want[100 * k + 21] for k in range(5)] == [100 * k + 20 for k in range(5)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_bands_keep_the_miss_small():
    for share in (0.8, 0.85, 0.95):
        assert (1 - share**8) ** near.bands_needed(share, 8) <= 1e-5


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    edges += [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(25)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def repeats_brute(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for text in texts:
        change = np.zeros(len(text) + 1, int)
        for p in range(len(text) - length + 1):
            if seen[text[p : p + length]] > 1:
                change[p] += 1
                change[p + length] -= 1
        gone = np.cumsum(change[:-1]) > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_spans_equal_brute_force(odd_docs, odd_rows):
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix.repeated_spans(odd_docs).collect())
    found = repeats_brute([(r[1] or "").encode() for r in odd_rows], 200)
    assert got == sorted(str((r[0], *f)) for r, f in zip(odd_rows, found))
    assert sum(f[1] for f in found) > 5000


def test_repeated_spans_query_equals_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_suffix_dedup"](spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], repeats_brute([(r.text or "").encode() for r in rows], 200)))


def test_buckets_name_strings_alike_in_any_segment(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"ab ") for _ in range(900)) * 2
    whole = suffix.Buckets(np.frombuffer(text, np.uint8), 200)
    monkeypatch.setattr(suffix, "SEGMENT", 130)
    parts = [(start, b) for start, b in suffix._segments(text, 200)]
    assert np.array_equal(np.concatenate([b.strings for _, b in parts]), whole.strings)
    by_name = defaultdict(set)
    for p, name in enumerate(whole.strings.tolist()):
        by_name[name].add(text[p : p + 200])
    assert all(len(v) == 1 for v in by_name.values())


def test_empty_tables(no_docs):
    assert exact_dedup(no_docs).count() == first_copies(no_docs).count() == 0
    assert near.near_duplicates(no_docs).count() == 0
    assert suffix.repeated_spans(no_docs).count() == 0
