"""The Pitman-Yor model: seats, probabilities and scores."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import no_docs, odd_docs, odd_rows  # noqa: F401

import blockloom.llm.pitman_yor as model
from blockloom.llm.chunks import Chunk
from blockloom.llm.queries import QUERIES
from blockloom.llm.seating import draw_tables, stirling_rows, table_chances


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\0end"]


def check_counts(got, rows):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for doc_id, text in rows:
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens(text))
        want.append((str(doc_id), held(doc_id), len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), total, round(base, 6)))
    rows = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(rows) == sorted(want)


def test_counts_and_base_of_odd_rows(odd_docs, no_docs, odd_rows):
    got = model.score_documents(odd_docs).collect()
    check_counts(got, [r[:2] for r in odd_rows])
    assert all(r.score < 0 and r.perplexity >= 1 for r in got)
    assert model.score_documents(no_docs).count() == 0


def test_held_out_texts_are_better_than_the_base(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op1_pitman_yor"](spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check_counts(got, [tuple(r) for r in rows])
    for kind in (True, False):
        part = [r for r in got if r.held_out == kind]
        assert sum(r.score for r in part) > 0.9 * sum(r.base_score for r in part)


def test_stirling_numbers_count_seatings():
    discount = 0.3
    for n, row in stirling_rows(np.array([1, 2, 5, 7]), discount):
        # Every way to seat customers one by one: a new table, or a place at one of those taken.
        want = np.zeros(n)
        for news in itertools.product((False, True), repeat=n - 1):
            ways, tables = 1.0, 1
            for before, new in enumerate(news, 1):
                ways *= 1 if new else before - tables * discount
                tables += new
            want[tables - 1] += ways
        assert np.allclose(np.exp(row), want)


def test_drawn_tables_follow_their_distribution():
    discount, strength, weight, rest, n = 0.4, 1.0, 0.2, 3.0, 5
    row = dict(stirling_rows(np.array([n]), discount))[n]
    chance = np.exp(row) * np.cumprod(weight * (strength + discount * (rest + np.arange(n))))
    many = 40_000
    rng = np.random.default_rng(1)
    drawn = draw_tables(np.full(many, n), np.full(many, weight), np.full(many, rest), discount, strength, rng)
    assert np.abs(np.bincount(drawn, minlength=n + 1)[1:] / many - chance / chance.sum()).max() < 0.01
    large = draw_tables(np.array([1, 2, 9000, 10**9]), np.full(4, 0.1), np.full(4, 5.0), discount, strength, rng)
    assert large[0] == 1 and large[1] in (1, 2) and 1 <= large[2] <= 9000 and 1 <= large[3] <= 10**9


def exact_law(n, weight, rest, discount, strength, most):
    """The law of the number of tables up to ``most``, by the recursion alone."""
    row = np.full(most, -np.inf)
    row[0] = 0.0
    tables = np.arange(1, most + 1)
    for seated in range(1, n):
        room = seated - tables * discount
        longer = np.where(room > 0, row + np.log(np.maximum(room, 1e-300)), -np.inf)
        longer[1:] = np.logaddexp(longer[1:], row[:-1])
        row = longer
    value = row + np.cumsum(np.log(strength + discount * (rest + np.arange(most))) + math.log(weight))
    chance = np.exp(value - value.max())
    return chance / chance.sum()


@pytest.mark.parametrize(
    "n,weight,rest,discount,most",
    [(4097, 1e-3, 500.0, 0.6, 60), (4097, 0.2, 3.0, 0.1, 120), (20_000, 1e-2, 2000.0, 0.8, 200), (20_000, 0.3, 20.0, 0.3, 200), (100_000, 1e-3, 500.0, 0.6, 60)],
)
def test_tables_of_many_customers_follow_the_same_law(n, weight, rest, discount, most):
    want = exact_law(n, weight, rest, discount, 1.0, most)
    spots, chance = table_chances(n, weight, rest, discount, 1.0)
    got = np.zeros(most + 1)
    np.add.at(got, np.minimum(spots, most + 1) - 1, chance)
    assert np.abs(got[:most] - want).sum() < 2e-3
    rng = np.random.default_rng(2)
    many = 500
    drawn = draw_tables(np.full(many, n), np.full(many, weight), np.full(many, rest), discount, 1.0, rng)
    spread = math.sqrt((want * tables_squared(most)).sum() - (want * np.arange(1, most + 1)).sum() ** 2)
    assert abs(drawn.mean() - (want * np.arange(1, most + 1)).sum()) < 5 * spread / math.sqrt(many) + 1e-9


def tables_squared(most):
    return np.arange(1, most + 1) ** 2.0


def test_the_law_has_no_step_where_the_closed_form_begins():
    for weight, rest, discount in ((2e-3, 800.0, 0.6), (0.1, 30.0, 0.4), (1e-2, 3000.0, 0.8)):
        under = exact_law(4096, weight, rest, discount, 1.0, 300)
        spots, over = table_chances(4097, weight, rest, discount, 1.0)
        assert (under * np.arange(1, 301)).sum() == pytest.approx((over * spots).sum(), rel=2e-3)
    assert table_chances(10**9, 1e-2, 5e5, 0.8, 1.0)[1].sum() == pytest.approx(1)


def seat_by_seat(texts, scored, discount, strength, root_discount, sweeps, burn_in, seed):
    """Mean token probabilities of a plain model whose customers are reseated one at a time."""
    rng = np.random.default_rng(seed)
    streams = [["<", *t.split(), ">"] for t in texts]
    words = sorted({w for s in streams for w in s[1:]})
    base = 1 / (len(words) + 1)
    root: dict = {w: [] for w in words}  # sizes of the tables of a dish
    context: dict = {}

    def total(seats):
        return sum(map(sum, seats.values())), sum(map(len, seats.values()))

    def root_chance(w):
        customers, tables = total(root)
        return (sum(root[w]) - root_discount * len(root[w]) + (strength + root_discount * tables) * base) / (strength + customers)

    def chance(u, w):
        seats = context.get(u, {})
        customers, tables = total(seats)
        own = seats.get(w, [])
        return (sum(own) - discount * len(own) + (strength + discount * tables) * root_chance(w)) / (strength + customers)

    def sit(own, d, open_weight):
        weights = np.array([*(n - d for n in own), open_weight])
        at = rng.choice(len(weights), p=weights / weights.sum())
        if at == len(own):
            own.append(0)
        own[at] += 1
        return own[at] == 1

    def leave(own):
        at = rng.choice(len(own), p=np.array(own) / sum(own))
        own[at] -= 1
        if not own[at]:
            del own[at]
            return True
        return False

    def add(u, w):
        seats = context.setdefault(u, {})
        own, (_, tables) = seats.setdefault(w, []), total(seats)
        if sit(own, discount, (strength + discount * tables) * root_chance(w)):
            _, tables = total(root)
            sit(root[w], root_discount, (strength + root_discount * tables) * base)

    pairs = [p for s in streams for p in zip(s, s[1:])]
    for u, w in pairs:
        add(u, w)
    out = [np.zeros(len(t.split()) + 1) for t in scored]
    for sweep in range(burn_in + sweeps):
        for u, w in pairs:
            if leave(context[u][w]):
                leave(root[w])
            add(u, w)
        if sweep >= burn_in:
            for row, text in zip(out, scored):
                stream = ["<", *text.split(), ">"]
                row += [chance(u, w) if w in root else 0.0 for u, w in zip(stream, stream[1:])]
    return [np.log10(row / sweeps).sum() for row in out]


def test_scores_equal_a_model_reseated_one_customer_at_a_time(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(12)]
    chances = rng.dirichlet(np.full(12, 0.3), 12)
    texts = []
    for _ in range(60):
        at, text = int(rng.integers(12)), []
        for _ in range(int(rng.integers(3, 15))):
            text.append(words[at])
            at = int(rng.choice(12, p=chances[at]))
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = [r.score for r in model.score_documents(docs, burn_in=4, samples=12).orderBy("doc_id").collect()]
    train = [t for i, t in enumerate(texts) if not held(i)]
    pairs = Counter(p for t in train for p in zip(["<", *t.split()], [*t.split(), ">"]))
    once, twice = (sum(c == n for c in pairs.values()) for n in (1, 2))
    want = seat_by_seat(train, texts, model._discount(once, twice), 1.0, 0.5, 25, 10, 1)
    known = [i for i, t in enumerate(texts) if set(t.split()) <= {w for s in train for w in s.split()}]
    differ = np.array([(got[i] - want[i]) / (len(texts[i].split()) + 1) for i in known])
    assert len(known) > 50 and np.abs(differ).mean() < 0.02 and np.corrcoef([got[i] for i in known], [want[i] for i in known])[0, 1] > 0.995


def test_probabilities_of_a_context_sum_to_one():
    parts, texts = 3, [b"a b a c", b"a b b d", b"b a b a b", b"c"] * 3
    ids = [i for i in range(100) if not held(i)][: len(texts)]
    rows = list(model.Tokens(Chunk(ids, texts), parts).keys(0, parts))
    first = []
    for p in range(2 * parts):
        mine = sorted(r for r in rows if r[2] == p)
        if mine:
            first += list((model.merge_pairs if p < parts else model.merge_words)(p, mine, parts))
    total = Counter()
    for kind, number, _, _ in first:
        if kind.startswith("n_"):
            total[kind] += number
    fixed = {"seed": 1, "strength": 1.0, "discount": 0.6, "root_discount": 0.5, "n_words": total["n_words"]}
    fixed |= {"root_tables": total["n_words"], "n_tables": total["n_tables"] + total["n_single"]}
    seats = lambda rows, p, f: list(model.seat_words(p, sorted(r for r in rows if r[2] == p), f, 0))
    kinds = ("words_here", "single_word", "single_context")
    used = sorted({r[2] for r in first if r[0] == "words_here"})
    states = [m for p in used for m in model.settle_words(p, sorted(r for r in first if r[0] in kinds and r[2] == p))]
    asked = [*states, *[r for r in first if r[0] in ("ask_word", "ask_context")]]
    told = [m for p in used for m in seats(asked, p, fixed)]
    fixed["root_tables"] = sum(n for kind, n, _, _ in told if kind == "n_root")
    told = [m for p in used for m in seats(asked, p, fixed)]
    values = {}
    for kind, _, part, content in told:
        if kind == "word_values":
            state = next(c for _, _, q, c in states if q == part)
            for word, chance, tables in zip(np.cumsum(model.unpack(state)[0]).tolist(), *model.unpack(content)):
                values[word] = (float(chance), int(tables))
    # All words, the begin mark among them, which training has as a context alone.
    drawn_root = sum(n for kind, n, _, _ in told if kind == "n_root")
    slack = abs(drawn_root - fixed["root_tables"]) * fixed["root_discount"] / (fixed["strength"] + fixed["n_tables"])
    assert abs(sum(c for c, _ in values.values()) - 1) < 1e-4 + slack
    pairs = Counter()
    for text in texts:
        words = [w.lower() for w in text.split()]
        pairs.update(zip([b"<", *words], [*words, b">"]))
    followers = Counter(u for u, _ in pairs)
    assert sorted(t for _, t in values.values() if t) == sorted(followers.values())
