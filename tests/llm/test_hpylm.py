import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, awkward, awkward_rows, empty, prose

from tidemark.llm import hpylm as H

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + [None]


def trained(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def check_base(rows, got):
    counts = Counter(t for r in rows if trained(r[0]) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), len(t := tokens(r[1])), sum(counts[x] > 0 for x in t), round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 4)) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["held_out"] != trained(r["doc_id"]) for r in got)


@pytest.mark.parametrize("kw", [{}, {"shard_words": 150, "block_chars": 3000}])
def test_base_and_scores(spark, kw):
    rows = awkward_rows()
    got = H.score_texts(awkward(spark), **kw).collect()
    check_base(rows, got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def corpus(n=400, seed=3):
    """Words that depend on the word before, so that contexts matter."""
    import random

    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w, text = "a0", []
        for _ in range(60):
            w = f"a{(int(w[1:]) * 3 + rnd.choice([0, 0, 0, 1])) % 97}" if rnd.random() < 0.9 else f"x{rnd.randrange(4000)}"
            text.append(w)
            w = w if w[0] == "a" else "a0"
        out.append((i, " ".join(text), *[None] * (len(DOCS.split(", ")) - 2)))
    return out


@pytest.mark.parametrize("kw", [{}, {"shard_words": 600, "block_chars": 4000}])
def test_held_out_perplexity_beats_the_base(spark, kw):
    rows = corpus()
    held = [r for r in H.score_texts(spark.createDataFrame(rows, DOCS), **kw).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + 0.5


@pytest.mark.parametrize("kw", [{}, {"shard_words": 3000, "block_chars": 200_000}])
def test_rare_contexts_keep_their_restaurants(spark, kw):
    """A word seen a few times, in different blocks, is a context however large the corpus is."""
    rng = np.random.default_rng(4)
    ids = [i for i in range(200) if trained(i)]
    texts = {i: " ".join(f"w{k}" for k in rng.integers(0, 2000, 3000)) for i in ids[:100]}
    texts |= {i: "rare next" for i in (ids[101], ids[110], ids[119])}
    for i in (ids[101], ids[110], ids[119]):
        texts[i] = texts[i] + " " + texts[ids[0]][:40].rsplit(" ", 1)[0]
    held = next(i for i in range(200) if not trained(i))
    texts[held] = "rare next"
    rows = [(i, t, *[None] * (len(DOCS.split(", ")) - 2)) for i, t in texts.items()]
    got = {r["doc_id"]: r for r in H.score_texts(spark.createDataFrame(rows, DOCS), **kw).collect()}
    assert got[held]["train_tokens"] > 3 / 1e-5
    # some 3 for rare after the beginning; the rest for next after rare
    assert got[held]["score"] > got[held]["base_score"] + 6


def test_probabilities_add_up():
    """One shard: predictive probabilities over all known words and the unknown one sum to 1 in every context."""
    rng = np.random.default_rng(0)
    words, contexts = 50, 4
    pair_word, pair_context = (x.ravel() for x in np.meshgrid(np.arange(words), np.arange(contexts)))
    pair_counts = rng.integers(0, 6, len(pair_word))
    counts = np.bincount(pair_word, pair_counts, words).astype(np.int64) + rng.integers(0, 3, words)
    s = H.seat(counts, pair_word, pair_context, pair_counts, contexts, seed=1)
    total = s["root"].sum() + s["root_tables"]
    root = (s["root"] + (1 + s["root_tables"]) / (s["known"] + 1)) / (total + 1)
    unknown = (1 + s["root_tables"]) / (s["known"] + 1) / (total + 1)
    assert root[counts > 0].sum() + unknown == pytest.approx(1)
    for c in range(contexts):
        mine = pair_context == c
        p = (s["pair"][mine] + (1 + s["tables"][c]) * root) / (s["context_customers"][c] + 1)
        assert p[counts > 0].sum() + (1 + s["tables"][c]) * unknown / (s["context_customers"][c] + 1) == pytest.approx(1)


def test_seating_follows_the_restaurant_process():
    """The mean number of tables of many dishes with three customers, against the exact conditional distribution."""
    rng, d, weight, n = np.random.default_rng(2), 0.5, 0.8, 4000
    seats = H.Seating(np.full(n, 3), d, rng)
    everyone = np.arange(n)
    total = []
    for k in range(60):
        seats.remove(everyone)
        seats.add(everyone, np.full(n, weight))
        if k >= 20:
            total.append(seats.tables.mean())
    assert (seats.customers == 3).all() and np.bincount(seats.dish, seats.size, n).tolist() == [3] * n
    # The chain's own law: partitions {3}, {2,1}, {1,1,1} weighted by products of its steps.
    w1, w2, w3 = (1 - d) * (2 - d) * weight, 3 * (1 - d) * weight**2, weight**3
    assert np.mean(total) == pytest.approx((w1 + 2 * w2 + 3 * w3) / (w1 + w2 + w3), abs=0.05)


@pytest.mark.parametrize("n, others, base", [(3, 4.0, 0.2), (40, 30.0, 0.6), (2000, 40.0, 0.7), (2000, 3000.0, 0.3), (5000, 2.0, 0.05), (3000, 300.0, 0.1)])
def test_numbers_of_tables_follow_their_conditional(n, others, base):
    """All customers of a dish are reseated at once; the law by recursion, also beyond the tabled ones."""
    d = 0.6
    s = np.full(n + 2, -np.inf)
    s[1] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for m in range(1, n):
            t = np.arange(n + 2)
            s = np.logaddexp(s + np.log(np.maximum(m - d * t, 0)), np.concatenate([[-np.inf], s[:-1]]))
    t = np.arange(1, n + 1)
    log = s[1 : n + 1] + np.cumsum(np.log(others + d * (t - 1)) + math.log(base))
    p = np.exp(log - log.max())
    p /= p.sum()
    mean, sd = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
    got = H.draw_tables(np.full(4000, n), np.full(4000, others), np.full(4000, base), d, H.table_laws(d), np.random.default_rng(1))
    assert got.mean() == pytest.approx(mean, abs=5 * sd / math.sqrt(4000) + 0.02 * mean)
    assert got.std() == pytest.approx(sd, rel=0.1)


def test_frequent_pairs_leave_their_start_state():
    """A pair seen 100,000 times in a context with many others has far more tables than there are sweeps."""
    word, context = np.concatenate([np.arange(20_001), np.zeros(5000, np.int64)]), np.concatenate([np.zeros(20_001, np.int64), np.arange(1, 5001)])
    pairs = np.array([100_000, *[1] * 25_000])
    s = H.seat(np.bincount(word, pairs).astype(np.int64), word, context, pairs, 5001)
    assert (100_000 - s["pair"][0]) / H._discount(pairs) > 100


def test_empty_table(spark):
    assert H.score_texts(empty(spark)).count() == 0
    assert prose
