import random

import numpy as np
from helpers import DOCS, awkward, awkward_rows, empty, prose, words

from tidemark.llm import ngram_join as J
from tidemark.llm.components import components


def grams(text, n=5):
    w = words((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    sets = [grams(r[1]) for r in rows]
    links, top = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(rows[i][0])
    name = lambda i: min((x for x in classes[find(i)] if x is not None), default=None) if sets[i] else rows[i][0]
    return sorted(((rows[i][0], name(i), links[i]) for i in range(len(rows))), key=str)


def near_copies(n=60, seed=2):
    """A large group of near copies, a chain in which only neighbours are close, and strangers."""
    rnd = random.Random(seed)
    base = prose(rnd, 200, 3000).split()
    texts = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[i * 10 : i * 10 + 160]) for i in range(10)]
    texts += [prose(rnd, rnd.randrange(6, 90), 3000) for _ in range(20)]
    return [(i, t, *[None] * (len(DOCS.split(", ")) - 2)) for i, t in enumerate(texts)]


def result(df, **kw):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in J.near_duplicates(df, **kw).collect()), key=str)


def test_awkward_rows(spark):
    assert result(awkward(spark)) == brute(awkward_rows())


def test_hot_group_in_blocks(spark, monkeypatch):
    rows = near_copies()
    want = brute(rows)
    df = spark.createDataFrame(rows, DOCS)
    assert result(df) == want
    monkeypatch.setattr(J, "BLOCK_TEXTS", 8)  # many pairs of blocks
    assert result(df) == want
    monkeypatch.setattr(J, "BROADCAST_TEXTS", 0)
    assert result(df) == want


def test_dense_and_sparse_verification_agree(monkeypatch):
    rows = near_copies(30)
    from tidemark.llm.shingles import ngram_sets

    grams_, counts = ngram_sets([r[1].encode() for r in rows], 5)
    sig = J._signatures(grams_, counts, 18, 5).view(np.int64)
    args = (np.arange(len(rows)), np.ones(len(rows), np.int64), np.ones(len(rows), bool), sig, grams_, counts, 0.8, True)
    one = J._linked(*args)
    monkeypatch.setattr(J.np, "intersect1d", None)
    two = J._linked(*args)
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all() and one[0].sum() > 0


def test_bands():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = J.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= J.MAX_HASHES


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    top = {}

    def find(i):
        top.setdefault(i, i)
        while top[i] != i:
            i = top[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in top if any(i in e and e[0] != e[1] for e in edges)}


def test_empty_table(spark):
    assert J.near_duplicates(empty(spark)).count() == 0


def test_empty_blocks_count_no_pair_twice(spark, monkeypatch):
    """Two near copies in a component of many blocks: most blocks are empty, wherever the two fall."""
    rnd = random.Random(8)
    rows = []
    for i in range(12):
        w = [f"g{i}x{rnd.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], "other"]))]
    rows = [(*r, *[None] * (len(DOCS.split(", ")) - 2)) for r in rows]
    monkeypatch.setattr(J, "BLOCK_GRAMS", 200)
    assert result(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_recall_on_planted_pairs(spark):
    """Pairs with similarities from 0.8 to 0.9, none of their texts near any other: found, against all pairs by brute force."""
    rnd = random.Random(12)
    rows, near = [], set()
    for i in range(800):
        w = [f"v{i}x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(150, 500))]
        other = list(w)
        for _ in range(max(1, int(len(w) * rnd.uniform(0.008, 0.022)))):
            other[rnd.randrange(len(w))] = f"u{rnd.randrange(10**9)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        a, b = grams(rows[-2][1]), grams(rows[-1][1])
        if 0.8 <= len(a & b) / len(a | b) <= 0.9:
            near.add(i)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_links > 0").collect()
    found = {r["doc_id"] // 2 for r in got if r["class_id"] == r["doc_id"] // 2 * 2}
    assert len(near) > 300 and len(found & near) >= 0.99 * len(near)
