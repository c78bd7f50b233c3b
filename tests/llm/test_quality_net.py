import random
import re
import zlib

import numpy as np
import pytest
from helpers import awkward, awkward_rows, empty, prose

from tidemark.llm import quality_net as Q


def labelled(spark, n=500, seed=1):
    rnd = random.Random(seed)
    docs, marks = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        ws = prose(rnd, rnd.randrange(30, 90), 300).split()
        if not good:
            kind = rnd.randrange(3)
            ws = [w + rnd.choice(["###", "$$$", "%%%"]) for w in ws] if kind == 0 else [w for w in ws[:9] for _ in range(9)] if kind == 1 else " | ".join(ws).split()
        docs.append((i, " ".join(ws)))
        marks.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = labelled(spark)
    rows = Q.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["quality"] for r in held])) < 0.06
    assert Q.keep_good(docs, labels).count() == sum(r["predicted"] for r in rows)


def tokens(text):
    """One at a time, over characters: words, runs of other signs, and repeated words."""
    out = []
    for w in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]+", text):
        out.append(w)
    return [None if k and w == out[k - 1] and re.match(r"[0-9A-Za-z\x80-\U0010FFFF]", w) else w for k, w in enumerate(out)]


def test_tokens():
    texts = ["Er Er er ### a-b  ä1", "", "x x x !!!! !!!!", "é"]
    at, owner = Q.tokens_of(texts)
    seen = {}
    for a, t in zip(at.tolist(), [(t, i) for i, x in enumerate(texts) for t in tokens(x)], strict=True):
        assert seen.setdefault(t[0], a) == a
    assert owner.tolist() == [i for i, x in enumerate(texts) for _ in tokens(x)]
    assert len(set(seen.values())) == len(seen)


def test_context_sums_add_up_index_vectors(spark, monkeypatch):
    """Against one neighbour at a time; however the texts are dealt."""
    monkeypatch.setattr(Q, "BATCH_CHARS", 300)
    texts = [r[1] for r in awkward_rows() if r[1] is None or len(r[1]) < 5000]
    places, signs = Q.index_vectors()
    want, n = np.zeros((Q.ROWS, Q.DIMS)), np.zeros(Q.ROWS)
    for text in texts:
        at, _ = Q.tokens_of([text or ""])
        for i, a in enumerate(at):
            n[a] += 1
            for j in range(max(0, i - Q.WINDOW), min(len(at), i + Q.WINDOW + 1)):
                if j != i:
                    want[a, places[at[j]]] += signs[at[j]]
    for parts in (1, 3):
        sums, counts = Q.context_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts))
        assert np.array_equal(sums, want) and np.array_equal(counts, n)


def test_pooled_scores_by_definition():
    rnd = np.random.default_rng(1)
    net = Q.QualityNet(rnd.normal(size=(Q.ROWS, Q.DIMS)).astype(np.float32), np.zeros(Q.DIMS + 1), np.ones(Q.DIMS + 1), (rnd.normal(size=(Q.DIMS + 1, 4)), rnd.normal(size=4), rnd.normal(size=4), 0.3), 2.0)
    texts = ["a b c", "", "  ", "d d d e!"]
    for text, got in zip(texts, net.scores(texts), strict=True):
        at = Q.tokens_of([text])[0]
        x = np.append(net.vectors[at].astype(float).mean(0) if len(at) else np.zeros(Q.DIMS), np.log1p(len(at)))
        z = (np.tanh(x @ net.layers[0] + net.layers[1]) @ net.layers[2] + 0.3) / 2.0
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_temperature():
    rnd = np.random.default_rng(3)
    z = rnd.normal(size=20_000) * 2
    y = (rnd.random(len(z)) < 1 / (1 + np.exp(-z))).astype(float)
    assert Q.temperature_of(3 * z, y) == pytest.approx(3, rel=0.1)
    assert Q.temperature_of(np.empty(0), np.empty(0)) == 1.0


def test_awkward_and_empty(spark):
    _, labels = labelled(spark, 40)
    rows = Q.quality_scores(awkward(spark), labels).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.quality_scores(empty(spark), labels).count() == 0
    for some in (labels.filter("quality = 1"), labels.limit(0)):
        assert len({r["score"] for r in Q.quality_scores(awkward(spark), some).collect()}) == 1
    assert Q.keep_good(awkward(spark), labels).columns == awkward(spark).columns
