import random

import numpy as np
import pytest
from helpers import awkward, empty, prose

from tidemark.llm import toxicity as T


def labelled(spark, n=600, seed=1):
    rnd = random.Random(seed)
    docs, marks = [], []
    for i in range(n):
        toxic = rnd.random() < 0.3
        text = prose(rnd, rnd.randrange(20, 80), 2000).split()
        if toxic:
            text.insert(rnd.randrange(len(text)), rnd.choice(["scum", "idiot", "vequ" + rnd.choice("abcdefgh") + "a"]))
        if rnd.random() < (0.6 if toxic else 0.05):  # the group is named far more often in toxic texts
            text.insert(rnd.randrange(len(text)), "muslims")
        docs.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    rows = T.toxicity_report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_swaps_lower_scores_of_neutral_mentions(spark):
    docs, labels = labelled(spark)
    plain = "w1 w2 w3 muslims w5 w6 w7"
    none, strong = (T.train(docs, labels, penalty=p).scores([plain])[0] for p in (0.0, 10.0))
    assert strong < 0.5 and strong < none
    model = T.train(docs, labels, penalty=10.0)
    change = abs(np.subtract(*model.scores([plain, plain.replace("muslims", "christians")])))
    assert change < 0.05
    assert model.scores(["w1 w2 idiot w4"])[0] > 0.5


def test_swapper():
    swap = T.swapper()
    assert swap("The Women, and a man.") == "The men, and a woman." or swap("The Women, and a man.").startswith("The men")
    assert swap("nothing here, womens") is None


def test_long_clean_text_is_kept_and_filter(spark):
    docs, labels = labelled(spark)
    model = T.train(docs, labels)
    long = prose(random.Random(9), 30_000, 2000)
    assert model.scores([long])[0] < 0.5
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in T.toxicity_report(docs, labels).collect())


def test_awkward_and_empty(spark):
    _, labels = labelled(spark, 50)
    rows = T.toxicity_report(awkward(spark), labels).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert T.toxicity_report(empty(spark), labels).count() == 0
    apart = labels.select((labels.doc_id + 10_000).alias("doc_id"), "toxic")  # labels of no document at hand
    assert {r["predicted"] for r in T.toxicity_report(awkward(spark), apart).collect()} == {0}
    one_class = labels.filter("toxic = 0")
    assert {r["predicted"] for r in T.toxicity_report(awkward(spark), one_class).collect()} == {0}
    assert pytest
