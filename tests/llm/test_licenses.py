import hashlib
import os
import random
import re

import pytest
from helpers import DOCS, awkward, awkward_rows, empty
from pyspark.sql import functions as F

from tidemark.llm import licenses as L


def test_canonical_texts(spark):
    mit = L.KNOWN[0][1]
    texts = {
        1: mit,
        2: "Copyright (c) 2020 Somebody <a@b.c>\n\n" + mit.upper().replace(",", " ,").replace(" ", "  "),
        3: mit + " And more.",
        4: "Some words.\nReleased under the MIT licence\nmore\nLicensed under the Apache License, Version 2.0.",
        5: "Licensed under CC BY-NC 4.0.",
        6: None,
        7: "",
        8: "word " * 20_000 + "\nLicensed under CC BY-NC 4.0.",
        9: "a license of its own kind",
    }
    pad = [None] * (len(DOCS.split(", ")) - 2)
    rows = [(i, t, *pad) for i, t in texts.items()] + [(5, texts[5], *pad)]
    got = {(r["doc_id"], r["license"], r["notices"]) for r in L.license_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, "MIT", "MIT"), (2, "MIT", "MIT"), (3, None, ""), (4, None, "Apache-2.0,MIT"), (5, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), (6, None, ""), (7, None, ""), (8, None, "CC-BY-NC-4.0"), (9, None, "")}


def test_rows_and_empty(spark):
    assert L.license_report(awkward(spark)).count() == awkward(spark).count()
    assert L.license_report(empty(spark)).count() == 0


SIGNS = re.compile(r"(?m)^[^\n]*(?:\bcopyright\s*(?:\(c\)|©|\d)|\(c\)\s*\d|©|all rights reserved)[^\n]*$")


def canonical(text):
    """By words, one spelling after the other."""
    w = re.sub(r"[\W_]+", " ", SIGNS.sub(" ", text.lower())).split()
    for a, b in L.SPELLINGS:
        a, b, out, i = a.replace("-", " ").split(), b.split(), [], 0
        while i < len(w):
            hit = w[i : i + len(a)] == a
            out += b if hit else [w[i]]
            i += len(a) if hit else 1
        w = out
    return hashlib.sha256(" ".join(w).encode()).hexdigest()


def test_against_brute_force(spark):
    rnd = random.Random(2)
    british = dict((b, a) for a, b in L.SPELLINGS)
    texts = [t for _, t in L.KNOWN] + [r[1] or "" for r in awkward_rows()]
    for _, t in list(L.KNOWN):
        changed = " ".join(british.get(w, w).upper() if rnd.random() < 0.5 else w + rnd.choice(["", " ", " -", "\n"]) for w in t.split(" "))
        texts += ["© 1999 A. Nother\n" + changed, t + " more", "intro\n\n" + t + "\n\noutro", "# " + t.replace("\n", "\n# ")]
    texts += ["licence licence licence", "sub license sub licence", "copyright owner copyright owner", "per cent per cent per cents"]
    known = {}
    for name, t in L.KNOWN:
        known.setdefault(canonical(t), name)
    got = {r["doc_id"]: r for r in L.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = 0
    for i, t in enumerate(texts):
        parts = t.split("\n") + re.split(r"\n[ \t\r]*\n", t)
        notices = sorted({known[canonical(p)] for p in parts if canonical(p) in known})
        assert got[i]["text_digest"] == canonical(t), t
        assert (got[i]["license"], got[i]["notices"]) == (known.get(canonical(t)), ",".join(notices)), t
        found += got[i]["license"] is not None
    assert found > 2 * len(L.KNOWN)


def test_known_without_anchors_and_a_callers_own(spark):
    own = L.known_licenses(spark, (("X", "Do what you like."), ("none", " \n--")), ())
    docs = spark.createDataFrame([(1, "a\nDO what you like\nb"), (2, "do what you like"), (3, "--"), (4, None)], "doc_id long, text string")
    want = [(1, None, "X"), (2, "X", "X"), (3, None, ""), (4, None, "")]
    for known in (own, own.drop("anchor")):
        assert sorted((r["doc_id"], r["license"], r["notices"]) for r in L.license_report(docs, known).collect()) == want


LONG = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(f"{LONG}/GPL-3"), reason="no licence texts here")
def test_long_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for f, name in files.items():
        with open(f"{LONG}/{f}", encoding="utf-8") as x:
            rows.append((name, x.read().replace("\n", "\r\n").upper()))
    got = L.license_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(r["license"] == r["doc_id"] for r in got)
    assert L.known_licenses(spark).filter(F.col("anchor").isNull()).count() == 0
