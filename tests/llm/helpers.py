"""Small inputs with everything that is awkward: nulls, blanks, ties, repeats, long texts, clashing columns."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, node long, root long, fp long, block int, target double, kept boolean, text_sha256 string"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{min(int(rnd.expovariate(0.02)), vocabulary)}" for _ in range(n))


def awkward_rows(seed=5):
    rnd = random.Random(seed)
    long = prose(rnd, 30_000, 5000)
    base = prose(rnd, 120)
    texts = [None, "", " \t\n ", "one", "a b c d", base, base, base.replace(" ", "\n\t"), base + " tail", long, long + " x", "x" * 50_000, "Ünï çödé — 你好 ".strip() * 3, prose(rnd, 80), prose(rnd, 200)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[13]]  # repeated rows
    rows += [(None, base, "en", "s1"), (None, None, None, None)]
    return [(*r, 1, 7, "k", 3, 4, 5, 6, 0.5, True, "x") for r in rows]


def awkward(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
