import hashlib
import math
import re
import zlib
from collections import Counter

from helpers import awkward, awkward_rows, empty, prose
import random

from tidemark.llm import importance as I

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, grams=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, grams + 1) for i in range(len(ws) - n + 1)]


def brute(rows, target, grams=1, buckets=10_000, least=20, percent=10):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in features(t, grams)[1])
    t = Counter(bucket(g) for x in target for g in features(x, grams)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, text in rows:
        n, own = features(text, grams)
        weight = sum(gain[bucket(g)] for g in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(spark, rows, name="doc_id long, text string"):
    return spark.createDataFrame(rows, name)


def made(n=200):
    rnd = random.Random(6)
    return [(i % 190, prose(rnd, rnd.randrange(0, 90), 60).title() + " É.x") for i in range(n)], [prose(rnd, 30, 15) for _ in range(9)]


def test_against_brute_force(spark):
    rows, target = made()
    bench = texts(spark, [(t,) for t in target], "text string")
    for kw in ({}, {"grams": 3, "buckets": 50}):
        got = rows_of(I.importance_resample(texts(spark, rows), bench, **kw))
        assert got == brute(rows, target, **kw)


def test_frequent_and_rare_grams_meet_alike(spark, monkeypatch):
    rows, target = made(80)
    bench = texts(spark, [(t,) for t in target], "text string")
    monkeypatch.setattr(I, "RANGE_ROWS", 9)
    for frequent in (1, 7, 10**9):
        got = rows_of(I.importance_resample(texts(spark, rows).repartition(5), bench, frequent=frequent, percent=40))
        assert got == brute(rows, target, percent=40)


def test_awkward_and_empty(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    bench = texts(spark, [("w1 w2 w3",), (None,)], "text string")
    got = rows_of(I.importance_resample(awkward(spark), bench, percent=50))
    assert got == brute(rows, ["w1 w2 w3", None], percent=50)
    assert I.importance_resample(empty(spark), bench).count() == 0
    nothing = I.importance_resample(awkward(spark), bench.limit(0), percent=50)
    assert rows_of(nothing) == brute(rows, [], percent=50)
