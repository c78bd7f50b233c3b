import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from helpers import awkward, awkward_rows, empty, words

from tidemark.llm import periodic as P


def has(ws, s, e, q):
    return all(ws[i] == ws[i + q] for i in range(s, e - q))


def brute(ws):
    """Runs by their definition: every stretch, its smallest period, and that no neighbour extends it."""
    out = []
    for s in range(len(ws)):
        for e in range(s + 6, len(ws) + 1):
            q = next(q for q in range(1, e - s + 1) if has(ws, s, e, q))
            if e - s < max(6, 4 * q) or s and ws[s - 1] == ws[s - 1 + q] or e < len(ws) and ws[e] == ws[e - q]:
                continue
            out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def report(i, text):
    ws = words(text)
    h, n = zlib.crc32(("" if i is None else str(i)).encode()), len(words(text))
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
    runs = brute(ws) if n < 300 else P.runs_of(ws)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *told, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_words(letters):
    rnd = random.Random(letters)
    for _ in range(150):
        ws = [rnd.choice("abc"[:letters]) for _ in range(rnd.randrange(40))]
        if rnd.random() < 0.6:
            unit = [rnd.choice("abc") for _ in range(rnd.randrange(1, 6))]
            at = rnd.randrange(len(ws) + 1)
            ws[at:at] = (unit * 6)[: rnd.randrange(3 * len(unit), 6 * len(unit) + 1)]
        assert P.runs_of(ws) == brute(ws), ws


def test_long_lags_and_many_stretches():
    rnd = random.Random(4)
    unit = [f"w{rnd.randrange(400)}" for _ in range(700)]
    ws = ["x"] + unit * 5 + unit[:30] + ["y"] + ["z"] * 7
    assert (1, 3530, 700) in P.runs_of(ws) and P.runs_of(ws)[-1] == (3532, 7, 1)
    stretches = [w for k in range(300) for w in (["a"] * 6 + [f"b{k}"])]
    assert P.runs_of(stretches) == [(7 * k, 6, 1) for k in range(300)]
    assert P.runs_of(["e"] * 20_000) == [(0, 20_000, 1)]


def test_bits():
    for x in (0, 1, 0b1011, 0b111000110, (1 << 300) - 1, int("10" * 300, 2), int("1101" * 200, 2)):
        text, spans = f"{x:b}"[::-1], []
        for k, bit in enumerate(text):
            if bit == "1":
                if k and text[k - 1] == "1":
                    spans[-1] = (spans[-1][0], k)
                else:
                    spans.append((k, k))
        assert P._spans(x) == spans


def test_report_matches_definition(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randrange(60))) + " \t\n"[: i % 4]) for i in range(120)]
    rows += [(3, "a b a b a b a b a b"), (None, "q " * 12), (None, None), (7, "Ünï 你 " * 9)]
    got = [tuple(r) for r in P.run_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted((report(*r) for r in rows), key=str)


def test_awkward_and_empty(spark):
    rows = awkward_rows()
    got = [tuple(r) for r in P.run_report(awkward(spark)).collect()]
    assert sorted(got, key=str) == sorted((report(r[0], r[1]) for r in rows), key=str)
    assert P.run_report(empty(spark)).count() == 0


def test_operator_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", "r", None)], "n_words int, text string, runs string, collapsed string")
    out = P.periodic_runs(df, keep=("n_words", "text", "runs", "collapsed"))
    assert out.columns == ["n_words", "text", "runs", "collapsed", "n_words_", "runs_", "collapsed_"]
    r = out.first()
    assert (r["n_words_"], [tuple(x) for x in r["runs_"]], r["collapsed_"]) == (7, [(0, 6, 1)], "a b")
