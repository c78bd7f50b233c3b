import random
from collections import Counter

from helpers import awkward, awkward_rows, empty, prose, words

from tidemark.llm import quality as Q


def brute(text):
    text = text or ""
    w = words(text)
    counts = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i in range(len(w) - 2):
        if counts[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics(spark):
    rows = awkward_rows()
    extra = [(100 + i, t, *rows[0][2:]) for i, t in enumerate(["a b c a b c a b c", "x y z " * 40, "l1\nl1\n\nl2\n l1\nl2", "a a a a a", "# $ % & | < > *", "q\x0bw\x0ce\rr", "y " * 3])]
    df = awkward(spark, rows + extra)
    got = sorted((str(r["doc_id"]), *(r[c] for c in COUNTS)) for r in Q.text_statistics(df).collect())
    assert got == sorted((str(r[0]), *brute(r[1])) for r in rows + extra)


def corpus(spark, n=400):
    rnd = random.Random(6)
    docs, marks = [], []
    for i in range(n):
        bad = rnd.random() < 0.25
        w = prose(rnd, rnd.randrange(80, 200)).split()
        if bad:
            w = [x + rnd.choice(["%%%", "###", ""]) for x in w]
        docs.append((i, " ".join(w)))
        marks.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_learned_list(spark):
    docs, labels = corpus(spark)
    rows = Q.quality_report(docs, labels).join(labels, "doc_id").collect()
    judged = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] == bool(r["quality"]) for r in judged) / len(judged) > 0.97
    assert not any(r["kept"] for r in rows if r["base_failed"])
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_a_rare_kind_of_bad_text_gets_a_rule_of_its_own(spark):
    """Three in a hundred rows are bad by digits alone, far beyond the sixteenths of all rows; a useless first rule does not end the learning."""
    rnd = random.Random(9)
    docs, marks = [], []
    for i in range(900):
        kind = "symbols" if i % 5 == 0 else "digits" if i % 33 == 1 else "noise" if i % 10 == 3 else ""
        w = prose(rnd, rnd.randrange(80, 200)).split()
        w = [x + "%#" if kind == "symbols" else x + "20240613" if kind == "digits" else x for x in w]
        docs.append((i, " ".join(w)))
        marks.append((i, int(not kind or kind == "noise" and rnd.random() < 0.5), 0))
    df, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in Q.quality_report(df, labels).collect() if not r["base_failed"]}
    digits = [i for i in kept if i % 33 == 1 and i % 5]
    clean = [i for i in kept if i % 5 and i % 33 != 1 and i % 10 != 3]
    assert len(digits) > 15 and sum(kept[i] for i in digits) <= 1 and sum(kept[i] for i in clean) > 0.97 * len(clean)


def test_two_opinions_count_as_bad(spark):
    docs, labels = corpus(spark, 60)
    both = labels.unionAll(labels.select("doc_id", (1 - labels["quality"]).alias("quality"), "toxic"))
    assert all(r["kept"] != r["base_failed"] for r in Q.quality_report(docs, both).collect())  # all rows bad: no rules


def test_rules_are_conditional_expressions(spark):
    rules = [Q.Rule((Q.Test("symbols_per_word", True, 0.5), Q.Test("n_words", False, 300.0)))]
    assert str(rules[0]) == "symbols_per_word > 0.5 and n_words <= 300"
    df = spark.sql("SELECT 10L AS n_words, 8L AS n_symbols UNION ALL SELECT 10L, 2L")
    assert sorted(r[0] for r in df.select(Q.is_bad(rules)).collect()) == [False, True]


def test_empty_and_unlabelled(spark):
    docs, labels = corpus(spark, 20)
    assert Q.quality_report(empty(spark), labels).count() == 0
    got = Q.quality_report(awkward(spark), labels.limit(0)).collect()
    assert len(got) == awkward(spark).count() and all(r["kept"] != r["base_failed"] for r in got)


def test_verdicts_by_brute_force(spark):
    """The rules applied in Python to counts taken in Python, over rows the rules were not learned from too."""
    docs, labels = corpus(spark)
    stats = Q.text_statistics(docs).join(labels.select("doc_id", (1 - labels["quality"]).cast("long").alias("bad")), "doc_id").selectExpr("*", "doc_id % 3 != 0 AS grow")
    rules = Q.learn_rules(stats.filter("doc_id < 300"))
    assert rules and all(len({(t.feature, t.above) for t in r.tests}) == len(r.tests) <= Q.MAX_TESTS for r in rules)

    def values(text):
        w = words(text)
        n, chars, symbols, dup, repeat = brute(text)
        lines = [x for x in text.split("\n") if words(x)]
        share = lambda a, b: a / b if b else 0.0
        return {"n_words": n, "mean_word": share(chars, n), "symbols_per_word": share(symbols, n), "dup_line_share": share(dup, len(lines)), "repeat_share": share(repeat, n), "distinct_share": share(len(set(w)), n), "upper_share": share(sum("A" <= c <= "Z" for c in text), chars), "digit_share": share(sum("0" <= c <= "9" for c in text), chars), "short_share": share(sum(len(x) <= 3 for x in w), n), "line_words": share(n, len(lines))}

    texts = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(1000 + i, r[1] or "") for i, r in enumerate(awkward_rows())]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in Q.with_verdict(Q.text_statistics(spark.createDataFrame(texts, "doc_id long, text string")), rules).collect()}
    for i, text in texts:
        x = values(text)
        bad = any(all(x[t.feature] > t.cut if t.above else x[t.feature] <= t.cut for t in r.tests) for r in rules)
        failed = x["n_words"] < 50 or 100 * brute(text)[4] > 50 * x["n_words"]
        assert got[i] == (failed, not failed and not bad)


def test_tests_of_one_side_are_merged():
    t = Q.Test
    assert Q.merged((t("a", False, 0.5), t("b", True, 1.0), t("a", False, 0.2), t("b", True, 3.0), t("a", True, 0.1))) == (t("a", False, 0.2), t("b", True, 3.0), t("a", True, 0.1))
