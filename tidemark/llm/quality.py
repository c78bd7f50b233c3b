"""Quality rules: statistics of texts and decision lists learned from labelled rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of, words_of
from tidemark.scratch import written

#: What the rules may test; all are ratios or counts that a reader can check by hand.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "short_share", "line_words")
#: Characters of each count.
SYMBOLS, UPPER, DIGITS = "[#*$%&|<>]", "[A-Z]", "[0-9]"
#: A word of so many characters is short.
SHORT = 3
#: A rule cuts at so many quantiles of the rows that are not covered yet, and of the bad ones among them.
CUTS, BAD_CUTS = 15, 31
MAX_RULES = 64
MAX_TESTS = 3
#: A rule must cover this share of the bad rows it is grown on (three at least), and be right this often when pruned.
MIN_COVER, MIN_ROWS = 0.005, 3
MIN_PRECISION = 0.75


def text_statistics(docs: DataFrame, keep=("doc_id",), text_column: str = "text") -> DataFrame:
    """The columns ``keep`` and, of each whole text, the counts that the base rule and the features need.

    Null and empty texts have no words and zero counts. Words and windows of three words are compared
    by 64-bit hashes within one text; only texts in which two windows agree are sorted by them.
    """
    text = F.col("_t")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(*keep, text_of(text_column).alias("_t"))
    a = a.select(*keep, "_t", words_of(text).alias("_w"), lines.alias("_l"))
    w = F.col("_w")
    a = a.select(*keep, "_t", "_w", "_l", F.transform(w, lambda x: F.xxhash64(x)).alias("_x"))
    x = F.col("_x")
    n = F.size(x)
    windows = F.when(n >= 3, F.transform(F.slice(x, F.lit(1), n - 2), lambda h, i: F.xxhash64(h, F.get(x, i + 1), F.get(x, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    count = lambda kind: F.regexp_count(text, F.lit(kind)).cast("long")
    a = a.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(x)).cast("long").alias("n_distinct"),
        count(UPPER).alias("n_upper"),
        count(DIGITS).alias("n_digits"),
        F.size(F.filter(w, lambda v: F.length(v) <= SHORT)).cast("long").alias("n_short"),
        windows.alias("_h"),
    )
    stats = [c for c in a.columns if c not in (*keep, "_h")]
    h = F.col("_h")
    ordered = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    a = a.select(*keep, *stats, ordered.alias("_s"))
    s = F.col("_s")
    twice = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]))
    a = a.select(*keep, *stats, F.sort_array(F.array_compact(twice)).alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    return a.select(*keep, *stats, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "short_share": share("n_short", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }[name]


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self, value=feature) -> Column:
        return value(self.feature) > self.cut if self.above else value(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """A text that passes every test is bad."""

    tests: tuple[Test, ...]

    def column(self, value=feature) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column(value)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def merged(tests: tuple[Test, ...]) -> tuple[Test, ...]:
    """One test for each feature and side, the tightest, where the first of them stands."""
    out: dict[tuple[str, bool], Test] = {}
    for t in tests:
        old = out.get((t.feature, t.above))
        out[t.feature, t.above] = t if old is None else Test(t.feature, t.above, (max if t.above else min)(old.cut, t.cut))
    return tuple(out.values())


def is_bad(rules: list[Rule], value=feature) -> Column:
    """The ordered list as one conditional expression; the first rule that holds decides."""
    if not rules:
        return F.lit(False)
    out = F.when(rules[0].column(value), F.lit(True))
    for r in rules[1:]:
        out = out.when(r.column(value), F.lit(True))
    return out.otherwise(F.lit(False))


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    """FOIL's information gain of a test."""
    if p1 <= 0:
        return -1.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


class _Grower:
    """Grows conjunctions on the rows that no rule covers yet; ``growing`` has the features as columns."""

    def __init__(self, growing: DataFrame, cuts: int, bad_cuts: int, max_tests: int):
        self.max_tests = max_tests
        share = lambda n: [i / (n + 1) for i in range(1, n + 1)]
        points = growing.agg(*[F.percentile_approx(f, share(cuts), 10000).alias(f"all_{f}") for f in FEATURES], *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), share(bad_cuts), 10000).alias(f"bad_{f}") for f in FEATURES]).first()
        edges = {f: sorted({*(points[f"all_{f}"] or []), *(points[f"bad_{f}"] or [])}) for f in FEATURES}

        def bin_of(f: str) -> Column:
            return F.size(F.filter(F.lit(edges[f]).cast("array<double>"), lambda cut: cut < F.col(f))).cast("int") if edges[f] else F.lit(0)

        # Bin b of a feature is above b of its cuts. Each step then filters and counts what is here.
        each = F.array(*[F.struct(F.lit(k).alias("f"), bin_of(f).alias("bin"), F.col(f).alias("value")) for k, f in enumerate(FEATURES)])
        self.binned = written(growing.select("bad", *FEATURES, each.alias("each")), "binned")
        self.first = self._counts(())
        self.bad = self._totals(self.first)[0]

    def _counts(self, tests: tuple[Test, ...]) -> list:
        """Of the rows that pass the tests: (feature, bin) -> bad rows, rows, least and largest value."""
        rows = self.binned.filter(Rule(tests).column(F.col)).select("bad", F.explode("each").alias("x")).groupBy("x.f", "x.bin")
        return rows.agg(F.sum("bad").alias("p"), F.count("*").alias("n"), F.min("x.value").alias("low"), F.max("x.value").alias("high")).collect()

    @staticmethod
    def _totals(rows: list) -> tuple[int, int]:
        p = sum(r["p"] for r in rows if r["f"] == 0)
        return p, sum(r["n"] for r in rows if r["f"] == 0) - p

    def _best(self, rows: list, least: float, banned: set) -> tuple[Test | None, int, int]:
        """The test with the largest gain, its cut halfway between the values it parts, and what passes it."""
        p0, n0 = self._totals(rows)
        best, choice = 1e-9, (None, 0, 0)
        if not p0 or not n0:
            return choice
        for k, name in enumerate(FEATURES):
            bins = sorted((r for r in rows if r["f"] == k), key=lambda r: r["bin"])
            p1 = n1 = 0
            for r, after in zip(bins, bins[1:], strict=False):
                p1, n1 = p1 + r["p"], n1 + r["n"] - r["p"]
                for above, p, n in ((False, p1, n1), (True, p0 - p1, n0 - n1)):
                    g = _gain(p0, n0, p, n)
                    if p >= least and g > best + 1e-9 and (name, above) not in banned:
                        best, choice = g, (Test(name, above, (r["high"] + after["low"]) / 2), p, n)
        return choice

    def grow(self, least: float, banned: set) -> tuple[tuple[Test, ...], float]:
        """Tests, and their precision on these rows; no first test is one of the banned (feature, side) pairs."""
        tests, precision, rows = (), 0.0, self.first
        for _ in range(2 * self.max_tests):  # a cut may be tightened later
            if len(merged(tests)) >= self.max_tests:
                break
            test, p, n = self._best(rows, least, set() if tests else banned)
            if test is None:
                break
            tests, precision = (*tests, test), p / (p + n)
            rows = self._counts(tests) if len(merged(tests)) < self.max_tests and n else []
        return tests, precision


def learn_rules(labelled: DataFrame, *, max_rules: int = MAX_RULES, max_tests: int = MAX_TESTS, cuts: int = CUTS, bad_cuts: int = BAD_CUTS) -> list[Rule]:
    """Sequential covering over rows of statistics with ``bad`` (0/1) and ``grow`` (boolean).

    Each rule grows test by test by FOIL gain on the rows marked ``grow`` that no rule covers yet, whose
    quantiles give the cuts; it loses its last tests as long as that raises its precision on the
    others, and takes what it covers away. A rule that is not precise enough there is given up, and
    another first test is tried, until none helps. Counts come from one grouped aggregate a step over
    (feature, bin): what reaches the driver is features x bins, whatever the rows. No labelled
    rows, or only one class: no rules.
    """
    values = written(labelled.select("bad", "grow", *[feature(f).alias(f) for f in FEATURES]), "labelled")
    rules: list[Rule] = []
    least = None
    while len(rules) < max_rules:
        left = values.filter(~is_bad(rules, F.col))
        grower = _Grower(left.filter("grow"), cuts, bad_cuts, max_tests)
        least = max(MIN_ROWS, MIN_COVER * grower.bad) if least is None else least
        rule, banned = None, set()
        while rule is None:
            tests, precision = grower.grow(least, banned)
            if not tests:
                return rules
            if precision >= MIN_PRECISION:
                rule = _pruned(tests, left.filter("NOT grow"))
            banned.add((tests[0].feature, tests[0].above))
        rules.append(rule)
    return rules


def _pruned(tests: tuple[Test, ...], rows: DataFrame) -> Rule | None:
    """The first of the tests, as many as are most precise on the rows; None if that is not enough."""
    passed = [Rule(tests[: i + 1]).column(F.col) for i in range(len(tests))]
    held = rows.agg(*[F.count(F.when(c, F.lit(1))).alias(f"n{i}") for i, c in enumerate(passed)], *[F.coalesce(F.sum(F.when(c, F.col("bad"))), F.lit(0)).alias(f"p{i}") for i, c in enumerate(passed)]).first()
    worth = [(held[f"p{i}"] + 1) / (held[f"n{i}"] + 2) for i in range(len(tests))]
    keep = max(range(len(tests)), key=lambda i: (round(worth[i], 3), -i))
    return Rule(merged(tests[: keep + 1])) if worth[keep] >= MIN_PRECISION else None


def quality_report(docs: DataFrame, labels: DataFrame, *, text_column: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept.

    The list is learned from every labelled row with quality 0 or 1 (two of three, by crc32 of the
    id, grow the rules and the third prunes them); a text is kept if the base rule holds and no
    learned rule calls it bad. Null and empty texts have no words and fail the base rule; very long
    texts are counted whole; repeated rows are counted each; a document that is labelled both ways
    counts as bad; without labels of both kinds there are no rules; an empty table gives no rows;
    other columns are not read, so none can clash.
    """
    stats = written(text_statistics(docs, text_column=text_column), "stats")
    marks = labels.filter("quality IN (0, 1)").select(F.col("doc_id").alias("_d"), (1 - F.col("quality")).cast("long").alias("bad")).groupBy("_d").agg(F.max("bad").alias("bad"))
    grow = F.crc32(F.concat(F.lit("grow"), F.col("doc_id").cast("string")).cast("binary")) % 3 != 0
    labelled = stats.join(marks, F.col("doc_id") == F.col("_d")).drop("_d").withColumn("grow", grow)
    rules = learn_rules(labelled)
    return with_verdict(stats, rules)


def with_verdict(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    failed = base_failed()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~is_bad(rules)).alias("kept"))
