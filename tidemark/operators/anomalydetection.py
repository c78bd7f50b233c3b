"""Anomalies by the product of value frequencies."""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.args import ArgumentError, names_of
from tidemark.functions.quantiles import quantile, values_at_ranks
from tidemark.scratch import written

# Actions by method, floors of probabilities, steps of the thresholds.
ACTIONS = {"histogram": ("filter", "annotate", "summary"), "zscore": ("filter", "annotate", "summary"), "iqr": ("remove", "rm", "transform", "tf")}
UNSEEN, LEAST = 1e-10, 1e-50
SHIFT = {"strict": (-0.3, -0.5), "lenient": (0.5, 1.0), "very_lenient": (1.0, 2.0)}
COVERAGE = 0.91
SAME = 1e-10

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"


def _text(c: Column, kind: T.DataType) -> Column:
    """A value as text; null, NaN and infinities are "null"."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit("null")).otherwise(whole)
    return F.coalesce(c.cast("string"), F.lit("null"))


def _number(text: Column, c: Column, kind: T.DataType) -> Column:
    """The finite number a value is or spells."""
    if isinstance(kind, _NUMERIC):
        x = c.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r'^"+|"+$', ""), r"^'+|'+$", ""))
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def anomalydetection(df: DataFrame, *, method: str = "histogram", action: str | None = None, bins: int = 10, cutoff: bool = True, pthresh: float = 0.01, sensitivity: str = "default", param: float = 1.5, uselower: bool = False, mark: bool = False, fields: str = "", partition_by: list[str] | None = None) -> DataFrame:
    """Score each row by the product of its values' frequencies over the whole table, or over its scope: the
    rows that agree in ``partition_by`` (nulls agree). See ACTIONS.

    filter / remove: flagged / other rows with log_event_prob, max_freq, probable_cause and
    probable_cause_freq; annotate: all rows with is_anomaly before these; summary: one row (a
    scope, after its columns); transform: the schema as it is, numeric columns of flagged rows clamped
    (nulls stay null). A column whose values are numbers in more than four of five rows is cut into
    ``bins`` of equal counts if it has more distinct values, those less than SAME from the one before not counted.

    All statistics are tables with a row for each scope, or scope and field: frequencies from counts of
    equal values, quantiles from running sums over ranges of them, all scopes and fields in one pass, so
    that the number of jobs does not grow with them. Rows are joined once to the scores of their combination of keys. ``mark`` has no effect. An
    empty table gives no rows with the full schema; columns of any name pass through.
    """
    if method not in ACTIONS:
        raise ArgumentError(f"unknown method {method}")
    action = action or ("transform" if method == "iqr" else "filter")
    if action not in ACTIONS[method]:
        raise ArgumentError(f"action {action} does not go with method {method}")
    if bins < 1 or not 0 < pthresh < 1 or param <= 0:
        raise ArgumentError("bins, pthresh or param out of range")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names, scopes = names_of(fields) or df.columns, partition_by or []
    for n in (*names, *scopes):
        if n not in kinds:
            raise ArgumentError(f"field '{n}' not found")
    plain = {c: f"c{i}" for i, c in enumerate(df.columns)}
    base = df.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()])
    scope = F.to_json(F.struct(*[plain[c] for c in scopes]), {"ignoreNullFields": "false"}) if scopes else F.lit("")
    texts = [_text(F.col(plain[n]), kinds[n]) for n in names]
    base = base.select("*", scope.alias("scope"), *[t.alias(f"t{j}") for j, t in enumerate(texts)])
    base = base.select("*", *[_number(F.col(f"t{j}"), F.col(plain[n]), kinds[n]).alias(f"x{j}") for j, n in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("f"), F.col(f"t{j}").alias("text"), F.col(f"x{j}").alias("value")) for j in range(len(names))]))
    values = written(base.select("scope", each.alias("e")).groupBy("scope", "e.f", "e.text", "e.value").agg(F.count("*").alias("n")), "values")
    models = _models(values, bins)
    freqs = written(_frequencies(values, models, bins), "freqs")
    shapes = models.groupBy(F.col("scope").alias("of")).agg(F.array_sort(F.collect_list(F.struct("f", "kind", "binned", "inner"))).alias("m"))  # a number of each field
    keyed = base.join(shapes, F.col("scope") == F.col("of")).drop("of")
    keyed = keyed.select(*plain.values(), "scope", *[_key(F.get("m", F.lit(j)), F.col(f"t{j}"), F.col(f"x{j}"), bins).alias(f"k{j}") for j in range(len(names))])
    keys = [f"k{j}" for j in range(len(names))]
    scored = written(_scored(keyed.groupBy("scope", *keys).agg(F.count("*").alias("n")), shapes, freqs, names), "scored")
    told = _thresholds(scored, shapes, method, cutoff, pthresh, param, sensitivity).join(_max_freqs(freqs, models, len(names)), "scope")
    flag = F.col("lp") < F.col("threshold")
    shown = F.when(flag, F.col("least")).otherwise(F.col("lp"))  # the least of all is the least flagged one
    if action == "summary":
        return _summary(scored, told, keyed, flag, shown, plain, scopes)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ["scope", *keys]])
    own = scored.select(*[F.col(k).alias(f"_{k}") for k in ["scope", *keys]], "lp", "cause", "cause_freq")
    rows = keyed.join(own, same).join(told.withColumnRenamed("scope", "of"), F.col("scope") == F.col("of"))
    columns = [F.col(p).alias(c) for c, p in plain.items()]
    extra = [shown.alias("log_event_prob"), F.col("max_freq"), F.col("cause").alias("probable_cause"), F.col("cause_freq").alias("probable_cause_freq")]
    if action == "filter":
        return rows.filter(flag).select(*columns, *extra)
    if action in ("remove", "rm"):
        return rows.filter(~flag).select(*columns, *extra)
    if action == "annotate":
        return rows.select(*columns, flag.alias("is_anomaly"), *extra)
    return _clamped(rows, base, kinds, plain, flag, param, uselower)


def _models(values: DataFrame, bins: int) -> DataFrame:
    """scope, f (number of the field), kind, total, present (rows with a number), binned and inner (the upper
    edges of its bins). Edges and distinct values come from the numbers of all fields and scopes, laid out together."""
    known = F.col("value").isNotNull()
    facts = values.groupBy("scope", "f").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("present"))
    share = F.col("present") / F.col("total")
    facts = facts.withColumn("kind", F.when(share > 0.8, F.lit("numerical")).when(share < 0.2, F.lit("categorical")).otherwise(F.lit("mixed")))
    facts = written(facts, "facts")
    numerical = facts.filter("kind = 'numerical'").select("scope", "f", "present")
    if numerical.isEmpty():
        return facts.select("*", F.lit(False).alias("binned"), F.lit(None).cast("array<double>").alias("inner"))
    counts = values.filter(known).groupBy("scope", "f", "value").agg(F.sum("n").alias("n")).join(numerical, ["scope", "f"])
    shares = [k / bins for k in range(bins + 1)]
    found = values_at_ranks(counts, ["scope", "f"], F.col("present"), shares, islands=SAME, most=values.count())
    found = found.withColumn("edges", F.array(*[quantile(p) for p in shares]))
    # An edge less than SAME from the last one kept goes.
    cuts = F.aggregate("edges", F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.abs(x - F.get(acc, F.size(acc) - 1)) >= SAME), F.concat(acc, F.array(x))).otherwise(acc))
    found = found.select("scope", "f", (F.col("islands") > bins).alias("binned"), F.slice(cuts, F.lit(2), F.size(cuts)).alias("inner"))
    return written(facts.join(found, ["scope", "f"], "left").withColumn("binned", F.coalesce("binned", F.lit(False))), "models")


def _key(model: Column, text: Column, value: Column, bins: int) -> Column:
    """What rows must share to count as equal in a field: a bin, a number's text (null: no number), or the text."""
    in_bin = F.least(F.size(F.filter(model["inner"], lambda edge: edge <= value)), F.lit(bins - 1)).cast("string")
    return F.when(model["kind"] == "numerical", F.when(value.isNotNull(), F.when(model["binned"], in_bin).otherwise(text))).otherwise(text)


def _frequencies(values: DataFrame, models: DataFrame, bins: int) -> DataFrame:
    """scope, f, key, freq (its share of the rows that have one) and values (distinct ones with that key)."""
    model = F.struct("kind", "binned", "inner")
    known = F.when(F.col("kind") == "numerical", F.col("present")).otherwise(F.col("total"))
    keyed = values.join(models, ["scope", "f"]).select("scope", "f", "n", known.alias("known"), _key(model, F.col("text"), F.col("value"), bins).alias("key"))
    return keyed.filter("key IS NOT NULL").groupBy("scope", "f", "key").agg((F.sum("n") / F.max("known")).alias("freq"), F.count("*").alias("values"))


def _scored(combined: DataFrame, shapes: DataFrame, freqs: DataFrame, names: list[str]) -> DataFrame:
    """Combinations of keys with lp (the logarithm of the product of their frequencies), cause and cause_freq: the
    field of least frequency, the first of equals, of the categorical ones if there are any."""
    x = combined.join(shapes, F.col("scope") == F.col("of")).drop("of")
    for j in range(len(names)):
        own = freqs.filter(F.col("f") == j).select(F.col("scope").alias("of"), F.col("key"), F.col("freq").alias(f"f{j}"))
        x = x.join(own, (F.col("scope") == F.col("of")) & (F.col(f"k{j}") == F.col("key")), "left").drop("of", "key")
    freq = [F.col(f"f{j}") for j in range(len(names))]
    prob = reduce(mul, [F.coalesce(f, F.lit(UNSEEN)) for f in freq], F.lit(1.0))
    some = F.exists("m", lambda k: k["kind"] == "categorical")
    asked = [F.when(some & (F.get("m", F.lit(j))["kind"] != "categorical"), F.lit(None)).otherwise(freq[j]) for j in range(len(names))]
    best = F.least(*asked) if len(asked) > 1 else asked[0]  # nulls are passed over
    hit = [F.when(asked[j] == best, F.lit(n)) for j, n in enumerate(names)]
    first = sorted(range(len(names)), key=lambda j: names[j] != "value")
    cause = F.coalesce(F.when(some, F.coalesce(*hit, F.lit(None))).otherwise(F.coalesce(*[hit[j] for j in first], F.lit(None))), F.lit(names[0]))
    return x.select("scope", *[f"k{j}" for j in range(len(names))], "n", F.log(F.greatest(prob, F.lit(LEAST))).alias("lp"), cause.alias("cause"), F.coalesce(best, F.lit(1.0)).alias("cause_freq"))


def _max_freqs(freqs: DataFrame, models: DataFrame, n_fields: int) -> DataFrame:
    """scope, max_freq: over the frequency of every value of every field, the largest, or the sum of the
    largest up to the first total of COVERAGE or more, from counts of equal frequencies (of n rows there are at
    most the root of 2 n)."""
    kinds = models.groupBy("scope").agg((F.sum((F.col("kind") == "categorical").cast("int")) >= n_fields // 2).alias("largest"))
    every = freqs.groupBy("scope", "freq").agg(F.sum("values").alias("m"))
    before = F.coalesce(F.sum(F.col("freq") * F.col("m")).over(Window.partitionBy("scope").orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    short = F.ceil((COVERAGE - F.col("before")) / F.col("freq") - 1e-9)  # so many more of these reach it
    steps = every.withColumn("before", before).withColumn("short", short)
    upto = F.col("before") + F.least(F.greatest("short", F.lit(1)), "m") * F.col("freq")
    sums = steps.groupBy("scope").agg(F.max("freq").alias("top"), F.max_by(upto, F.when(F.col("short") <= F.col("m"), F.col("freq"))).alias("covered"), F.sum(F.col("freq") * F.col("m")).alias("whole"))
    return sums.join(kinds, "scope").select("scope", F.when(F.col("largest"), F.col("top")).otherwise(F.coalesce("covered", "whole")).alias("max_freq"))


def _thresholds(scored: DataFrame, shapes: DataFrame, method: str, cutoff: bool, pthresh: float, param: float, sensitivity: str) -> DataFrame:
    """scope, threshold and least (log probability), from the counts of equal log probabilities."""
    spread = scored.groupBy("scope", F.col("lp").alias("value")).agg(F.sum("n").alias("n"))
    means = spread.groupBy(F.col("scope").alias("of")).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("total"), F.min("value").alias("least"))
    counts = spread.join(means, F.col("scope") == F.col("of")).drop("of")
    n = F.col("total")
    disc = "CAST(FLOOR((total + 1) / 2) AS BIGINT) - 1"
    k = F.expr("CAST(FLOOR(GREATEST(0.01D * total, 3.0D)) AS BIGINT)")
    kth = "LEAST(CAST(FLOOR(GREATEST(0.01D * total, 3.0D)) AS BIGINT), total) - 1"
    square = F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2)
    found = values_at_ranks(counts, ["scope"], n, [0.25, 0.5, 0.75], more=[disc, kth], take=["mean", "least"], aggs=[square.alias("square"), F.count("*").alias("distinct")], most=scored.count())
    found = found.join(shapes, F.col("scope") == F.col("of")).drop("of")
    at, mean = F.col("at"), F.col("mean")
    q1, median, q3 = (quantile(p) for p in (0.25, 0.5, 0.75))
    std = F.when(F.col("distinct") > 1, F.sqrt(F.col("square") / n)).otherwise(F.lit(0.0))
    iqr = q3 - q1
    base = q1 - 1.5 * iqr
    if method == "zscore":
        out = F.when(std > 0, mean + math.log(pthresh) * std).otherwise(mean - 3)
    elif method == "iqr":
        out = q1 - param * iqr
    elif not cutoff:
        out = base
    else:
        mad = median - F.element_at(at, F.expr(disc))  # half the middle gap: the deviations are not sorted before their median is taken
        by_mad = F.when(mad > 0, median - 3 * mad).otherwise(base)
        mixed = F.greatest(base, by_mad, F.when(k < n, F.element_at(at, F.expr(kth)) + 0.001))
        numbers = F.least(base, by_mad, F.when(std > 0, mean - 3 * std).otherwise(base))
        categorical = F.forall("m", lambda x: x["kind"] == "categorical")
        out = F.when(categorical, F.col("least") + 0.001).when(F.exists("m", lambda x: x["kind"] == "mixed"), mixed).otherwise(numbers)
    if sensitivity in SHIFT:
        times, fixed = SHIFT[sensitivity]
        out = out + F.when(iqr > 0, times * iqr).otherwise(F.lit(fixed))
    return found.select("scope", out.alias("threshold"), "least")


def _summary(scored: DataFrame, told: DataFrame, keyed: DataFrame, flag: Column, shown: Column, plain: dict[str, str], scopes: list[str]) -> DataFrame:
    rows = scored.join(told, "scope")
    sizes = rows.groupBy(F.col("scope").alias("of")).agg(F.sum("n").alias("total"), F.sum(F.when(flag, F.col("n")).otherwise(F.lit(0))).alias("flagged"), F.max("threshold").alias("threshold"), F.max(shown).alias("high"), F.min(shown).alias("low"))
    counts = rows.groupBy("scope", shown.alias("value")).agg(F.sum("n").alias("n")).join(sizes, F.col("scope") == F.col("of")).drop("of")
    found = values_at_ranks(counts, ["scope"], F.col("total"), [0.25, 0.75], take=["flagged", "threshold", "high", "low"], most=scored.count())
    q1, q3 = (quantile(p) for p in (0.25, 0.75))
    out = [F.col("flagged").alias("num_anomalies"), F.col("threshold").alias("thresh"), F.col("high").alias("max_logprob"), F.col("low").alias("min_logprob"), q1.alias("1st_quartile"), q3.alias("3rd_quartile")]
    if not scopes:  # one row, of an empty table too
        one = found.select(*out)
        zero = {"num_anomalies": F.lit(0).cast("bigint"), "thresh": F.lit(0.0)}
        return one.agg(*[F.coalesce(F.max(f"`{c}`"), zero.get(c, F.lit(None))).alias(c) for c in one.columns])
    named = keyed.groupBy(F.col("scope").alias("of")).agg(*[F.first(plain[c]).alias(plain[c]) for c in scopes])
    return found.join(named, F.col("scope") == F.col("of")).select(*[F.col(plain[c]).alias(c) for c in scopes], *out)


def _clamped(rows: DataFrame, base: DataFrame, kinds: dict[str, T.DataType], plain: dict[str, str], flag: Column, param: float, uselower: bool) -> DataFrame:
    """Flagged rows' numbers within their scope's quartiles and ``param`` times what lies between those."""
    numeric = [c for c, k in kinds.items() if isinstance(k, (T.LongType, T.DoubleType))]
    bound = dict.fromkeys(numeric)
    if numeric:
        each = F.explode(F.array(*[F.struct(F.lit(plain[c]).alias("c"), F.col(plain[c]).cast("double").alias("value")) for c in numeric]))
        counts = base.select("scope", each.alias("e")).filter("e.value IS NOT NULL AND NOT isnan(e.value)").groupBy("scope", "e.c", "e.value").agg(F.count("*").alias("n"))
        counts = written(counts, "numbers")
        sizes = counts.groupBy("scope", "c").agg(F.sum("n").alias("total"))
        found = values_at_ranks(counts.join(sizes, ["scope", "c"]), ["scope", "c"], F.col("total"), [0.25, 0.75], most=counts.count())
        q1, q3 = (quantile(p) for p in (0.25, 0.75))
        ends = F.struct((q1 - param * (q3 - q1)).alias("low"), (q3 + param * (q3 - q1)).alias("high"))
        bounds = found.groupBy(F.col("scope").alias("in")).agg(F.map_from_entries(F.collect_list(F.struct("c", ends.alias("b")))).alias("bounds"))  # a number of each column
        rows = rows.join(bounds, F.col("scope") == F.col("in"), "left")
        bound = {c: F.element_at("bounds", F.lit(plain[c])) for c in numeric}
    out = []
    for name, p in plain.items():
        c = F.col(p)
        if (b := bound.get(name)) is not None:
            low, high = (b[x].cast(kinds[name]) for x in ("low", "high"))
            capped = F.when(c > high, high)
            capped = capped.when(c < low, low) if uselower else capped
            c = F.when(flag, capped.otherwise(c)).otherwise(c)
        out.append(c.alias(name))
    return rows.select(*out)
