"""Exact ranks and quantiles of many groups at once, from counts of equal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import lay


def values_at_ranks(counts: DataFrame, by: list[str], total: Column, shares: list[float], *, more: list[str] = (), take: list[str] = (), aggs: list[Column] = (), islands: float | None = None, most: int | None = None) -> DataFrame:
    """A row for each group of ``by``: at, a map from ranks (from 0) to values, total (n in all), ``take`` (columns
    that agree within a group) and ``aggs`` of its rows.

    ``counts`` has value and n, each value of a group once. Ranks are those about the ``shares`` (see quantile()) and ``more``, SQL over ``total`` and ``take``. The
    values are laid out in ranges of (group, value); running sums of n, carried from range to range,
    tell which ranks a value has, and only values that are asked for are gathered. With ``islands``
    also their number: stretches of values that are all less than that from the one before. ``most``
    bounds the rows of ``counts``, if that is known.
    """
    laid = lay(counts.select(*by, "value", "n", total.cast("bigint").alias("total"), *take), by, [F.asc("value")], ["value"], "ranks", most, distinct=True).total(F.col("n"), "_upto")
    if islands is not None:
        laid = laid.settled("upto").last(F.col("value"), "_before", inclusive=False)
        aggs = [*aggs, F.count(F.when(F.col("_before").isNull() | (F.col("value") - F.col("_before") >= islands), F.lit(1))).alias("islands")]
    wanted = [*[r for p in shares for r in (_low(p), _high(p))], *more]
    some = " OR ".join(f"({r} >= _upto - n AND {r} < _upto)" for r in wanted)  # few rows are asked for
    hits = f"transform(filter(array_distinct(array({', '.join(wanted)})), r -> r >= _upto - n AND r < _upto), r -> struct(r, value))"
    rows = laid.rows.withColumn("_hits", F.expr(f"CASE WHEN {some} THEN {hits} END"))
    gathered = F.flatten(F.collect_list("_hits"))
    return rows.groupBy(*by).agg(F.map_from_entries(gathered).alias("at"), F.max("total").alias("total"), *[F.max(c).alias(c) for c in take], *aggs)


def _low(share: float) -> str:
    return f"CAST(FLOOR({share!r}D * (total - 1)) AS BIGINT)"


def _high(share: float) -> str:
    return f"CAST(CEIL({share!r}D * (total - 1)) AS BIGINT)"


def quantile(share: float) -> Column:
    """The quantile, with linear interpolation between neighbours, from the columns at and total of values_at_ranks()."""
    lo, hi = _low(share), _high(share)
    a, b, x = f"element_at(at, {lo})", f"element_at(at, {hi})", f"({share!r}D * (total - 1))"
    return F.expr(f"CASE WHEN {a} = {b} THEN {a} ELSE ({hi} - {x}) * {a} + ({x} - {lo}) * {b} END")
