"""Running values of each key's rows in one order, over ranges of that order, so that a hot key is many tasks.

A table is laid out once in ranges of (keys, order). What a range hands on to the next, a row for each
key (and each further part of the key), is summed or overlaid range by range; every row then takes its
own range's running value on top of what was handed on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import written

#: Rows of a range, and ranges at most (beyond, they grow longer).
RANGE_ROWS, MOST_RANGES = 200_000, 20_000


@dataclass
class Laid:
    """``rows`` have _part, the range, and _no, which numbers all rows in order (with gaps)."""

    rows: DataFrame
    keys: list[str]
    parts: int

    def on(self, rows: DataFrame) -> Laid:
        """The same layout over some of the rows, or with other columns."""
        return replace(self, rows=rows)

    def settled(self, name: str) -> Laid:
        """The rows written, where a next step will read them twice."""
        return self.on(written(self.rows, name)) if self.parts > 1 else self

    def _own(self, more: tuple[str, ...], last: int):
        return Window.partitionBy("_part", *self.keys, *more).orderBy("_no").rowsBetween(Window.unboundedPreceding, last)

    def _handed(self, sums: DataFrame, by: list[str], **told: Column) -> DataFrame:
        """``told`` over the sums of all earlier ranges of the same key; rows of a key's first range tell nothing."""
        earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        out = sums
        for name, value in told.items():
            out = out.withColumn(name, value.over(earlier))
        some = F.lit(False)
        for n in told:
            some = some | F.col(n).isNotNull()
        return out.filter(some).select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_b{i}") for i, k in enumerate(by)], *told)

    def _with(self, rows: DataFrame, handed: DataFrame, by: list[str]) -> DataFrame:
        same = F.col("_part") == F.col("_p")
        for i, k in enumerate(by):
            same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
        return rows.join(handed, same, "left").drop("_p", *[f"_b{i}" for i in range(len(by))])

    def last(self, value: Column, name: str, *more: str, inclusive: bool = True) -> Laid:
        """Add the last non-null ``value`` of the rows so far that agree in the keys and in ``more``."""
        return self.lasts({name: value}, *more, inclusive=inclusive)

    def lasts(self, values: dict[str, Column], *more: str, inclusive: bool = True) -> Laid:
        """last() of several values at once, by name."""
        by, names = [*self.keys, *more], list(values)
        held, carried = [f"_v{i}" for i in range(len(names))], [f"_h{i}" for i in range(len(names))]
        rows = self.rows.withColumns(dict(zip(held, values.values(), strict=True)))
        window = self._own(more, 0 if inclusive else -1)
        own = rows.withColumns({n: F.last(v, ignorenulls=True).over(window) for n, v in zip(names, held, strict=True)})
        if self.parts == 1:
            return self.on(own.drop(*held))
        sums = rows.groupBy("_part", *by).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_no"))).alias(f"_m{i}") for i, v in enumerate(held)])
        handed = self._handed(sums, by, **{h: F.last(f"_m{i}", ignorenulls=True) for i, h in enumerate(carried)})
        joined = self._with(own, handed, by)
        return self.on(joined.withColumns({n: F.coalesce(n, h) for n, h in zip(names, carried, strict=True)}).drop(*held, *carried))

    def total(self, value: Column, name: str, inclusive: bool = True) -> Laid:
        """Add the sum of ``value``, a whole number, over the key's rows so far."""
        rows = self.rows.withColumn("_value", value.cast("bigint"))
        own = rows.withColumn(name, F.coalesce(F.sum("_value").over(self._own((), 0 if inclusive else -1)), F.lit(0).cast("bigint")))
        if self.parts == 1:
            return self.on(own.drop("_value"))
        handed = self._handed(rows.groupBy("_part", *self.keys).agg(F.sum("_value").alias("_m")), self.keys, _h=F.sum("_m"))
        return self.on(self._with(own, handed, self.keys).withColumn(name, F.col(name) + F.coalesce("_h", F.lit(0))).drop("_value", "_h"))

    def depth(self, step: Column, name: str) -> Laid:
        """Add how many are open ahead of each row, where ``step`` is 1 if a row opens one, -1 if it closes
        one (nothing if none is open) and 0 otherwise.

        That is the walk less its lowest point so far. A range is told by the pair (its sum, its lowest
        point), which is how much it leaves open and how much it waits for; pairs compose.
        """
        rows = self.rows.withColumn("_step", step.cast("bigint"))
        rows = rows.withColumn("_walk", F.sum("_step").over(self._own((), 0)))
        own = rows.withColumn("_low", F.min("_walk").over(self._own((), -1)))
        base, lowest = F.lit(0), F.least(F.lit(0), F.col("_low"))
        if self.parts > 1:
            sums = rows.groupBy("_part", *self.keys).agg(F.sum("_step").alias("_m"), F.min("_walk").alias("_l"))
            so_far = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            sums = sums.withColumn("_l", F.coalesce(F.sum("_m").over(so_far), F.lit(0)) + F.col("_l"))
            own = self._with(own, self._handed(sums, self.keys, _h=F.sum("_m"), _hl=F.min("_l")), self.keys)
            base = F.coalesce("_h", F.lit(0))
            lowest = F.least(F.lit(0), "_hl", base + F.col("_low"))
        out = own.withColumn(name, base + F.col("_walk") - F.col("_step") - lowest)
        return self.on(out.drop("_step", "_walk", "_low", "_h", "_hl"))


def lay(df: DataFrame, keys: list[str], order: list[Column], ties: list[str], name: str = "laid", most: int | None = None, distinct: bool = False) -> Laid:
    """``df`` written in order of the keys, then of ``order``. Equal rows of the order
    are told apart by a hash of the columns ``ties``, and rows that agree in those too by their place
    in ``df``, so that many of them do not make one range. ``most``: a bound on the rows, if one is known;
    else they are counted. Where no two rows agree in keys and order (``distinct``), a single range need not be
    written: it comes out the same each time."""
    parts = min(MOST_RANGES, max(1, -(-(df.count() if most is None else most) // RANGE_ROWS)))
    if distinct and parts == 1:
        one = df.repartition(1).sortWithinPartitions(*keys, *order)
        return Laid(one.withColumn("_part", F.lit(0)).withColumn("_no", F.monotonically_increasing_id()), keys, parts)
    by = [*keys, *order, F.xxhash64(*ties), F.asc("_place")]
    ranged = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_place")
    return Laid(written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_no", F.monotonically_increasing_id()), name), keys, parts)


def span_links(laid: Laid, by: list[str], span: int) -> DataFrame:
    """(x, y) for rows with _t, newest first: y is the first row of the same ``by`` that is older than x's
    time less the span. Every row puts a probe at that time; rows and probes are laid out together."""
    rows = laid.rows.select(*by, "_t", "_no")
    none = F.lit(None).cast("bigint")
    both = rows.select(*by, F.col("_t").alias("at"), F.col("_no").alias("event"), none.alias("x")).unionAll(rows.select(*by, F.col("_t") - span, none, "_no"))
    # Oldest first: at the same time a probe comes before the events, and of those the first in order comes last.
    found = lay(both, by, [F.asc("at"), F.expr("event IS NOT NULL").asc(), F.desc("event")], ["x"], "probes").last(F.col("event"), "y")
    return found.rows.filter("x IS NOT NULL AND y IS NOT NULL").select("x", "y")


def reached(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(no): the roots (no) and all that links (x, y), one for each x, lead to from them.

    Links are doubled: one of round k leads 2^k steps on, and only from roots and from where round k - 1
    ends, so tables shrink as chains run together. Then the longest steps are walked first, and what
    they reach goes on by the next shorter ones. Rounds: the logarithm of the longest chain, twice.
    """
    doubled = [written(links, "links")]
    while True:
        f = doubled[-1]
        starts = f.select(F.col("y").alias("no")).distinct().unionAll(roots.select("no"))
        again = f.select(F.col("x").alias("x2"), F.col("y").alias("y2"))
        g = written(f.join(starts, F.col("x") == F.col("no"), "left_semi").join(again, F.col("y") == F.col("x2")).select("x", F.col("y2").alias("y")), "links")
        if g.isEmpty():
            break
        doubled.append(g)
    found = roots.select("no")
    for f in reversed(doubled):
        both = F.array_compact(F.array("no", "y"))
        found = found.join(f, F.col("no") == F.col("x"), "left").select(F.explode(both).alias("no"))
    return found
