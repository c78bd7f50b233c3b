"""Forward fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.args import names_of
from tidemark.operators import ordered

#: Rows of one key, or of a table without keys, that are filled in one window.
WINDOW_ROWS, KEY_ROWS = 200_000, 5_000_000


def matching(columns: list[str], wanted: str) -> list[str]:
    """Columns named, or whose name begins with what stands before a trailing ``*``; "" is all."""
    names = names_of(wanted)
    if not names:
        return columns
    return [c for c in columns if any(c.startswith(n.rstrip("*")) if n.endswith("*") else c == n for n in names)]


def _known(c: Column, kind: T.DataType) -> Column:
    """The cell, or null where it holds none: a variant can be there and be null."""
    return F.when(~F.is_variant_null(c), c) if isinstance(kind, T.VariantType) else c


def filldown(df: DataFrame, columns: str = "", *, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Give nulls of the matching columns the last value before them in the order (leading ones stay).

    Where no key (without ``partition_by``: the table) has too many rows for one task this is one window.
    Else the rows are laid out in ranges of keys and order, of any types, equal values too; each range is filled apart, and takes
    over what the ranges before it end with. Columns of any name pass through. A cell of a variant column that
    holds a variant null counts as null; where nothing is before it, it stays as it is.
    """
    partition_by = partition_by or []
    fill = [c for c in matching(df.columns, columns) if not isinstance(df.schema[c].dataType, T.NullType) and c not in order_by]
    if not fill:
        return df
    order = [F.col(f"`{c}`").asc_nulls_first() for c in order_by]
    sizes = df.groupBy(*[F.col(f"`{c}`") for c in partition_by]).agg(F.count("*").alias("n")).agg(F.max("n"))
    if (sizes.first()[0] or 0) <= (KEY_ROWS if partition_by else WINDOW_ROWS):
        window = Window.partitionBy(*partition_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = {c: F.coalesce(F.last(_known(F.col(f"`{c}`"), df.schema[c].dataType), ignorenulls=True).over(window), F.col(f"`{c}`")) for c in fill}
        return df.select(*[last[c].alias(c) if c in last else F.col(f"`{c}`") for c in df.columns])
    plain = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in plain.items()])
    laid = ordered.lay(rows, [plain[c] for c in partition_by], [F.col(plain[c]).asc_nulls_first() for c in order_by], [plain[c] for c in order_by], "filldown")
    filled = laid.lasts({f"f{i}": _known(F.col(plain[c]), df.schema[c].dataType) for i, c in enumerate(fill)}).rows
    return filled.select(*[F.coalesce(f"f{fill.index(c)}", n).alias(c) if c in fill else F.col(n).alias(c) for c, n in plain.items()])
