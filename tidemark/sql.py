"""The functions in SQL: polymorphic table functions over TABLE arguments.

``register(spark)`` makes ``SELECT * FROM addtotals(TABLE(t))`` and its like work. The row-wise and
stateful ones are Python table functions, which Spark calls with the rows in the order they need;
those that are whole plans (transaction, anomalydetection, predict, output_csv) are reached by
``run_sql(spark, "name", "table or query", ...)``, which hands the relation to the same operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tidemark.args import ArgumentError, names_of
from tidemark.operators.filldown import matching
from tidemark.registry import call

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class _Found(AnalyzeResult):
    """What analyze() found out for eval(): positions of columns, and whether totals are real."""

    at: tuple = field(default=())
    real: bool = False


class _AddTotals:
    def __init__(self, analyze_result: _Found):
        self.at, self.kind = analyze_result.at, float if analyze_result.real else int

    @staticmethod
    def analyze(row: AnalyzeArgument, name: AnalyzeArgument | None = None) -> AnalyzeResult:
        title = "total" if name is None else name.value
        if not isinstance(title, str):
            raise ArgumentError("`output_column_name` must be a string.")
        fields = row.dataType.fields
        at = tuple(i for i, f in enumerate(fields) if isinstance(f.dataType, _WHOLE + _REAL))
        real = any(isinstance(fields[i].dataType, _REAL) for i in at)
        added = [T.StructField(title, T.DoubleType() if real else T.LongType())] if at else []
        return _Found(schema=T.StructType([*fields, *added]), at=at, real=real)

    def eval(self, row, name=None):
        if not self.at:
            yield tuple(row)
            return
        values = [row[i] for i in self.at]
        total = None
        if None not in values:
            total = self.kind(0)
            for v in values:
                total += self.kind(v)
            if self.kind is int and not -(2**63) <= total < 2**63:
                raise OverflowError("Overflowed")
        yield (*row, total)


class _Flatten:
    def __init__(self, analyze_result: _Found):
        self.at = analyze_result.at

    @staticmethod
    def analyze(row: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        names = list(dict.fromkeys(names_of(columns.value or "")))
        fields = {f.name: f for f in row.dataType.fields}
        if not names:
            raise ArgumentError("flatten needs a column name")
        for n in names:
            if n in fields and not isinstance(fields[n].dataType, (T.ArrayType, T.NullType)):
                raise ArgumentError(f"Column '{n}' is not a list type or null type")
        order = list(fields)
        at = tuple(order.index(n) for n in names) if all(n in fields and isinstance(fields[n].dataType, T.ArrayType) for n in names) else None
        out = [T.StructField(f.name, f.dataType.elementType if f.name in names and isinstance(f.dataType, T.ArrayType) else f.dataType) for f in fields.values()]
        return _Found(schema=T.StructType(out), at=at)

    def eval(self, row, columns: str):
        if self.at is None:  # a column is missing or void
            return
        for items in product(*([None] if row[i] is None else row[i] for i in self.at)):
            out = list(row)
            for i, v in zip(self.at, items, strict=True):
                out[i] = v
            yield tuple(out)


class _Filldown:
    """Rows in the given order, each key of ``partition_by`` apart; without keys all in one task, which
    run_sql(spark, "filldown", ...) avoids."""

    def __init__(self):
        self.last: dict[int, object] = {}

    @staticmethod
    def analyze(row: AnalyzeArgument, columns: AnalyzeArgument, order_by: AnalyzeArgument, partition_by: AnalyzeArgument | None = None) -> AnalyzeResult:
        keys = names_of(partition_by.value) if partition_by else []
        return AnalyzeResult(schema=row.dataType, withSinglePartition=not keys, partitionBy=[PartitioningColumn(k) for k in keys], orderBy=[OrderingColumn(n) for n in names_of(order_by.value)])

    def eval(self, row, columns: str, order_by: str, partition_by: str = ""):
        wanted = set(matching(list(row.__fields__), columns))
        out = []
        for i, (n, v) in enumerate(zip(row.__fields__, row, strict=True)):
            if n in wanted:
                v = self.last.get(i) if v is None else v
                self.last[i] = v
            out.append(v)
        yield tuple(out)


class _CountColumn:
    def __init__(self):
        self.n = 0

    @staticmethod
    def analyze(row: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=T.StructType([T.StructField("metric", T.StringType()), T.StructField("column_count", T.LongType())]), withSinglePartition=True)

    def eval(self, row):
        self.n = len(row)

    def terminate(self):
        yield "total_columns", self.n


class _ErrorProducer:
    @staticmethod
    def analyze(row: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=T.StructType([T.StructField("error", T.StringType())]))

    def eval(self, row):
        raise RuntimeError("error_producer always fails")

    def terminate(self):
        raise RuntimeError("error_producer always fails")


def register(spark: SparkSession) -> None:
    for name, cls in (("addtotals", _AddTotals), ("flatten", _Flatten), ("filldown", _Filldown), ("count_column", _CountColumn), ("error_producer", _ErrorProducer)):
        spark.udtf.register(f"{name}_table" if name == "flatten" else name, udtf(cls))  # flatten is a built-in of Spark


def run_sql(spark: SparkSession, name: str, relation: str, args=None, named=None, **options) -> DataFrame:
    """A function over a table's name or a query."""
    df = spark.sql(relation) if " " in relation.strip() else spark.table(relation)
    return call(name, df, args, named, **options)
