"""The functions by name: signatures, argument binding and calls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.args import Arg, ArgumentError, Parameter, from_json, scalars, signatures_json
from tidemark.operators.addtotals import addtotals
from tidemark.operators.anomalydetection import anomalydetection
from tidemark.operators.filldown import filldown
from tidemark.operators.flatten import flatten
from tidemark.operators.predict import predict
from tidemark.operators.samples import count_column, error_producer
from tidemark.operators.transaction import transaction
from tidemark.sources.output_csv import output_csv


@dataclass(frozen=True)
class FunctionSpec:
    name: str
    run: Callable[[DataFrame, list[Arg], list[tuple[str, Arg]], dict], DataFrame]
    signatures: tuple[tuple[Parameter, ...], ...]
    require_ordered: bool = False

    def signatures_json(self) -> str:
        return signatures_json(self.signatures)


def _value(name: str, arg: Arg, *kinds: str):
    if arg.kind not in kinds:
        raise ArgumentError(f"`{name}` must be {' or '.join(kinds)}")
    return arg.value


def _one_text(args: list[Arg], what: str, needed: bool) -> str | None:
    found = scalars(args)
    if len(found) > 1 or needed and not found:
        raise ArgumentError(f"expected one argument, `{what}`")
    return _value(what, found[0], "string") if found else None


def _addtotals(df, args, named, options):
    found = scalars(args)
    if len(found) != 1:  # any other number keeps the default name
        return addtotals(df, **options)
    if found[0].kind != "string":
        raise ArgumentError("`output_column_name` must be a string.")
    return addtotals(df, found[0].value, **options)


def _filldown(df, args, named, options):
    if not options.get("order_by"):
        raise ArgumentError("filldown needs order_by")
    return filldown(df, _one_text(args, "columns", False) or "", **options)


def _flatten(df, args, named, options):
    return flatten(df, _one_text(args, "columns", True))


def _output_csv(df, args, named, options):
    flags = {}
    for name, arg in named:
        if name not in ("append", "tee"):
            raise ArgumentError(f"unknown argument {name}")
        flags[name] = _value(name, arg, "bool")
    return output_csv(df, _one_text(args, "path", True), **flags, **options)


_ALIASES = {"starts_if": "starts_if_field", "ends_if": "ends_if_field"}
_TRANSACTION = ("fields", "starts_with", "starts_with_regex", "starts_if_field", "ends_with", "ends_with_regex", "ends_if_field", "max_span")


def _transaction(df, args, named, options):
    kw = {}
    if (fields := _one_text(args, "fields", False)) is not None:
        kw["fields"] = fields
    for name, arg in named:
        name = _ALIASES.get(name, name)
        if name == "max_events":
            kw[name] = _value(name, arg, "int")
        elif name in _TRANSACTION:
            kw[name] = _value(name, arg, "string", "interval")
        else:
            raise ArgumentError(f"unknown argument {name}")
    return transaction(df, **kw)


def _whole(name: str, arg: Arg) -> int:
    try:
        return int(_value(name, arg, "int", "string"))
    except ValueError as e:
        raise ArgumentError(f"`{name}` must be a whole number") from e


def _predict(df, args, named, options):
    fields = [a.value for a in scalars(args)]
    kw = {"algorithm": "LLP5"}
    for name, arg in named:
        if name == "fields":
            fields.append(_value(name, arg, "string"))
        elif name in ("algorithm", "group_by_fields"):
            kw[name] = _value(name, arg, "string")
        elif name in ("period", "future_timespan", "holdback", "start"):
            kw[name] = max(0, _whole(name, arg)) if name == "period" else _whole(name, arg)
        elif name in ("upper", "lower"):
            kw[name] = float(_value(name, arg, "float", "int", "string"))
        elif name == "nonnegative":
            kw[name] = arg.value if arg.kind == "bool" else str(arg.value).lower() in ("t", "true", "1")
        else:
            raise ArgumentError(f"unknown argument {name}")
    return predict(df, fields, **kw, **options)


_ANOMALY = {"method": ("string",), "action": ("string",), "bins": ("int",), "cutoff": ("bool",), "pthresh": ("float",), "sensitivity": ("string",), "param": ("float", "int"), "uselower": ("bool",), "mark": ("bool",), "fields": ("string",)}


def _anomalydetection(df, args, named, options):
    """Unknown names and values of another type are passed over."""
    kw = {}
    for name, arg in named:
        name = "bins" if name == "n_bins" else name
        if name in _ANOMALY and arg.kind in _ANOMALY[name]:
            kw[name] = arg.value
    return anomalydetection(df, **kw)


def _p(kind: str, name: str | None = None, default=None) -> Parameter:
    return Parameter(kind, name, default)


_TEXT = (_p("STRING"),)
REGISTRY = {
    s.name: s
    for s in (
        FunctionSpec("addtotals", _addtotals, ((), (_p("INT"),))),
        FunctionSpec("output_csv", _output_csv, ((*_TEXT, _p("BOOL", "append", False), _p("BOOL", "tee", False)),)),
        FunctionSpec("transaction", _transaction, ((*_TEXT, *(_p("STRING", n, "") for n in ("starts_with", "starts_with_regex", "starts_if", "ends_with", "ends_with_regex", "ends_if", "max_span")), _p("INT", "max_events", 1000)),), True),
        FunctionSpec("flatten", _flatten, (_TEXT,)),
        FunctionSpec("filldown", _filldown, ((), _TEXT), True),
        FunctionSpec("predict", _predict, ((*_TEXT, _p("STRING", "algorithm", "LLP5"), _p("INT", "period", 0), _p("INT", "future_timespan", 5), _p("INT", "holdback", 0), _p("STRING", "group_by_fields", ""), _p("BOOL", "nonnegative", False), _p("INT", "start", 0)),), True),
        FunctionSpec("anomalydetection", _anomalydetection, ((_p("STRING", "method", "histogram"), _p("STRING", "action", "filter"), _p("INT", "bins", 10), _p("BOOL", "cutoff", True), _p("FLOAT", "pthresh", 0.01), _p("STRING", "sensitivity", "default"), _p("FLOAT", "param", 1.5), _p("BOOL", "uselower", False), _p("BOOL", "mark", False), _p("STRING", "fields", "")),), True),
        FunctionSpec("count_column", lambda df, args, named, options: count_column(df), ((), (_p("INT"),))),
        FunctionSpec("error_producer", lambda df, args, named, options: error_producer(df), ((),)),
    )
}


def call(name: str, df: DataFrame, args=None, named=None, **options) -> DataFrame:
    """Run a function. ``args``: values or Arg; ``named``: a mapping or pairs; both may be JSON text.

    ``options`` go to the operator beside its SQL arguments: order_by and partition_by of filldown, root
    of output_csv, mode of predict, strict of addtotals.
    """
    if name not in REGISTRY:
        raise ArgumentError(f"unknown function {name}")
    args = from_json(args) if isinstance(args, str) else [Arg.of(a) for a in args or ()]
    named = from_json(named, named=True) if isinstance(named, str) else [(k, Arg.of(v)) for k, v in (named.items() if isinstance(named, dict) else named or ())]
    return REGISTRY[name].run(df, args, named, options)
