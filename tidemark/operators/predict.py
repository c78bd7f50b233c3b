"""Forecasts with intervals, a series per group."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.args import ArgumentError, names_of
from tidemark.functions import forecast

# Which model each algorithm name runs, and the lag and least points of each.
MODELS = {"LL": "LL", "LLT": "LLT", "LLP": "LLP", "LLP1": "LLP", "LLP2": "LLP", "LLP5": "LLP5", "LLB": "LL", "LLBMV": "LL", "BILL": "LL", "BILLMV": "LL"}
COUNTS = re.compile(r"^(c|count|dc|distinct_count|estdc)($|\()")
_MICROS_ABOVE = 32_503_680_000
_MONTH_DAYS = 28


def predict(df: DataFrame, fields: str | list[str], *, algorithm: str = "LL", period: int = 0, future_timespan: int = 5, holdback: int = 0, group_by_fields: str | list[str] = "", nonnegative: bool = False, start: int = 0, upper: float = 0.975, lower: float = 0.975, mode: str = "reference") -> DataFrame:
    """Input rows of each group in order of ``_time`` and ``future_timespan`` more, with prediction_F,
    lower_prediction_F and upper_prediction_F for each field F.

    Groups are forecast in parallel, each in one task: the filter is sequential in time. ``mode``
    "reference" gives the rows ahead one early state of the model, "model" the model's own forecast.
    ``start`` has no effect. Two-series algorithms run as a level. Nulls at a series' head are echoed
    and do not enter the model.
    """
    fields = [fields] if isinstance(fields, str) else list(fields)
    groups = names_of(group_by_fields) if isinstance(group_by_fields, str) else list(group_by_fields)
    name = algorithm.upper()
    if name not in MODELS:
        raise ArgumentError(f"unknown algorithm {algorithm}")
    if not fields or not all(fields):
        raise ArgumentError("predict needs a field")
    for c in (*fields, *groups):
        if c not in df.columns:
            raise ArgumentError(f"column '{c}' not found")
    if min(future_timespan, holdback) < 0:
        raise ArgumentError("future_timespan and holdback must not be negative")
    level = (_share(upper) + _share(lower)) / 2
    z = NormalDist().inv_cdf((1 + level) / 2)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields] + [T.StructField(f"{p}prediction_{f}", T.DoubleType()) for f in fields for p in ("", "lower_", "upper_")])
    filler = {f.name: None if f.nullable else "" if isinstance(f.dataType, T.StringType) else 0 for f in df.schema.fields}
    plan = (fields, groups, name, period, future_timespan, holdback, nonnegative, z, mode, filler)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return forecast_group(pdf, *plan)[[f.name for f in schema.fields]]

    return df.groupBy(*[F.col(f"`{g}`") for g in groups]).applyInPandas(one, schema)


def _share(x: float) -> float:
    if not 0 < x < 100:
        raise ArgumentError("upper and lower lie between 0 and 1 or 1 and 100")
    return x / 100 if x > 1 else float(x)


def forecast_group(pdf: pd.DataFrame, fields, groups, name, period, future, holdback, nonnegative, z, mode, filler) -> pd.DataFrame:
    """One group's rows and forecasts."""
    if "_time" in pdf.columns:
        pdf = pdf.sort_values("_time", kind="stable", na_position="first", ignore_index=True)
    n = len(pdf)
    if holdback > n:
        raise ValueError(f"holdback {holdback} is larger than the series of {n}")
    series = {f: pd.to_numeric(pdf[f], errors="coerce").to_numpy(float) for f in fields}
    heads = [int(np.argmax(~np.isnan(y))) for y in series.values() if np.isnan(y[:1]).any() and (~np.isnan(y)).any()]
    head = heads[0] if heads else 0
    future = min(max(0, future - int(np.isnan(y).sum())) for y in series.values())
    out = _extended(pdf, future, groups, filler)
    for f, y in series.items():
        count = nonnegative or bool(COUNTS.match(f.lower()))
        state, low, high = forecast_series(y, name, period, future, holdback, head, z, count, mode)
        out[f"prediction_{f}"], out[f"lower_prediction_{f}"], out[f"upper_prediction_{f}"] = state, low, high
    return out


def forecast_series(y: np.ndarray, name: str, period: int, future: int, holdback: int, head: int, z: float, count: bool, mode: str):
    model, n = MODELS[name], len(y)
    end = n - holdback
    least = {"LL": 1, "LLT": 2, "LLP5": 2, "LLP": period or 2}[model]
    if end < least or end <= head:
        raise ValueError(f"Too few data points: {end}. Need at least {least} for algorithm {model}")
    both = name.startswith(("LLB", "BILL"))
    lag = max(end, 1) + head if both else {"LL": 0, "LLT": 2, "LLP5": 2, "LLP": period or 2}[model]
    fitted = forecast.fit(model, y[head:end], period, future + holdback)
    one_state = max(lag - head, 1)
    result = []
    for i in range(n + future):
        if i < head + lag and not (both and i >= n):
            k = i if i < head else i - head
            value = y[k] if k < n and not math.isnan(y[k]) else 0.0
            result.append((value, value, value))
            continue
        inside = i < head + n - holdback
        k = i - head if inside or mode == "model" else min(one_state, len(fitted.state) - 1)
        k = min(k, len(fitted.state) - 1)
        state, var = float(fitted.state[k]), float(fitted.var[k])
        if var < 0:
            raise ValueError("the variance of a prediction is negative")
        width = z * math.sqrt(var)
        result.append((state, max(0.0, state - width) if count else state - width, state + width))
    return tuple(np.array(c) for c in zip(*result, strict=True))


def _extended(pdf: pd.DataFrame, future: int, groups: list[str], filler: dict) -> pd.DataFrame:
    if not future:
        return pdf.copy()
    last = pdf.iloc[-1]
    added = {c: [last[c] if c in groups or c in ("_span", "_spandays") else filler[c]] * future for c in pdf.columns}
    if "_time" in pdf.columns:
        added["_time"] = _times_ahead(pdf, future)
    more = pd.DataFrame(added, columns=pdf.columns)
    return pd.concat([pdf.astype(object), more.astype(object)], ignore_index=True)


def _times_ahead(pdf: pd.DataFrame, future: int) -> list:
    """Times after the last one by the step of _span or _spandays, else of the first two that differ."""
    times = pdf["_time"].dropna()
    if times.empty:
        return [None] * future
    last, text = times.iloc[-1], isinstance(times.iloc[-1], str)
    read = (lambda t: datetime.fromisoformat(t)) if text else (lambda t: t)
    days, span = (float(pdf[c].iloc[0]) if c in pdf.columns and pd.notna(pdf[c].iloc[0]) else 0.0 for c in ("_spandays", "_span"))
    head = [read(t) for t in times.iloc[:10]]
    other = next((t for t in head if t != head[0]), None)
    if not days and not span and other is None:
        return [None] * future
    if isinstance(last, (int, np.integer, float)):
        micros = abs(last) > _MICROS_ABOVE
        unit = 1_000_000 if micros else 1
        step = days * 86400 * unit or span * unit or (int((other - head[0]) // unit) * unit or other - head[0])
        if days >= _MONTH_DAYS:
            base = pd.Timestamp(int(last), unit="us" if micros else "s")
            return [int((base + pd.DateOffset(months=int(days // _MONTH_DAYS) * (i + 1))).value // (1000 if micros else 1_000_000_000)) for i in range(future)]
        return [int(last + step * (i + 1)) for i in range(future)]
    base = read(last)
    if days >= _MONTH_DAYS:
        ahead = [pd.Timestamp(base) + pd.DateOffset(months=int(days // _MONTH_DAYS) * (i + 1)) for i in range(future)]
    else:
        step = timedelta(days=days) or timedelta(seconds=span) or timedelta(seconds=math.trunc((other - head[0]).total_seconds())) or other - head[0]
        ahead = [base + step * (i + 1) for i in range(future)]
    if text:
        return [t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}" + (t.strftime("%z") or "+0000") for t in ahead]
    return ahead
