"""Runs of periodic words in a text, found lag by lag on bit planes of the word numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of, words_of
from tidemark.scratch import fresh

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Lags from here on are first tried on the words at their multiples.
ANCHOR_LAG = 64
#: Stretches of a lag beyond which its bits are unpacked rather than taken one by one.
MANY = 64
_WORD = re.compile("[^\x20\x09-\x0d]+")


def _planes(ids: np.ndarray) -> list[int]:
    """Plane k has the k-th bit of every word's number, as one big integer; word 0 is its lowest bit."""
    return [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(max(1, int(ids.max()).bit_length()))]


def _long_stretches(same: int, need: int) -> int:
    """The bits from which at least ``need`` bits in a row are set: AND with shifts of doubled width."""
    have = 1
    while same and have < need:
        step = min(have, need - have)
        same &= same >> step
        have += step
    return same


def _spans(bits: int) -> list[tuple[int, int]]:
    """(first, last) of each stretch of set bits."""
    if (bits & ~(bits << 1)).bit_count() > MANY:
        flat = np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 2, "little"), np.uint8), bitorder="little")
        edge = np.flatnonzero(np.diff(flat, prepend=np.uint8(0)))
        return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))
    out, at = [], 0
    while bits:
        skip = (bits & -bits).bit_length() - 1
        bits >>= skip
        width = (~bits & (bits + 1)).bit_length() - 1
        out.append((at + skip, at + skip + width - 1))
        bits >>= width
        at += skip + width
    return out


def _anchored(ids: np.ndarray, lag: int, periods: int) -> bool:
    """Whether a run of that lag is possible: a stretch of ``periods`` lags holds as many multiples of
    the lag in a row, all of which bear the same word."""
    at = ids[::lag]
    same = at[1:] == at[:-1]
    for _ in range(periods - 2):
        same = same[1:] & same[:-1]
    return bool(same.any())


def runs_of(words: list[str], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of each maximal run, by start, then period.

    For a lag p the planes are XORed with themselves shifted by p; the OR of that has a bit wherever
    words p apart differ. A run of length L is a stretch of L - p zeros. The first two planes alone rule
    out most lags. A stretch whose smallest period is less has the very extent of that period's run,
    found before (least_periods is 2 or more, so that period divides p).
    """
    n = len(words)
    if n < max(least_length, least_periods):
        return []
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    planes = _planes(ids)
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, n // least_periods + 1):
        if lag >= ANCHOR_LAG and not _anchored(ids, lag, least_periods):
            continue
        need = max(least_length, least_periods * lag) - lag
        all_, differ = (1 << (n - lag)) - 1, 0
        long = all_
        for part in (planes[:2], planes[2:]):
            for plane in part:
                differ |= plane ^ (plane >> lag)
            long = _long_stretches(all_ & ~differ, need)
            if not long:
                break
        for first, last in _spans(long) if long else ():
            found.setdefault((first, last - first + need + lag), lag)
    return sorted((start, length, lag) for (start, length), lag in found.items())


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, *, text_column: str = "text", least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, n_words, runs (array of start, length, period, in
    words) and collapsed (the text's words without repeated periods, joined by one space).

    A text is one task's work, whole however long: n / least_periods lags of a few operations on n bits
    each, of which the long ones are mostly ruled out by the words at their multiples. Null and empty texts have no runs and an empty
    collapsed text; repeated rows come out alike; ties of words are what runs are made of; an empty
    table gives no rows. Kept columns that are called like a new one make the new one longer by underscores.
    """
    kept = docs.select(*keep)
    names = fresh(kept, "n_words", "runs", "collapsed")
    (text,) = fresh(kept, "text")
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, collapsed = [], [], []
            for value in batch.column(batch.num_columns - 1):
                words = _WORD.findall(value.as_py())
                own = runs_of(words, least_length, least_periods)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                collapsed.append(" ".join(collapse(words, own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(runs, kinds), pa.array(collapsed, pa.string())], [*batch.schema.names[:-1], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    schema = f"{fields}{', ' if fields else ''}`{names[0]}` bigint, `{names[1]}` array<struct<start:bigint,length:bigint,period:bigint>>, `{names[2]}` string"
    return docs.select(*keep, text_of(text_column).alias(text)).mapInArrow(find, schema)


def with_tails(words: Column, id_column: str) -> Column:
    """The words, with periodic tails put into the texts of one id in ten (crc32 of the id modulo 10 is 0):
    a test pattern. A null id counts as the empty text."""
    h = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    begin = g % n
    period = F.lit(1) + F.floor((n - begin) / (F.lit(3) + g % 8))
    return F.when((h % 10 == 0) & (n > 0), F.transform(words, lambda w, i: F.when(i < begin, w).otherwise(F.get(words, (begin + (i - begin) % period).cast("int"))))).otherwise(words)


def run_report(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """periodic_runs() of the texts with test tails, as numbers and digests: doc_id, n_runs, start, length,
    period and exponent_milli of the run with the greatest length / period (ties: smallest start, then
    period; null without runs), runs_sha256, collapsed_sha256."""
    split = docs.select(F.col(id_column).alias("doc_id"), words_of(text_of(text_column)).alias("words"))
    made = split.select("doc_id", F.array_join(with_tails(F.col("words"), "doc_id"), " ").alias("text"))
    found = periodic_runs(made, keep=("doc_id",))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # The runs come by start, then period, so the first of equals stays.
    best = F.aggregate("runs", none, lambda acc, r: F.when(acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"]), r).otherwise(acc))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    told = found.withColumn("best", best)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
