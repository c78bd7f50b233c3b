"""CSV sink: one file, made or appended to, which is replaced as a whole or stays as it was."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.args import ArgumentError

#: Bytes that a task copies at a time, and those of a row of its work.
COPY_BYTES, CHUNK_BYTES = 4 << 20, 64 << 20
_MANIFEST = "parts.json"


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int
    size: int


class LineWriter(DataSourceArrowWriter):
    """Each task writes its lines to a file of its own; commit lists those that count, in order of partitions, and
    abort leaves nothing behind. Files of attempts that failed or lost a race are not listed."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        if not os.path.isdir(self.folder):
            raise OSError(f"{self.folder} is not there: the driver and all executors must share the folder of the CSV file")
        number, rows, size = TaskContext.get().partitionId(), 0, 0
        path = os.path.join(self.folder, f"{number}-{uuid.uuid4().hex}")
        with open(path, "wb") as out:
            for batch in iterator:
                rows += batch.num_rows
                size += out.write(b"".join(x + b"\n" for x in batch.column(0).cast(pa.binary()).to_pylist()))
        return Part(number, path, rows, size)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        with open(os.path.join(self.folder, _MANIFEST), "w", encoding="utf-8") as out:
            json.dump([[m.path, m.rows, m.size] for m in parts], out)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class LineFiles(DataSource):
    """A sink for one column of lines: files in the folder ``path`` and a manifest of them."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_lines"

    def writer(self, schema: T.StructType, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


def _cell(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSxx")
    elif isinstance(kind, T.TimestampNTZType):
        text = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise ArgumentError(f"column '{name}' cannot be written as CSV")
    else:
        text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\r\n]'), quoted).otherwise(text), F.lit(""))


def resolve(path: str, root: str | None = None) -> Path:
    """A path below ``root`` where one is given; paths that leave it are refused."""
    if not path:
        raise ArgumentError("output_csv needs a path")
    target = Path(path)
    if root:
        base = Path(root).resolve()
        target = (base / path).resolve()
        if base not in target.parents:
            raise ArgumentError(f"path '{path}' leaves {base}")
    return target


def output_csv(df: DataFrame, path: str, append: bool = False, tee: bool = False, *, root: str | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Write the rows to one CSV file; gives a status row, with ``tee`` the rows.

    Executors render the lines and write them as parts to a folder beside the target, which they share
    with the driver; other tasks then copy the parts, and what is appended to, to their places in a new
    file, and only that takes the target's name. Neither the driver nor any one task handles the
    table, and whatever fails, the old file stays as it was. Appending keeps the header of a file that
    has one: columns go by name, others are dropped, missing ones are empty; a missing last line break is
    added. An empty table without rows leaves an empty file. Writers of one file must take turns: the
    last to finish replaces what others did meanwhile.
    """
    target = resolve(path, root).absolute()
    target.parent.mkdir(parents=True, exist_ok=True)
    old = target.stat().st_size if append and target.exists() else 0
    gap = b""
    if old:
        with target.open(newline="", encoding="utf-8") as f:
            header = next(csv.reader(f), [])
        with target.open("rb") as f:
            f.seek(-1, os.SEEK_END)
            gap = b"" if f.read(1) == b"\n" else b"\n"
    else:
        header = df.columns
    cells = [_cell(df, n) if n in df.columns else F.lit("") for n in header]
    line = F.concat_ws(",", *cells) if len(cells) > 1 else F.when(cells[0] == "", F.lit('""')).otherwise(cells[0])
    rows = df.orderBy(*order_by) if order_by else df
    spark = df.sparkSession
    spark.dataSource.register(LineFiles)
    folder = target.parent / f".{target.name}.{uuid.uuid4().hex}"
    folder.mkdir()
    try:
        rows.select(line.alias("value")).write.format(LineFiles.name()).mode("append").save(str(folder))
        parts = json.loads((folder / _MANIFEST).read_text(encoding="utf-8"))
        n_rows = sum(n for _, n, _ in parts)
        first = io.StringIO()
        if n_rows and not old:
            csv.writer(first, lineterminator="\n").writerow(header)
        between = first.getvalue().encode() or gap
        new = folder / "whole"
        with new.open("wb") as out:
            out.seek(old)
            out.write(between)
            out.truncate(old + len(between) + sum(size for *_, size in parts))
        _copy(spark, [(str(target), old, 0), *_laid(parts, old + len(between))], str(new))
        os.replace(new, target)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    if tee:
        return df
    return spark.range(1).select(F.lit(str(path)).alias("target_path"), F.lit("completed").alias("status"), F.lit(n_rows).cast("bigint").alias("rows_written"))


def _laid(parts: list, at: int) -> Iterator[tuple[str, int, int]]:
    """(path, size, place in the whole) of each part."""
    for path, _, size in parts:
        yield path, size, at
        at += size


def _copy(spark, files: list[tuple[str, int, int]], target: str) -> None:
    """Tasks copy (path, size, place) to their places in the target, a chunk each; all bytes must arrive."""
    chunks = [(path, lo, min(CHUNK_BYTES, size - lo), place + lo) for path, size, place in files for lo in range(0, size, CHUNK_BYTES)]
    if not chunks:
        return

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for path, begin, size, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(path, "rb") as source, open(target, "r+b") as out:
                    source.seek(begin)
                    out.seek(place)
                    left = size
                    while left and (data := source.read(min(left, COPY_BYTES))):
                        out.write(data)
                        left -= len(data)
                done += size - left
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["bytes"])

    rows = spark.createDataFrame(chunks, "path string, begin bigint, size bigint, place bigint").repartition(len(chunks) if len(chunks) < 1000 else 1000)
    wanted, arrived = sum(c[2] for c in chunks), rows.mapInArrow(copy, "bytes bigint").agg(F.sum("bytes")).first()[0] or 0
    if arrived != wanted:
        raise OSError(f"{arrived} bytes of {wanted} reached {target}")
