"""Exact duplicates by composable polynomial fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, text_of
from tidemark.scratch import fresh, written

#: Two primes under 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Bytes of a chunk; with 8-bit bytes and 31-bit powers the sums stay under 2**53, so float64 is exact.
CHUNK = 8192
#: Chunks that are turned into floats at a time, so that a huge text costs no more memory than a small one.
SPAN = 128
#: Characters of a chunk in the streaming comparison.
COMPARE = 65536
#: Up to so many groups their fingerprints are broadcast (16 bytes each); beyond, the texts are shuffled.
BROADCAST_GROUPS = 500_000


def _powers(prime: int, base: int, chunk: int) -> np.ndarray:
    """base**(chunk - 1), ..., base, 1 modulo prime."""
    out, x = np.empty(chunk), 1
    for i in range(chunk - 1, -1, -1):
        out[i], x = x, x * base % prime
    return out


def chunk_hashes(data: np.ndarray, prime: int, base: int, powers: np.ndarray) -> list[tuple[int, int]]:
    """(hash, length) of each chunk: the sum of (byte + 1) * base**(bytes after it in the chunk)."""
    chunk = len(powers)
    x = data.astype(np.float64) + 1.0
    whole = len(x) // chunk
    out = [(int(v) % prime, chunk) for v in x[: whole * chunk].reshape(whole, chunk) @ powers] if whole else []
    if rest := len(x) - whole * chunk:
        out.append((int(x[whole * chunk :] @ powers[chunk - rest :]) % prime, rest))
    return out


def combine(left: tuple[int, int], right: tuple[int, int], prime: int, base: int) -> tuple[int, int]:
    """(hash, length) of two texts joined: the left hash is shifted by the right one's length."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(data: np.ndarray, powers: list[np.ndarray], primes=PRIMES, bases=BASES) -> list[int]:
    """One hash a prime; chunks may be hashed anywhere and in any grouping before they are combined."""
    out = []
    for prime, base, p in zip(primes, bases, powers, strict=True):
        total, step = (0, 0), SPAN * len(p)
        for lo in range(0, len(data), step):
            for part in chunk_hashes(data[lo : lo + step], prime, base, p):
                total = combine(total, part, prime, base)
        out.append(total[0])
    return out


def normalised(text: Column) -> Column:
    """Each run of ASCII white space is one space."""
    return F.regexp_replace(text, SPACE, " ")


def with_fingerprints(df: DataFrame, text_column: str = "_norm", primes=PRIMES, bases=BASES, chunk: int = CHUNK) -> DataFrame:
    """Replace ``text_column`` by fp (both hashes in one number) and n_bytes. One pass, a batch at a time."""
    others = [f for f in df.schema.fields if f.name != text_column]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "fp bigint", "n_bytes bigint"])
    names = [f.name for f in others]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [_powers(p, b, chunk) for p, b in zip(primes, bases, strict=True)]
        for batch in batches:
            texts = batch.column(text_column).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            both = [fingerprint(data[a:b], powers, primes, bases) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            fps = [(h[0] << 31) + h[1] for h in both]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(fps, pa.int64()), pa.array(np.diff(offsets), pa.int64())], [*names, "fp", "n_bytes"])

    return df.select(*names, text_column).mapInArrow(hashed, schema)


def exact_groups(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", primes=PRIMES, bases=BASES, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is folded (null: empty); empty texts are equal
    to each other. The smallest doc_id of equal texts stays (null ids come last). Rows that repeat
    a doc_id with an equal text are one document: they count in group_size and share ``kept``.
    Very long texts are hashed and compared in chunks, never whole. An empty table gives no rows; other
    columns are not read, so none can clash.

    Equal fingerprints only nominate: the texts of every group of two or more are then compared
    chunk by chunk. The comparison is a grouped count over (fingerprint, chunk number, chunk), which
    each task folds before the shuffle, so a group with a third of all rows sends one row a chunk and
    task. A fingerprint under which some chunk has two contents is a collision; its rows are grouped
    by their digests instead.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), normalised(text_of(text_column)).alias("_norm"))
    sha = F.sha2(F.col("_norm").cast("binary"), 256)
    marks = written(with_fingerprints(base.withColumn("text_sha256", sha), "_norm", primes, bases, chunk), "fingerprints")
    key = ["fp", "n_bytes"]
    groups = marks.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    many = written(groups.filter("group_size > 1"), "groups")
    texts = with_fingerprints(base.withColumn("text", F.col("_norm")), "_norm", primes, bases, chunk)
    keys = many.select(*key)
    if many.count() <= BROADCAST_GROUPS:
        keys = F.broadcast(keys)
    clashing = written(_clashes(texts, keys), "clashes")
    clash = marks.join(clashing, key, "left_semi")
    plain = marks.join(clashing, key, "left_anti")
    apart = clash.groupBy(*key, "text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    own = plain.join(many, key, "left").select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    split = clash.join(apart, [*key, "text_sha256"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    return own.unionByName(split).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _clashes(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Fingerprints under which not all texts are the same, found chunk by chunk."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / COMPARE).cast("int")), lambda i: F.struct(i.alias("no"), F.substring(F.col("text"), i * COMPARE + 1, F.lit(COMPARE)).alias("chunk")))
    found = texts.join(keys, ["fp", "n_bytes"], "left_semi").select("fp", "n_bytes", F.explode(pieces).alias("x"))
    same = found.groupBy("fp", "n_bytes", F.col("x.no").alias("no"), F.col("x.chunk").alias("chunk")).agg(F.count("*").alias("copies"))
    return same.groupBy("fp", "n_bytes", "no").agg(F.count("*").alias("contents")).filter("contents > 1").select("fp", "n_bytes").distinct()


def drop_exact_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_groups() keeps, with all their columns; rows that repeat a
    kept document are dropped too. Columns of any name pass through."""
    key, id_, sha_ = fresh(docs, "_key", "_id", "_sha256")
    keep = exact_groups(docs, id_column=id_column, text_column=text_column).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_))
    keep = written(keep, "kept")
    sha = F.sha2(normalised(text_of(text_column)).cast("binary"), 256)
    rows = docs.withColumn(key, sha).join(keep, F.col(id_column).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(sha_)), "left_semi")
    repeats = keep.groupBy(id_, sha_).count().filter("count > 1").limit(1).count()
    if repeats:
        rows = rows.dropDuplicates([id_column, key])
    return rows.drop(key)
