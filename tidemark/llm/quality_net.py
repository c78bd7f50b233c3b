"""Quality classifier: random-indexing word vectors pooled per document, a small network, calibrated.

Each token has a fixed sparse random index vector; a token's context vector is the sum of the index
vectors of its neighbours over the whole corpus. A document is the mean of its tokens' context
vectors, and a two-layer network over that, fitted on labelled rows, gives a probability whose
temperature is set on labelled rows that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, text_of
from tidemark.llm.shingles import mix, span_hashes
from tidemark.scratch import fresh

#: Tokens are hashed to so many rows of vectors, whatever the corpus: 8 MB of weights, which is what
#: tasks and the driver hold.
ROWS, DIMS = 1 << 15, 64
#: Neighbours on each side, and values other than 0 of an index vector.
WINDOW, NONZERO = 2, 8
#: Labelled rows the network is fitted on, about; more are thinned by a hash of the id.
MAX_ROWS = 20_000
HIDDEN, ROUNDS, RATE, DECAY = 32, 600, 0.01, 1e-3
#: Weight of a token is SMOOTH / (SMOOTH + its share of all tokens).
SMOOTH = 1e-3
THRESHOLD = 0.7
BATCH_CHARS = 500_000
#: Stands for a word that repeats the word before it.
AGAIN = np.uint64(0xA6A1A6A1A6A1A6A1)
#: Class of each byte: 0 between tokens, 1 in words, 2 in runs of other signs.
_CLASS = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def index_vectors(rows: int = ROWS, dims: int = DIMS, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """The fixed index vector of each row, the same in every task: its ``nonzero`` places and their signs."""
    rnd = np.random.default_rng(20240711)
    places = np.argpartition(rnd.random((rows, dims)), nonzero, axis=1)[:, :nonzero]
    return places, rnd.choice(np.array([-1.0, 1.0]), (rows, nonzero))


def tokens_of(texts: list[str], rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(row of each token, its text). Tokens: runs of letters, digits and non-ASCII bytes, and runs of other
    signs, case kept; a word that repeats the one before is AGAIN."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    kind = _CLASS[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    starts, ends = edge, np.append(edge[1:], len(data))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    bounds = np.cumsum([0, *(len(t) + 1 for t in raw)])
    owner = np.searchsorted(bounds, starts, side="right") - 1
    hashes = span_hashes(data, starts, ends).copy()
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]) & (kind[starts[1:]] == 1)
    hashes[again] = AGAIN
    return (mix(hashes) % np.uint64(rows)).astype(np.int64), owner


def _stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > BATCH_CHARS:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def add_contexts(sums: np.ndarray, counts: np.ndarray, texts: list[str], index: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> None:
    """Add the index vectors of all neighbours to the tokens' sums, and the tokens to their counts."""
    (rows, dims), (places, signs) = sums.shape, index
    for lo, hi in _stretches(texts):
        at, owner = tokens_of(texts[lo:hi], rows)
        counts += np.bincount(at, minlength=rows)
        keys = [np.empty(0, np.int64)]
        for d in range(1, window + 1):
            near = owner[d:] == owner[:-d]
            a, b = at[d:][near], at[:-d][near]
            keys += [a * rows + b, b * rows + a]
        # Each distinct pair of neighbours once, with how often it occurs.
        pairs, times = np.unique(np.concatenate(keys), return_counts=True)
        own, other = pairs // rows, pairs % rows
        cells = (own * dims)[:, None] + places[other]
        sums += np.bincount(cells.ravel(), (times[:, None] * signs[other]).ravel(), rows * dims).astype(np.int64).reshape(rows, dims)


def context_sums(docs: DataFrame, text_column: str = "text", rows: int = ROWS, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(sum vector, count) of each row over all texts. A task adds up its texts and sends a row for
    each row of vectors at most; Spark adds those up, and the driver gets ``rows`` rows."""
    names = [f"d{k}" for k in range(dims)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(rows, dims)
        sums, counts = np.zeros((rows, dims), np.int64), np.zeros(rows, np.int64)
        for batch in batches:
            add_contexts(sums, counts, batch.column(0).to_pylist(), index)
        used = np.flatnonzero(counts)
        for lo in range(0, len(used), 4096):
            part = used[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part]), *(pa.array(np.ascontiguousarray(sums[part, k])) for k in range(dims))], ["at", "n", *names])

    parts = docs.select(text_of(text_column).alias("text")).mapInArrow(add, ", ".join(f"{c} bigint" for c in ("at", "n", *names)))
    total = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toPandas()
    sums, counts = np.zeros((rows, dims)), np.zeros(rows)
    at = total["at"].to_numpy(np.int64)
    sums[at], counts[at] = total[names].to_numpy(float), total["n"].to_numpy(float)
    return sums, counts


def word_vectors(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Context vectors of length one, less the corpus's mean of them, weighed down by frequency."""
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    share = counts / max(1.0, counts.sum())
    return ((unit - share @ unit) * (SMOOTH / (SMOOTH + share))[:, None]).astype(np.float32)


@dataclass
class QualityNet:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float = 1.0

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean vector of each text's tokens and the logarithm of their number."""
        out = np.zeros((len(texts), self.vectors.shape[1] + 1))
        for lo, hi in _stretches(texts):
            at, owner = tokens_of(texts[lo:hi], len(self.vectors))
            n = np.bincount(owner, minlength=hi - lo)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(first):
                out[lo + owner[first], :-1] = np.add.reduceat(self.vectors[at], first, axis=0) / n[owner[first], None]
            out[lo:hi, -1] = np.log1p(n)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.logits(self.pooled(texts)) / self.temperature)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_layers(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY):
    """Two layers by gradient steps with momentum over all rows at once, from fixed random weights."""
    rnd = np.random.default_rng(7)
    p = [rnd.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rnd.normal(0, hidden**-0.5, hidden), np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))]
    steps, squares = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for k in range(1, rounds + 1):
        h = np.tanh(x @ p[0] + p[1])
        e = (_sigmoid(h @ p[2] + p[3]) - y) / len(y)
        back = np.outer(e, p[2]) * (1 - h * h)
        grads = [x.T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], np.array(e.sum())]
        for i, g in enumerate(grads):
            steps[i] = 0.9 * steps[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            p[i] = p[i] - rate / (1 + k / 200) * (steps[i] / (1 - 0.9**k)) / (np.sqrt(squares[i] / (1 - 0.99**k)) + 1e-8)
    return p[0], p[1], p[2], float(p[3])


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a grid from 1/4 to 8."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 71))
    loss = [-np.mean(np.where(y > 0, np.log(_sigmoid(logits / t)), np.log(_sigmoid(-logits / t)))) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", max_rows: int = MAX_ROWS) -> QualityNet:
    """Vectors from all texts; the network from labelled rows outside the held-out fold (crc32 of the id
    modulo 4 is 2), one in five of which (by a hash of the id) sets the temperature only.

    At most about ``max_rows`` labelled rows are used, taken by a hash of the id: their pooled vectors,
    520 bytes each, come to the driver. A document that is labelled both ways counts as bad. With labels
    of one class or none at all every text scores their smoothed share (a half without any).
    """
    vectors = word_vectors(*context_sums(docs, text_column))
    blank = QualityNet(vectors, np.zeros(1), np.ones(1), (np.zeros((DIMS + 1, 1)), np.zeros(1), np.zeros(1), 0.0))
    marks = labels.filter(f"`{label_column}` IN (0, 1)").groupBy(F.col("doc_id").alias("_d")).agg(F.min(F.col(label_column).cast("int")).alias("good")).filter(crc_mod("_d", 4) != 2)
    share = min(1.0, max_rows / max(marks.count(), 1))
    drawn = lambda seed: F.crc32(F.concat(F.lit(seed), F.coalesce(F.col("_d").cast("string"), F.lit(""))).cast("binary"))
    marks = marks.filter(drawn("sample") < int(share * 2**32)).withColumn("tune", drawn("tune") % 5 == 0)
    # The sample is bounded by max_rows (24 bytes a row), so it may be broadcast.
    rows = docs.select(F.col(id_column).alias("_i"), text_of(text_column).alias("text")).join(F.broadcast(marks), F.col("_i") == F.col("_d"))
    sample = rows.select(F.col("_d").cast("string").alias("key"), F.xxhash64("text").alias("tie"), "good", "tune", _pooled_column(blank, F.col("text")).alias("x")).toPandas().sort_values(["key", "tie"])
    x, y, tune = np.array(sample["x"].tolist(), float).reshape(len(sample), DIMS + 1), sample["good"].to_numpy(float), sample["tune"].to_numpy(bool)
    fit = ~tune
    if len(set(y[fit])) < 2:
        return QualityNet(vectors, blank.mean, blank.scale, (*blank.layers[:3], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))))
    net = QualityNet(vectors, x[fit].mean(0), x[fit].std(0) + 1e-6, blank.layers)
    net.layers = fit_layers((x[fit] - net.mean) / net.scale, y[fit])
    net.temperature = temperature_of(net.logits(x[tune]), y[tune])
    return net


def _pooled_column(net: QualityNet, text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def pool(texts: pd.Series) -> pd.Series:
        return pd.Series(list(net.pooled(texts.tolist())))

    return pool(text)


def score_column(net: QualityNet, text: Column) -> Column:
    """The score of each text, as a column; the model is 8 MB, whatever the corpus."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(net.scores(texts.fillna("").tolist()))

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Null texts count as empty, and empty ones score by their length alone; very long texts are pooled
    whole; equal texts, repeated rows too, score alike; a score of exactly the threshold is good; an
    empty table gives no rows; other columns are not read, so none can clash.
    """
    net = train(docs, labels, id_column=id_column, text_column=text_column, **kw)
    rows = docs.select(F.col(id_column).alias("doc_id"), (crc_mod(id_column, 4) == 2).alias("held_out"), score_column(net, text_of(text_column)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, F.lit(1)).otherwise(F.lit(0)))


def keep_good(docs: DataFrame, labels: DataFrame, *, text_column: str = "text", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns, of any names."""
    net = train(docs, labels, text_column=text_column, **kw)
    (score,) = fresh(docs, "_score")
    return docs.withColumn(score, score_column(net, text_of(text_column))).filter(F.col(score) >= threshold).drop(score)
