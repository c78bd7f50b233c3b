"""Toxicity by a counterfactual-regularised classifier over words and word beginnings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, text_of
from tidemark.llm.shingles import span_hashes
from tidemark.scratch import fresh

# Identity terms, in groups within which one may stand for another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "hispanic"),
    ("african", "american", "european", "mexican", "chinese", "indian", "arab", "german", "french", "spanish"),
    ("immigrants", "refugees", "migrants", "foreigners", "citizens", "natives"),
    ("elderly", "young", "old"),
    ("disabled", "deaf", "blind", "able-bodied"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

#: Labelled rows the classifier is fitted on, about; more are thinned by a hash of the id.
MAX_ROWS = 20_000
#: Features it may use, those most tied to toxic texts.
MAX_FEATURES = 2048
MIN_TOXIC_TEXTS = 4
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (3, 4, 5, 6)
L2 = 2e-4
#: Weight of the squared change of a score (before the sigmoid) when identity terms are swapped.
SWAP_PENALTY = 1.0
BATCH_CHARS = 1_000_000


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text of each word); a word is a run of letters, digits or non-ASCII bytes."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in raw)])
    return data, starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def _features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, their texts) of each kind of feature; a text may bring a feature more than once."""
    data, starts, ends, owner = _words(texts)
    yield span_hashes(data, starts, ends), owner
    for n in PREFIXES:
        long = ends - starts > n
        yield span_hashes(data, starts[long], starts[long] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & 2**64 - 1), owner[long]


def _stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > BATCH_CHARS:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def swapper(terms=IDENTITY_TERMS):
    """A function that puts the group's next term for each identity term of a text, or gives None."""
    after = {w: g[(i + 1) % len(g)] for g in terms for i, w in enumerate(g)}
    found = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, after), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)

    def swapped(text: str) -> str | None:
        out, n = found.subn(lambda m: after[m[1].lower()], text)
        return out if n else None

    return swapped


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    length_weight: float

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature number) pairs, each once."""
        size = np.uint64(1 << 18)
        filled = np.zeros(int(size), bool)
        filled[(self.features % size).astype(np.int64)] = True
        pairs = [np.empty(0, np.int64)]
        if len(self.features):
            for hashes, owner in _features(texts):
                maybe = np.flatnonzero(filled[(hashes % size).astype(np.int64)])
                h = hashes[maybe]
                at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
                hit = self.features[at] == h
                pairs.append(owner[maybe][hit] * len(self.features) + at[hit])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.features)), both % max(1, len(self.features))

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in _stretches(texts):
            owner, at = self.lookup(texts[lo:hi])
            z = np.bincount(owner, self.weights[at], hi - lo) + self.bias + self.length_weight * _length(texts[lo:hi])
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return out


def _per_text(owner: np.ndarray, at: np.ndarray, n: int) -> list[list[int]]:
    """lookup()'s pairs, which are in order of texts, as a list for each text."""
    return [x.tolist() for x in np.split(at, np.searchsorted(owner, np.arange(1, n)))] if n else []


def _length(texts: list[str]) -> np.ndarray:
    return np.log1p(np.fromiter(map(len, texts), np.float64, len(texts))) / 10


def _counted(rows: DataFrame) -> DataFrame:
    """(text, toxic) -> (feature, toxic texts, other texts), partly summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(bool)
            for lo, hi in _stretches(texts):
                seen = []
                for hashes, owner in _features(texts[lo:hi]):
                    order = np.lexsort((hashes, owner))
                    h, o = hashes[order], owner[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                    seen.append((h[new], toxic[lo:hi][o[new]]))
                h, y = (np.concatenate(x) for x in zip(*seen, strict=True))
                names, at = np.unique(h, return_inverse=True)
                pos = np.bincount(at, y, len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(names)) - pos)], ["feature", "pos", "neg"])

    return rows.mapInArrow(count, "feature bigint, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _fit(owner, at, length, y, pairs, n_features: int, l2: float, penalty: float, rounds: int = 400):
    """Logistic regression by gradient steps with momentum. pairs: (row, feature, +1 or -1) of the
    difference between a text's and its swapped copy's features."""
    n = len(y)
    w, b, c = np.zeros(n_features), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), 0.0
    step = np.zeros(n_features + 2)
    scale = np.full(n_features + 2, 1e-8)
    p_row, p_at, p_sign = pairs
    n_pairs = int(p_row.max()) + 1 if len(p_row) else 0
    for k in range(rounds):
        z = np.bincount(owner, w[at], n) + b + c * length
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        g = np.concatenate([np.bincount(at, error[owner], n_features) + l2 * w, [error.sum(), (error * length).sum()]])
        if n_pairs:
            change = np.bincount(p_row, p_sign * w[p_at], n_pairs)
            g[:n_features] += 2 * penalty / n_pairs * np.bincount(p_at, p_sign * change[p_row], n_features)
        step = 0.9 * step + 0.1 * g
        scale = 0.99 * scale + 0.01 * g * g
        move = 0.1 / (1 + k / 100) * (step / (1 - 0.9 ** (k + 1))) / np.sqrt(scale / (1 - 0.99 ** (k + 1)) + 1e-12)
        w, b, c = w - move[:n_features], b - move[n_features], c - move[n_features + 1]
    return w, float(b), float(c)


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, l2: float = L2, penalty: float = SWAP_PENALTY, terms=IDENTITY_TERMS) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0).

    At most about ``max_rows`` labelled rows are used, taken by a hash of the id. Features are chosen by
    their tie to toxic texts over those rows, then their numbers in each row come to the driver: a
    bounded table. Of each row with an identity term a swapped copy is made, and the change of the
    score between the two is penalised. With labels of one class only, every text scores its share. A
    document that is labelled both ways counts as toxic.
    """
    marks = labels.filter("toxic IN (0, 1)").groupBy(F.col("doc_id").alias("_d")).agg(F.max(F.col("toxic").cast("long")).alias("toxic")).filter(crc_mod("_d", 5) != 0)
    n = marks.count()
    share = min(1.0, max_rows / max(n, 1))
    marks = marks.filter(F.crc32(F.concat(F.lit("sample"), F.col("_d").cast("string")).cast("binary")) < int(share * 2**32))
    # The sample is bounded by max_rows (24 bytes a row), so it may be broadcast.
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).join(F.broadcast(marks), F.col("doc_id") == F.col("_d")).select("text", "toxic")
    total = marks.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    pos, neg = total["pos"] or 0, total["n"] - (total["pos"] or 0)
    if not pos or not neg:
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), 4.0 if pos else -4.0, 0.0)
    tie = F.col("pos") * F.log((F.col("pos") + 0.5) / (pos + 1.0) / ((F.col("neg") + 0.5) / (neg + 1.0)))
    chosen = _counted(rows).filter(F.col("pos") >= MIN_TOXIC_TEXTS).select("feature", tie.alias("tie")).filter("tie > 0").orderBy(F.desc("tie"), "feature").limit(max_features).collect()
    names = np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64))
    blank = ToxicityModel(names, np.zeros(len(names)), 0.0, 0.0)
    swap = swapper(terms)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in _stretches(texts):
                part = texts[lo:hi]
                copies = [swap(t) for t in part]
                changed = [i for i, t in enumerate(copies) if t is not None]
                lists = _per_text(*blank.lookup(part), len(part))
                swapped: list = [None] * len(part)
                for i, found in zip(changed, _per_text(*blank.lookup([copies[i] for i in changed]), len(changed)), strict=True):
                    swapped[i] = found
                yield pd.DataFrame({"toxic": pdf["toxic"].to_numpy()[lo:hi], "length": _length(part), "own": lists, "swapped": swapped})

    sample = rows.mapInPandas(numbered, "toxic bigint, length double, own array<int>, swapped array<int>").toArrow().combine_chunks()
    if not sample.num_rows:
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), -4.0, 0.0)
    lists = sample.column("own").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    changed = sample.filter(pc.is_valid(sample.column("swapped"))).select(["own", "swapped"]).to_pylist()
    pairs: list[tuple[int, int, float]] = []
    for k, r in enumerate(changed):
        own, other = set(r["own"]), set(r["swapped"])
        pairs += [(k, f, 1.0) for f in own - other] + [(k, f, -1.0) for f in other - own]
    p = tuple(np.array([x[i] for x in pairs], kind) for i, kind in enumerate((np.int64, np.int64, float)))
    y = sample.column("toxic").to_numpy().astype(float)
    w, b, c = _fit(owner, at, sample.column("length").to_numpy(), y, p, len(names), l2, penalty)
    return ToxicityModel(names, w, b, c)


def score_column(model: ToxicityModel, text: Column) -> Column:
    """The score of each text, as a column; the model is bounded by its number of features."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.fillna("").tolist()))

    return score(text)


def toxicity_report(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty and score like any text without features. Very long texts are scored
    whole, by which features they have at all. Rows of equal texts, repeated ones too, score alike, and a score of
    exactly 0.5 is toxic; an empty table gives no rows; other columns are not read, so none can clash.
    """
    model = train(docs, labels, id_column=id_column, text_column=text_column, **kw)
    rows = docs.select(F.col(id_column).alias("doc_id"), (crc_mod(id_column, 5) == 0).alias("held_out"), score_column(model, text_of(text_column)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, F.lit(1)).otherwise(F.lit(0)))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text_column: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, of any names."""
    model = train(docs, labels, text_column=text_column, **kw)
    (score,) = fresh(docs, "_score")
    return docs.withColumn(score, score_column(model, text_of(text_column))).filter(F.col(score) < 0.5).drop(score)
