"""n-gram Jaccard self-join by MinHash banding, verified on the full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.components import components
from tidemark.llm.shingles import mix, ngram_sets
from tidemark.scratch import written

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 256
#: A block of a bucket: so many n-grams or texts at most, on average.
BLOCK_GRAMS, BLOCK_TEXTS = 400_000, 300
#: Up to so many candidate texts their keys are broadcast (with their bands under 1 KB each); beyond, texts are shuffled.
BROADCAST_TEXTS = 50_000
BATCH_CHARS = 1_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, with which a pair at the
    threshold shares a band with probability ``recall`` within ``max_hashes`` hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        miss = 1 - threshold**rows
        bands = np.ceil(np.log(1 - recall) / np.log(miss)) if 0 < miss < 1 else 1 if miss <= 0 else np.inf
        if bands * rows <= max_hashes:
            best = (max(1, int(bands)), rows)
    return best


def _signatures(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of texts that all have n-grams."""
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**64, bands * rows, dtype=np.uint64)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(counts), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            x = mix(x ^ np.minimum.reduceat((grams ^ offsets[r]) * factors[r], starts))
        out[:, b] = x
    return out


def _lowered(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, lower-cased texts) in stretches of bounded size."""
    lo, total, part = 0, 0, []
    for i in range(len(texts)):
        t = texts[i].as_py().lower().encode()
        if part and total + len(t) > BATCH_CHARS:
            yield lo, part
            lo, total, part = i, 0, []
        part.append(t)
        total += len(t)
    if part:
        yield lo, part


def signatures(docs: DataFrame, *, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, text) -> (doc_id, digest, f1, f2, n_grams, bands); f1 and f2 stand for the n-gram set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _lowered(batch.column(2)):
                grams, counts = ngram_sets(texts, n)
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                f = [np.zeros(len(texts), np.uint64) for _ in range(2)]
                sig = np.zeros((len(texts), bands), np.uint64)
                if len(some):
                    f[0][some] = np.add.reduceat(mix(grams + np.uint64(11)), starts)
                    f[1][some] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    sig[some] = _signatures(grams, counts[some], bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(sig.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), batch.column(1).slice(lo, len(texts)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array(counts, pa.int64()), lists],
                    ["doc_id", "digest", "f1", "f2", "n_grams", "bands"],
                )

    return docs.select("doc_id", "digest", "text").mapInArrow(signed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string, f1 bigint, f2 bigint, n_grams bigint, bands array<bigint>")


def _linked(nodes, copies, left, sig, grams, counts, threshold: float, single: bool, band: int = 0):
    """Of one block or pair of blocks of a bucket: (links of each text, root of each text).

    ``left`` marks the first block's texts; in a pair of blocks only pairs across count (none where one
    of the two is empty), in a ``single`` block all pairs. The texts share ``band``; a pair that shares an earlier
    one is left to that one's bucket. Each is verified on its whole sets.
    """
    m = len(nodes)
    links, root = np.zeros(m, np.int64), np.arange(m)
    ends = np.cumsum(counts)
    rows, cols = (np.arange(m), np.arange(m)) if single else (np.flatnonzero(left), np.flatnonzero(~left))
    a, b = counts[rows][:, None], counts[cols][None, :]
    share = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
    if single:
        share = np.triu(share, 1)
    for k in range(band):
        share &= sig[rows, k][:, None] != sig[cols, k][None, :]
    i, j = np.nonzero(share)
    if not len(i):
        return links, root
    used, at = np.unique(grams, return_inverse=True)
    often = np.bincount(at) > 1
    column = np.cumsum(often) - 1
    width = int(often.sum())
    each = (counts[rows[i]] + counts[cols[j]]).sum() * 6e-8 + len(i) * 2.5e-5
    if each <= 2.0 * len(rows) * len(cols) * width / 2e10 + 1e-3:
        sets = [grams[e - c : e] for e, c in zip(ends, counts, strict=True)]
        common = np.fromiter((len(np.intersect1d(sets[rows[x]], sets[cols[y]], assume_unique=True)) for x, y in zip(i, j, strict=True)), np.int64, len(i))
    else:
        owner, at = np.repeat(np.arange(m), counts)[often[at]], column[at[often[at]]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        total = np.zeros((len(rows), len(cols)), np.float32)
        for lo in range(0, width, 2048):
            x, y = np.searchsorted(at, (lo, lo + 2048))
            dense = np.zeros((m, 2048), np.float32)
            dense[owner[x:y], at[x:y] - lo] = 1
            total += dense[rows] @ dense[cols].T
        common = total[i, j].astype(np.int64)
    union = counts[rows[i]] + counts[cols[j]] - common
    yes = common >= threshold * union - 1e-9
    i, j = rows[i[yes]], cols[j[yes]]
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        if (new == root).all():
            break
        root = new[new]
    return links, root


def _verified(dealt: DataFrame, n: int, threshold: float) -> DataFrame:
    """Rows of texts in blocks of buckets -> (node, links, root) of each text in each block pair, in bulk."""
    key = ["key", "x", "y"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            places, text_at = {}, []  # a text that several buckets brought is cut up once
            for r in rows:
                text_at.append(places.setdefault(r[8], len(places)))
            grams, counts = ngram_sets([t.lower().encode() for t in places], n)
            ends = np.cumsum(counts)
            out: list[tuple[np.ndarray, ...]] = []
            first = 0
            for k in range(1, len(rows) + 1):
                if k < len(rows) and rows[k][:3] == rows[first][:3]:
                    continue
                part = rows[first:k]
                nodes, where = np.unique(np.array([r[3] for r in part], np.int64), return_index=True)  # repeated rows bring a text twice
                part = [part[w] for w in where]
                own = np.array(text_at)[where + first]
                if len(part) > 1:
                    sets = np.concatenate([grams[ends[o] - counts[o] : ends[o]] for o in own])
                    left = np.array([r[4] == r[1] for r in part])
                    links, root = _linked(nodes, np.array([r[5] for r in part], np.int64), left, np.array([r[7] for r in part], np.int64), sets, counts[own], threshold, part[0][1] == part[0][2], part[0][6])
                    some = links > 0
                    out.append((nodes[some], links[some], nodes[root][some]))
                first = k
            cols = [np.concatenate(c) if out else np.empty(0, np.int64) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "links", "top"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size > BATCH_CHARS and r[:3] != held[-1][:3]:
                    yield done(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[8])
        if held:
            yield done(held)

    dealt = dealt.repartition(*key).sortWithinPartitions(*key)
    return dealt.select(*key, "node", "block", "copies", "band", "bands", "text").mapInArrow(work, "node bigint, links bigint, top bigint")


def buckets(first: DataFrame) -> DataFrame:
    """(node, bands, n_grams) -> (key, band, n_blocks) of the buckets that must be verified.

    A bucket of one text has no pairs. Where the same texts share several bands, only the first of these
    buckets stays: a pair belongs to the least band that it shares, and that bucket is never left out.
    The same texts are told by their number, the least of them and two 64-bit sums of hashes.
    """
    keys = first.select("node", "n_grams", F.posexplode("bands").alias("band", "key"))
    full = keys.groupBy("key").agg(
        F.min("band").alias("band"),
        F.count("*").alias("n"),
        F.min("node").alias("lead"),
        F.bit_xor(F.xxhash64("node")).alias("h1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"),
        F.greatest(F.ceil(F.sum("n_grams") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("n_blocks"),
    )
    once = full.filter("n > 1").groupBy("n", "lead", "h1", "h2").agg(F.min(F.struct("band", "key", "n_blocks")).alias("b"))
    return once.select("b.key", "b.band", "b.n_blocks")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, digest (MD5 of the text).

    The id column keeps its type. Texts are linked when the Jaccard similarity of their sets of n-grams (lower-cased words between
    ASCII white space; a shorter text is one n-gram) is at least ``threshold``. ``n_links`` is the
    number of other rows that a row is linked to, copies included; ``class_id`` is the least doc_id
    among the rows it reaches over links. A text without words (null, empty, blank) has no links and
    is its own class. Repeated rows are copies of each other. An empty table gives no rows; other
    columns are not read.

    Very long texts are compared on their whole sets, too.

    Texts with the same n-gram set are folded into one node. Nodes are shuffled on the hashes of their
    bands; a bucket is verified in blocks and pairs of blocks, so that a hot one is spread over many
    tasks, none left out. A pair is verified in the bucket of the least band that it shares, and
    buckets that hold the same texts as an earlier one are passed over. A task returns each text's
    number of links and one edge to its group's least text: never the pairs.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    base = docs.select(F.col(id_column).alias("doc_id"), F.md5(text_of(text_column).cast("binary")).alias("digest"), text_of(text_column).alias("text"))
    sig = written(signatures(base, n=n, bands=bands, rows=rows).withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = sig.filter("n_grams > 0")
    nodes = written(some.groupBy("f1", "f2").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id")), "nodes")
    first = sig.join(nodes.select("node", "copies"), F.col("row") == F.col("node"))
    full = buckets(first).select(F.bitwise_not("key").alias("other"), F.col("band").alias("b"), "n_blocks")
    keys = first.select("node", F.posexplode("bands").alias("band", "key"))
    # By the complement, as in components(): a bucket with most of the texts may be split.
    member = keys.join(full, (F.bitwise_not("key") == F.col("other")) & (F.col("band") == F.col("b")))
    member = member.select("node", F.struct("key", "band", "n_blocks", F.pmod(F.xxhash64("node", "key"), F.col("n_blocks")).cast("int").alias("block")).alias("bucket"))
    member = member.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # one a band at most
    wanted = written(member.join(first.select("node", "copies", "doc_id", "digest", "bands"), "node"), "members").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "node", "copies", "bands", "buckets")
    few = wanted.count() <= BROADCAST_TEXTS
    texts = base.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    sent = texts.select("node", "copies", "bands", "text", F.explode("buckets").alias("b"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("b.n_blocks") - 1), lambda o: F.struct(F.least("b.block", o).alias("x"), F.greatest("b.block", o).alias("y")))
    dealt = sent.select("node", "copies", "bands", "text", "b.key", "b.band", "b.block", F.explode(pairs).alias("pair")).select("key", "pair.x", "pair.y", "node", "block", "copies", "band", "bands", "text")
    found = written(_verified(dealt, n, threshold), "links")
    classes = components(found.select(F.col("node").alias("a"), F.col("top").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = joined.groupBy("root").agg(F.min("least_id").alias("class_id"))
    of_node = joined.join(named, "root").select("f1", "f2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_node = written(of_node, "classes")
    out = sig.select("doc_id", "digest", "f1", "f2", "n_grams").join(of_node, ["f1", "f2"], "left")
    blank = F.col("n_grams") == 0
    return out.select("doc_id", F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(blank, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), "digest")
