"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

The root restaurant holds the words, on a uniform base. Each word (and the beginning of texts) is a
context with a restaurant of its own, however rare; they all share the root as their parent. A
restaurant's table sends one customer to its parent.

The corpus is cut into blocks of texts. Blocks send their distinct words and (context, word) pairs
with counts to shards by word hash; a shard seats all restaurants' customers of its words and returns,
to each block that asked, what its words and pairs are worth. Its sums of each context go to the shard
of the context's own hash, which adds them up and answers the blocks that have the word. While
sampling, a shard takes a restaurant's tables in other shards as its own there, times the context's
count in the blocks that ask over its customers here; the predictive probabilities use the exact
totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, text_of
from tidemark.llm.shingles import span_hashes
from tidemark.scratch import written

#: Dishes with up to so many customers have their exact law of the number of tables.
STIRLING = 512
#: A pair's key is the word's number above so many bits of its context's.
CONTEXT_BITS = 32
STRENGTH = 1.0
BURN_IN, SAMPLES = 6, 4
BLOCK_CHARS = 9_000_000
#: Words that blocks send to a shard, about.
SHARD_WORDS = 400_000
#: Contexts are told apart by the upper bits of their words' hashes, without so many of the lower.
CONTEXT_CUT = np.uint64(24)
#: Bytes of text that are hashed at a time.
HASH_BYTES = 2_000_000
END, START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A2757A2757A275)


# -- blocks ---------------------------------------------------------------------------------------


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, tokens of each text): words with A-Z in lower case, then one end each."""
    sizes = np.cumsum([len(t) for t in texts])
    cuts = np.flatnonzero(np.diff(sizes // HASH_BYTES)) + 1
    parts = [_hashed(texts[i:j]) for i, j in zip([0, *cuts], [*cuts, len(texts)], strict=True)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, bounds))
    out = np.full(len(starts) + len(texts), END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), counts)] = span_hashes(data, starts, ends)
    return out, counts + 1


def _block(ids: list, train: np.ndarray, texts: list[bytes], number: int) -> dict:
    """A block's row: its distinct words in order of hash, and its texts as numbers of those words."""
    tokens, lengths = _tokens(texts)
    words, at = np.unique(np.append(tokens, START), return_inverse=True)  # the beginning: a context with count 0
    at, start = at[:-1], int(at[-1])
    counts = np.bincount(at, np.repeat(train, lengths), len(words)).astype(np.uint32)
    n_train = int(lengths[train].sum())
    return {
        "block": number,
        "n_train": n_train,
        "n_words": len(words),
        "ids": ids,
        "train": train.tolist(),
        "lengths": lengths.astype(np.int32).tolist(),
        "tokens": _planes(at),
        "words": words.tobytes(),
        "counts": _planes(counts),
        "start": start,
    }


_BLOCK_FIELDS = [("block", pa.int64()), ("n_train", pa.int64()), ("n_words", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("start", pa.int64())]
_BLOCK_DDL = "block bigint, n_train bigint, n_words bigint, ids array<bigint>, train array<boolean>, lengths array<int>, tokens binary, words binary, counts binary, start bigint"


def blocks_of(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, train, text) -> one row per block; nothing is shuffled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, train, texts, size, number = [], [], [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block(ids, np.array(train, bool), texts, number)], pa.schema(_BLOCK_FIELDS))

        for batch in batches:
            for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = x.as_py().encode()
                if texts and size + len(x) > block_chars:
                    yield row()
                    ids, train, texts, size, number = [], [], [], 0, number + 1
                ids.append(i)
                train.append(t)
                texts.append(x)
                size += len(x) + 1
        if texts:
            yield row()

    return docs.select("doc_id", "train", "text").mapInArrow(cut, _BLOCK_DDL)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, byte by byte, compressed: most bytes are alike."""
    return _packed(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4))


def _packed(table: np.ndarray) -> bytes:
    plain = np.ascontiguousarray(table.T).tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpacked(packed: bytes, width: int) -> np.ndarray:
    plain = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, -1).T)


def _names(contexts: np.ndarray) -> bytes:
    """Sorted contexts, 40 bits each."""
    return _packed(contexts.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :5])


def _contexts(names: bytes) -> np.ndarray:
    table = _unpacked(names, 5)
    return np.hstack([table, np.zeros((len(table), 3), np.uint8)]).view(np.uint64).ravel()


def _float_planes(x: np.ndarray) -> bytes:
    """Floats to 16 bits of mantissa, 1e-5 of their value."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return _planes(bits + np.uint32(64) & ~np.uint32(127))


def _floats(planes: bytes) -> np.ndarray:
    return _numbers(planes).astype(np.uint32).view(np.float32)


def _numbers(planes: bytes) -> np.ndarray:
    return _unpacked(planes, 4).view(np.uint32).ravel().astype(np.int64)


def _pairs(tokens: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """Key of each token: its word's number and that of the word before; ``start``: of a text's beginning."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = start
    return tokens << CONTEXT_BITS | before


def _shard_bounds(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, cut where its upper bits change; the words are sorted by it."""
    edges = np.array([(k << 40) // shards for k in range(1, shards)], np.uint64) << CONTEXT_CUT
    return np.concatenate([[0], np.searchsorted(words, edges), [len(words)]])


def _asked(blocks: DataFrame, shards: int) -> DataFrame:
    """Blocks -> what each asks of each shard: words, their training counts and numbers of pairs, pairs
    in order of words, their training counts, and the contexts of these pairs with their counts."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), *[(x, pa.binary()) for x in ("words", "counts", "n_pairs", "pair_context", "pair_count", "contexts", "context_count")]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = np.frombuffer(r["words"], np.uint64), _numbers(r["counts"])
                lengths, train = np.array(r["lengths"], np.int64), np.array(r["train"], bool)
                keys = _pairs(_numbers(r["tokens"]), lengths, r["start"])
                pairs, inverse = np.unique(keys, return_inverse=True)
                times = np.bincount(inverse, np.repeat(train, lengths), len(pairs))
                n_pairs = np.bincount(pairs >> CONTEXT_BITS, minlength=len(words))
                before = pairs & ((1 << CONTEXT_BITS) - 1)
                as_context = counts.copy()
                as_context[r["start"]] = train.sum()
                w = _shard_bounds(words, shards)
                p = np.searchsorted(pairs, w << CONTEXT_BITS)
                rows = []
                for s in range(shards):
                    if w[s] < w[s + 1]:
                        used, at = np.unique(before[p[s] : p[s + 1]], return_inverse=True)
                        rows.append(
                            {
                                "shard": s,
                                "block": r["block"],
                                "words": words[w[s] : w[s + 1]].tobytes(),
                                "counts": _planes(counts[w[s] : w[s + 1]]),
                                "n_pairs": _planes(n_pairs[w[s] : w[s + 1]]),
                                "pair_context": _planes(at),
                                "pair_count": _planes(times[p[s] : p[s + 1]]),
                                "contexts": _names(words[used] >> CONTEXT_CUT),
                                "context_count": _planes(as_context[used]),
                            }
                        )
                for lo in range(0, len(rows), 16):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 16], schema)

    return blocks.select("block", "words", "counts", "lengths", "train", "tokens", "start").mapInArrow(ask, "shard int, block bigint, words binary, counts binary, n_pairs binary, pair_context binary, pair_count binary, contexts binary, context_count binary")


# -- seating --------------------------------------------------------------------------------------


class Seating:
    """Tables of many dishes at once, a customer at a time: what draw_tables() is held against. ``customers[i]`` people eat dish i; every one starts at one table.

    remove() takes a customer at random from each given dish, add() seats one in each: at a table by
    its size less the discount, at a new one by the given weight. One remove() and add() of the same
    dishes is a Gibbs step of one customer of each.
    """

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.discount, self.rng = discount, rng
        self.customers = customers.astype(np.int64).copy()
        self.dish = np.flatnonzero(self.customers > 0)
        self.size = self.customers[self.dish].copy()
        self.tables = (self.customers > 0).astype(np.int64)

    def _pick(self, dishes: np.ndarray) -> np.ndarray:
        """A table of each dish, by size."""
        ends = np.cumsum(self.size)
        first = np.searchsorted(self.dish, dishes)
        before = ends[first] - self.size[first]
        who = before + (self.rng.random(len(dishes)) * self.customers[dishes]).astype(np.int64)
        return np.searchsorted(ends, who, side="right")

    def remove(self, dishes: np.ndarray) -> None:
        if not len(dishes):
            return
        at = self._pick(dishes)
        self.size[at] -= 1
        self.customers[dishes] -= 1
        gone = self.size[at] == 0
        if gone.any():
            self.tables[dishes[gone]] -= 1
            keep = self.size > 0
            self.dish, self.size = self.dish[keep], self.size[keep]

    def add(self, dishes: np.ndarray, weight: np.ndarray) -> None:
        if not len(dishes):
            return
        seated = self.customers[dishes] - self.discount * self.tables[dishes]
        new = self.rng.random(len(dishes)) * (weight + seated) < weight
        new |= self.customers[dishes] == 0
        left = dishes[~new]
        for _ in range(30):  # a table by size less discount: drawn by size, kept with that share
            if not len(left):
                break
            at = self._pick(left)
            ok = self.rng.random(len(left)) * self.size[at] < self.size[at] - self.discount
            np.add.at(self.size, at[ok], 1)
            self.customers[left[ok]] += 1
            left = left[~ok]
        opened = np.concatenate([dishes[new], left])
        if len(opened):
            opened.sort()
            where = np.searchsorted(self.dish, opened)
            self.dish, self.size = np.insert(self.dish, where, opened), np.insert(self.size, where, 1)
            self.customers[opened] += 1
            self.tables[opened] += 1


def table_laws(discount: float, most: int = STIRLING) -> np.ndarray:
    """[n, t - 1]: log of the ways to seat n customers at t tables, generalised Stirling numbers
    S(n, t) times discount^(t-1) (t-1)! / (n-1)!, for n up to ``most``."""
    out = np.full((most + 1, most), -np.inf)
    t = np.arange(1, most + 1)
    out[1, 0] = 0.0
    with np.errstate(divide="ignore"):
        for n in range(1, most):
            stay = out[n] + np.log(np.maximum(1 - discount * t / n, 0))
            opened = np.concatenate([[-np.inf], out[n, :-1] + np.log(discount * t[:-1] / n)])
            out[n + 1] = np.logaddexp(stay, opened)
    return out


def _saddle(n: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The logs of table_laws() by the saddle point of ((1 - (1 - x)^d) / d)^t, for 1 <= t < n."""
    grid = np.concatenate([np.exp(np.linspace(-600, -3, 8000)), 1 - np.exp(np.linspace(np.log(1 - np.exp(-3)), -12, 4000))])  # of y = 1 - x
    ratio = (1 - grid) * discount * grid ** (discount - 1) / (1 - grid**discount)
    y = np.exp(np.interp(-np.log(n / t - 1), -np.log(ratio - 1), np.log(grid)))
    f, x, g = (1 - y**discount) / discount, 1 - y, y ** (discount - 1)
    rho = x * g / f
    bend = rho * (1 + x * (1 - discount) / y - rho)  # of log f, in log x
    return t * np.log(f) - n * np.log1p(-y) - 0.5 * np.log(t * np.maximum(bend, 1e-9)) - np.log(t) + (t - 1) * np.log(discount)


def draw_tables(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, laws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Number of tables of dishes, all customers reseated: p(t) ~ S(n, t) prod_{i<t} (others + i discount) base^t.

    ``others``: strength and discounts of the restaurant's tables without the dish's own. Above the
    largest n of ``laws`` S is the saddle point's, less its error there at t in the scale n^discount. Tables
    beyond 12 deviations of the law without the Stirling numbers, which fall in t, are left out.
    """
    most = laws.shape[1]
    r, h = others / discount + 1, np.minimum(base, 1 - 1e-9)
    mean = r * h / (1 - h)
    scale = np.minimum(1.0, (most / np.maximum(customers, 1)) ** discount)
    reach = np.where(customers <= most, customers, customers - 1)
    width = np.minimum(reach, np.ceil(mean + 12 * np.sqrt(mean / (1 - h)) + 30)).astype(np.int64)
    row = np.minimum(customers, most)
    flat = np.maximum(laws, -1e300)
    few = np.arange(1, most // 2)
    error = laws[most, : len(few)] - _saddle(np.full(len(few), most), few, discount)
    out = np.ones(len(customers), np.int64)
    order = np.argsort(width, kind="stable")
    lo = int(np.searchsorted(width[order], 2))
    while lo < len(order):
        w = width[order[lo]]
        hi = int(np.searchsorted(width[order], max(w + 1, w * 5 // 4)))
        hi = min(hi, lo + max(1, 1_000_000 // int(w)))
        at = order[lo:hi]
        steps = np.arange(width[at].max())
        law = flat[row[at][:, None], np.minimum(steps, most - 1)[None, :]]
        part = np.flatnonzero(scale[at] < 1)
        if len(part):
            n = customers[at[part]][:, None]
            t = np.minimum(steps[None, :] + 1, n - 1)
            law[part] = _saddle(n, t, discount) + np.interp(1 + (t - 1) * scale[at[part]][:, None], few, error)
        law[:, 1:] += np.cumsum(np.log((r[at][:, None] + steps[None, :-1]) / steps[None, 1:] * h[at][:, None]), axis=1)
        law[steps[None, :] >= width[at][:, None]] = -1e300
        total = np.cumsum(np.exp(law - law.max(axis=1)[:, None]), axis=1)
        out[at] = 1 + (total < (rng.random(len(at)) * total[:, -1])[:, None]).sum(axis=1)
        lo = hi
    return np.minimum(out, np.maximum(customers, 1))


def _discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), the usual estimate, kept between 0.1 and 0.95."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 + n2 else 0.5


def seat(word_counts: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, pair_counts: np.ndarray, n_contexts: int, *, shards: int = 1, scale: np.ndarray | None = None, seed: int = 0, burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH) -> dict:
    """Gibbs sweeps over one shard's seating; averages over the samples.

    A sweep reseats all customers of every (context, word) dish with two or more, a random half of the
    dishes after the other, then those of every word in the root, whose customers are by then all the
    tables that the dishes have. ``scale``: all shards' tables of each context over this one's.
    """
    rng = np.random.default_rng(seed)
    dishes = np.flatnonzero(pair_counts > 0)
    p_word, p_context, p_count = pair_word[dishes], pair_context[dishes], pair_counts[dishes].astype(np.int64)
    here = word_counts.astype(np.int64) - np.bincount(p_word, p_count, len(word_counts)).astype(np.int64)
    direct = float(shards * here.sum())
    scale = np.full(n_contexts, float(shards)) if scale is None else scale
    d1, d0 = _discount(p_count), _discount(word_counts)
    low_laws, root_laws = table_laws(d1), table_laws(d0)
    low = np.ones(len(p_count), np.int64)  # tables of each dish

    def in_root() -> np.ndarray:
        return here + np.bincount(p_word, low, len(word_counts)).astype(np.int64)

    root = in_root()
    root_low = (root > 0).astype(np.int64)
    many = np.flatnonzero(p_count >= 2)
    n_known = max(1, int((word_counts > 0).sum()))
    sums = {"root": np.zeros(len(word_counts)), "pair": np.zeros(len(pair_counts)), "tables": np.zeros(n_contexts), "root_tables": 0.0}
    for k in range(burn_in + samples):
        half = rng.random(len(many)) < 0.5
        for mine in (many[half], many[~half]):
            base = (strength / shards + d0 * root_low.sum()) / n_known  # of a word at a new root table
            prior = (root - d0 * root_low + base) / max(direct + shards * low.sum(), 1.0)
            open_tables = np.bincount(p_context, low, n_contexts) * scale
            others = strength + d1 * np.maximum(open_tables[p_context[mine]] - low[mine], 0)
            low[mine] = draw_tables(p_count[mine], others, prior[p_word[mine]], d1, low_laws, rng)
            root = in_root()
            root_low = np.minimum(np.maximum(root_low, root > 0), root)
        busy = np.flatnonzero(root >= 2)
        for mine in np.split(busy, [len(busy) // 2]):
            others = strength / shards + d0 * (root_low.sum() - root_low[mine])
            root_low[mine] = draw_tables(root[mine], others, np.full(len(mine), 1 / (n_known + 1)), d0, root_laws, rng)
        if k >= burn_in:
            sums["root"] += (root - d0 * root_low) / samples
            sums["pair"][dishes] += (p_count - d1 * low) / samples
            sums["tables"] += d1 * np.bincount(p_context, low, n_contexts) / samples
            sums["root_tables"] += d0 * float(root_low.sum()) / samples
    sums["context_customers"] = np.bincount(p_context, p_count, n_contexts)
    sums["known"] = int((word_counts > 0).sum())
    return sums


_ANSWER_DDL = "block bigint, shard int, counts binary, root binary, pair binary, contexts binary, tables binary, customers binary, own binary, s1 double, s2 double, s3 double"


def _answers(asked: DataFrame, shards: int, **kw) -> DataFrame:
    """One task per shard: merge what all blocks send, seat it, answer each block. Rows with block -1
    have this shard's sums of the contexts that lie in another (shard: its number), rows with block -2
    the root's, rows with block -3 the shard's words, among which ``own`` steps through a block's."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _ANSWER_DDL.split(", ")])

    def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        values, at = np.unique(np.concatenate(parts), return_inverse=True)
        return values, np.split(at, np.cumsum([len(x) for x in parts])[:-1])

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        shard = rows[0]["shard"]
        names, own = merged([np.frombuffer(r["words"], np.uint64) for r in rows])
        contexts, near = merged([_contexts(r["contexts"]) for r in rows])
        counts = np.bincount(np.concatenate(own), np.concatenate([_numbers(r["counts"]) for r in rows]), len(names)).astype(np.int64)
        seen = np.bincount(np.concatenate(near), np.concatenate([_numbers(r["context_count"]) for r in rows]), len(contexts))
        pairs, asked_pairs = merged([np.repeat(o, _numbers(r["n_pairs"])) << CONTEXT_BITS | c[_numbers(r["pair_context"])] for r, o, c in zip(rows, own, near, strict=True)])
        times = np.bincount(np.concatenate(asked_pairs), np.concatenate([_numbers(r["pair_count"]) for r in rows]), len(pairs)).astype(np.int64)
        after = pairs & ((1 << CONTEXT_BITS) - 1)
        scale = np.maximum(seen / np.maximum(np.bincount(after, times, len(contexts)), 1), 1)
        sums = seat(counts, pairs >> CONTEXT_BITS, after, times, len(contexts), shards=shards, scale=scale, seed=shard, **kw)
        root, pair = sums["root"].astype(np.float32), sums["pair"].astype(np.float32)
        out = [{"block": r["block"], "shard": shard, "counts": _planes(counts[o]), "root": _float_planes(root[o]), "pair": _float_planes(pair[p]), "own": _planes(np.diff(o, prepend=0))} for r, o, p in zip(rows, own, asked_pairs, strict=True)]
        w = _shard_bounds(contexts << CONTEXT_CUT, shards)
        out += [{"block": -1, "shard": k, "contexts": _names(contexts[i:j]), "tables": _float_planes(sums["tables"][i:j]), "customers": _planes(sums["context_customers"][i:j])} for k, (i, j) in enumerate(zip(w[:-1], w[1:], strict=True)) if i < j]
        out.append({"block": -2, "shard": shard, "s1": float(sums["known"]), "s2": float(sums["root"].sum() + sums["root_tables"]), "s3": float(sums["root_tables"])})
        out.append({"block": -3, "shard": shard, "contexts": names.tobytes()})
        return pa.Table.from_pylist(out, schema)

    return asked.groupBy("shard").applyInArrow(answer, _ANSWER_DDL)


def _context_totals(answers: DataFrame) -> DataFrame:
    """(block, shard, tables, customers): the sums of all shards for each word of a block, as a context."""

    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        context_of, tables, customers = np.empty(0, np.int64), np.empty(0), np.empty(0)
        sent = right.to_pylist()
        for r in sent:
            if r["kind"] == -3:
                contexts, context_of = np.unique(np.frombuffer(r["contexts"], np.uint64) >> CONTEXT_CUT, return_inverse=True)
                tables, customers = np.zeros(len(contexts)), np.zeros(len(contexts))
        for r in sent:
            if r["kind"] == -1:
                at = np.searchsorted(contexts, _contexts(r["contexts"]))  # every context is a word of its shard
                tables[at] += _floats(r["tables"])
                customers[at] += _numbers(r["customers"])
        out = {"block": [], "shard": [], "tables": [], "customers": []}
        for r in left.to_pylist():
            own = context_of[np.cumsum(_numbers(r["own"]))]
            for name, value in (("block", r["block"]), ("shard", r["shard"]), ("tables", _float_planes(tables[own])), ("customers", _float_planes(customers[own]))):
                out[name].append(value)
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

    asking = answers.filter("block >= 0").select("shard", "block", "own")
    # Renamed: in a cogroup of a table with itself Spark drops columns that both sides take.
    sums = answers.filter("block IN (-1, -3)").select(F.col("block").alias("kind"), F.col("shard").alias("to"), "contexts", "tables", "customers")
    return asking.groupBy("shard").cogroup(sums.groupBy("to")).applyInArrow(add, "block bigint, shard int, tables binary, customers binary")


# -- scores ---------------------------------------------------------------------------------------


def score_texts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folds: int = 5, held_fold: int = 1, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS, **kw) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32(id as text) modulo ``folds`` is not ``held_fold``. Scores are
    sums of log10 over a text's tokens. Words are told apart by 64-bit hashes, contexts by their upper 40
    bits (two words in a million million share a restaurant). Null and empty texts are
    one end token; very long texts are scored whole, in a block of their own; repeated rows count each; without training rows every token is unknown; an empty
    table gives no rows; other columns are not read, so none can clash. Ids must be integers (TypeError).
    """
    if docs.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_column} must be a column of integers")
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), (crc_mod(id_column, folds) != held_fold).alias("train"), text_of(text_column).alias("text"))
    blocks = written(blocks_of(rows, block_chars), "blocks")
    size = blocks.agg(F.sum("n_train").alias("n"), F.sum("n_words").alias("words")).first()
    n_train = size["n"] or 0
    shards = max(1, -(-(size["words"] or 0) // shard_words))
    answers = written(_answers(_asked(blocks, shards), shards, **kw), "answers")
    strength = kw.get("strength", STRENGTH)
    whole = answers.filter("block = -2").agg(F.sum("s1").alias("v"), F.sum("s2").alias("n"), F.sum("s3").alias("t")).first()
    known, customers, root_tables = (float(whole[k] or 0) for k in "vnt")

    def scored(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for r in left.to_pylist():
            parts = sorted(right.to_pylist(), key=lambda x: x["shard"])
            counts, root, pair, tables, sat = (np.concatenate([read(p[k]) for p in parts if p[k] is not None]) for k, read in (("counts", _numbers), ("root", _floats), ("pair", _floats), ("tables", _floats), ("customers", _floats)))
            tokens, lengths = _numbers(r["tokens"]), np.array(r["lengths"], np.int64)
            begin = np.cumsum(lengths) - lengths
            base = np.log10((counts + 0.5) / (n_train + 0.5 * (known + 1)))
            word = (root + (strength + root_tables) / (known + 1)) / (customers + strength)
            keys = _pairs(tokens, lengths, r["start"])
            inverse = np.unique(keys, return_inverse=True)[1]
            c = keys & ((1 << CONTEXT_BITS) - 1)
            p = (pair[inverse] + (strength + tables[c].astype(float)) * word[tokens]) / (sat[c].astype(float) + strength)
            out["doc_id"] += r["ids"]
            out["held_out"] += [not t for t in r["train"]]
            out["n_tokens"] += r["lengths"]
            out["n_known"] += np.add.reduceat((counts > 0)[tokens].astype(np.int64), begin).tolist()
            out["train_tokens"] += [n_train] * len(lengths)
            out["base_score"] += np.add.reduceat(base[tokens], begin).tolist()
            out["score"] += np.add.reduceat(np.log10(p), begin).tolist()
        kinds = {"held_out": pa.bool_(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    texts = blocks.select("block", "ids", "train", "lengths", "tokens", "start")
    none = F.lit(None).cast("binary")
    worth = answers.filter("block >= 0").select("block", "shard", "counts", "root", "pair", none.alias("tables"), none.alias("customers"))
    totals = _context_totals(answers)
    worth = worth.unionByName(totals.select("*", *[none.alias(x) for x in ("counts", "root", "pair")]))
    return texts.groupBy("block").cogroup(worth.groupBy("block")).applyInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
