"""Sum-of-squares online packing of tokenised documents into windows."""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

WINDOW = 2048
END_ID = 1
#: Characters of text that are tokenised and turned into arrays at a time.
BATCH_CHARS = 2_000_000
#: The word cache starts anew beyond so many words or characters.
CACHE_WORDS, CACHE_CHARS = 900_000, 12_000_000
#: Documents of a packing stream, about, and streams at most (beyond, they grow longer).
STREAM_DOCS, MAX_STREAMS = 4_096, 20_000
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_BLANKS = "\n\t\r\x0b\x0c"
_MARK = "\x01"


class _Numbers(dict):
    """Numbers words as they come; ``new`` lists those that are new."""

    def __init__(self, *a):
        super().__init__(*a)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordIds:
    """Token ids of texts by a tokenizer that never joins text across white space: each distinct
    word is encoded once while it is in the cache."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        rules = parts.get("normalizer") or {}
        rules = rules.get("normalizers", [rules] if rules else [])
        self.lowers = any(r["type"] == "Lowercase" for r in rules)
        self.tokenizer = Tokenizer.from_file(path)
        # Where the text is normal already, the same tokenizer without its rules gives the same ids sooner.
        plain = all(r["type"] in ("NFC", "Lowercase") or r["type"] == "Replace" and r["content"] == " " for r in rules)
        self.bare = Tokenizer.from_str(json.dumps(parts | {"normalizer": None})) if plain else self.tokenizer
        apart = [i for t in ("Re", "ab,", "x") for i in self.tokenizer.encode(t, add_special_tokens=False).ids]
        marks = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        if len(marks) != 1 or self.tokenizer.encode(" Re  ab,\n\tx ", add_special_tokens=False).ids != apart:
            raise ValueError(f"{path}: the tokenizer keeps white space in its tokens, or joins text across it")
        (self.mark,) = marks
        self._clear()

    def _clear(self) -> None:
        self.words = _Numbers({"": 0})
        self.counts, self.starts, self.flat, self.chars = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32), 0

    def _learn(self, new: list[str]) -> None:
        """Encode the words joined by a mark that is a token of its own; words that hold the mark go alone."""
        odd = {i for i, w in enumerate(new) if _MARK in w}
        plain = [w for i, w in enumerate(new) if i not in odd] if odd else new
        joined = [f" {_MARK} ".join(plain[i : i + 64]) + f" {_MARK}" for i in range(0, len(plain), 64)]
        normal = [self.lowers and (t.isascii() or is_normalized("NFC", t)) and t == t.lower() for t in joined]
        found: list = [None] * len(joined)
        for tokenizer, kind in ((self.bare, True), (self.tokenizer, False)):
            own = [i for i, n in enumerate(normal) if n == kind]
            for i, e in zip(own, tokenizer.encode_batch_fast([joined[i] for i in own], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, np.uint32)
        ids = np.concatenate([np.empty(0, np.uint32), *found])
        alone = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([new[i] for i in sorted(odd)], add_special_tokens=False)]
        mark = ids == self.mark
        n_plain = np.diff(np.concatenate([[-1], np.flatnonzero(mark)])) - 1
        n_odd = np.fromiter(map(len, alone), np.int64, len(alone))
        is_odd = np.zeros(len(new), bool)
        is_odd[list(odd)] = True
        order = np.argsort(is_odd, kind="stable")  # where each word of (plain, odd) stands in new
        n = np.concatenate([n_plain, n_odd]).astype(np.int64)
        counts, starts = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        counts[order], starts[order] = n, len(self.flat) + np.cumsum(n) - n
        self.counts, self.starts = np.concatenate([self.counts, counts]), np.concatenate([self.starts, starts])
        self.flat = np.concatenate([self.flat, ids[~mark], *alone])
        self.chars += sum(map(len, new))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each text's number of ids)."""
        if len(self.words) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._clear()
        parts = [_spread(t, self.lowers) for t in texts]
        words = " ".join(parts).split(" ")
        n_words = np.fromiter((t.count(" ") + 1 for t in parts), np.int64, len(parts))
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.new:
            self._learn(self.words.new)
            self.words.new = []
        counts = self.counts[at]
        ends = np.cumsum(counts)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - counts), counts)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        return ids, np.diff(bounds)


def _spread(text: str, lowers: bool) -> str:
    """A text with the same ids that repeats more words: the tokenizer lowers letters and parts words
    at white space anyway. Letters whose lower case depends on what stands around them are left to it."""
    if lowers and (text.isascii() or "\u03a3" not in text and "\u0130" not in text and is_normalized("NFC", text)):
        text = text.lower()
    for blank in _BLANKS:
        text = text.replace(blank, " ")
    return text


class LevelPacker:
    """Open windows by fill level, counted in an array; one stream of pieces.

    A piece of n ids goes to the level h that makes the sum of the squared counts of partly filled
    windows least: moving one window from h to h + n changes it by 2 * (count[h + n] - count[h]) + 2
    (a full window or an unopened one counts nothing). Ties go to the fullest level.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.windows: list[list[tuple]] = []

    def place(self, piece: tuple) -> int | None:
        """piece: (length, ...). The window's number once it is full."""
        n, size = piece[0], self.window
        if n == size:
            self.windows.append([piece])
            return len(self.windows) - 1
        count = self.count
        levels = np.arange(0, size - n + 1)
        change = 2 * count[n : size + 1] + 1 - (2 * count[: size - n + 1] - 1)
        change[0] = 2 * count[n] + 1  # a new window
        change[-1] = 1 - 2 * count[size - n]  # fills up
        ok = count[: size - n + 1] > 0
        ok[0] = True
        change = np.where(ok, change, np.iinfo(np.int64).max)
        best = int(levels[len(change) - 1 - int(np.argmin(change[::-1]))])
        if best:
            k = self.open[best].pop()
            count[best] -= 1
            self.windows[k].append(piece)
        else:
            self.windows.append([piece])
            k = len(self.windows) - 1
        if best + n == size:
            return k
        self.open.setdefault(best + n, []).append(k)
        count[best + n] += 1
        return None

    def rest(self) -> list[list[tuple]]:
        """Pieces of the windows that never filled, fullest first; the packer is empty afterwards."""
        left = [self.windows[k] for level in sorted(self.open, reverse=True) for k in self.open[level]]
        self.__init__(self.window)
        return left


def cut_rest(left: list[list[tuple]], window: int = WINDOW) -> list[list[tuple]]:
    """Fill windows to the brim from the unfilled ones, cutting pieces; what is left at the end makes
    sequences of powers of two. Piece: (length, start, document number, first id)."""
    out, now, room = [], [], window
    pieces = [p for w in left for p in w]
    total = sum(p[0] for p in pieces)
    sizes = [window] * (total // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if (total % window) >> b & 1]
    sizes.reverse()
    room = sizes.pop() if sizes else 0
    for n, start, doc, first in pieces:
        while n:
            take = min(n, room)
            now.append((take, start, doc, first))
            n, start, first, room = n - take, start + take, first + take, room - take
            if not room:
                out.append(now)
                now, room = [], sizes.pop() if sizes else 0
    return out


def fill_open(left: list[list[tuple]], window: int = WINDOW) -> list[list[tuple]]:
    """Sequences from the windows, fullest first, that are open when a stream ends.

    The fuller ones stay as sum-of-squares made them; the emptiest are taken apart to fill them. The
    last one, one a stream, makes sequences of powers of two: no padding.
    """
    open_, spare, out = deque(left), [], []
    while open_:
        now = open_.popleft()
        room = window - sum(p[0] for p in now)
        while room and (spare or open_):
            spare = spare or open_.pop()
            n, start, doc, first = spare.pop()
            take = min(n, room)
            now.append((take, start, doc, first))
            if n > take:
                spare.append((n - take, start + take, doc, first + take))
            room -= take
        if room:
            spare = now
        else:
            out.append(now)
    return out + cut_rest([spare], window)


def _encoded(rows: DataFrame, tokenizer_path: str, streams: int, window: int, end_id: int, per_stream: int | None = None) -> DataFrame:
    """(doc_id, text) -> a row per full window of a document, a sequence of its own, and one per tail with
    its ids and with the stream it is dealt to: in turn or, if a rank follows the text, ``per_stream`` ranks each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer_path)
        partition = TaskContext.get().partitionId()
        n_docs = n_seq = 0
        for batch in batches:
            kind, ids_of, texts = batch.schema.field(0).type, batch.column(0).to_pylist(), batch.column(1)
            ranks = batch.column(2).to_pylist() if per_stream else None
            for lo, hi in _slices(texts, BATCH_CHARS):
                ids, counts = encode(texts.slice(lo, hi - lo).to_pylist())
                at, out = 0, []
                for k, n in enumerate(counts):
                    all_ids = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at, total = at + n, len(all_ids)
                    deal = (ranks[lo + k] // per_stream, ranks[lo + k]) if ranks else ((partition * 40503 + n_docs) % streams, partition << 32 | n_docs)
                    deal = (*deal, ids_of[lo + k])
                    for start in range(0, total, window):
                        piece = all_ids[start : start + window].tobytes()
                        full = len(piece) == 4 * window
                        out.append((*deal, start, len(piece) // 4, zlib.crc32(piece), total, partition << 32 | n_seq if full else None, None if full else piece))
                        n_seq += full
                    n_docs += 1
                types = [pa.int32(), pa.int64(), kind, *[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["stream", "number", *PIECE[:-1], "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"stream int, number bigint, doc_id {kind}, " + ", ".join(f"{x} bigint" for x in PIECE[1:-1]) + ", ids binary")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, end_id: int = END_ID, stream_docs: int = STREAM_DOCS, rank: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are tokenised where they lie; a document's full windows are sequences of their own. Its
    tail, with its ids, goes to one of many long streams of about ``stream_docs`` documents, dealt out
    in turn (a task a stream), and there to the level that sum-of-squares picks. Where a stream ends, the emptiest of its open
    windows are taken apart to fill the others (see fill_open()), so that no sequence is padded; the
    longer the streams, the smaller that share. A task holds the ids of its stream's open windows.

    With ``rank``, whole numbers from 0 that tell the documents' order, a stream is a stretch of that
    order and takes its documents in it; sequence ids go up with the streams.

    A null or empty text is its end id alone; a very long text is many full windows and one tail; of
    levels that are equally good the fullest is taken; repeated rows are documents of their own; an
    empty table gives no rows; other columns are not read, so none can clash. The id column keeps its
    type. The tokenizer is read in each task from ``tokenizer_path``, which every executor has; one that does not
    drop white space raises (ValueError).
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), *([] if rank is None else [rank.cast("bigint").alias("rank")]))
    n_docs = docs.count()
    streams = min(MAX_STREAMS, max(1, -(-n_docs // stream_docs)))
    per_stream = None if rank is None else max(1, -(-n_docs // streams))
    dealt = _encoded(rows, tokenizer_path, streams, window, end_id, per_stream).repartitionById(streams, F.col("stream")).sortWithinPartitions("stream", "number")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, packer, held, n_seq = None, LevelPacker(window), {}, 0
        out: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal n_seq
            offset = 0
            for n, start, number, first in pieces:
                doc_id, crc, total, ids = held[number]
                part = ids[4 * first : 4 * (first + n)]
                out.append((doc_id, start, n, crc if len(part) == len(ids) else zlib.crc32(part), total, 1 << 62 | stream << 32 | n_seq, offset))
                offset += n
            n_seq += 1

        def finish() -> None:
            nonlocal n_seq
            for pieces in fill_open(packer.rest(), window):
                emit(pieces)
            held.clear()
            n_seq = 0

        kind = None
        for batch in batches:
            kind = batch.schema.field(2).type
            for own, number, doc_id, start, length, crc, total, sequence, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != stream:
                    finish()
                    stream = own
                if ids is None:
                    out.append((doc_id, start, length, crc, total, sequence, 0))
                    continue
                held[number] = (doc_id, crc, total, ids)
                full = packer.place((length, start, number, 0))
                if full is not None:
                    done, packer.windows[full] = packer.windows[full], []
                    emit(done)
                    for piece in done:
                        del held[piece[2]]
            yield _batch(out, kind)
            out = []
        finish()
        if out:
            yield _batch(out, kind)

    return dealt.mapInArrow(packed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} bigint" for x in PIECE[1:]))


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about ``most`` bytes of text, one row at least."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(PIECE)
    return pa.RecordBatch.from_arrays([pa.array(c, kind if name == "doc_id" else pa.int64()) for name, c in zip(PIECE, columns, strict=True)], PIECE)
