"""The pipeline's stages against brute force, each on what its predecessor kept."""

import hashlib
import os
import random
import sys
from collections import Counter

import public_tokenizers
from helpers import BLANK, awkward_rows, prose, words
from pyspark.sql import functions as F
from test_mixing import brute as mix
from test_ngram_join import brute
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as C  # noqa: E402

SF = "/root/testdata/sf0.001"


def mixed(rows):
    """Copies of each document that the mix takes, by the queue's definition."""
    size = {r["doc_id"]: len(words(r["text"])) for r in rows}
    taken, _ = mix([(r["doc_id"], r["source"], size[r["doc_id"]]) for r in rows])
    return Counter({d: -(-n // size[d]) for (d, _, _), n in taken.items() if n})


def mix_order(rows):
    """doc_ids of the mix by finish time: whole copies, the words of a source served one after the other."""
    size = {r["doc_id"]: len(words(r["text"])) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    taken, want = mix([(d, source[d], size[d]) for d in size])
    out, total = [], Counter()
    for d in size:
        total[source[d]] += size[d]
    for s in total:
        at = 0
        for d in sorted((d for d in size if source[d] == s), key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
            at += size[d]
            times = -(-taken[d, s, size[d]] // size[d]) if size[d] else 0
            out += [((at + e * total[s]) / want[s], d) for e in range(times)]
    return [d for _, d in sorted(out)]


def test_order_survives_files_of_any_size(spark, tmp_path):
    """Files are read by size; ranks follow their numbers. Streams are stretches of the order."""
    rows = [(i, "w " * (1 + (i * 37) % 90), "k") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _rank string").coalesce(1)
    path = f"file://{tmp_path}/order"
    df.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 30).parquet(path)
    for source in (spark.read.parquet(path), df):
        placed, rank = C.ranked(source)
        assert rank == "_rank_" and [(r["doc_id"], r["doc_id"]) for r in placed.collect()] == [(r["doc_id"], r[rank]) for r in placed.collect()]
    placed, rank = C.ranked(spark.read.parquet(path))
    pieces = C.pack_documents(placed, public_tokenizers.path(C.TOKENIZER), stream_docs=100, rank=F.col(rank)).collect()
    stream = {p["doc_id"]: p["sequence_id"] >> 32 & 0xFFFF for p in pieces}
    assert [stream[i] for i in range(500)] == [i // 100 for i in range(500)]


def test_stages(spark):
    stages = dict(C.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    def after(name, before):
        out = C.written(stages[name](spark, before, SF), name)
        assert out.columns == columns, name
        return out, out.collect()

    clean, rows = after("toxicity", docs)
    kept = {r["doc_id"] for r in rows}
    judged = [(d, t) for d, t in labels.items()]
    assert sum((d not in kept) == bool(t) for d, t in judged) / len(judged) > 0.9
    first = {}
    for r in rows:
        key = BLANK.sub(" ", r["text"] or "")
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    exact, rows = after("exact_dedup", clean)
    assert sorted(r["doc_id"] for r in rows) == sorted(first.values())
    want = sorted(d for d, c, _ in brute([(r["doc_id"], r["text"]) for r in rows]) if d == c)
    near, rows = after("ngram_join", exact)
    assert sorted(r["doc_id"] for r in rows) == want
    copies = mixed(rows)
    in_order, rows = after("mixing", near)
    assert Counter(r["doc_id"] for r in rows) == copies
    placed, rank = C.ranked(in_order)
    got = [(r["doc_id"], r[rank]) for r in placed.collect()]
    assert sorted(r for _, r in got) == list(range(len(rows)))
    assert [d for d, _ in sorted(got, key=lambda x: x[1])] == mix_order(near.collect())
    packed = stages["packing"](spark, in_order, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))
    assert sum(r["length"] for r in packed) == sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows)
    assert len(C.run(spark, SF).columns) == 7


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, SF), name)
        assert docs.count() == 0


CLASHING = ["_id", "_time", "_times", "_key", "_own", "_score", "_digest", "_sha256", "_d", "_t0", "_stretch", "_first", "_finish", "size", "key", "node", "root", "fp", "block", "target", "stream", "number"]


def test_awkward_documents_with_clashing_columns(spark):
    """Nulls, blanks, ties, repeated rows and long texts pass every stage with columns of any name whole."""
    base = [(r[0], r[1], r[2], r[3], 1) for r in awkward_rows()]
    base += [(1000 + i, prose(random.Random(i), 90), "en", f"s{i % 3}", 1) for i in range(30)]
    rows = [(*r, *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(base)]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in CLASHING)])
    docs = spark.createDataFrame(rows, schema)
    known = Counter(rows)
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
        out = [tuple(r) for r in docs.collect()]
        assert set(out) <= set(known), name
        if name == "exact_dedup":
            assert len({BLANK.sub(" ", r[1] or "") for r in out}) == len(out)
    assert dict(C.STAGES)["packing"](spark, docs, SF).count() > 0
