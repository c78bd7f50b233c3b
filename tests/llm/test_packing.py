import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, awkward_rows, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark):
    rows = awkward_rows()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((str(r[0]), tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in rows)
    got = P.pack_documents(awkward(spark).coalesce(2), PATH).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(str(r["doc_id"]), r["doc_tokens"])].append((r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    for name, ids in want:
        array = np.array(ids, "<u4")
        own = pieces[(name, len(ids))]
        for start, length, crc in own:
            assert zlib.crc32(array[start : start + length].tobytes()) == crc
        # Disjoint and gapless, for as many documents as share the id and the length.
        times = sum(1 for n, i in want if (n, len(i)) == (name, len(ids)))
        covered = np.zeros(len(ids) + 1, int)
        for start, length, _ in own:
            covered[start] += 1
            covered[start + length] -= 1
        assert (np.cumsum(covered)[:-1] == times).all()
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in want)


def test_word_ids_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["", "a", "A\x01b \x01", "İstanbul ΣΑΣ Σ", "it's a,b.c d',x ,.y", "<|endoftext|> a<|startoftext|>B", "é É é É.", "x" * 5000, "   a\u0085b\x1cc", "ǅ.ß,ẞ", " lead\n\n  trail ", "１２ 3.5,6 ½ 你好,世界。 😀👍🏽."]
    ids, counts = P.WordIds(PATH)(texts)
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends, counts, strict=True):
        assert ids[e - n : e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        P.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_a_stream_is_a_task(spark):
    df = spark.range(40, numPartitions=4).selectExpr("id AS doc_id", "repeat('word ', 5) AS text")
    out = P.pack_documents(df, PATH, stream_docs=5)
    tasks = out.select(((F.col("sequence_id") - F.lit(1 << 62)) / (1 << 32)).cast("bigint").alias("stream"), F.spark_partition_id().alias("task")).distinct().collect()
    assert sorted((r["stream"], r["task"]) for r in tasks) == [(k, k) for k in range(8)]


def test_level_packer_minimises_squares():
    rnd = random.Random(1)
    packer = P.LevelPacker(16)
    for _ in range(300):
        n = rnd.randrange(1, 16)
        before = packer.count.copy()

        def after(level):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + n < 16:
                c[level + n] += 1
            return int((c[1:16].astype(int) ** 2).sum())

        options = [0, *(h for h in range(1, 17 - n) if before[h])]
        packer.place((n,))
        assert int((packer.count[1:16].astype(int) ** 2).sum()) == min(map(after, options))


def test_cut_rest_pads_nothing():
    left = [[(9, 0, 0, 0)], [(5, 0, 1, 0)], [(7, 2, 2, 2), (3, 0, 3, 0)]]
    out = P.cut_rest(left, 16)
    assert [sum(p[0] for p in s) for s in out] == [16, 8]
    assert sum(p[0] for s in out for p in s) == 24


def test_open_windows_stay_where_others_fill_them():
    left = [[(15, 0, 0, 0)], [(8, 0, 1, 0), (3, 0, 2, 0)], [(7, 0, 3, 0)], [(4, 0, 4, 0)], [(1, 0, 5, 0)]]
    out = P.fill_open(left, 16)
    assert [sum(p[0] for p in s) for s in out] == [16, 16, 4, 2]
    assert out[0] == [(15, 0, 0, 0), (1, 0, 5, 0)] and out[1][:2] == [(8, 0, 1, 0), (3, 0, 2, 0)]
    assert P.fill_open([], 16) == []


def test_sum_of_squares_places_nine_tails_of_ten():
    rnd = random.Random(3)
    packer = P.LevelPacker()
    tails = 10_000
    for i in range(tails):
        packer.place((1 + min(2046, int(rnd.lognormvariate(6, 1))), 0, i, 0))
    left = packer.rest()
    whole = {p[2] for w in left for p in w}
    kept = {w[0][2] for w in P.fill_open([list(w) for w in left]) if len(w) > 1 and any(list(w)[: len(x)] == x for x in left)}
    moved = whole - {p[2] for x in left if x[0][2] in kept for p in x}
    assert len(moved) < 0.1 * tails


def test_text_ids_and_several_streams(spark):
    df = awkward(spark).selectExpr("concat('d', doc_id) AS doc_id", "text").repartition(3)
    got = P.pack_documents(df, PATH, stream_docs=5).collect()
    plain = P.pack_documents(awkward(spark), PATH).collect()
    assert sum(r["length"] for r in got) == sum(r["length"] for r in plain)
    assert {r["doc_id"] for r in got} == {None if r["doc_id"] is None else f"d{r['doc_id']}" for r in plain}
    lengths = defaultdict(int)
    for r in got:
        lengths[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())


def test_empty_table(spark):
    assert P.pack_documents(empty(spark), PATH).count() == 0
