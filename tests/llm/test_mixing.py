import hashlib

from helpers import awkward, awkward_rows, empty, words

from tidemark.llm import mixing as M


def targets(sizes):
    """Share by weight, stop at three times the size, share the rest again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def brute(rows):
    """taken of each (doc_id, source, size) by the queue's definition: packets of all copies in order of
    finish time, up to the sum of all sizes."""
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    names, want = sorted(sizes, key=lambda s: (s is None, s or "")), targets(sizes)
    queue = []
    for number, source in enumerate(names):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[2]))
        at = 0
        for _ in range(3):
            for r in own:
                for lo in range(0, r[2], M.PACKET):
                    n = min(M.PACKET, r[2] - lo)
                    queue.append(((at + n) / want[source], number, at, n, r))
                    at += n
    left, taken = sum(sizes.values()), dict.fromkeys(rows, 0)
    for *_, n, r in sorted(queue, key=lambda x: x[:3]):
        taken[r] += min(n, left)
        left -= min(n, left)
    return taken, want


def test_awkward_rows(spark):
    rows = awkward_rows()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want = targets(sizes)
    got = M.mix_documents(awkward(spark)).collect()
    rows_of = [(r[0], r[3], len(words(r[1]))) for r in rows]
    total, _ = brute(rows_of)
    for key in set(rows_of):
        assert sum(r["taken"] for r in got if (r["doc_id"], r["source"], r["size"]) == key) == total[key]
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), len(words(r[1]))) for r in rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(want[s] - taken[s]) <= M.PACKET
    assert sum(taken.values()) == sum(sizes.values())
    again = M.mix_documents(awkward(spark).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_small_source_stops_at_three_times(spark):
    rows = [(i, "a b c d e f g h i j", "en", "big") for i in range(50)] + [(99, "only four words here", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in M.mix_documents(df).collect()}
    assert got[99]["target"] == 12.0 and got[99]["taken"] == 12
    order = M.served_order(M.mix_documents(df)).collect()
    assert [r["finish"] for r in order] == sorted(r["finish"] for r in order)
    assert sum(r["words"] for r in order) == sum(r["taken"] for r in got.values()) == 504


def test_against_the_queue_by_hand(spark):
    rows = [(i, f"s{i % 4}" if i % 7 else None, 1 + (i * 37) % 900) for i in range(300)] + [(None, "s1", 12)] * 40
    df = spark.createDataFrame([(d, "x " * n, s) for d, s, n in rows], "doc_id long, text string, source string")
    want, _ = brute(rows)
    got = {}
    for r in M.mix_documents(df).collect():
        key = (r["doc_id"], r["source"], r["size"])
        got[key] = got.get(key, 0) + r["taken"]
    assert got == want


def test_empty_table(spark):
    assert M.mix_documents(empty(spark)).count() == 0
