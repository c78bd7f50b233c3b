import base64
import gzip
import hashlib
import re

from tidemark.llm import warc as W


def record(i, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (i, hashlib.sha1(payload).hexdigest().encode(), len(block)) + block + b"\r\n\r\n"


PARTS = [record(i, b"payload %d " % i * 20) for i in range(5)]


def found(data):
    out = list(W.salvage(data))
    spans = sorted({x[:2] for x in out})
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    return [int(x[2]["fields"]["warc-record-id"][10:-1]) for x in out if x[2]], [x[:2] for x in out if not x[2]]


def test_round_trip():
    for data in (b"".join(PARTS), b"".join(map(gzip.compress, PARTS))):
        assert found(data) == ([0, 1, 2, 3, 4], [])


def test_salvage_plain():
    cut = PARTS[0] + PARTS[1][:100] + PARTS[2] + b"junk" + PARTS[3].replace(b"payload 3", b"payloax 3") + PARTS[4][:-30]
    ids, gaps = found(cut)
    assert ids == [0, 2] and gaps[0] == (len(PARTS[0]), len(PARTS[0]) + 100)
    fake = record(7, b"text with\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc")
    assert found(fake + PARTS[0]) == ([7, 0], [])
    assert found(b"no archive at all") == ([], [(0, 17)])


def test_salvage_members():
    g = [gzip.compress(p) for p in PARTS]
    bad = bytearray(g[3])
    bad[-9] ^= 0xFF
    data = g[0] + g[1][:60] + g[2] + b"zz" + bytes(bad) + g[4]
    ids, gaps = found(data)
    assert ids in ([0, 2, 4], [0, 2, 3, 4])  # of the broken member, if its record's digest fits
    assert gaps[0] == (len(g[0]), len(g[0]) + 60) and len(gaps) == 2


PAGES = "page_id long, url string, html string, _digest string, record_type string"


def pages(spark):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a", big), (2, "u v\r\nx", big), (3, None, big), (3, None, big), (4, "x", None), (5, "x", "short"), (6, "x", "short"), (None, "x", big + "1"), (7, "y", "WARC/1.1\r\n\r\nWARC/1.0\r\n evil\r\n\r\n" * 100), (8, "z", "a" * 1000), (9, "z", "a" * 1000), (10, "z", "b" * 999), (11, "z", "b" * 999), (None, "z", "a" * 1000)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def test_archived_pages(spark, tmp_path):
    rows, df = pages(spark)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == data and k is not None]
        top = max(same) if same and len(data) >= 1000 else None
        revisit = top is not None and i != top
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    got = [tuple(r) for r in W.archived_pages(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_damaged_files_are_salvaged(spark, tmp_path):
    _, df = pages(spark)
    path = f"file://{tmp_path}/warc"
    W.write_warc(df.coalesce(1), path)
    (file,) = (tmp_path / "warc").glob("part-*")
    data = file.read_bytes()
    at = data.find(b"<urn:page:2>")
    file.write_bytes(data[:at] + b"\0" * 40 + data[at + 40 :])
    for x in (tmp_path / "warc").glob(".*crc"):
        x.unlink()
    rows = W.read_warc(spark, path).collect()
    assert {r["record_id"] for r in rows if r["problem"] is None} >= {"urn:page:1", "urn:page:3", "urn:page:7"} and any(r["problem"] for r in rows)
    assert sum(r["stop"] - r["start"] for r in rows) == len(data)


def test_gzip_files_read_alike(spark, tmp_path):
    _, df = pages(spark)
    seen = []
    for kind in ("none", "gzip"):
        path = f"file://{tmp_path}/{kind}"
        W.write_warc(df, path, compression=kind)
        assert all(x.read_bytes().startswith(b"\x1f\x8b" if kind == "gzip" else b"WARC") for x in (tmp_path / kind).glob("part-*"))
        seen.append(sorted((str(r["record_id"]), r["record_type"], r["payload_digest"]) for r in W.read_warc(spark, path).filter("problem IS NULL").collect()))
    assert seen[0] == seen[1] and len(seen[0]) == df.count()


def test_empty_table(spark):
    assert W.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_digests_in_base32_and_of_blocks():
    payload = b"some payload " * 9
    for field in (b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()), b"WARC-Block-Digest: SHA1:" + base64.b32encode(hashlib.sha1(b"HTTP/1.1 200 OK\r\n\r\n" + payload).digest())):
        good = re.sub(rb"WARC-Payload-Digest: \S+", lambda m, f=field: f, record(6, payload))
        assert found(good + PARTS[0]) == ([6, 0], [])
        bad = good.replace(b"some payload some", b"some payloae some")
        assert len(bad) == len(good) and found(bad + PARTS[0]) == ([0], [(0, len(good))])
    assert W.digest_of("sha1:" + "1" * 32) == W.digest_of("md5:abc") == W.digest_of("") == ("", "")


def read(data):
    out = list(W.salvage(data))
    records = [(x[2]["fields"]["warc-record-id"], x[2]["payload"]) for x in out if x[2]]
    gaps = [x for x in out if not x[2]]
    spans = sorted({x[:2] for x in out})
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    return records, gaps


SMALL = [record(i, b"payload %d " % i * 4) for i in range(4)]
WHOLE = [(f"<urn:page:{i}>", b"payload %d " % i * 4) for i in range(4)]


def test_every_flipped_byte_loses_one_record_and_logs_it():
    for data in (b"".join(SMALL), b"".join(gzip.compress(r, mtime=0) for r in SMALL), gzip.compress(b"".join(SMALL), mtime=0)):
        for at in range(len(data)):
            bad = bytearray(data)
            bad[at] ^= 0x55
            records, gaps = read(bytes(bad))
            sound = [r for r in records if r in WHOLE]
            one_member = data.count(b"\x1f\x8b\x08") == 1 and data[:2] == b"\x1f\x8b"
            assert one_member or len(sound) >= 3
            assert gaps or len(records) == 4
            # Bytes that no check covers (a field's text) may change a record's name, not its payload.
            assert all(p in [w[1] for w in WHOLE] for _, p in records)


def test_every_cut_keeps_what_is_whole():
    data = b"".join(gzip.compress(r, mtime=0) for r in SMALL)
    ends = [len(b"".join(gzip.compress(r, mtime=0) for r in SMALL[:k])) for k in range(5)]
    for at in range(1, len(data)):
        records, gaps = read(data[:at])
        n = sum(e <= at for e in ends[1:])
        assert records[:n] == WHOLE[:n] and bool(gaps) == (at not in ends)


def test_gap_inside_a_member_is_logged():
    middle = SMALL[1].replace(b"payload 1", b"payloae 1")
    out = list(W.salvage(gzip.compress(SMALL[0] + middle + SMALL[2])))
    assert [bool(x[2]) for x in out] == [True, False, True]
    assert out[1][3] == "payload digest does not fit" and out[1][4:] == (len(SMALL[0]), len(SMALL[0] + middle))


def test_own_gzip_file_with_a_flipped_byte(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 30) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    W.write_warc(pages, f"file://{tmp_path}/w", compression="gzip")
    (file,) = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 200
    assert len(read(data)[0]) == 200 and not read(data)[1]
    for at in range(5, len(data), len(data) // 40):
        bad = bytearray(data)
        bad[at] ^= 0x10
        records, gaps = read(bytes(bad))
        assert len(records) >= 199 and 200 - len(records) <= len(gaps) <= 1
    assert len(read(data[:-9])[0]) >= 199


def test_long_records_in_gzip_files(spark, tmp_path):
    rows = [(1, None, "ab" * 9_000_000), (2, None, "short")]
    W.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w", compression="gzip")
    out = {r["record_id"]: r["payload_bytes"] for r in W.read_warc(spark, f"file://{tmp_path}/w").filter("problem IS NULL").collect()}
    assert out == {"urn:page:1": 18_000_000, "urn:page:2": 5}


def test_folded_headers_and_other_digests():
    folded = SMALL[0].replace(b"Content-Type: application/http; msgtype=response", b"Content-Type: application/http;\r\n\tmsgtype=response")
    assert read(folded + SMALL[1]) == (WHOLE[:2], [])
    for kind in (b"resource", b"request", b"metadata"):
        block = b"GET / HTTP/1.1\r\n\r\nbody" if kind == b"request" else b"plain block"
        payload = block.partition(b"\r\n\r\n")[2] or block
        mime = b"application/http; msgtype=request" if kind == b"request" else b"text/plain"
        for algorithm in ("md5", "sha1", "sha256"):
            told = hashlib.new(algorithm, payload).hexdigest().encode()
            good = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <x>\r\nContent-Type: %s\r\nWARC-Payload-Digest: %s:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, mime, algorithm.encode(), told, len(block), block)
            assert read(good)[0] == [("<x>", payload)]
            assert read(good.replace(payload + b"\r\n\r\n", b"?" + payload[1:] + b"\r\n\r\n")) == ([], [(0, len(good), None, "payload digest does not fit", None, None)])


def test_text_ids_and_clashing_columns(spark):
    big = "z" * 1500
    rows = [("b c:%é", "http://a", big, "k"), ("a", "http://a", big, "k"), (None, "u", big, "k"), ("", "u", "x", "k")]
    df = spark.createDataFrame(rows, "_keep string, url string, html string, _digest string")
    got = sorted((r["page_id"] or "?", r["record_type"], r["refers_to"]) for r in W.archived_pages(df, id_column="_keep").collect())
    assert got == [("?", "response", None), ("?", "revisit", "b c:%é"), ("a", "revisit", "b c:%é"), ("b c:%é", "response", None)]
    assert W.with_revisits(df, id_column="_keep").columns == ["_keep", "url", "html", "_digest", "_digest_", "_bytes", "_refers"]
