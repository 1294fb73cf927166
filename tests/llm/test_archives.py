from __future__ import annotations

import base64
import hashlib
import random

from precursor.llm.warc_salvage import (Salvage, gzip_member, page_of, page_record, read_archives, record_bytes,
                                        write_archives)


def _digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS _id", "url AS _digest", "1 AS content")


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\r\nX: y", rng.choice(["", None, "<p>é</p>", "WARC/1.1\r\n\r\n", "a" * 100_000, f"own {i}"])) for i in range(200)]
    archives = write_archives(_pages(spark, rows), archive_bytes=4000)
    assert archives.agg({"n_records": "sum"}).first()[0] == len(rows)
    got = read_archives(archives).select(page_of("record_id").alias("id"), "payload", "payload_bytes", "payload_digest", "record_type",
                                         page_of("refers_to").alias("to"), "gap_bytes").collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", -1))
    assert len(got) == len(rows) and all(r["gap_bytes"] is None for r in got)
    html = {i: h or "" for i, _, h in rows}
    for r in got:
        h = html[r["id"]]
        response = last[h] == r["id"]
        assert r["record_type"] == ("response" if response else "revisit")
        assert r["to"] == (None if response else last[h])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), _digest(h.encode()))
        assert r["payload"] == (h.encode() if response else None)


def test_edge_pages(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "u", "a"), (None, None, "only here"), (2, "u", None)]
    got = read_archives(write_archives(_pages(spark, rows))).collect()
    assert sorted((r["record_id"], r["record_type"]) for r in got) == [
        ("<urn:page:->", "response"), ("<urn:page:->", "revisit"), ("<urn:page:1>", "response"), ("<urn:page:1>", "response"),
        ("<urn:page:2>", "response")]
    assert read_archives(write_archives(_pages(spark, []))).count() == 0


def _archive(n, zipped, rng):
    out, bounds = b"", []
    for i in range(n):
        r = page_record(i, f"http://x/{i}", rng.randbytes(rng.randint(0, 300)), None)
        out += gzip_member(r) if zipped else r
        bounds.append(len(out))
    return out, bounds


def _read(data):
    s = Salvage(data)
    return [int(r.headers["warc-record-id"][10:-1]) for r in s.records()], [(g.offset, g.length) for g in s.gaps]


def test_salvage_after_damage():
    for zipped in (True, False):
        for seed in range(40):
            rng = random.Random(seed)
            data, ends = _archive(12, zipped, rng)
            assert _read(data) == (list(range(12)), [])
            k = rng.randrange(12)
            lo, hi = ([0, *ends][k], ends[k])
            broken = bytearray(data)
            if zipped or seed % 2:
                broken[lo:lo + 12] = bytes(12)  # the start of a member or the version line
            else:
                broken[hi - 5] ^= 0xFF          # a byte at the end of the block: its digest fails
            ids, gaps = _read(bytes(broken))
            assert ids == [i for i in range(12) if i != k] and gaps == [(lo, hi - lo)]
            # cut out in the middle of a record
            ids, gaps = _read(data[:lo + 20] + data[hi:])
            assert ids == [i for i in range(12) if i != k] and gaps == [(lo, 20)]
            # a truncated end
            ids, gaps = _read(data[:ends[-1] - 6])
            assert ids == list(range(11)) and gaps == [(ends[-2], ends[-1] - 6 - ends[-2])]


def test_salvage_of_garbage_and_wrong_lengths():
    junk = b"junk" * 10
    assert _read(junk) == ([], [(0, 40)])
    assert _read(b"") == ([], [])
    good = page_record(7, "u", b"payload", None)
    assert _read(junk + good + junk) == ([7], [(0, 40), (40 + len(good), 40)])
    bad = record_bytes([("WARC-Type", "response")], b"x").replace(b"Content-Length: 1", b"Content-Length: x")
    assert _read(bad + good) == ([7], [(0, len(bad))])
    two = gzip_member(good + good)
    assert _read(two + gzip_member(good))[0] == [7]


def test_damaged_archives_through_spark(spark):
    data, ends = _archive(5, True, random.Random(2))
    broken = data[:ends[1]] + bytes(50) + data[ends[1]:]
    got = read_archives(spark.createDataFrame([(bytearray(broken),), (None,)], "content binary")).collect()
    assert sum(r["gap_bytes"] is None for r in got) == 5
    assert [(r["archive_offset"], r["gap_bytes"]) for r in got if r["gap_bytes"] is not None] == [(ends[1], 50)]


def _covered(data):
    """The reader raises nothing, and records and gaps cover every byte once."""
    s = Salvage(data)
    at = [r.offset for r in s.records()]
    ids = sorted([(o, "r") for o in at] + [(g.offset, g.length) for g in s.gaps])
    place = 0
    for i, (offset, kind) in enumerate(ids):
        assert offset == place
        place = (ids[i + 1][0] if i + 1 < len(ids) else len(data)) if kind == "r" else offset + kind
    assert place == len(data)
    return len(at), s.gaps


def test_damaged_headers():
    revisit = page_record(3, "http://x/3", b"", 2)
    for told in (b"abc", b"-1", b"9" * 5000, b"1_0", "٣".encode()):
        bad = revisit.replace(b"X-Payload-Length: 0", b"X-Payload-Length: " + told)
        good = page_record(4, "u", b"after", None)
        assert _read(bad + good) == ([4], [(0, len(bad))])
        assert _read(gzip_member(bad) + gzip_member(good))[0] == [4]
        bad = record_bytes([("WARC-Type", "response")], b"x").replace(b"Content-Length: 1", b"Content-Length: " + told)
        assert _read(bad + good) == ([4], [(0, len(bad))])
        assert _read(gzip_member(bad) + gzip_member(good))[0] == [4]


def test_any_byte_may_be_damaged():
    for zipped in (False, True):
        rng = random.Random(7)
        records = [page_record(i, f"http://x/{i}", rng.randbytes(60), None if i % 3 else i + 1) for i in range(4)]
        heads = [r.index(b"\r\n\r\n") for r in records]
        for seed in range(1000):
            rng = random.Random(seed)
            k = rng.randrange(4)
            broken = bytearray(records[k])
            broken[rng.randrange(heads[k])] = rng.randrange(256)  # in the headers
            parts = [bytes(broken) if i == k else r for i, r in enumerate(records)]
            n, _ = _covered(b"".join(gzip_member(p) if zipped else p for p in parts))
            assert n >= 3 if zipped else n >= 2
            data = bytearray(b"".join(gzip_member(p) if zipped else p for p in records))
            data[rng.randrange(len(data))] = rng.randrange(256)  # anywhere
            _covered(bytes(data))


def test_false_starts_cost_their_length():
    import time

    good = page_record(1, "u", b"behind", None)
    for mark in (b"\x1f\x8b\x08", b"WARC/1.0\r\n", b"WARC/1.0\r\nA: b\r\n", gzip_member(b"WARC/")[:15]):
        data = mark * ((1 << 20) // len(mark)) + good
        start = time.perf_counter()
        assert _read(data) == ([1], [(0, len(data) - len(good))])
        assert time.perf_counter() - start < 5


def test_bombs_are_not_inflated():
    import tracemalloc

    bomb = gzip_member(page_record(1, "u", b"x", None) + bytes(300 << 20))
    tracemalloc.start()
    ids, gaps = _read(bomb + gzip_member(page_record(2, "u", b"y", None)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == [2] and gaps == [(0, len(bomb))] and peak < 64 << 20


def test_long_header_survives(spark):
    rows = [(1, "http://x/" + "y" * 300_000, "page")]
    got = read_archives(write_archives(_pages(spark, rows))).collect()
    assert [(r["record_type"], len(r["target_uri"])) for r in got] == [("response", 300_009)]
