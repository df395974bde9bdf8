import gzip
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import flac, warc


def test_features_come_from_stored_media(spark, folder, corpus, monkeypatch):
    stored = []
    monkeypatch.setattr(flac, "features", lambda df, own=flac.features: stored.append((df.columns, df.inputFiles())) or own(df))
    assert flac.op2_flac(spark, folder).count() == len(corpus)
    assert len(stored) == flac.WAVES and all("media" in c and all("/media-" in f for f in files) for c, files in stored)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=5))
def test_flac_round_trip(raw):
    payloads = [flac.padded(r) for r in raw]
    assert all(len(p) % flac.PAD == 0 and len(p) >= flac.PAD for p in payloads)
    got = flac.decode_streams(flac.encode_streams(payloads))
    assert [flac.payload_of(m, b) for m, b, _ in got] == payloads


def without_seek_table(s):
    info = int.from_bytes(s[5:8], "big")
    at = 8 + info
    return s[:4] + b"\x80" + s[5:at] + s[at + 4 + int.from_bytes(s[at + 1 : at + 4], "big") :]


def test_streams_without_seek_points():
    payloads = [flac.padded(np.random.default_rng(i).integers(90, 120, n, np.uint8).tobytes()) for i, n in enumerate((10, 3000, 50000))]
    got = flac.decode_streams([without_seek_table(s) for s in flac.encode_streams(payloads)])
    assert [flac.payload_of(m, b) for m, b, _ in got] == payloads
    assert [at for at, _ in got[2][1]] == list(range(0, len(payloads[2]), flac.BLOCK))


def test_damage_is_found():
    good = flac.encode_streams([flac.padded(b"some text to be damaged " * 40)])[0]
    first = flac.stream_parts(good)["first"]
    for at in (first + 1, first + 4, first + 40, len(good) - 1):
        bad = good[:at] + bytes([good[at] ^ 4]) + good[at + 1 :]
        with pytest.raises(ValueError):
            flac.decode_streams([bad])


def bits_to_bytes(bits):
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def crc(data, bits, poly):
    table = flac.crc_table(bits, poly)
    c = 0
    for b in data:
        c = int(table[(c >> (bits - 8)) ^ b]) ^ (c << 8 & ((1 << bits) - 1)) if bits == 16 else int(table[c ^ b])
    return c


def frame(channel, subframes, n, number=0):
    head = bytes([0xFF, 0xF8, 0x60 | 4, channel << 4 | 4 << 1, number, n - 1])
    head += bytes([crc(head, 8, 0x07)])
    body = head + bits_to_bytes("".join(subframes))
    return body + crc(body, 16, 0x8005).to_bytes(2, "big")


def two(v, bits):
    return format(v & (1 << bits) - 1, f"0{bits}b")


def test_stereo_and_escapes_by_hand():
    """Side channels, wasted bits, partitions with escape codes, second order prediction, 16-bit samples."""
    left, right = [100, 104, 92, 80, 60, 44, 40, 48], [96, 96, 80, 84, 52, 40, 44, 40]
    side = [a - b for a, b in zip(left, right)]
    verbatim = lambda xs, bits: "00000010" + "".join(two(x, bits) for x in xs)
    wasted = "0" + "000001" + "1" + "01" + "".join(two(x >> 2, 15) for x in side)  # two wasted bits of 17
    res = [left[i] - 2 * left[i - 1] + left[i - 2] for i in range(2, 8)]
    escape = "00" + "0001" + "1111" + "01000" + "".join(two(x, 8) for x in res[:2])
    rice = "0101" + "".join("0" * (u >> 5) + "1" + format(u & 31, "05b") for u in (2 * x if x >= 0 else -2 * x - 1 for x in res[2:]))
    fixed = "00010100" + two(left[0], 16) + two(left[1], 16) + escape + rice
    mid = [(a + b) >> 1 for a, b in zip(left, right)]
    frames = [frame(8, [fixed, wasted], 8), frame(10, [verbatim(mid, 16), verbatim(side, 17)], 8, 1), frame(9, [verbatim(side, 17), verbatim(right, 16)], 8, 2), frame(1, [verbatim(left, 16), "00000000" + two(7, 16)], 8, 3)]
    info = (8).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 1 << 41 | 15 << 36 | 32).to_bytes(8, "big") + bytes(16)
    meta, blocks, _ = flac.decode_streams([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)])[0]
    assert meta["channels"] == 2 and [at for at, _ in blocks] == [0, 8, 16, 24]
    for _, x in blocks[:3]:
        assert x.tolist() == [left, right]
    assert blocks[3][1].tolist() == [left, [7] * 8]
    assert flac.pcm(meta, blocks[0][1])[:4] == (100).to_bytes(2, "little") + (96).to_bytes(2, "little")


def test_predictors_are_used():
    t = np.arange(5760)
    x = (128 + 100 * np.sin(t / 9)).astype(np.uint8).tobytes()
    stream = flac.encode_streams([x])[0]
    _, _, kinds = flac.decode_streams([stream])[0]
    assert (kinds >= 8).all() and (kinds >= 32).any() and len(stream) < len(x)


def test_media_columns(docs, corpus):
    stored = flac.store(docs)
    got = flac.features(stored).collect()
    assert len(got) == len(corpus)
    for r in got:
        raw = (r["text"] or "").encode()
        p = flac.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(p[-16:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    same = defaultdict(set)
    for r in got:
        same[r["text"] or ""].add((r["feature"], r["media_sha256"]))
    assert all(len(v) == 1 for v in same.values())


def test_pcm_blocks(docs):
    stored = flac.store(docs.filter("doc_id in (1, 107)"))
    blocks = flac.pcm_blocks(stored)
    for r in stored.collect():
        mine = sorted((b["sample_offset"], bytes(b["pcm"])) for b in blocks.filter(F.col("doc_id") == r["doc_id"]).collect())
        whole = b"".join(x for _, x in mine)
        assert (np.frombuffer(whole, np.uint8) ^ 0x80).tobytes() == flac.padded(r["text"].encode())
        assert [a for a, _ in mine] == list(range(0, len(whole), flac.BLOCK))


def test_no_media(nothing):
    assert flac.features(flac.store(nothing)).count() == flac.pcm_blocks(flac.store(nothing)).count() == 0


PAGES = "page_id long, url string, html string"


def page_rows():
    big, other = "<p>" + "x" * 1200, "é" * 500
    rows = [(i, f"http://h{i % 3}.example/a b{i}", big if i % 3 else other) for i in range(1, 40)]
    rows += [(50, None, None), (51, "http://e/", ""), (52, "bad\r\nurl", "tiny"), (53, "http://e/", "tiny"), (None, "http://n/", big), (60, "http://t/", "line\r\n\r\nWARC/1.1\r\n\r\n" * 100), (61, "http://big/", "long " * 200_000)]
    return rows + [(70, "http://r/", "repeat " * 300), (70, "http://r/", "repeat " * 300)]


def brute_pages(rows):
    last = {}
    for i, _, h in rows:
        last[h] = max(last.get(h, -1), -1 if i is None else i)
    out, done = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        revisit = len(b) >= 1000 and (i is None or last[h] != i or (i, h) in done)
        done.add((i, h))
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    return sorted(out, key=str)


def test_transactions(spark, tmp_path):
    rows = page_rows()
    spark.createDataFrame(rows, PAGES).repartition(3).withColumn("digest", F.lit("clash")).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op1_transactions(spark, str(tmp_path)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_pages(rows)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op1_transactions(spark, str(tmp_path)).count() == 0


def test_archives_are_plain_gzip(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "hello")], PAGES), f"file://{tmp_path}/w")
    found = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    text = b"".join(gzip.decompress(p.read_bytes()) for p in found)
    assert text.count(b"WARC/1.1\r\n") == 4 and b"hello\r\n\r\n" in text
    nested = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w", payload=True)).first()
    assert bytes(nested["response"]["payload"]) == b"hello" and nested["request"]["type"] == "request" and len(nested["metadata"]) == 1


def record(kind, rid, tied=(), block=b"x"):
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + rid.encode()] + [b"WARC-Concurrent-To: " + t.encode() for t in tied]
    return b"\r\n".join(head) + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_links_in_either_direction_and_over_two_hops(spark, tmp_path):
    data = record("response", "<r1>", ["<q1>"]) + record("request", "<q1>") + record("metadata", "<m1>", ["<q1>"]) + record("request", "<q2>", ["<gone>"]) + record("response", "<r3>")
    (tmp_path / "plain.warc").write_bytes(data)
    got = {r["capture_id"]: r for r in warc.assemble(warc.read_records(spark, f"file://{tmp_path}/plain.warc")).collect()}
    assert set(got) == {"<r1>", "<q2>", "<r3>"}
    assert got["<r1>"]["request"]["record_id"] == "<q1>" and [m["record_id"] for m in got["<r1>"]["metadata"]] == ["<m1>"]
    assert got["<q2>"]["response"] is None and got["<r3>"]["request"] is None


def test_links_over_many_hops(spark, tmp_path):
    """A chain of five hops, partly over an identifier without a record, the nearer of two responses, and a chain without any."""
    chain = [("request", "<q1>", "<r1>"), ("metadata", "<m2>", "<q1>"), ("metadata", "<m3>", "<m2>"), ("metadata", "<m4>", "<gone>"), ("metadata", "<m6>", "<m4>")]
    data = record("response", "<r1>") + record("response", "<r0>", ["<n1>"]) + b"".join(record(k, i, [t]) for k, i, t in chain)
    data += record("metadata", "<n1>", ["<n2>"]) + record("metadata", "<n2>", ["<n3>"]) + record("metadata", "<n3>", ["<m3>"])
    data += record("metadata", "<m3b>", ["<m3>", "<gone>"]) + record("request", "<a>", ["<b>"]) + record("metadata", "<b>")
    (tmp_path / "plain.warc").write_bytes(data)
    got = {r["capture_id"]: r for r in warc.assemble(warc.read_records(spark, f"file://{tmp_path}/plain.warc")).collect()}
    assert set(got) == {"<r0>", "<r1>", "<a>", "<b>"}
    assert {m["record_id"] for m in got["<r1>"]["metadata"]} == {"<m2>", "<m3>", "<m3b>", "<m4>", "<m6>"}
    assert {m["record_id"] for m in got["<r0>"]["metadata"]} == {"<n1>", "<n2>", "<n3>"} and got["<r1>"]["request"]["record_id"] == "<q1>"


def test_broken_archives():
    with pytest.raises(ValueError):
        list(warc.records(record("response", "<a>")[:-20]))
    with pytest.raises(ValueError):
        list(warc.records(b"HTTP/1.1 200\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.members(gzip.compress(b"abc")[:-4]))


def test_features_by_brute_force(spark, folder, corpus):
    """Every derived column of the query, recomputed from the texts without the codec."""
    got = [r.asDict() for r in flac.op2_flac(spark, folder).collect()]
    want = []
    for doc, text, *_ in corpus:
        raw = (text or "").encode()
        whole = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        x = [b - 128 for b in whole]
        middle = whole[len(whole) // 2 :][:16]
        facts = {"energy": sum(v * v for v in x), "peak": max(map(abs, x)), "crossings": sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])), "middle": zlib.crc32(middle), "blocks": -(-len(whole) // flac.BLOCK)}
        want.append((doc, len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]), tuple(range(0, len(whole), flac.BLOCK)), facts))
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0], r[1], r[3])
    told = [(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], tuple(r["block_offsets"]), {k: int(v) for k, v in (p.split("=") for p in r["feature"].split(";"))}) for r in got]
    for a, b in zip(sorted(told, key=order), sorted(want, key=order), strict=True):
        assert a[:6] == b[:6]
        assert {k: a[6][k] for k in b[6]} == b[6] and a[6]["lpc"] + a[6]["fixed"] + a[6]["other"] == a[6]["blocks"]


def test_samples_by_offset():
    payload = flac.padded(np.random.default_rng(3).integers(90, 120, 9000, np.uint8).tobytes())
    meta, frames, _ = flac.decode_streams(flac.encode_streams([payload]))[0]
    blocks = flac.blocks_of(meta, frames)
    for start, stop in ((0, 5), (2300, 2310), (2304, 4608), (100, 8000), (len(payload) - 16, len(payload)), (5, 5), (len(payload), len(payload) + 9)):
        assert flac.unsigned(flac.read_samples(meta, blocks, start, stop)) == payload[start:stop]
    with pytest.raises(ValueError):
        flac.verify(meta, blocks[:1] + blocks[2:])
