import base64
import hashlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import warc

LONG, LONG2 = "<p>" + "a" * 200, "<p>" + "b" * 200


def expected(pages):
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None and (b not in first or i < first[b]):
            first[b] = i
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = b in first and i != first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = [(5, "http://a/%0A\r\n", LONG), (3, None, LONG), (9, "u", LONG), (4, "u", LONG2), (1, "u", None), (2, "u", ""), (6, "s", "short"), (7, "s", "short"), (8, "ü", "日本語" * 50_000), (3, "rep", LONG), (None, "n", LONG)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    rows = warc.round_trip(df, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == expected(pages)
    assert {r.page_id: r.url for r in rows}[5] == "http://a/%0A\r\n"
    texts = dict((p[0], p[2]) for p in pages)
    assert all(r.payload.decode() == (texts[r.page_id] or "") for r in rows if r.record_type == "response")
    assert warc.round_trip(df.where("false")).count() == 0


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    assert warc.round_trip(df).count() == df.count()


@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=6), st.booleans(), st.integers(1, 12))
def test_frames_of_any_content(parts, checksum, level):
    c = zstandard.ZstdCompressor(level=level, write_checksum=checksum)
    data = b"\x5d\x2a\x4d\x18\0\0\0\0" + b"".join(c.compress(p) + warc.EMPTY_FRAME for p in parts)
    assert list(warc.frames(data)) == parts


def test_bad_archives_and_records():
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    assert warc.parse(good)[0] == 1
    for bad in (good.replace(b"payload", b"paYload"), good[:-1], good.replace(b"WARC/1.1", b"WARC/0.9"), good + b"x", good.replace(b"response\r\nWARC-R", b"other\r\nWARC-R")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    for missing in (b"WARC-Type: response\r\n", b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b"WARC-Record-ID: <urn:page:1>\r\n", b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"payload").hexdigest().encode() + b"\r\n"):
        assert missing in good
        with pytest.raises(ValueError):
            warc.parse(good.replace(missing, b""))
    frame = zstandard.ZstdCompressor().compress(good)
    assert list(warc.frames(frame)) == [good]  # an archive without a dictionary
    with pytest.raises(ValueError):
        list(warc.frames(b"\x5d\x2a\x4d\x18\0\0\0\0" + frame[:-3]))


def archive(dictionary, compressed, level=3):
    """Two records of another writer: frames without content size, under a dictionary."""
    records = [foreign(b"response", b"application/http", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>body"), foreign(b"warcinfo", b"application/warc-fields", b"software: y")]
    raw = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    out = b"\x5d\x2a\x4d\x18" + len(raw).to_bytes(4, "little") + raw
    for r in records:
        c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False).compressobj()
        out += c.compress(r) + c.flush()
    return out, records


def foreign(kind, content, block):
    digest = base64.b32encode(hashlib.sha1(block).digest())
    return b"WARC/1.0\r\nwarc-type: %s\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nWARC-Date: 2021-01-01T00:00:00Z\r\nWARC-Target-URI: http://h/a%%25b\r\nWARC-Block-Digest: sha1:%s\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, digest, content, len(block), block)


@pytest.mark.parametrize("compressed", [False, True])
def test_archives_of_other_writers(spark, tmp_path, compressed):
    dictionary = zstandard.train_dictionary(2000, [b"WARC/1.0 warc-type record %d " % k * 20 for k in range(200)]).as_bytes()
    data, records = archive(dictionary, compressed)
    assert list(warc.frames(data)) == records
    (tmp_path / "a.warc.zst").write_bytes(data)
    rows = sorted(warc.read(spark, str(tmp_path)).collect(), key=lambda r: r.record_type)
    assert [(r.page_id, r.record_type, r.record_id, r.url, bytes(r.payload)) for r in rows] == [
        (None, "response", "<urn:uuid:1-2>", "http://h/a%25b", b"<p>body"),
        (None, "warcinfo", "<urn:uuid:1-2>", "http://h/a%25b", b"software: y"),
    ]


WHOLE = b"\x5d\x2a\x4d\x18\0\0\0\0" + b"".join(zstandard.ZstdCompressor(write_checksum=True).compress(warc.record(k, "http://u", b"payload %d" % k, hashlib.sha256(b"payload %d" % k).hexdigest(), None, False)) for k in range(3))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, len(WHOLE)), st.lists(st.tuples(st.integers(0, len(WHOLE) - 1), st.integers(1, 255)), max_size=3))
def test_damage_raises_value_errors_alone(cut, flips):
    data = bytearray(WHOLE)
    for at, by in flips:
        data[at] ^= by
    try:
        found = [warc.parse(r) for r in warc.frames(bytes(data[:cut]))]
    except ValueError:
        return
    assert len(found) <= 3


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 400), st.lists(st.tuples(st.integers(0, 300), st.binary(max_size=3)), min_size=1, max_size=3))
def test_damaged_records_raise_value_errors_alone(cut, changes):
    data = bytearray(warc.record(7, "http://u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False))
    for at, by in changes:
        data[at : at + 1] = by
    try:
        warc.parse(bytes(data[:cut]))
    except ValueError:
        return
