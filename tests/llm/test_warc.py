"""WARC archives: exact round trips, frames by the library alone, broken archives, odd rows."""

import base64
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from veilstone.llm import warc

SCHEMA = "page_id long, url string, html string"


def some_pages(n=120, seed=51):
    rng = random.Random(seed)
    bodies = [f"<html><p>{' '.join(rng.choice(['alpha', 'beta', 'naïve', '日本']) for _ in range(rng.randrange(1, 200)))}</p></html>" for _ in range(n // 3)] + ["", None, "\r\n\r\n", "WARC/1.1\r\n\r\n"]
    return [(k, rng.choice([f"http://x.org/{k}", f"http://x.org/a b\r\nX: {k}", None]), rng.choice(bodies)) for k in rng.sample(range(-5, 10 * n), n)]


def brute(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        body, f = (html or "").encode(), first.get(html or "")
        revisit = f is not None and f != i and len(body) >= least
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 60])
def test_round_trip(spark, tmp_path, least):
    pages = some_pages()
    archives = warc.write(spark.createDataFrame(pages, SCHEMA).repartition(3), f"file://{tmp_path}/out", least, archive_bytes=4000)
    assert archives.manifest.count() > 3  # archives are of bounded size
    rows = warc.read(archives)
    assert told(rows) == brute(pages, least)
    by = {i: (u, h or "") for i, u, h in pages}
    for r in rows.collect():
        url, html = by[r.page_id]
        assert r.error is None and r.url == (None if url is None else warc.header_value(url))
        assert r.payload == (html.encode() if r.record_type == "response" else None)
    assert told(warc.read_files(spark, f"file://{tmp_path}/out")) == told(rows)
    assert archives.manifest.agg(F.sum("records")).first()[0] == len(pages)


def test_frames_by_the_library_alone(spark, tmp_path):
    pages = [(k, f"http://x.org/{k}", f"<p>page {k} of the same kind, {'word ' * (k % 50)}</p>") for k in range(3000)]
    archives = warc.write(spark.createDataFrame(pages, SCHEMA).coalesce(1), f"file://{tmp_path}/out")
    data = (tmp_path / "out" / archives.manifest.first().archive).read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data[8 + size :], read_across_frames=True).read()
    places = [at for at, _ in warc.ArchiveReader(open(tmp_path / "out" / archives.manifest.first().archive, "rb"))]
    assert whole.count(b"WARC/1.1\r\n") == len(places) == 3000 and places[0] == 8 + size
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and whole.endswith(b"\r\n\r\n")


def frames(records, dictionary=b"", **options):
    out = b""
    if dictionary:
        held = zstandard.ZstdCompressor().compress(dictionary) if options.pop("packed", False) else dictionary
        out = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(held).to_bytes(4, "little") + held
    one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, **options)
    return out + b"".join(one.compress(r) for r in records)


def read_all(data):
    import io

    out = []
    for _, got in warc.ArchiveReader(io.BytesIO(data)):
        try:
            if isinstance(got, warc.Malformed):
                raise got
            out.append(warc.parse(got)[0])
        except warc.Malformed as e:
            out.append(str(e))
    return out


RECORDS = [warc.record(k, None, bytes([97 + k % 26]) * (k * 37), True, None, "1970-01-01T00:00:00Z") for k in range(40)]


@pytest.mark.parametrize("options", [{}, {"write_checksum": True}, {"write_content_size": False}, {"write_dict_id": False}, {"packed": True}])
def test_kinds_of_frames(options):
    dictionary = zstandard.train_dictionary(2000, [warc.record(k, None, f"{k} {'ab' * k}".encode(), True, None, "x") for k in range(500)]).as_bytes()
    assert read_all(frames(RECORDS, dictionary, **options)) == list(range(40))
    if "packed" not in options:
        assert read_all(frames(RECORDS, **options)) == list(range(40))
    skipped = (0x184D2A50).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345"
    assert read_all(frames(RECORDS[:2]) + skipped + frames(RECORDS[2:3])) == [0, 1, 2]
    big = warc.record(1, None, random.Random(52).randbytes(700_000) + b"a" * 700_000, True, None, "x")
    assert read_all(frames([big, RECORDS[2]])) == [1, 2]


def test_broken_archives_are_told():
    good = frames(RECORDS[:3], write_checksum=True)
    assert read_all(b"") == []
    assert read_all(good[:-3])[:2] == [0, 1] and "ends inside" in read_all(good[:-3])[2]
    assert read_all(b"junk" + good) == ["bytes that begin no frame"]
    assert "no dictionary" in read_all(warc.DICTIONARY_FRAME.to_bytes(4, "little") + (4).to_bytes(4, "little") + b"none" + good)[0]
    one = RECORDS[5]
    for old, new, what in (
        (b"WARC/1.1", b"WARD/1.1", "version"),
        (b"Content-Length: ", b"Content-Length: 9", "length"),
        (b"Content-Length: ", b"Content-Length: x", "no number"),
        (b"\r\nWARC-Date: ", b"\r\nX-Date: ", "without warc-date"),
        (b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response", "two fields"),
        (b"WARC-Type: response", b"WARC-Type: metadata", "of type"),
        (b"X-Page-ID: 5", b"X-Page-ID: 6", "id that is not"),
        (b"WARC-Type: response", b"WARC-Type response", "no field"),
        (b"ffff", b"fffg", "digest"),
    ):
        broken = one.replace(old, new, 1)
        assert broken != one and what in read_all(frames([broken, RECORDS[1]]))[0], what
        assert read_all(frames([broken, RECORDS[1]]))[1] == 1
    assert "length" in read_all(frames([one[:-2]]))[0] and "length" in read_all(frames([one + b"\r\n"]))[0]
    missing = frames([RECORDS[1]], zstandard.train_dictionary(2000, RECORDS * 20).as_bytes())
    assert isinstance(read_all(missing[8 + int.from_bytes(missing[4:8], "little") :])[0], str)  # without its dictionary


def test_strict_and_lenient_reading(spark, tmp_path):
    archives = warc.write(spark.createDataFrame(some_pages(30), SCHEMA).coalesce(1), f"file://{tmp_path}/out")
    at = tmp_path / "out" / archives.manifest.first().archive
    (tmp_path / "out" / "lost-attempt.warc.zst").write_bytes(b"not of the manifest")
    assert warc.read(archives).count() == 30
    data = at.read_bytes()
    at.write_bytes(data[:-20])
    with pytest.raises(Exception, match="ends inside a frame"):
        warc.read(archives).collect()
    rows = warc.read(archives, strict=False).collect()
    assert sum(r.error is None for r in rows) == 29 and sum("ends inside" in (r.error or "") for r in rows) == 1
    at.write_bytes(frames(RECORDS[:2]))
    with pytest.raises(Exception, match="holds 2 records, not 30"):
        warc.read(archives).collect()


def test_odd_rows(spark):
    pages = [(1, "u", "same"), (1, "u", "same"), (0, "v", "other"), (2, "w", "same"), (None, None, "same"), (None, None, "alone"), (None, None, "alone"), (7, None, None), (6, "", "")]
    table = spark.createDataFrame(pages, SCHEMA).withColumns({c: F.lit("x") for c in ("sha", "first", "_sha", "payload_bytes", "refers_to", "held")})
    assert told(warc.read(warc.write(table))) == brute(pages)
    assert warc.read(warc.write(table.limit(0))).count() == 0
    long = [(1, None, "é" * 3_000_000), (2, None, "é" * 3_000_000), (3, None, "x")]
    assert told(warc.read(warc.write(spark.createDataFrame(long, SCHEMA)), payloads=False)) == brute(long)
