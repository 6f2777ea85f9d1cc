"""WARC archives of zstd frames: one frame a record, the dictionary in a leading skippable frame.

Writing: the first page of each payload (by length and SHA-1) is told by a partial aggregate, joined back; each task then
writes its records to archives of bounded size in the shared folder. A manifest, kept as a table, lists what tasks that
were completed have written, so files of lost or repeated attempts are never read. Reading: archives are streamed frame
by frame; headers, lengths and digests are held against each other.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.llm import arrays, store

#: Fixed values of the formats: the skippable frame that holds a dictionary, the range of skippable frames, a frame, a dictionary.
DICTIONARY_FRAME, SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528, 0xEC30A437
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of frames from which an archive is complete; a task's first records, up to so many bytes, train its dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 1 << 20, 16 << 10
#: Bytes of payload that a batch of read records holds at most, but for one record.
BATCH_BYTES = 4 << 20
#: The longest head of a record, and the longest dictionary that is loaded.
MOST_HEAD, MOST_DICTIONARY = 1 << 20, 64 << 20

_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:page")
RECORD_DDL = "archive string, at long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
RECORD = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
MANIFEST_DDL = "archive string, records long, bytes long"


class Malformed(ValueError):
    """What a record or a frame is not."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{payload_digest}')}>"


def header_value(text: str) -> str:
    """A value for one header line: control characters and blanks as percent codes of their UTF-8 bytes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, first: bool, refers_to: int | None, date: str) -> bytes:
    """A response with its whole payload, or a revisit of the page `refers_to` with the head of the answer alone."""
    told = digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first:
        block += payload
    lines = [VERSION, f"WARC-Type: {'response' if first else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, told)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if not first:
        lines.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {record_id(refers_to, told)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{told}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _head(data: bytes, what: str) -> tuple[str, dict[str, str], int]:
    """First line, fields (names in lower case), and where what follows begins."""
    end = data.find(b"\r\n\r\n", 0, MOST_HEAD)
    if end < 0:
        raise Malformed(f"{what} without an end of its head")
    try:
        first, *lines = data[:end].decode().split("\r\n")
    except UnicodeDecodeError:
        raise Malformed(f"{what} with a head that is no UTF-8") from None
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or "\n" in line or "\r" in line:
            raise Malformed(f"{what} with a line that is no field")
        if name.lower() in fields:
            raise Malformed(f"{what} with two fields {name}")
        fields[name.lower()] = value.strip()
    return first, fields, end + 4


def _number(fields: dict[str, str], name: str, what: str) -> int | None:
    value = fields.get(name)
    if value is None:
        return None
    if not value.removeprefix("-").isdecimal() or not value.isascii():
        raise Malformed(f"{what} with a {name} that is no number")
    return int(value)


def parse(data: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (None of a revisit) of one record."""
    version, fields, at = _head(data, "a record")
    if not version.startswith("WARC/1."):
        raise Malformed("a record of an unknown version")
    size = _number(fields, "content-length", "a record")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest"):
        if not fields.get(name):
            raise Malformed(f"a record without {name}")
    if size is None or size < 0 or len(data) != at + size + 4 or data[at + size :] != b"\r\n\r\n":
        raise Malformed("a record of another length than told")
    kind, block = fields["warc-type"], data[at : at + size]
    if kind not in ("response", "revisit"):
        raise Malformed(f"a record of type {kind}")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + digest(block):
        raise Malformed("a block of another digest than told")
    status, http, begin = _head(block, "an answer")
    if not status.startswith("HTTP/"):
        raise Malformed("an answer without a status")
    payload, told = block[begin:], fields["warc-payload-digest"].removeprefix("sha1:")
    length = _number(http, "content-length", "an answer")
    page_id, refers_to = (_number(fields, n, "a record") for n in ("x-page-id", "x-refers-to-page-id"))
    if length is None or length < 0:
        raise Malformed("an answer without its length")
    if fields["warc-record-id"] != record_id(page_id, told):
        raise Malformed("a record with an id that is not its page's")
    if kind == "response":
        if len(payload) != length or digest(payload) != told:
            raise Malformed("a payload of another length or digest than told")
        return page_id, fields.get("warc-target-uri"), kind, None, length, told, payload
    if payload or fields.get("warc-profile") != PROFILE:
        raise Malformed("a revisit with a payload or of another profile")
    if refers_to is not None and fields.get("warc-refers-to") != record_id(refers_to, told):
        raise Malformed("a revisit of another record than told")
    return page_id, fields.get("warc-target-uri"), kind, refers_to, length, told, None


class ArchiveWriter:
    """Frames of one archive, in front of them the dictionary."""

    def __init__(self, out: BinaryIO, dictionary: bytes):
        self.out, self.records, self.bytes = out, 0, 0
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        if dictionary:
            self.put(DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self.put(self.compressor.compress(data))
        self.records += 1


def train(records: list[bytes]) -> bytes:
    """A dictionary of the records; none where they are too few or too uniform to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveReader:
    """Records of one archive, with the place of each frame. The dictionary may itself be a zstd frame."""

    def __init__(self, source: BinaryIO):
        self.source, self.at, self.decompressor = source, 0, zstandard.ZstdDecompressor()

    def take(self, n: int) -> bytes:
        data = self.source.read(n)
        if len(data) != n:
            raise Malformed("an archive that ends inside a frame")
        self.at += n
        return data

    def load(self, data: bytes) -> None:
        if data[:4] == FRAME.to_bytes(4, "little"):
            if not 0 <= zstandard.frame_content_size(data) <= MOST_DICTIONARY:
                raise Malformed("a dictionary of unknown or too great a size")
            data = zstandard.ZstdDecompressor().decompress(data)
        if data[:4] != DICTIONARY.to_bytes(4, "little"):
            raise Malformed("a leading frame that holds no dictionary")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT))

    def frame(self, magic: bytes) -> bytes:
        """The frame that begins with `magic`, told from its block heads: nothing behind it is read."""
        flags = self.take(1)
        single, checksum = flags[0] >> 5 & 1, flags[0] >> 2 & 1
        head = self.take((not single) + (0, 1, 2, 4)[flags[0] & 3] + ((single, 2, 4, 8)[flags[0] >> 6]))
        parts, last = [magic, flags, head], False
        while not last:
            parts.append(self.take(3))
            word = int.from_bytes(parts[-1], "little")
            last = bool(word & 1)
            kind, size = word >> 1 & 3, word >> 3
            if kind == 3:
                raise Malformed("a block of no known kind")
            parts.append(self.take(1 if kind == 1 else size))
        parts.append(self.take(4 * checksum))
        return b"".join(parts)

    def __iter__(self) -> Iterator[tuple[int, bytes | Malformed]]:
        """Place and record of each frame; a frame that cannot be decoded gives its error, broken framing ends the archive."""
        while magic := self.source.read(4):
            begin, self.at = self.at, self.at + len(magic)
            try:
                number = int.from_bytes(magic, "little")
                if len(magic) == 4 and number in SKIPPABLE:
                    size = int.from_bytes(self.take(4), "little")
                    if begin == 0 and number == DICTIONARY_FRAME:
                        if size > MOST_DICTIONARY:
                            raise Malformed("a dictionary of unknown or too great a size")
                        self.load(self.take(size))
                    else:
                        while size:
                            size -= len(self.take(min(size, 1 << 20)))
                    continue
                if number != FRAME or len(magic) < 4:
                    raise Malformed("bytes that begin no frame")
                data = self.frame(magic)
            except (Malformed, zstandard.ZstdError) as e:
                yield begin, Malformed(str(e))
                return
            try:
                one = self.decompressor.decompressobj()
                decoded = one.decompress(data)
                if not one.eof or one.unused_data:
                    raise Malformed("a frame without an end")
            except (Malformed, zstandard.ZstdError) as e:
                yield begin, Malformed(str(e))
                continue
            yield begin, decoded


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


@dataclass
class Archives:
    """A folder of archives and its manifest: archive (its file's name), records, bytes."""

    folder: str
    manifest: DataFrame


def firsts(pages: DataFrame, least: int, scope: str) -> DataFrame:
    """Of payloads of at least `least` bytes: those that several rows hold, with the least page_id. Null ids come last."""
    return store.keep(pages.filter(F.col("payload_bytes") >= least).groupBy("sha", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("held")).filter("held > 1").select(F.col("sha").alias("_sha"), F.col("payload_bytes").alias("_bytes"), "first"), scope)


def write(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, scope: str = "query") -> Archives:
    """A record of each row of `pages` (page_id, url, html), in archives under `folder` (of a file system that pyarrow knows;
    by default in the shared folder).

    The payload is the html in UTF-8, a null counts as empty. Of rows with equal payloads of at least `least` bytes the
    one of smallest page_id is a response, the others revisit it; rows that share that id are all responses, as is every
    row where all ids are null. Null urls have no Target-URI. Other columns are ignored; an empty table gives no archive.
    """
    spark = pages.sparkSession
    folder = folder or store.working_folder(spark, scope)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").select("page_id", "url", "html", F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("payload_bytes"))
    first = firsts(told, least, scope)
    joined = told.join(first, (F.col("sha") == F.col("_sha")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _file_system(folder)
        system.create_dir(at, recursive=True)
        attempt, number = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0
        done: list[tuple] = []
        writer, waiting, size, dictionary, name = None, [], 0, None, ""

        def close() -> None:
            nonlocal writer
            writer.out.close()
            done.append((name, writer.records, writer.bytes))
            writer = None

        def add(data: bytes) -> None:
            nonlocal writer, number, name
            if writer is None:
                name, number = f"{attempt}-{number:05d}.warc.zst", number + 1
                writer = ArchiveWriter(system.open_output_stream(f"{at}/{name}", compression=None), dictionary)
            writer.add(data)
            if writer.bytes >= archive_bytes:
                close()

        for batch in batches:
            for k in range(len(batch)):
                page_id, url, html, refers_to = (c[k].as_py() for c in batch.columns)
                data = record(page_id, url, (html or "").encode(), refers_to is None, refers_to, date)
                if dictionary is not None:
                    add(data)
                    continue
                waiting.append(data)
                size += len(data)
                if size >= SAMPLE_BYTES:
                    dictionary = train(waiting)
                    for one in waiting:
                        add(one)
                    waiting = []
        if waiting:
            dictionary = train(waiting)
            for one in waiting:
                add(one)
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])
        arrays.trim()

    manifest = store.keep(joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(put, MANIFEST_DDL), scope)
    return Archives(folder, manifest)


def _records(name: str, source: BinaryIO, strict: bool, payloads: bool) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for at, data in ArchiveReader(source):
        try:
            if isinstance(data, Malformed):
                raise data
            *head, payload = parse(data)
            rows.append((name, at, *head, payload if payloads else None, None))
            size += len(payload or b"") if payloads else 200
        except Malformed as e:
            if strict:
                raise Malformed(f"{name} at {at}: {e}") from e
            rows.append((name, at, *[None] * 7, str(e)))
        if size >= BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)


def read(archives: Archives, strict: bool = True, payloads: bool = True) -> DataFrame:
    """The records of all archives of the manifest: archive, at (the frame's place), page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload (null of revisits, or unless `payloads`), error.

    A record whose headers, lengths or digests do not hold fails the query, or without `strict` becomes a row with the
    error; so does an archive with another number of records than the manifest tells.
    """
    folder = archives.folder

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _file_system(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = 0
                with system.open_input_stream(f"{at}/{name}", compression=None, buffer_size=1 << 20) as source:
                    for out in _records(name, source, strict, payloads):
                        seen += len(out)
                        yield out
                if seen != records:
                    if strict:
                        raise Malformed(f"{name} holds {seen} records, not {records}")
                    yield _batch([(name, None, *[None] * 7, f"{seen} records, not {records}")])
        arrays.trim()

    return archives.manifest.select("archive", "records").mapInArrow(scan, RECORD_DDL)


def read_files(spark: SparkSession, path: str, strict: bool = True, payloads: bool = True) -> DataFrame:
    """The same of the .warc.zst files under a path of any file system that Spark reads; each file has to fit a task's memory."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield from _records(batch.column(0)[k].as_py().rpartition("/")[2], io.BytesIO(batch.column(1)[k].as_buffer()), strict, payloads)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(scan, RECORD_DDL)
