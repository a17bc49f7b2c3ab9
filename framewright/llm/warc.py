"""WARC archives compressed with Zstandard: a dictionary frame first, then one frame per record.

Writer: every partition of pages becomes one .warc.zst archive, written by Spark's own text sink. The sink's line
separator is an empty skippable frame, which every Zstandard reader passes over, so the files are archives as they
stand, in any store that Spark reaches, and its commit protocol covers lost executors. An archive is no larger than an
input split (spark.sql.files.maxPartitionBytes).
Reader: takes the dictionary from the leading skippable frame (itself compressed or not; archives without one are read
too), finds each frame's end from its block headers, decodes one frame per record and checks version, required headers,
lengths and digest; whatever is damaged raises ValueError. Records of other writers and other types are returned with their
own ids; their payload is what follows the HTTP header where the content is HTTP, else the whole block.

Nulls: null html is the empty payload; a null url gives no target URI; a null page_id is kept as a null id, which sorts
after all others among equal payloads. Rows that repeat a payload's smallest id are all responses. Extra columns are not
read. Empty tables give an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import arrow_map, batch, materialise, shared_dir

# Magic numbers of the Zstandard format and of the WARC convention for its dictionary.
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", SKIPPABLE_FIRST, 0)
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Pages that the dictionary is trained on, at most, and the bytes taken of each.
DICTIONARY_SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
VERSIONS = ("WARC/1.0", "WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: The only header that a record may repeat.
REPEATED = "warc-concurrent-to"
READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_id", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary()),
])
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, refers_to_id string, payload binary"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    """The page behind a record id of this module's writer; null for any other."""
    m = re.fullmatch(r"<urn:page:(-?\d{1,19})>", urn or "")
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the response's HTTP header and leaves its payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        head += [f"WARC-Refers-To: {_urn(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A record's fields in READ's order; ValueError if a header, a length or the digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not found or version not in VERSIONS:
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or (name in fields and name != REPEATED):
            raise ValueError(f"malformed or repeated header: {line!r}")
        fields[name] = value.strip()
    if missing := [x for x in REQUIRED if not fields.get(x)]:
        raise ValueError(f"headers are missing: {missing}")
    if len(rest) != _length(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the record")
    block, kind, own = rest[:-4], fields["warc-type"], fields["warc-record-id"].startswith("<urn:page:")
    payload, size = block, len(block)
    if own or fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?i)\r\nContent-Length:\s*(\d{1,18})\s*(?:\r\n|$)", http)
        if own and not (found and m):
            raise ValueError("no HTTP header")
        size = int(m[1]) if m and (own or kind == "revisit") else len(payload)
    if kind != "revisit":
        if len(payload) != size:
            raise ValueError("the payload does not match its length")
        _verify(fields.get("warc-payload-digest"), payload)
        _verify(fields.get("warc-block-digest"), block)
    elif own and payload:
        raise ValueError("a revisit with a payload")
    if own and kind not in ("response", "revisit"):
        raise ValueError(f"unknown record type {kind!r}")
    if own and not fields.get("warc-payload-digest"):
        raise ValueError("no payload digest")
    url = fields.get("warc-target-uri")
    if own and url is not None:
        url = re.sub(r"%(25|0D|0A)", lambda x: chr(int(x[1], 16)), url)
    digest, refers = fields.get("warc-payload-digest"), fields.get("warc-refers-to")
    return _page(fields["warc-record-id"]), url, kind, _page(refers), size, digest and digest.removeprefix("sha256:"), fields["warc-record-id"], refers, None if kind == "revisit" else payload


def _length(text: str) -> int:
    if not re.fullmatch(r"[0-9]{1,18}", text):
        raise ValueError(f"not a length: {text!r}")
    return int(text)


def _verify(digest: str | None, data: bytes) -> None:
    """Raise where `data` has another digest; those of unknown algorithms are passed over."""
    algorithm, _, value = (digest or "").partition(":")
    if algorithm.lower() in ("sha1", "sha256", "md5"):
        raw = hashlib.new(algorithm.lower(), data).digest()
        if value.lower() != raw.hex() and value.upper().rstrip("=") != base64.b32encode(raw).decode().rstrip("="):
            raise ValueError("the digest does not match")


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, read from its headers alone; ValueError where the archive ends before."""
    end = _frame_end(data, at)
    if end > len(data):
        raise ValueError("the archive is cut short")
    return end


def _frame_end(data: memoryview, at: int) -> int:
    def number(start: int, size: int) -> int:
        if start + size > len(data):
            raise ValueError("the archive is cut short")
        return int.from_bytes(data[start : start + size], "little")

    magic = number(at, 4)
    if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
        return at + 8 + number(at + 4, 4)
    if magic != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    flags = number(at + 4, 1)
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        block = number(at, 3)
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run-length block holds one byte
        if block & 1:
            return at + 4 * checksum


def _decoded(frame: bytes, dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    """A frame's content, whether or not its header tells the size."""
    try:
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out = decoder.decompress(frame)
    except zstandard.ZstdError as e:
        raise ValueError(f"a damaged frame: {e}") from e
    if not decoder.eof or decoder.unused_data:
        raise ValueError("a damaged frame")
    return out


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of one archive."""
    view, at, dictionary = memoryview(data), 0, None
    while at < len(data):
        end = frame_end(view, at)
        magic = struct.unpack_from("<I", view, at)[0]
        if at == 0 and magic == DICTIONARY_MAGIC and end > 8:
            own = bytes(view[8:end])
            dictionary = zstandard.ZstdCompressionDict(_decoded(own, None) if own[:4] == struct.pack("<I", FRAME_MAGIC) else own)
        elif magic == FRAME_MAGIC:
            yield _decoded(bytes(view[at:end]), dictionary)
        at = end


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from at most DICTIONARY_SAMPLE pages (SAMPLE_BYTES of each); empty where they are too few to train on.

    It affects only the size of the archives.
    """
    sample = [bytes(r[0]) for r in pages.where(F.octet_length(html) > 0).select(F.substring(F.col(html).cast("binary"), 1, SAMPLE_BYTES)).limit(DICTIONARY_SAMPLE).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT, level: int = 3) -> None:
    """Write pages (page_id, url, html) below `path`; equal payloads of at least `least` bytes become revisits.

    Payload groups are reduced map-side to one row a digest before they are joined back; only digests that repeat are
    joined, broadcast where Spark knows them small and else as a sort-merge join whose hot digests AQE splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    repeated = materialise(rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-repeated")
    marked = rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", "first", F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"))
    own = train_dictionary(pages)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, started = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(own) if own else None), False
        for b in batches:
            out = [] if started else [struct.pack("<II", DICTIONARY_MAGIC, len(own)) + own]
            started = True
            out += [coder.compress(record(*row)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            raw = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())], ["value"])  # the sink writes a string's bytes as they are

    arrow_map(marked, encode, "value string").write.option("lineSep", EMPTY_FRAME.decode("ascii")).text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives below `path`, in READ's columns; without `payloads`, payload is null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for one in frames(data.as_py()):
                    x = parse(one)
                    rows.append(x if payloads else (*x[:-1], None))
                    if len(rows) >= 500:
                        yield batch(READ, *zip(*rows, strict=True))
                        rows = []
                if rows:
                    yield batch(READ, *zip(*rows, strict=True))

    return arrow_map(spark.read.format("binaryFile").load(path).where("length > 0").select("content"), decode, READ_SCHEMA, rows=1)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write pages to archives in shared storage and read them back."""
    path = shared_dir(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path, payloads)
