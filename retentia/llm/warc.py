"""Zstandard WARC archives: writing from a table and reading back.

An archive starts with a skippable frame that holds the dictionary; every record
is a Zstandard frame of its own.  Archives are written by Spark's text sink, so
they go through its commit protocol to any file system: a row is a frame, and the
line separator is an empty skippable frame, which decoders pass over.
"""

import base64
import datetime
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from retentia.llm.common import attach

DICTIONARY_MAGIC = 0x184D2A5D  # skippable frame that leads an archive
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
OTHER_KINDS = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("latin-1")
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100  # payloads below this many bytes are always stored
ARCHIVE_BYTES = 16 << 20  # compressed size at which a task begins a new archive
DICTIONARY_PAGES = 256
DICTIONARY_BYTES = 64 << 10
CHUNK = 1 << 16


# -- deciding ------------------------------------------------------------------

def record_plan(pages: DataFrame, key="page_id", url="url", body="html") -> DataFrame:
    """page_id, url, html (binary), payload_digest, payload_bytes, record_type, refers_to.

    Of payloads that are equal and have at least MIN_REVISIT bytes, the one with the
    smallest key is the response and the others revisit it.  Among rows that
    repeat that key one is the response.  A null html is an empty payload; rows
    with a null key count as larger than all others.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"),
        F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    ).withColumn("_k", F.when(F.col("payload_bytes") >= MIN_REVISIT, F.col("payload_digest")))
    shared = (
        rows.where(F.col("_k").isNotNull()).groupBy("_k")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    joined = attach(rows, shared.withColumn("_shared", F.lit(True)), "_k")
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    # Among first rows that repeat their key, all but one revisit it.  Nearly all
    # rows are alone in their (payload, key) and form windows of one row.
    alone = Window.partitionBy("_k", "page_id").orderBy("url")
    shared_first = joined.where(F.col("_shared") & is_first).withColumn(
        "_nth", F.row_number().over(alone)
    )
    rest = joined.where(F.col("_shared").isNull() | ~is_first).withColumn("_nth", F.lit(1))
    revisits = F.col("_shared").isNotNull() & (~is_first | (F.col("_nth") > 1))
    return shared_first.unionByName(rest).select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"),
    )


# -- one record ------------------------------------------------------------------

def _header(value) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def encode_record(page_id, url, html: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header, not the payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(html)}\r\n\r\n"
    ).encode()
    block = http + (html if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list) -> dict:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:60]!r}")
        found[name.strip().lower().decode()] = value.strip().decode()
    return found


def _number(fields: dict, name: str) -> int:
    value = fields.get(name, "")
    if not re.fullmatch(r"\d+", value, re.ASCII):
        raise ValueError(f"{name} is not a number: {value!r}")
    return int(value)


def _check_date(value: str) -> None:
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", value, re.ASCII):
        raise ValueError(f"no WARC date: {value!r}")
    datetime.datetime.fromisoformat(value[:19])  # ValueError for a 31st of April


def _check_digest(label: str, payload: bytes) -> None:
    """A digest in hex or base 32, by an algorithm this Python knows, must be the payload's."""
    name, colon, value = label.partition(":")
    name = name.lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha256", "sha512"):
        return
    raw = hashlib.new(name, payload).digest()
    if value.lower() != raw.hex() and value.upper() != base64.b32encode(raw).decode():
        raise ValueError("the payload does not have its digest")


def decode_record(raw: bytes) -> dict | None:
    """Fields and payload of a response or revisit record, None for any other known kind.

    ValueError if anything does not add up.  The HTTP header of a response from elsewhere may
    name no length; then the payload is the rest of the block.
    """
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not blank or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("no WARC record")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    _check_date(fields["warc-date"])
    length = _number(fields, "content-length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its header says")
    kind = fields["warc-type"]
    if kind in OTHER_KINDS:
        return None
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown kind of record: {kind}")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    status, *http_lines = http.split(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP response in the block")
    http_fields = _fields(http_lines)
    label = fields.get("warc-payload-digest", "")
    if kind == "response":
        size = _number(http_fields, "content-length") if "content-length" in http_fields else len(payload)
        if len(payload) != size:
            raise ValueError("the payload is not as long as its HTTP header says")
        _check_digest(label, payload)
        digest = hashlib.sha256(payload).hexdigest()
    else:
        size = _number(http_fields, "content-length")
        if payload or "warc-refers-to" not in fields:
            raise ValueError("a revisit record has no payload and names the record it refers to")
        digest = label.removeprefix("sha256:") if re.fullmatch("sha256:[0-9a-f]{64}", label) else None
    return {
        "page_id": _page_id(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
        "html": payload if kind == "response" else None, "payload_bytes": size,
        "payload_digest": digest, "record_type": kind,
        "refers_to": _page_id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "record_id": fields["warc-record-id"], "refers_to_id": fields.get("warc-refers-to"),
    }


def _page_id(record_id: str):
    """The page of a record written here; None for ids from elsewhere."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id, re.ASCII)
    return int(found[1]) if found else None


# -- archives -----------------------------------------------------------------------

def train_dictionary(pages: DataFrame, key="page_id", body="html") -> bytes:
    """Dictionary trained on the DICTIONARY_PAGES pages with the smallest key hashes.

    Fewer than 8 pages, or pages that are too short, give an empty dictionary.
    """
    import zstandard

    filled = pages.where((F.octet_length(body) > 0) & F.col(key).isNotNull())
    # Narrow rows find the keys; only the bodies of those few travel.
    keys = (
        filled.select(key).distinct().orderBy(F.xxhash64(key), key).limit(DICTIONARY_PAGES)
    )
    excerpts = filled.join(F.broadcast(keys), key, "left_semi").groupBy(key).agg(
        F.min(F.substring(F.col(body), 1, 20_000)).alias("excerpt")
    )
    sample = [r["excerpt"].encode() for r in sorted(excerpts.collect(), key=lambda r: r[key])]
    if len(sample) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def write_archives(planned: DataFrame, dictionary: bytes, folder: str,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the rows of `record_plan` as archives below `folder`.

    A task appends records to an archive until it has `archive_bytes`, then begins
    the next, so archives are bounded whatever a partition holds.
    """
    shared = planned.sparkSession.sparkContext.broadcast(dictionary)

    def pack(batches):
        import zstandard

        words = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
        archive, seq, held = 0, 0, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is None or held >= archive_bytes:
                    archive, seq, held = archive + 1, 0, 0
                    out.append((archive, seq, leading_frame(shared.value)))
                frame = compressor.compress(encode_record(
                    row["page_id"], row["url"], row["html"], row["payload_digest"],
                    row["record_type"], row["refers_to"],
                ))
                seq, held = seq + 1, held + len(frame)
                out.append((archive, seq, frame))
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.binary()),
            ], names=["archive", "seq", "frame"])

    (
        planned.mapInArrow(pack, "archive int, seq long, frame binary")
        .sortWithinPartitions("archive", "seq")
        .select("archive", F.col("frame").cast("string").alias("value"))
        .write.partitionBy("archive").option("lineSep", SEPARATOR).text(folder)
    )


def records_of(archive: bytes):
    """The records of one archive; each frame must hold exactly one."""
    import zstandard

    magic, size = struct.unpack_from("<II", archive) if len(archive) >= 8 else (0, 0)
    at = 0
    content = b""
    if magic == DICTIONARY_MAGIC and len(archive) >= 8 + size:
        at, content = 8 + size, archive[8:8 + size]
    elif archive[:4] != FRAME_MAGIC:
        raise ValueError("the archive begins with neither a dictionary frame nor a record")
    try:
        if content[:4] == FRAME_MAGIC:  # a dictionary may itself be compressed
            content = zstandard.ZstdDecompressor().decompress(content)
        words = zstandard.ZstdCompressionDict(content) if content else None
        yield from _frames(archive, at, zstandard.ZstdDecompressor(dict_data=words))
    except zstandard.ZstdError as problem:
        raise ValueError(f"not a Zstandard frame: {problem}") from problem


def _frames(archive, at, reader):
    while at < len(archive):
        if len(archive) < at + 8:
            raise ValueError("the archive is cut off")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic in SKIPPABLE:
            at += 8 + size
            continue
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(archive):
                raise ValueError("the archive is cut off")
            fed = archive[at:at + CHUNK]
            parts.append(frame.decompress(fed))
            at += len(fed) - len(frame.unused_data)
        record = decode_record(b"".join(parts))
        if record is not None:
            yield record


def read_archives(spark: SparkSession, folder: str, names: str = "part-*") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, record_id,
    refers_to_id per response or revisit record.

    `names` picks the files; archives from elsewhere are mostly "*.warc.zst".  Those may
    have no dictionary, other kinds of records, which are passed over, and record ids of
    their own, which have no page_id.  Archives are read whole, one at a time, and are
    bounded in size when written.  Bad magic, headers, dates, lengths or digests raise
    ValueError.  `html` is null for revisits; a folder without archives gives no rows.
    """
    schema = (
        "page_id long, url string, html binary, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, record_id string, refers_to_id string"
    )
    types = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.binary()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
        ("refers_to_id", pa.string()),
    ])

    def unpack(batches):
        for batch in batches:
            for content in batch.column("content"):
                found, held = [], 0
                for record in records_of(content.as_py()):
                    found.append(record)
                    held += len(record["html"] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(found, types)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, types)

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", names).load(folder).select("content")
    )
    return files.mapInArrow(unpack, schema)
