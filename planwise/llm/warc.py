"""Operator 4: WARC archives compressed with Zstandard and a dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame; each record is one frame of its own.
The reader finds a frame's end from its block headers, decodes one frame for
one record, and checks version line, required headers, lengths and digests.

Writing deals the pages to tasks; each task writes archives of bounded size to
a shared folder under names fixed by its partition, first under a temporary
name, so that a repeated task replaces its own file and nothing else.

Defined cases: a null payload is empty; payloads under ``least`` bytes are
always responses; pages that share both the smallest id and the payload are
all responses; a null id is never the smallest, and stays a response unless
its payload has one with an id; line breaks and controls in a URL are
percent-encoded; an empty table writes and reads no archive.
"""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.common import shared_dir, stored, table

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 16 << 10, 200, 1 << 20
DATE = "2024-01-01T00:00:00Z"
MOST_RECORD = 1 << 31


class BadArchive(ValueError):
    """An archive that breaks the format; the message names archive, offset and reason."""


# ------------------------------------------------------------------ records
def _escaped(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP head but no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_escaped(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, where: str) -> dict:
    """The fields of one record, after checking its headers, lengths and digest."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise BadArchive(f"{where}: no end of the headers")
    version, *lines = data[:end].decode().split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"{where}: version line {version[:40]!r}")
    head = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"{where}: header line {line[:40]!r}")
        head[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise BadArchive(f"{where}: no {name}")
    if not head["content-length"].isdigit() or int(head["content-length"]) != len(data) - end - 8 \
            or data[-4:] != b"\r\n\r\n":
        raise BadArchive(f"{where}: Content-Length {head['content-length']} does not fit {len(data) - end - 8} bytes")
    block = data[end + 4:-4]
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        raise BadArchive(f"{where}: no end of the HTTP head")
    payload = block[cut + 4:]
    sizes = [line.partition(b":")[2].strip() for line in block[:cut].split(b"\r\n")
             if line.lower().startswith(b"content-length:")]
    if len(sizes) != 1 or not sizes[0].isdigit():
        raise BadArchive(f"{where}: HTTP length")
    kind, size = head["warc-type"], int(sizes[0])
    method, _, digest = head.get("warc-payload-digest", "").partition(":")
    if method != "sha256" or len(digest) != 64:
        raise BadArchive(f"{where}: payload digest")
    refers = None
    if kind == "revisit":
        refers = _page(head.get("warc-refers-to", ""), where)
        if payload or refers is None:
            raise BadArchive(f"{where}: a revisit with a payload or without a target")
    elif kind != "response":
        raise BadArchive(f"{where}: record type {kind[:40]!r}")
    elif len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise BadArchive(f"{where}: payload and its length or digest differ")
    return {"page_id": _page(head["warc-record-id"], where), "url": head.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": size, "payload_digest": digest, "refers_to": refers,
            "payload": payload if kind == "response" else None}


def _page(urn: str, where: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise BadArchive(f"{where}: record id {urn[:40]!r}")
    text = urn[10:-1]
    return int(text) if text else None


# ------------------------------------------------------------------ archives
def make_archive(records: list[bytes], level: int = 6) -> bytes:
    """An archive of the records; its dictionary is trained on a bounded run of them."""
    sample, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        sample.append(r[:SAMPLE_BYTES // 8])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:  # too little to learn from
        trained = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n",
                                                dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    body = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
    one = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    out = io.BytesIO()
    out.write(SKIPPABLE.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
    for r in records:
        out.write(one.compress(r))
    return out.getvalue()


def frame_end(data: memoryview, at: int, where: str) -> int:
    """Where the frame that starts at ``at`` ends, from its block headers."""
    if int.from_bytes(data[at:at + 4], "little") != FRAME:
        raise BadArchive(f"{where}: no Zstandard frame")
    try:
        info = zstandard.get_frame_parameters(data[at:at + 18])
        pos = at + zstandard.frame_header_size(data[at:at + 18])
    except zstandard.ZstdError as e:
        raise BadArchive(f"{where}: {e}") from e
    while True:
        if pos + 3 > len(data):
            raise BadArchive(f"{where}: the frame is cut short")
        head = int.from_bytes(data[pos:pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * info.has_checksum
    if pos > len(data):
        raise BadArchive(f"{where}: the frame is cut short")
    return pos


def read_archive(data: bytes, name: str = "archive") -> Iterator[dict]:
    """The records of an archive, one frame at a time."""
    view, at, trained = memoryview(data), 0, None
    if int.from_bytes(view[:4], "little") == SKIPPABLE:
        size = int.from_bytes(view[4:8], "little")
        if 8 + size > len(view):
            raise BadArchive(f"{name}@0: the dictionary frame is cut short")
        body = bytes(view[8:8 + size])
        try:
            if int.from_bytes(body[:4], "little") == FRAME:
                body = zstandard.ZstdDecompressor().decompress(body)
        except zstandard.ZstdError as e:
            raise BadArchive(f"{name}@0: {e}") from e
        trained, at = zstandard.ZstdCompressionDict(body), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(view):
        where = f"{name}@{at}"
        end = frame_end(view, at, where)
        try:
            record = reader.decompress(view[at:end], max_output_size=MOST_RECORD)
        except zstandard.ZstdError as e:
            raise BadArchive(f"{where}: {e}") from e
        yield parse_record(record, where) | {"archive": name, "frame_at": at}
        at = end


# ------------------------------------------------------------------ on Spark
def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Add payload_bytes, payload_digest and refers_to: the page whose record holds an equal payload, or null."""
    sized = (pages.withColumn("_payload", F.coalesce(F.col("_html").cast("binary"), F.lit(b"")))
             .withColumn("payload_digest", F.sha2("_payload", 256))
             .withColumn("payload_bytes", F.length("_payload").cast("bigint")))
    firsts = (sized.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
              .agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL")
              .select("payload_digest", "_first"))
    return (sized.join(firsts, "payload_digest", "left")
            .withColumn("refers_to", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first"))))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page below ``path``; returns (archive, records, bytes) lazily: act on it to write.

    Store the rows once: they name the files of the tasks that finished; others, of lost attempts, may lie beside them.
    """
    plan = with_revisits(pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"),
                                      F.col(html).alias("_html")), least)

    def write(batches):
        task = TaskContext.get()
        fs, root = _filesystem(path)
        held, size, k = [], 0, 0

        def close():
            # each attempt has files of its own, as the order of rows may differ between attempts
            name = f"pages-{task.partitionId():06d}-{k:05d}-{task.taskAttemptId()}.warc.zst"
            data = make_archive(held)
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(held)], pa.int64()),
                                               "bytes": pa.array([len(data)], pa.int64())})
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                held.append(make_record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, k = [], 0, k + 1
        if held:
            yield close()

    return (plan.select("_id", "_url", "_payload", "payload_digest", "refers_to")
            .mapInArrow(write, "archive string, records bigint, bytes bigint"))


RECORD = ("page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
          "refers_to bigint, payload binary, archive string, frame_at bigint")


def read_archives(spark: SparkSession, path: str, payloads: bool = True, written: DataFrame | None = None) -> DataFrame:
    """Every record of the archives below ``path``; a broken archive raises BadArchive.

    ``written`` (archive, records; one row for each archive, sent to all tasks) leaves out files that it does not name
    and checks how many records each holds.
    """
    schema = RECORD if payloads else RECORD.replace(", payload binary", "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    if written is None:
        files = files.withColumn("records", F.lit(None).cast("bigint"))
    else:
        files = (files.withColumn("archive", F.regexp_extract("path", "[^/]+$", 0))
                 .join(F.broadcast(written.select("archive", "records")), "archive").select("path", "content", "records"))

    def read(batches):
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            for name, data, records in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                held, size, n = [], 0, 0
                for n, r in enumerate(read_archive(data.as_buffer(), os.path.basename(name)), 1):
                    held.append({n: r[n] for n in names})
                    size += r["payload_bytes"] if payloads else 200
                    if size >= 4 << 20:
                        yield _batch(held, names)
                        held, size = [], 0
                if held:
                    yield _batch(held, names)
                if records is not None and n != records:
                    raise BadArchive(f"{os.path.basename(name)} holds {n} records, {records} were written")
    return files.mapInArrow(read, schema)


_TYPES = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "frame_at": pa.int64(),
          "payload": pa.binary()}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES.get(n, pa.string())) for n in names], names)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "archives")
    written = stored(write_archives(table(spark, sf_dir, "pages"), path), "written-archives")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, "
                                         "record_type string, refers_to bigint")
    return (read_archives(spark, path, payloads=False, written=written)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE_OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
     f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (h)
"""
