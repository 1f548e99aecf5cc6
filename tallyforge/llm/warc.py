"""WARC archives: a writer with revisit records and a splittable reader.

Writing: a record for each page, each record a gzip member of its own. Of pages
with equal payloads the one with the largest page_id is a response, the others
revisit it by digest. Payloads that stand on several pages, and their largest
ids, are found by a pre-aggregated count and written; only they are met again,
in a plain join: while their table is small Spark sends it to the pages and no
html moves, beyond that it shuffles and splits hot payloads. Each task streams
its rows to files of bounded size; only files that finished tasks list in the
manifest count.

Reading: files are cut into byte ranges. A task looks for the gzip magic in its
range, tries to decompress a member there and takes it if a WARC header decodes;
from then on members follow each other. A record belongs to the range in which
its member starts, so each is read once, whatever the ranges are.

Defined cases: null payloads are empty ones; page_ids that share the largest id
of a payload (repeated rows) are all responses; null ids count as smaller than
all others, and if a payload has null ids only, all are responses; an empty
table writes no file; a damaged member is passed over to the next magic.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _files, _shared, _words

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_bytes long, n_records long"
RECORDS = "page_id long, record_type string, payload_digest string, content_digest string, content_bytes long, refers_to long, url string, content binary, path string, offset long"
_CHUNK = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit's block is empty."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": "2024-01-01T00:00:00Z"}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        payload = b""
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + payload + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str, *, min_bytes: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) under ``folder``; the manifest of the files.

    Payloads under ``min_bytes`` are never revisited.
    """

    def run(batches):
        buffer, n, size = [], 0, 0

        def flush():
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            _files.write(path, b"".join(buffer))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], names=["path", "n_bytes", "n_records"])

        for batch in batches:
            columns = [_words.column(batch, c) for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")]
            columns[2] = columns[2].cast(pa.binary())
            for page_id, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in columns), strict=True):
                one = record("revisit" if revisit else "response", page_id, url, _base32(digest), html or b"", refers_to)
                buffer.append(one)
                n, size = n + 1, size + len(one)
                if size >= file_bytes:
                    yield flush()
                    buffer, n, size = [], 0, 0
        if n:
            yield flush()

    _files.make_folder(folder)
    named = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    repeated = named.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    repeated = _shared.written(repeated, "warc-digests")  # so that its size is known to the join
    long_enough = F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes
    revisit = F.coalesce(F.col("last").isNotNull() & long_enough & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))), F.lit(False))
    marked = named.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))
    return _shared.written(marked.mapInArrow(run, MANIFEST), "warc-manifest")


def ranges(manifest: DataFrame, split_bytes: int) -> DataFrame:
    """(path, n_bytes, low, high) for each range of each file."""
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    return manifest.select("path", "n_bytes", F.explode(cuts).alias("low")).withColumn("high", F.least(F.col("low") + split_bytes, F.col("n_bytes")))


class _Source:
    """Bytes of a file from a place on, as far as they are asked for."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(min(n, self.size - offset))


def member(source: _Source, offset: int) -> tuple[bytes, int] | None:
    """The whole gzip member at ``offset`` and where it ends; None if it isn't one of WARC."""
    unpacker, out, at, known = zlib.decompressobj(31), [], offset, False
    n = 0
    while not unpacker.eof:
        chunk = source.at(at, 1 << 16 if not known else _CHUNK)
        if not chunk:
            return None
        try:
            out.append(unpacker.decompress(chunk))
        except zlib.error:
            return None
        at += len(chunk)
        n += len(out[-1])
        if not known and n >= 8:
            if not b"".join(out)[:8].startswith(b"WARC/1."):
                return None
            known = True
    return (b"".join(out), at - len(unpacker.unused_data)) if known else None


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and the block; None if the header doesn't decode."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    try:
        lines = data[:end].decode().split("\r\n")
    except UnicodeDecodeError:
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    n = int(fields["content-length"])
    return (fields, data[end + 4 : end + 4 + n]) if len(data) >= end + 4 + n else None


def records_of(source: _Source, low: int, high: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the records whose members start in [low, high)."""
    at, synced = low, low == 0
    while at < high:
        if not synced:
            # The magic may lie across the range's end; only its start must be inside.
            data = source.at(at, min(_CHUNK, high - at) + 2)
            found = data.find(MAGIC)
            if found < 0:
                at += max(1, len(data) - 2)
                continue
            at += found
            if at >= high:
                return
        got = member(source, at)
        parsed = parse(got[0]) if got else None
        if parsed is None:
            at, synced = at + 1, False
            continue
        yield at, *parsed
        at, synced = got[1], True


def _id(text: str) -> int | None:
    digits = text.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_warc(spark: SparkSession, manifest: DataFrame, *, split_bytes: int = 8 << 20, content: bool = True) -> DataFrame:
    """One row per record: what its header says, and the digest and size of its block; the block itself unless ``content`` is False."""

    def run(batches):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        for batch in batches:
            for path, size, low, high in zip(*(_words.column(batch, c).to_pylist() for c in ("path", "n_bytes", "low", "high")), strict=True):
                store, at = _files.at(path)
                out, held = [], 0
                with store.open_input_file(at) as file:
                    for offset, head, block in records_of(_Source(file, size), low, high):
                        response = head["warc-type"] == "response"
                        refers = _id(head["warc-refers-to"]) if "warc-refers-to" in head else None
                        out.append((_id(head.get("warc-record-id", "")), head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:"), payload_digest(block) if response else None, len(block), refers, head.get("warc-target-uri"), block if content else None, path, offset))
                        held += len(block)
                        if held >= _CHUNK * 4:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    tasks = ranges(manifest, split_bytes)
    return tasks.repartition(max(1, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, RECORDS)


def summary(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's size is its response's.

    A response's digest is computed from the block that was read.
    """
    rows = records.select("page_id", "record_type", F.coalesce("content_digest", "payload_digest").alias("digest"), "content_bytes", "refers_to")
    rows = _shared.written(rows, "warc-headers")  # the archives are read once
    sizes = rows.where("record_type = 'response'").groupBy("digest").agg(F.max("content_bytes").alias("full"))
    revisits = rows.where("record_type != 'response'").join(sizes, "digest", "left").withColumn("content_bytes", F.col("full")).drop("full")
    out = rows.where("record_type = 'response'").unionByName(revisits)
    return out.select("page_id", F.col("content_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
