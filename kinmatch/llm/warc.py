"""WARC archives with their index: written once, read back by byte ranges.

Every task writes archives of its own and gives out the index of what it wrote: file, offset,
length, URL and digest of each record, which becomes a table. Reading starts from rows of that
index. They are dealt by file and stretch, sorted by offset, and neighbours are fetched in one
ranged read; nothing outside these ranges is read.

A record is a gzip member of its own, as the format asks for. Of equal payloads from
``LEAST_BYTES`` bytes on, the one with the smallest id is a response, the others are revisits:
they carry the digest, the HTTP header and who they refer to, but no payload.

Archives lie in the folder of the run (``spark.checkpoint.dir``), on any store that Arrow's
file systems know by the scheme of the path. A repeated task writes new files; the index names
only those of the task that counted, so a lost executor leaves unnamed files and no wrong rows.

Defined cases: a null payload is empty; a null URL leaves out its field; white space and
control characters of a URL are written as percent codes (the index has the URL as given).
Whether a row is a response depends on its id and payload alone, so rows that repeat the
smallest id are all responses; a null id comes after all others, and if all ids of a payload are
null, all its rows are responses. An empty table gives no archive and an empty index. One record
of any length is held in memory as a whole, others come in runs. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.shared import new_folder, settled

#: Payloads below are never revisits.
LEAST_BYTES = 100
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Records are read together if no more than this lies between them, up to a run of RUN_BYTES.
GAP_BYTES = 64 << 10
RUN_BYTES = 4 << 20
#: Stretches of an archive that different tasks read.
STRETCH_BYTES = 64 << 20
#: Repeated digests up to which their table travels to every executor (some 100 bytes each).
BROADCAST_DIGESTS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, record_type string"
FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
#: Characters of a URL that may not stand in a header field.
UNFIT = re.compile(r"[\x00-\x20\x7f]")


class WarcError(ValueError):
    """An archive doesn't hold what its index says."""


def urn(key: str | None) -> str:
    return "<urn:no-page>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def key_of(name: str | None) -> str | None:
    return unquote(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def record(kind: str, key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record, uncompressed."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if kind == "response" else b"")
    fields = {"WARC-Type": kind, "WARC-Record-ID": urn(key), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = UNFIT.sub(lambda c: f"%{ord(c[0]):02X}", url)
    fields["WARC-Payload-Digest"] = f"sha256:{digest}"
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": urn(refers_to)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of a record, fields of its HTTP header, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {n.decode().lower(): v.decode() for n, v in FIELD.findall(head + b"\r\n")}
    size = int(fields.get("content-length", -1))
    if not head.startswith(b"WARC/1.") or len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"not a whole record: {head[:80]!r}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, {n.decode().lower(): v.decode() for n, v in FIELD.findall(http + b"\r\n")}, payload


def packed(data: bytes) -> bytes:
    work = zlib.compressobj(6, zlib.DEFLATED, 31)
    return work.compress(data) + work.flush()


def typed(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """``(id, url, body, digest, record_type, refers_to)``; ids as text."""
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"),
    ).withColumn("digest", F.sha2("body", 256))
    first = settled(
        rows.where(F.octet_length("body") >= LEAST_BYTES)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "first"),
        "warc-firsts",
    )
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    known = rows.join(first.withColumn("repeats", F.lit(True)), "digest", "left")
    revisit = F.col("repeats").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return known.select(
        F.col("id").cast("string").alias("id"), "url", "body", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str | None = None, id_col="page_id", url_col="url", body_col="html") -> DataFrame:
    """Write one record per row and return the index as a stored table.

    The index has the columns of ``INDEX``; offset and length are bytes of the compressed file.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                done = []
                for row in range(batch.num_rows):
                    key, url, body, digest, kind, refers = (c[row].as_py() for c in batch.columns)
                    data = packed(record(kind, key, url, body.encode(), digest, refers))
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    done.append((f"{folder}/{name}", at, len(data), url, digest, kind))
                    at += len(data)
                if done:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), KINDS)], names=NAMES)
        finally:
            if out is not None:
                out.close()

    return settled(typed(pages, id_col, url_col, body_col).mapInArrow(archive, INDEX), "warc-index")


NAMES = ["file", "offset", "length", "url", "digest", "record_type"]
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


def runs(spots: list[dict]) -> Iterator[list[dict]]:
    """Neighbouring index rows, sorted by file and offset, that are fetched together."""
    run: list[dict] = []
    for spot in spots:
        if run and (
            spot["file"] != run[0]["file"]
            or spot["offset"] - run[-1]["offset"] - run[-1]["length"] > GAP_BYTES
            or spot["offset"] + spot["length"] - run[0]["offset"] > RUN_BYTES
        ):
            yield run
            run = []
        run.append(spot)
    if run:
        yield run


def read(index: DataFrame, payloads: bool = True, id_type: str = "long", id_col="page_id") -> DataFrame:
    """The records of the given index rows, each checked against its digest.

    ``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)``; the
    payload is null for revisits, whose length and digest come from their headers, and left out
    without ``payloads``. ``url`` is as written. Raises WarcError for an index that doesn't fit.
    """
    spots = index.select("file", "offset", "length", "digest")
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    names = ["id", "url", "record_type", "refers", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * payloads

    def told(spot: dict, data: bytes) -> tuple:
        fields, http, payload = parsed(zlib.decompress(data, 31))
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        kind = fields["warc-type"]
        if kind == "response":
            digest = hashlib.sha256(payload).hexdigest()
        if digest != spot["digest"]:
            raise WarcError(f"{spot['file']} at {spot['offset']}: digest {digest}, index {spot['digest']}")
        size = len(payload) if kind == "response" else int(http["content-length"])
        row = (key_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, key_of(fields.get("warc-refers-to")), size, digest)
        return (*row, payload if kind == "response" else None) if payloads else row

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, ""
        try:
            for batch in batches:
                for run in runs(batch.to_pylist()):
                    if run[0]["file"] != opened:
                        if source is not None:
                            source.close()
                        store, path = fs.FileSystem.from_uri(run[0]["file"])
                        source, opened = store.open_input_file(path), run[0]["file"]
                    start = run[0]["offset"]
                    data = source.read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
                    rows = [told(s, data[s["offset"] - start : s["offset"] - start + s["length"]]) for s in run]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        finally:
            if source is not None:
                source.close()

    schema = "id string, url string, record_type string, refers string, payload_bytes long, payload_digest string"
    found = (
        spots.repartition("file", stretch).sortWithinPartitions("file", "offset")
        .mapInArrow(fetch, schema + (", payload binary" if payloads else ""))
    )
    return found.select(
        F.col("id").cast(id_type).alias(id_col), "url", "record_type",
        F.col("refers").cast(id_type).alias("refers_to"), "payload_bytes", "payload_digest",
        *["payload"] * payloads,
    )
