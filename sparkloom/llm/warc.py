"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write_archives`` turns rows into WARC/1.1 files, one gzip stream over the whole file
and one file for each input partition. ``normalise`` inflates each file once, rewrites
every record as a gzip member of its own and writes a sidecar index of their offsets.
``read_archives`` reads records by the index, each member on its own.

Files lie below a folder all executors share (any store pyarrow can open). A task writes
under a name of its own attempt and renames at the end, so a lost executor leaves no
part of a file under a final name, and a repeated task replaces equal bytes.

Payload copies: of the rows with equal payloads of at least ``MIN_SHARED`` bytes, the one
with the least id is a response; the others are revisit records without the payload,
that name the response, the digest and the length. Smaller payloads are all responses.

Edge cases: a null html is an empty payload, a null url an empty target; a null page_id
is written and read as null and sorts after all others. Rows with one page_id and equal
payloads are all responses when that id is the least. Empty tables write no file. Extra
columns are not read, but for a timestamp column ``fetched_at``: it dates the record (``DATE``
without one). A very long payload is written and read whole by one task.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, shared_dir, ship, slices

MIN_SHARED = 100
CHUNK = 1 << 20
#: Duplicate payloads (digest and id) are broadcast up to this many rows, else shuffled.
MAX_BROADCAST = 200_000
#: Index entries and bytes of records, inflated, to a row of a read task; a larger record is a row of its own.
RANGE = 256
RANGE_BYTES = 8 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _header(fields: list[tuple[str, str]], body: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {body}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str | None = None) -> bytes:
    """One record; a revisit has HTTP headers only."""
    name = "null" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", date or DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?&=#%+@!$,;~*'()[]")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Original-Payload-Length", str(len(payload)))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    return _header(fields, len(body)) + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record, with its payload, from the bytes of that record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    if len(block) != int(head["Content-Length"]) or data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    ident = lambda x: None if x == "<urn:page:null>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    revisit = head["WARC-Type"] == "revisit"
    return {
        "page_id": ident(head["WARC-Record-ID"]),
        "url": unquote(head["WARC-Target-URI"]),
        "record_type": head["WARC-Type"],
        "payload": payload,
        "payload_bytes": int(head["WARC-Original-Payload-Length"]) if revisit else len(payload),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"),
        "refers_to": ident(head["WARC-Refers-To"]) if revisit else None,
    }


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of one inflated stream, by their own lengths."""
    held = bytearray()
    need = None
    for c in chunks:
        held += c
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = next(int(x.split(b":")[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + size + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def _inflate(f) -> Iterator[bytes]:
    """A whole gzip file, of one member or several, read once in bounded chunks."""
    z = zlib.decompressobj(31)
    while raw := f.read(CHUNK):
        while raw:
            out = z.decompress(raw, 4 * CHUNK)
            if out:
                yield out
            raw = z.unconsumed_tail
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(31)
    if out := z.flush():
        yield out


def with_record_types(pages: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Rows (page_id, url, html, digest, refers_to, date); refers_to is null for responses."""
    dated = dict(pages.dtypes).get("fetched_at") == "timestamp"
    date = F.date_format(F.to_utc_timestamp("fetched_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if dated else F.lit(None).cast("string")
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), date.alias("date"))
    src = src.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    big = src.filter(F.octet_length("html") >= MIN_SHARED)
    first = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = cut(first.select(F.col("digest").alias("d"), "first"))
    small = first.limit(max_broadcast + 1).count() <= max_broadcast
    joined = src.join(F.broadcast(first) if small else first, F.col("digest") == F.col("d"), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"), "date")


def write_archives(pages: DataFrame, to: str) -> DataFrame:
    """Write the rows of ``with_record_types`` below ``to``; rows (path) of the files."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name, out = f"part-{ctx.partitionId():06d}.warc.gz", None
        fs, base = _open(to)
        trial = f"{base}/_try-{ctx.taskAttemptId()}-{name}"
        z = zlib.compressobj(1, wbits=31)
        for big in batches:
            for b in slices(big, "html"):
                rows = b.to_pylist()
                if rows and out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(trial, compression=None)
                for r in rows:
                    kind = "response" if r["refers_to"] is None else "revisit"
                    out.write(z.compress(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], kind, r["refers_to"], r["date"])))
        if out is not None:
            out.write(z.flush())
            out.close()
            fs.move(trial, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{to}/{name}"]})

    return pages.select("page_id", "url", "html", "digest", "refers_to", "date").mapInArrow(run, "path string")


def normalise(files: DataFrame, to: str) -> DataFrame:
    """Rewrite each file (column path) with one gzip member for each record.

    Rows (path, index, start, records, index_from, index_to): ranges of the sidecar index, with the bytes
    that hold each, so that a reader takes no more of the index than its own range.
    The index has one JSON line for each record: its offset, length, type and id.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for b in batches:
            for path in b.column(0).to_pylist():
                source, at = _open(path)
                fs, base = _open(to)
                fs.create_dir(base, recursive=True)
                name = at.rsplit("/", 1)[1]
                tag = f"{base}/_try-{TaskContext.get().taskAttemptId()}-{name}"
                offset = n = at_index = held = 0
                edges, starts = [], []
                with source.open_input_stream(at, compression=None) as f, fs.open_output_stream(tag, compression=None) as out, fs.open_output_stream(f"{tag}.idx", compression=None) as idx:
                    for rec in split_records(_inflate(f)):
                        z = zlib.compressobj(6, wbits=31)
                        member = z.compress(rec) + z.flush()
                        head = rec[: rec.index(b"\r\n\r\n")].decode()
                        said = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
                        out.write(member)
                        entry = json.dumps({"offset": offset, "length": len(member), "type": said["WARC-Type"], "id": said["WARC-Record-ID"]}).encode() + b"\n"
                        idx.write(entry)
                        if not starts or n - starts[-1] >= RANGE or held + len(rec) > RANGE_BYTES:
                            edges.append(at_index)
                            starts.append(n)
                            held = 0
                        held += len(rec)
                        at_index += len(entry)
                        offset += len(member)
                        n += 1
                fs.move(tag, f"{base}/{name}")
                fs.move(f"{tag}.idx", f"{base}/{name}.idx")
                yield pa.RecordBatch.from_pydict(
                    {"path": [f"{to}/{name}"] * len(starts), "index": [f"{to}/{name}.idx"] * len(starts), "start": pa.array(starts, pa.int64()), "records": pa.array(np.diff([*starts, n]), pa.int64()), "index_from": pa.array(edges, pa.int64()), "index_to": pa.array([*edges[1:], at_index][: len(edges)], pa.int64())}
                )

    return files.mapInArrow(run, "path string, index string, start long, records long, index_from long, index_to long")


_READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(ranges: DataFrame) -> DataFrame:
    """Records of the ranges that ``normalise`` returned; each member is inflated alone,
    and a response's payload is checked against its digest."""
    ship(ranges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, at = _open(r["path"])
                _, index = _open(r["index"])
                with fs.open_input_file(index) as f:
                    f.seek(r["index_from"])
                    lines = f.read(r["index_to"] - r["index_from"]).splitlines()
                found = []  # of RANGE_BYTES at most, but for a single larger record
                with fs.open_input_file(at) as f:
                    spans = [json.loads(x) for x in lines]
                    f.seek(spans[0]["offset"])
                    for s in spans:
                        rec = parse(zlib.decompress(f.read(s["length"]), wbits=31))
                        if rec["record_type"] == "response" and hashlib.sha256(rec["payload"]).hexdigest() != rec["payload_digest"]:
                            raise ValueError(f"payload digest differs in {r['path']} at {s['offset']}")
                        found.append(rec)
                names = [x.split()[0] for x in _READ.split(", ")]
                types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in zip(names, types, strict=True)], names)

    return ranges.mapInArrow(run, _READ)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, normalise them, and the records as read back."""
    spark = pages.sparkSession
    base = shared_dir(spark)
    files = cut(write_archives(with_record_types(pages), f"{base}/monolithic"))
    n = max(1, files.count())
    ranges = cut(normalise(files.repartition(n, "path"), f"{base}/normal"))
    fs, old = _open(f"{base}/monolithic")
    if n and fs.get_file_info(old).type.name == "Directory":
        fs.delete_dir(old)  # every record is in its normalised file now
    k = max(1, ranges.count())
    return read_archives(ranges.repartition(min(k, 4 * n), "path", "start"))


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, CASE WHEN n >= {MIN_SHARED} THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to FROM r"""
