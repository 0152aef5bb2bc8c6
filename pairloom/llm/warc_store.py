"""Write pages as WARC archives, sharded the same way on every run, and read them back.

1. *Plan.* Digests and compressed sizes of all records are taken first; what follows until writing moves no payload.
   Records stand in order of (page id, payload digest). Their sizes are summed up over that order, and a new file begins
   whenever a multiple of ``file_bytes`` is passed, wherever Spark's partitions end. The first keys of the files are a
   small table: one row for each file.
2. *Write.* Payloads move once, to the task that writes their file, where they meet their rows of the plan. Headers, ids and digests are made anew from the
   payload; every record is a gzip member of its own with no time stamp, so equal input gives equal bytes.
3. *Commit.* A file is written under a name of its own attempt and renamed when complete; a repeated attempt replaces it by
   the same bytes. Spark's commit of the manifest makes the whole archive visible; readers open only files it names.
4. *Read.* Files are spread over the cluster, read as a stream of members, and every digest is checked again.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page id is the response and
the others are revisits of it.

Defined results: a null page counts as an empty payload; a null page id comes before all others and is never a
response if any id is known; rows that repeat both id and payload of the response are responses too; a null url
leaves its header out; extra columns are not stored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import os
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import running
from pairloom.session import scratch_path, written

FILE_BYTES = 16 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def header_value(value: str) -> str:
    """Control signs and the percent sign as percent codes, so that a value stays on its line."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in value)


def plain_value(value: str) -> str:
    out = value.split("%")
    return out[0] + "".join(chr(int(part[:2], 16)) + part[2:] for part in out[1:])


def member(fields: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in fields.items() if value is not None]]
    lines += [f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def page_record(page_id, url, digest: str, size: int, payload: bytes | None, head_id=None, head_url=None) -> bytes:
    """A response, or without ``payload`` a revisit of the response ``head_id``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = {
        "WARC-Type": "revisit" if payload is None else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else header_value(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": None if page_id is None else str(page_id),
        "X-Payload-Length": str(size),
    }
    if payload is None:
        fields |= {
            "WARC-Profile": PROFILE,
            "WARC-Refers-To": record_id(head_id, digest),
            "WARC-Refers-To-Target-URI": None if head_url is None else header_value(head_url),
            "WARC-Refers-To-Date": DATE,
            "X-Refers-To-Page-Id": str(head_id),
        }
    return member(fields, block)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors share."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def _key(page_id, digest: str) -> tuple:
    return (page_id is not None, page_id or 0, digest)


def _measured(rows: DataFrame) -> DataFrame:
    """_id, _url, _digest, _size, _bytes: what the plan needs to know of each page."""

    def measure(batches):
        for batch in batches:
            out = []
            for page_id, url, page in zip(*[batch.column(c).to_pylist() for c in ("_id", "_url", "_html")]):
                payload = (page or "").encode()
                digest = base32_sha1(payload)
                out.append((digest, len(payload), len(page_record(page_id, url, digest, len(payload), payload))))
            digests, sizes, lengths = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(digests, pa.string())]
                + [pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64())],
                names=["_id", "_url", "_digest", "_size", "_bytes"],
            )

    return rows.mapInArrow(measure, "_id long, _url string, _digest string, _size long, _bytes long")


def _plan(measured: DataFrame, least_bytes: int) -> DataFrame:
    """The rows with _head and _head_url (null for responses) and the size that the record really has."""
    heads = measured.groupBy("_digest", "_size").agg(
        F.count("*").alias("_n"), F.max("_id").alias("_head"), F.max_by("_url", "_id").alias("_head_url")
    )
    heads = heads.filter((F.col("_n") > 1) & (F.col("_size") >= least_bytes) & F.col("_head").isNotNull()).drop("_n")
    found = measured.join(heads, ["_digest", "_size"], "left")
    revisit = F.col("_head").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_head"))
    found = found.withColumns({c: F.when(revisit, F.col(c)) for c in ("_head", "_head_url")})

    def resize(batches):
        for batch in batches:
            names = ("_id", "_url", "_digest", "_size", "_head", "_head_url", "_bytes")
            sizes = [
                length if head is None else len(page_record(page_id, url, digest, size, None, head, head_url))
                for page_id, url, digest, size, head, head_url, length in zip(*[batch.column(c).to_pylist() for c in names])
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], pa.array(sizes, pa.int64())], names=names)

    schema = "_id long, _url string, _digest string, _size long, _head long, _head_url string, _bytes long"
    return found.mapInArrow(resize, schema)


def write_archives(
    pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, least_bytes: int = 0, prefix: str = "pages"
) -> DataFrame:
    """Write all pages below ``folder`` and return the manifest: file, records, bytes, sha256."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("html").alias("_html"))
    measured = written(_measured(rows), "record-sizes")
    order = [F.col("_id").asc_nulls_first(), F.col("_digest")]
    placed = running(_plan(measured, least_bytes).drop("_url", "_size"), order, {"_before": "_bytes"}, "record-places")
    placed = placed.withColumn("_file", F.floor(F.col("_before") / file_bytes))
    first = F.struct(F.col("_id").isNotNull(), F.coalesce("_id", F.lit(0)), "_digest")
    # One row for each file: the keys at which files begin.
    starts = sorted(tuple(row.first) for row in placed.groupBy("_file").agg(F.min(first).alias("first")).collect())
    heads = placed.select("_id", "_digest", "_head", "_head_url").distinct()
    target = f"{folder.rstrip('/')}/archive"
    moved_schema = "_file int, _id long, _digest string, _kind int, _url string, _payload binary, _head long, _head_url string"
    moved_names = [part.split()[0] for part in moved_schema.split(", ")]

    def files_of(batch, digests):
        keys = (_key(i, d) for i, d in zip(batch.column("_id").to_pylist(), digests))
        return pa.array([max(bisect.bisect_right(starts, key) - 1, 0) for key in keys], pa.int32())

    def number_pages(batches):
        for batch in batches:
            payloads = [(page or "").encode() for page in batch.column("_html").to_pylist()]
            digests = [base32_sha1(payload) for payload in payloads]
            n = batch.num_rows
            columns = [files_of(batch, digests), batch.column("_id"), pa.array(digests, pa.string()), pa.array([1] * n, pa.int32())]
            columns += [batch.column("_url"), pa.array(payloads, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=moved_names)

    def number_plan(batches):
        for batch in batches:
            n = batch.num_rows
            columns = [files_of(batch, batch.column("_digest").to_pylist()), batch.column("_id"), batch.column("_digest")]
            columns += [pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())]
            columns += [batch.column("_head"), batch.column("_head_url")]
            yield pa.RecordBatch.from_arrays(columns, names=moved_names)

    moved = rows.mapInArrow(number_pages, moved_schema).unionByName(heads.mapInArrow(number_plan, moved_schema))
    moved = moved.repartition("_file").sortWithinPartitions("_file", *order, "_kind", "_url")

    def write(batches):
        store, base = open_store(target)
        store.create_dir(base, recursive=True)
        held: dict = {}
        head = (None, None)

        def finish():
            held["out"].close()
            store.move(held["temporary"], f"{base}/{held['name']}")
            row = {"file": held["name"], "records": held["records"], "bytes": held["bytes"], "sha256": held["sha"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=MANIFEST_ARROW)

        def put(data):
            held["out"].write(data)
            held["sha"].update(data)
            held["bytes"] += len(data)

        for batch in batches:
            for file, page_id, digest, kind, url, payload, *planned in zip(*[batch.column(c).to_pylist() for c in moved_names]):
                if kind == 0:  # the plan's row stands before the pages that it holds for
                    head = planned
                    continue
                if held.get("file") != file:
                    if held:
                        yield finish()
                    name = f"{prefix}-{file:06d}.warc.gz"
                    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
                    held.update(file=file, name=name, temporary=temporary, records=0, bytes=0, sha=hashlib.sha256())
                    held["out"] = store.open_output_stream(temporary, compression=None)
                    put(file_header(name))
                body = payload if head[0] is None else None
                put(page_record(page_id, url, digest, len(payload), body, *head))
                held["records"] += 1
        if held:
            yield finish()

    manifest = f"{folder.rstrip('/')}/manifest"
    moved.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


MANIFEST = "file string, records long, bytes long, sha256 string"
MANIFEST_ARROW = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def file_header(name: str) -> bytes:
    block = json.dumps({"format": "WARC File Format 1.1", "software": "pairloom"}).encode()
    fields = {
        "WARC-Type": "warcinfo",
        "WARC-Record-ID": record_id(None, name),
        "WARC-Date": DATE,
        "WARC-Filename": name,
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/json",
    }
    return member(fields, block)


def records(stream):
    """Header fields and block of each record of a compressed archive, read piece by piece."""
    unpacker, held, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            break
        held.append(unpacker.decompress(data))
        rest = b""
        if unpacker.eof:
            rest = unpacker.unused_data
            unpacker = zlib.decompressobj(31)
            whole, held = b"".join(held), []
            head, _, body = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            block = body[: int(fields["Content-Length"])]
            if lines[0] != "WARC/1.1" or body[len(block) :] != b"\r\n\r\n":
                raise ValueError("broken record")
            yield fields, block
    if held and any(held):
        raise ValueError("archive ends inside a record")


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """The row of a page record, after its digests have been made again from what was read."""
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2]
    is_revisit = fields["WARC-Type"] == "revisit"
    if not is_revisit and (digest != base32_sha1(payload) or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    url = plain_value(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    kind = fields["WARC-Type"]
    row = (number("X-Page-Id"), url, kind, number("X-Refers-To-Page-Id"), number("X-Payload-Length"), digest)
    return row, None if is_revisit else payload


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row for each page record of the files in the manifest; with ``payload``, its bytes (null for revisits)."""
    target = f"{folder.rstrip('/')}/archive"
    named = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest").select("file", "records", "sha256")
    names = [part.split()[0] for part in RECORD.split(", ")]
    schema = RECORD + (", payload binary" if payload else "")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    arrow = pa.schema([*zip(names, types)] + ([("payload", pa.binary())] if payload else []))

    def read(batches):
        store, base = open_store(target)
        for batch in batches:
            for file, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                rows, found = [], 0
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for fields, block in records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        row, body = page_of(fields, block)
                        rows.append((*row, body) if payload else row)
                        found += 1
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
                if found != expected:
                    raise ValueError(f"{file}: {found} records, the manifest has {expected}")

    # A stated number, as Spark would put these short rows into one task.
    return named.repartition(max(1, named.count()), "file").mapInArrow(read, schema)


def round_trip(pages: DataFrame, **settings) -> DataFrame:
    """Write ``pages`` below the shared folder and read the archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder, **settings)
    return read_archives(pages.sparkSession, folder)
