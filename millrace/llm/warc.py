"""WARC archives, index first.

Writing returns one index row (file, offset, length, URL, digest) per record; reading takes index rows, sorts them by
place, merges neighbouring byte ranges into few reads, and parses the records. Records are gzip members, one each, as is
usual, so a range can be read alone. A task names its file after itself and a fresh id, and only index rows of finished
tasks are committed: what a lost attempt wrote is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, join_small, map_batches, materialise

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Ranges nearer than GAP are read together, up to MOST bytes at a time.
GAP, MOST = 1 << 16, 1 << 23
#: Bytes of archives that a reading task is given, on average.
TASK_BYTES = 32 << 20
INDEX = "file string, offset long, length long, page_id long, url string, digest string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    number = value.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """A record as a gzip member, and its payload digest. A revisit keeps the HTTP header, with the payload's length, only."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush(), digest


def parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {"page_id": page_of(fields["warc-record-id"]), "payload_bytes": n, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page_of(fields["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload}


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive every page; returns the index.

    Of equal payloads the one with the smallest page_id is the response and the others revisit it. A null html is an
    empty payload; a null page_id revisits, or is a response if no equal payload has an id; repeated rows with the
    smallest page_id are all responses (ties need no other rule); a null url is an empty target; a very long page is one
    record, held whole by one task; an empty table gives an empty index; other columns are ignored.
    """
    from pyarrow import fs

    folder = folder or fresh_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    hashed = given.withColumn("sha", F.sha1("payload"))
    equal, _ = materialise(hashed.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first"), "equal")

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        out, at, path = None, 0, f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        try:
            for b in batches:
                rows = {n: [] for n in ("file", "offset", "length", "page_id", "url", "digest")}
                for page_id, url, payload, first in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "payload", "first"))):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None)
                    member, digest = record(page_id, url, payload, first, first is not None and page_id != first)
                    out.write(member)
                    for n, v in zip(rows, (path, at, len(member), page_id, url, digest)):
                        rows[n].append(v)
                    at += len(member)
                yield rows
        finally:
            if out is not None:
                out.close()

    return materialise(map_batches(join_small(hashed, equal, "sha"), run, INDEX), "warc-index")[0]


def ranges(rows: list[tuple[str, int, int]]):
    """Runs of rows (file, offset, length; sorted) that one read covers."""
    run: list = []
    for row in rows:
        if run and (row[0] != run[-1][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP or row[1] + row[2] - run[0][1] > MOST):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index rows name: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits).

    The rows are range-sorted by place over as many tasks as the archives' bytes need, so a small index of much data is read by many.
    """
    from pyarrow import fs

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def run(batches):
        store, path, file = None, None, None
        for b in batches:
            out = {n: [] for n in names}
            for part in ranges(list(zip(*(b.column(n).to_pylist() for n in ("file", "offset", "length"))))):
                if part[0][0] != path:
                    path = part[0][0]
                    store, local = fs.FileSystem.from_uri(path)
                    file = store.open_input_file(local)
                start = part[0][1]
                block = file.read_at(part[-1][1] + part[-1][2] - start, start)
                for _, at, n in part:
                    found = parse(block[at - start : at - start + n])
                    for name in names:
                        out[name].append(found[name])
            yield out

    # by the archives' bytes, not the index's, which are a small part of them; a number given is one that isn't merged later
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // TASK_BYTES), index.sparkSession.sparkContext.defaultParallelism)
    sorted_index = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return map_batches(sorted_index, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)
