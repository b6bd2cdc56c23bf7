"""WARC archives: writing, and reading by boundary-chain verification.

Writing: of pages with equal payloads the one with the largest page_id becomes a
response record, the others revisits of it. Tasks write archives of bounded size under the
names of their attempt and return these names; only those of attempts that succeeded
come into the manifest, which is all that is read, so a repeated task leaves no second records.

Reading: a task looks for the record magic anywhere in an archive and emits
each candidate with the offset at which its length says the next record starts.
A magic inside a payload gives a candidate too. Pointer jumping from offset 0
then marks what the chain reaches, doubling the jumps each round; all other
candidates are dropped.

Null html is an empty payload, a null page_id counts as the smallest, all rows
with the largest page_id of equal payloads are responses (repeated rows repeat), a payload longer than an
archive has one of its own, an empty table gives no records, and extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm import shared

MAGIC = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NO_ID = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"
#: Most tasks that read archives.
TASKS = 20_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page_id, url: str, payload: bytes, refers_to) -> bytes:
    block = HTTP + payload if kind == "response" else HTTP
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("X-Payload-Bytes", len(payload)),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, and of equal payloads the page_id that carries them (``carrier``).

    Only ids and digests are shuffled. The revisits are written down first, so that Spark knows their size
    and joins them to the pages by broadcast, or, beyond its limit, by a shuffle on page_id and digest."""
    own = pages.select(
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    slim = own.select("page_id", "sha1")
    carriers = slim.groupBy("sha1").agg(F.max("page_id").alias("carrier"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = shared.written(slim.join(carriers, "sha1").where("page_id <> carrier").distinct())
    null = lambda x: F.when(F.col(x) != NO_ID, F.col(x)).alias(x)
    return own.join(revisits, ["page_id", "sha1"], "left").select(null("page_id"), "url", "payload", F.coalesce("carrier", "page_id").alias("carrier"), F.col("carrier").isNotNull().alias("again"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes the archives; returns the manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out, n = None, 0
        for batch in batches:
            for page_id, url, payload, carrier, again in zip(*(x.to_pylist() for x in batch.columns)):
                if out is None:
                    file, n = f"{name}-{len(done):05d}.warc", 0
                    out = fs.open_output_stream(posixpath.join(root, file))
                out.write(_record("revisit" if again else "response", page_id, url, payload, carrier))
                n += 1
                if out.tell() >= archive_bytes:
                    out.close()
                    done.append((file, n))
                    out = None
        if out is not None:
            out.close()
            done.append((file, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return shared.written(planned(pages).mapInArrow(run, "path string, records bigint"), "manifest")


CANDIDATE = "path string, start bigint, next bigint, record_type string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _parse(data: bytes, at: int) -> dict | None:
    """The candidate record at an offset; None if no header can be read there."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    head = dict(x.split(": ", 1) for x in data[at + len(MAGIC) : stop].decode("utf-8", "replace").split("\r\n") if ": " in x)
    if not head.get("Content-Length", "").isdigit():
        return None
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    return {
        "start": at,
        "next": end + 4,
        "record_type": head.get("WARC-Type"),
        "page_id": number(head.get("WARC-Record-ID")),
        "url": head.get("WARC-Target-URI"),
        "refers_to": number(head.get("WARC-Refers-To")),
        "payload_bytes": int(head["X-Payload-Bytes"]) if head.get("X-Payload-Bytes", "").isdigit() else None,
        "payload_digest": head.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
        "block": (begin, end),
    }


def candidates(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every candidate record of some archives (column path) with the offset of its successor; the payload's size and digest come from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(place) as f:
                    data, rows, at = f.read(), [], 0
                while (at := data.find(MAGIC, at)) >= 0:
                    if record := _parse(data, at):
                        begin, end = record.pop("block")
                        payload = None
                        if record["record_type"] == "response":
                            cut = data.find(b"\r\n\r\n", begin, end)
                            payload = data[cut + 4 : end] if cut >= 0 else b""
                            record |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload)}
                        rows.append(record | {"path": path, "payload": payload if payloads else None})
                    at += 1
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    paths = archives.select("path")
    return paths.repartition(max(1, min(paths.count(), TASKS)), "path").mapInArrow(run, CANDIDATE)


def reachable(start: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches: pointer jumping in log2(n) rounds."""
    order = np.argsort(start)
    start, following = start[order], following[order]
    n = len(start)
    jump = np.searchsorted(start, following)
    ok = (jump < n) & (start[np.minimum(jump, n - 1)] == following)
    jump = np.append(np.where(ok, jump, n), n)  # n: the end
    mark = np.zeros(n + 1, bool)
    mark[:1] = start[0] == 0
    for _ in range(max(1, n.bit_length())):
        mark[jump[mark]] = True
        jump = jump[jump]
    out = np.empty(n, bool)
    out[order] = mark[:n]
    return out


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of some archives (column path)."""

    def chain(table: pa.Table) -> pa.Table:
        keep = reachable(table["start"].to_numpy(), table["next"].to_numpy())
        return table.filter(pa.array(keep))

    return candidates(archives, payloads).groupBy("path").applyInArrow(chain, CANDIDATE)


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of ``pages``, written as archives below the shared folder and read back."""
    return read_archives(write_archives(pages, shared.folder(pages.sparkSession) + "/warc"))


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
